"""Sets of rows as bitmaps: rows are numbered into words of 64 bits, and a set has one row per word that it touches.

Sets are met with & and |, counted with bit_count, and weighed by a table per word: of each of its 16 nibbles, the sums of the
weights of its 16 subsets.  So a set of n rows takes n / 64 rows, and none of these steps goes back to single rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
#: Words of one bucket, on average: rows are numbered inside buckets of their hash, so no window sees them all.
BUCKET_WORDS = 1024


def numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows, a row a key, with word (long) and bit (0 to 63); rows is read twice."""
    buckets = max(1, -(-rows.count() // (BITS * BUCKET_WORDS)))
    hashed = rows.withColumn("_hash", F.xxhash64(*keys)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *keys)) - 1
    placed = hashed.withColumn("_at", at)
    return placed.select(*rows.columns, (F.col("_bucket") * F.lit(1 << 32) + F.floor(F.col("_at") / BITS)).alias("word"), (F.col("_at") % BITS).cast("int").alias("bit"))


def set_of(bit: str = "bit", where: Column | None = None) -> Column:
    """Aggregate: the bits of a group's rows (that meet a condition) as one word."""
    one = F.expr(f"shiftleft(1L, {bit})")
    return F.coalesce(F.bit_or(one if where is None else F.when(where, one)), F.lit(0).cast("long"))


def has(bits: Column | str, bit: str = "bit") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.expr(f"shiftleft(1L, {bit})")) != 0


def weight_tables(rows: DataFrame, **weights: Column) -> DataFrame:
    """word and, for each weight, the sums by nibble; rows: word, bit and what the weights are made of."""
    by = rows.select("word", "bit", *(w.alias(name) for name, w in weights.items())).groupBy("word")
    flat = by.agg(*(F.map_from_entries(F.collect_list(F.struct("bit", F.coalesce(name, F.lit(0.0))))).alias(name) for name in weights))  # 64 entries at most

    def table(name: str) -> Column:
        of = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.coalesce(F.try_element_at(name, b), F.lit(0.0)))
        part = lambda flat, i, j: F.when(i.bitwiseAND(F.lit(1 << j)) != 0, F.get(flat, F.floor(i / 16).cast("int") * 4 + j)).otherwise(0.0)
        nibbles = lambda flat: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: reduce(lambda x, y: x + y, (part(flat, i, j) for j in range(4))))
        return F.get(F.transform(F.array(of), nibbles), 0).alias(name)

    return flat.select("word", *(table(name) for name in weights))


def weight_of(bits: Column, table: Column | str) -> Column:
    """The sum of the weights of a word's set bits."""
    parts = (F.get(table, F.shiftrightunsigned(bits, 4 * k).bitwiseAND(F.lit(15)).cast("int") + 16 * k) for k in range(BITS // 4))
    return reduce(lambda x, y: x + y, parts)
