"""Best-fit packing of sequences into bins of several permitted lengths.

Best-fit decreasing looks only at lengths, so the plan is made over the histogram of lengths, which has at most as many
rows as the longest bin has tokens, however many documents there are.  Bins of like contents form a run of bin numbers,
and one step of the plan fills a whole run.  Where no open bin has room, a run of new bins is opened at the permitted
length that costs least per token that can still be put into it; at the end every bin shrinks to the shortest
permitted length that holds its contents.  Rows then find their bin from their rank among the rows of their length, a
count that Spark takes in two levels, so no length gathers in one task.

Defined results: a null or empty text has length 1 (its end token); a text longer than the longest bin is cut into
pieces of that length and a rest, all of which are packed; equal lengths are ranked by where their rows were read, so
repeated rows get places of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm._common import WORD, shuffle_partitions, written

#: Permitted sequence lengths, in tokens.
CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Rows in one bucket of the ranking, on average, at most.
BUCKET_ROWS = 200_000


def bin_cost(capacity: int) -> float:
    """What a bin costs: linear layers, attention (quadratic), and a fixed overhead per sequence."""
    return 16 + capacity * (1 + capacity / 8192)


class PackingPlan:
    """steps, by length: (first rank, first bin, bins, items a bin, tokens already in each bin); runs: (first bin, bins, capacity, used)."""

    def __init__(self, histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES):
        self.capacities = sorted(capacities)
        self.steps: dict[int, list[tuple[int, int, int, int, int]]] = {}
        self.bins = 0
        self._rooms: list[int] = []  # distinct free lengths of open bins, rising
        self._open: dict[int, list[tuple[int, int, int]]] = {}  # by free length: (first bin, bins, opened capacity)
        mass = sum(k * n for k, n in histogram.items())
        for length in sorted(histogram, reverse=True):
            mass -= length * histogram[length]
            self._place(length, histogram[length], mass)
        self.runs = sorted((first, n, self._shrunk(cap - room), cap - room) for room, groups in self._open.items() for first, n, cap in groups)

    def _shrunk(self, used: int) -> int:
        return self.capacities[bisect_left(self.capacities, used)]

    def _add(self, room: int, group: tuple[int, int, int]) -> None:
        if room not in self._open:
            self._open[room] = []
            insort(self._rooms, room)
        self._open[room].append(group)

    def _take(self, room: int) -> tuple[int, int, int]:
        group = self._open[room].pop()
        if not self._open[room]:
            del self._open[room]
            del self._rooms[bisect_left(self._rooms, room)]
        return group

    def _opened(self, length: int, count: int, mass: int) -> int:
        """The permitted length of least cost per token, if bins take this length's items and then shorter ones as far as they go."""

        def per_token(capacity: int) -> float:
            each = min(capacity // length, count)
            bins = -(-count // (capacity // length))
            return bin_cost(capacity) / (each * length + min(capacity - each * length, mass / bins))

        return min((c for c in self.capacities if c >= length), key=per_token)

    def _place(self, length: int, count: int, mass: int) -> None:
        steps, rank = self.steps.setdefault(length, []), 0
        while rank < count:
            left, at = count - rank, bisect_left(self._rooms, length)
            if at < len(self._rooms):
                room = self._rooms[at]
                first, n, cap = self._take(room)
            else:
                cap = room = self._opened(length, left, mass)
                first, n = self.bins, -(-left // (cap // length))
                self.bins += n
            each = room // length
            full = min(n, left // each)
            if full:
                steps.append((rank, first, full, each, cap - room))
                self._add(room - each * length, (first, full, cap))
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                steps.append((rank, first + full, 1, left, cap - room))
                self._add(room - left * length, (first + full, 1, cap))
                rank, full = rank + left, full + 1
            if full < n:
                self._add(room, (first + full, n - full, cap))

    def assign(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, its final capacity, and the offset inside it, of each row."""
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            length = int(lengths[rows[0]])
            table = np.array(self.steps[length], np.int64)
            hit = table[np.searchsorted(table[:, 0], ranks[rows], side="right") - 1]
            within = ranks[rows] - hit[:, 0]
            bins[rows] = hit[:, 1] + within // hit[:, 3]
            offsets[rows] = hit[:, 4] + within % hit[:, 3] * length
        runs = np.array(self.runs, np.int64).reshape(-1, 4)
        return bins, runs[np.searchsorted(runs[:, 0], bins, side="right") - 1, 2] if len(runs) else bins, offsets


def n_tokens(text_col: str) -> F.Column:
    """Words of the text, and one end token."""
    return (F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)) + 1).cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Per piece: doc_id, piece, start_token, n_tokens, bin_id, bin_capacity, bin_offset."""
    spark, most = docs.sparkSession, max(capacities)
    sized = docs.select(F.col(id_col).alias("doc_id"), n_tokens(text_col).alias("tokens"))
    pieces = written(
        sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / most).cast("int"))).alias("piece"))
        .select("doc_id", "piece", (F.col("piece").cast("long") * most).alias("start_token"), F.least(F.lit(most).cast("long"), F.col("tokens") - F.col("piece").cast("long") * most).alias("n_tokens"))
        .withColumn("row_key", F.monotonically_increasing_id()),
        "pieces",
    )
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most as many rows as the longest bin has tokens
    plan = PackingPlan(histogram, capacities)
    buckets = max(shuffle_partitions(spark), -(-sum(histogram.values()) // BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("bucket", "n_tokens").agg(F.count("*").alias("n")).select("bucket", "n_tokens", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = (
        dealt.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "n_tokens").orderBy("row_key")) - 1)
        .join(offsets, ["bucket", "n_tokens"])
        .select("doc_id", "piece", "start_token", "n_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["bin_id"], f["bin_capacity"], f["bin_offset"] = plan.assign(f["n_tokens"].to_numpy(), f["rank"].to_numpy())
            yield f.drop(columns="rank")

    schema = f"doc_id {dict(pieces.dtypes)['doc_id']}, piece int, start_token long, n_tokens long, bin_id long, bin_capacity long, bin_offset long"
    return ranked.mapInPandas(place, schema)
