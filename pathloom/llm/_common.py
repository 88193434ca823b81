"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the contracts call white space: space, tab, line feed, VT, FF, CR.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: By application, the local folder that stands in for an unset spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests).

    A local folder would not do on a cluster, so there an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


class _Steps(threading.local):
    """Per thread and open step (see settled), the paths of the tables written in it."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_STEPS = _Steps()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _STEPS.open:
        _STEPS.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a written table; nothing may read it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, as a written table; the tables written on the way to it are deleted."""
    _STEPS.open.append([])
    try:
        df = make()
        path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    finally:
        passing = _STEPS.open.pop()
    for p in passing:
        dropped(spark, p)
    if _STEPS.open:
        _STEPS.open[-1].append(path)
    return out


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not among columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def short(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, without a copy: batches of 10,000, the default, hold too many long texts to work on at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """At the end of a task: what its worker does not need any more goes back to the system, since the worker lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of a side that may be broadcast, by its row count and the width of its columns; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20


def row_bytes(schema: T.StructType) -> int | None:
    """The width of a row whose columns all have a known one; None where some grow with their content."""
    total = 8
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            inner = row_bytes(f.dataType)
            if inner is None:
                return None
            total += 8 + inner
        elif isinstance(f.dataType, T.BinaryType) and f.name == "digest":  # SHA-256
            total += 40
        elif isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
            return None
        else:
            total += 8
    return total


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it was counted to fit BROADCAST_BYTES; df should be a written table.

    Where a column's width is not known, its bytes are summed first.
    """
    width = row_bytes(df.schema)
    if width is not None:
        most = BROADCAST_BYTES // width
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if len(wide) < sum(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for f in df.schema.fields):
        return df
    size = df.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, wide) + F.lit(16 + 16 * len(df.columns))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def keyed(docs: DataFrame, taken: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs, each row with a number of its own that is the same whenever it is read, and the number's name.

    Rows of files are known by file and place.  What does not come straight from files is written first.
    """
    spark = docs.sparkSession
    key = unused("_row", [*docs.columns, *(taken or [])])
    try:
        if "_metadata" in (c.lower() for c in docs.columns):
            raise ValueError("a column hides the files' own")
        rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index")).toDF(*docs.columns, f"{key}_file", f"{key}_index")
        files = sorted(docs.inputFiles())
    except (AnalysisException, ValueError):
        return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key
    paths = written(spark.createDataFrame(list(enumerate(files)), f"{key}_n long, {key}_file string"), "files")  # a row a file
    name = lambda c: F.regexp_replace(F.col(c), "^[^:/]+:/*", "/")  # noqa: E731  schemes are spelled in several ways
    numbers = paths.select(F.col(f"{key}_n"), name(f"{key}_file").alias(f"{key}_path"))
    found = rows.withColumn(f"{key}_path", name(f"{key}_file")).join(F.broadcast(numbers), f"{key}_path", "left")
    number = F.col(f"{key}_n") * F.lit(1 << 36) + F.col(f"{key}_index")
    checked = F.when(number.isNull(), F.raise_error(F.lit("a row's file is not among those of its table")).cast("long")).otherwise(number)
    return found.select(*docs.columns, checked.alias(key)), key


def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs, each row with a key of its own in the order of id_col (null ids last), and the key's name.

    Rows that share an id, or have none, differ in their keys.  Only ids are sorted; texts stay where they are.
    """
    spark = docs.sparkSession
    key = unused("_key", docs.columns)
    rows, at = keyed(docs, [key])
    by = F.col(id_col).cast("long").alias("_by")
    order = [F.col("_by").asc_nulls_last(), F.col(at).asc()]
    ordered = rows.select(by, at).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    keys = written(ordered.select(at, F.monotonically_increasing_id().alias(key)), "row-keys")
    return rows.join(small(keys), at).drop(at), key
