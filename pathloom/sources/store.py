"""Tables kept between stages, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import json
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: By application, the local folder that stands in for an unset spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the tables written inside go as soon as these are written; the user's setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Passing(threading.local):
    """Per thread and stage that is being made, the tables that were written on the way to it, each with its store."""

    def __init__(self) -> None:
        self.open: list[list[tuple[StageStore, str]]] = []


_PASSING = _Passing()


def written_once(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a written table of its own; made on the way to a stage, it is deleted when the stage is written."""
    store = StageStore(df.sparkSession)
    out = store.get_or_make(name, lambda: df, run=uuid.uuid4().hex)
    if _PASSING.open:
        _PASSING.open[-1].append((store, store.made[-1]))
    return out


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's columns and rows, whatever their order and their files: equal tables have the same.

    Two 64-bit hashes a row, summed in whole numbers: one pass, one row to the driver.
    """
    plain = [F.sort_array(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields]
    missing = F.concat(*(F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns))
    rows = df.select(F.xxhash64(*plain, missing).cast("decimal(20,0)").alias("x"), F.xxhash64(F.lit("second"), missing, *plain).cast("decimal(20,0)").alias("y"))
    r = rows.agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{r['n']}|{r['x']}|{r['y']}".encode()).hexdigest()[:32]


class StageStore:
    """Results of stages, written once under a name made of the stage and all that it was made from."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}")
        #: Paths that this store has written, in order.
        self.made: list[str] = []

    def path(self, stage: str, **made_from: object) -> str:
        key = hashlib.sha256(json.dumps(made_from, sort_keys=True, default=str).encode()).hexdigest()[:24]
        return f"{self.root}/{stage}-{key}"

    def get_or_make(self, stage: str, make: Callable[[], DataFrame], refresh: bool = False, partition_by: Sequence[str] = (), **made_from: object) -> DataFrame:
        path = self.path(stage, **made_from)
        files, done = self._files(f"{path}/_SUCCESS")
        if refresh or not files.exists(done):
            _PASSING.open.append([])
            try:
                df = make()
                with swept(self.spark):
                    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
            finally:
                passing = _PASSING.open.pop()
            self.made.append(path)
            for store, table in passing:
                store.drop([table])
            return self.spark.read.schema(df.schema).parquet(path)  # an empty table has no file to learn it from
        return self.spark.read.parquet(path)

    def drop(self, paths: Sequence[str]) -> None:
        """Deletes some of the tables that this store has written; nothing may read them any more."""
        for path in paths:
            self.made.remove(path)
            files, folder = self._files(path)
            files.delete(folder, True)

    def drop_since(self, mark: int) -> None:
        """Deletes the tables that were written after len(made) was mark; nothing may read them any more."""
        while len(self.made) > mark:
            files, path = self._files(self.made.pop())
            files.delete(path, True)

    def version(self, folder: str) -> str:
        """A hash of the names, sizes and times of the files in a folder: what is made from it is made anew when it changes."""
        files, path = self._files(folder)
        seen, found = files.listFiles(path, True), []
        while seen.hasNext():
            f = seen.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()[:24]

    def _files(self, path: str):
        """(the file system of a path, the path) in the JVM."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop
