"""Session settings that the engine's joins gain from; what a user has set stays."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Where all partitions of a join's side turn out, at run time, to be no larger than this, a hash map replaces two sorts.
HASH_JOIN_BYTES = "128m"


def tuned(spark: SparkSession) -> SparkSession:
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(key, "0") in ("0", "0b"):
        spark.conf.set(key, HASH_JOIN_BYTES)
    return spark
