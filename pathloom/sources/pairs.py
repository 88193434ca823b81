"""Files of pairs, predictions and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.expressions import first_of_pair
from pathloom.sources.tables import Graph


def read_delimited(spark: SparkSession, path: str, header: bool = True, sep: str = "\t", comment: str | None = None, schema: str | None = None, leading_only: bool = False) -> DataFrame:
    """A delimited file; with comment, lines that start with it are left out: all, or (leading_only) those before the first other line."""
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if comment and not leading_only:
        reader = reader.option("comment", comment)
    reader = reader.schema(schema) if schema else reader
    if not comment or not leading_only:
        return reader.csv(path)
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    first = lines.filter(~F.col("value").startswith(comment)).groupBy("file").agg(F.min("at").alias("first"))  # a row a file
    rest = lines.join(F.broadcast(first), "file").filter(F.col("at") >= F.col("first"))
    top = rest.filter(F.col("at") == F.col("first")).select("value").first()
    cells = top[0].split(sep) if top else []
    names = [c.strip('"') for c in cells] if header else [f"_c{i}" for i in range(len(cells))]
    body = rest.filter(F.col("at") > F.col("first")) if header else rest
    parsed = F.from_csv("value", schema or ", ".join(f"`{c}` string" for c in names) or "_c0 string", {"sep": sep})
    return body.select(parsed.alias("r")).select("r.*")


def write_delimited(df: DataFrame, path: str, header: bool = True, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def read_pairs(spark: SparkSession, graph: Graph, path: str, id_format: str = "name", sep: str = "\t", columns: tuple[str, str] | None = None, weight_column: str | None = "weight") -> tuple[DataFrame, DataFrame]:
    """(pairs: a, b, weight; unresolved: first, second) of a file.

    columns names the two id columns of a file with a header; without, the first two columns count.  The weight is in
    weight_column or the third column, else 1.  Of repeated pairs, the last line counts.
    """
    if id_format not in ("id", "name"):
        raise ValueError(f"unknown id format {id_format!r}")
    raw = read_delimited(spark, path, header=columns is not None, sep=sep)
    names = raw.columns
    first, second = columns or (names[0], names[1])
    weight = weight_column if columns and weight_column in names else names[2] if not columns and len(names) > 2 else None
    rows = raw.select(F.trim(first).alias("first"), F.trim(second).alias("second"), (F.col(weight).try_cast("double") if weight else F.lit(1.0)).alias("weight")).withColumn("line", F.monotonically_increasing_id())
    return resolved_pairs(graph, rows, id_format)


def resolved_pairs(graph: Graph, rows: DataFrame, id_format: str = "name") -> tuple[DataFrame, DataFrame]:
    """Rows (first, second, weight, line) as oriented pairs of node ids, and those with an end that the graph lacks."""
    n = graph.nodes.select(F.col(id_format).alias("key"), "id", "orient_val")
    x, y = (n.select(F.col("key").alias(k), F.col("id").alias(f"{k}_id"), F.col("orient_val").alias(f"{k}_val")) for k in ("first", "second"))
    both = rows.join(x, "first", "left").join(y, "second", "left")
    known = F.col("first_id").isNotNull() & F.col("second_id").isNotNull()
    ahead = first_of_pair(F.col("first_id"), F.col("first_val"), F.col("second_id"), F.col("second_val"))
    a, b = F.when(ahead, F.col("first_id")).otherwise(F.col("second_id")), F.when(ahead, F.col("second_id")).otherwise(F.col("first_id"))
    pairs = both.filter(known).groupBy(a.alias("a"), b.alias("b")).agg(F.max_by(F.coalesce("weight", F.lit(1.0)), "line").alias("weight"))
    return pairs, both.filter(~known).select("first", "second").distinct()


def one_pair(spark: SparkSession, graph: Graph, value: str, id_format: str = "name", sep: str = ",") -> tuple[DataFrame, DataFrame]:
    ends = [x.strip() for x in value.split(sep)]
    if len(ends) != 2:
        raise ValueError(f"a pair is two names with {sep!r} between them")
    return resolved_pairs(graph, spark.createDataFrame([(ends[0], ends[1], 1.0, 0)], "first string, second string, weight double, line long"), id_format)


def prediction_table(graph: Graph, predictions: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """Names and ids of both ends, and the probability, highest first; unresolved pairs at the end, without one."""
    n = graph.nodes.select("id", "name")
    named = predictions.join(n.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a", "left").join(n.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b", "left")
    out = named.select("name_a", "name_b", F.col("a").alias("id_a"), F.col("b").alias("id_b"), "probability")
    if unresolved is not None:
        none = F.lit(None)
        out = out.unionByName(unresolved.select(F.col("first").alias("name_a"), F.col("second").alias("name_b"), none.cast("string").alias("id_a"), none.cast("string").alias("id_b"), none.cast("double").alias("probability")))
    return out.orderBy(F.desc_nulls_last("probability"), "name_a", "name_b")


def write_predictions(table: DataFrame, path: str) -> None:
    """Tab-separated, in order; a missing probability is NaN in the file."""
    write_delimited(table.withColumn("probability", F.coalesce(F.col("probability").cast("string"), F.lit("NaN"))), path)


def read_scored_folds(spark: SparkSession, path: str) -> DataFrame:
    """fold, score, label, weight of a table with a row per fold and JSON lists in its cells."""
    raw = read_delimited(spark, path).withColumn("fold", F.monotonically_increasing_id())
    lists = F.arrays_zip(*(F.from_json(c, "array<double>").alias(n) for c, n in (("predictions", "score"), ("y", "label"), ("sample_weights", "weight"))))
    return raw.select("fold", F.explode(lists).alias("x")).select("fold", F.col("x.score").alias("score"), F.col("x.label").cast("int").alias("label"), F.col("x.weight").alias("weight"))


def read_method_predictions(spark: SparkSession, graph: Graph, path: str, value: str, sep: str = ",", id_format: str = "name") -> tuple[DataFrame, DataFrame]:
    """(a, b, probability; first, second of pairs that the graph lacks) of another method's table, whose index holds pair literals.

    Pairs come in any order and are oriented as the graph's; of repeated pairs the last line counts.
    """
    rows = read_tuple_index(spark, path, value, sep).select("first", "second", F.col("score").alias("weight")).withColumn("line", F.monotonically_increasing_id())
    pairs, unresolved = resolved_pairs(graph, rows, id_format)
    return pairs.withColumnRenamed("weight", "probability"), unresolved


def read_tuple_index(spark: SparkSession, path: str, value: str, sep: str = "\t") -> DataFrame:
    """first, second, score of a table whose first column is a pair literal such as ('A', 'B')."""
    raw = read_delimited(spark, path, sep=sep)
    part = lambda i: F.regexp_extract(raw.columns[0], r"""\(\s*['"]([^'"]*)['"]\s*,\s*['"]([^'"]*)['"]""", i)
    return raw.select(part(1).alias("first"), part(2).alias("second"), F.col(value).cast("double").alias("score"))
