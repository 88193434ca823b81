"""Sinks for explanations and for the figures of many runs."""

from __future__ import annotations

import json
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.tables import explanation_rows
from pathloom.plans.engine import Parameters
from pathloom.sources.graphml import to_xml
from pathloom.sources.tables import Graph


def explanation_graphs(graph: Graph, ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """name, xml: one small GraphML per pair and matching rule, named pair-rank-probability-paths.graphml.

    ranked: a, b, rule_id, rank, probability, n_paths; edges: rule_id, a, b, eid.  A group holds one explanation.
    """
    title = F.concat(F.concat_ws("-", "a", "b", F.col("rank").cast("string"), F.format_string("%.3f", "probability"), F.col("n_paths").cast("string")), F.lit(".graphml"))
    rows = explanation_rows(graph, edges).join(ranked.select("a", "b", "rule_id", title.alias("title")), ["a", "b", "rule_id"])

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = {r[f"{end}"]: {"id": r[end], "type": r[f"{end}_type"], "name": r[f"{end}_name"]} for r in pdf.to_dict("records") for end in ("src", "dst")}
        links = pdf.sort_values("eid")[["src", "dst", "label", "score", "target_id"]].to_dict("records")
        return pd.DataFrame({"name": [pdf["title"].iloc[0]], "xml": [to_xml([nodes[k] for k in sorted(nodes)], links)]})

    return rows.groupBy("a", "b", "rule_id").applyInPandas(make, "name string, xml string")


#: Explanations in one file of a table of them.
GRAPHS_A_FILE = 10_000


def write_explanation_graphs(graphs: DataFrame, path: str) -> None:
    """A Parquet table of name and xml, in files of a bounded number of rows: there may be millions of explanations."""
    graphs.write.mode("overwrite").option("maxRecordsPerFile", GRAPHS_A_FILE).parquet(path)


def write_graph_files(graphs: DataFrame, path: str) -> None:
    """A folder per explanation, with its GraphML as the only text file: for the few of single pairs."""
    graphs.repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def append_run(spark: SparkSession, path: str, run: str, parameters: Parameters, figures: dict[str, float], fold: int | None = None) -> None:
    """One row of a run's figures (performance, counts, seconds), with its parameters, added to a table."""
    row = [(run, fold, json.dumps(asdict(parameters)), {k: float(v) for k, v in figures.items()})]
    spark.createDataFrame(row, "run string, fold int, parameters string, figures map<string,double>").coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """run, fold, parameters, figure, value: in long form."""
    return spark.read.parquet(path).select("run", "fold", "parameters", F.explode("figures").alias("figure", "value"))


def held_out_table(graph: Graph, held: DataFrame, id_format: str = "name") -> DataFrame:
    """first, second, weight of held-out pairs, by name or by id."""
    if id_format == "id":
        return held.select(F.col("a").alias("first"), F.col("b").alias("second"), "weight")
    n = graph.nodes.select("id", "name")
    named = held.join(n.select(F.col("id").alias("a"), F.col("name").alias("first")), "a", "left").join(n.select(F.col("id").alias("b"), F.col("name").alias("second")), "b", "left")
    return named.select("first", "second", "weight")
