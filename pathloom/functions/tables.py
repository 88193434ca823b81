"""The engine's tables from SQL: table functions, and the views that they read.

    register(spark)                                    explanation_graph(TABLE(rows) PARTITION BY (a, b, rule_id) ORDER BY eid)
    publish_paths(spark, paths)                        metapaths('x', 'y')
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pathloom.sources.graphml import to_xml
from pathloom.sources.tables import Graph


class ExplanationGraph:
    """The rows of one explanation, in the order of their edges, as one GraphML text; it holds one explanation at a time."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.nodes: dict[str, dict] = {}
        self.links: list[dict] = []

    def eval(self, row: Row) -> None:
        self.key = (row["a"], row["b"], row["rule_id"])
        for end in ("src", "dst"):
            self.nodes[row[end]] = {"id": row[end], "type": row[f"{end}_type"], "name": row[f"{end}_name"]}
        self.links.append({c: row[c] for c in ("src", "dst", "label", "score", "target_id")})

    def terminate(self) -> Iterator[tuple]:
        if self.key is not None:
            yield (*self.key, len(self.nodes), len(self.links), to_xml([self.nodes[k] for k in sorted(self.nodes)], self.links))


def explanation_rows(graph: Graph, edges: DataFrame) -> DataFrame:
    """rule_id, a, b, eid with the edge's own columns and the type and name of both its ends: what explanation_graph takes.

    edges: rule_id, a, b, eid; with the edge's own columns beside them (matching.explanation_steps), the graph's edges are not read.
    """
    own = ["src", "dst", "label", "score", "target_id"]
    full = edges if set(own) <= set(edges.columns) else edges.select("rule_id", "a", "b", "eid").join(graph.edges.select("eid", *own), "eid")
    for end in ("src", "dst"):
        named = graph.nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name"))
        full = full.join(named, end)
    return full


def register(spark: SparkSession) -> None:
    """explanation_graph becomes a table function of the session."""
    made = F.udtf(ExplanationGraph, returnType="a string, b string, rule_id int, n_nodes int, n_edges int, xml string")
    spark.udtf.register("explanation_graph", made)


def explanation_texts(rows: DataFrame) -> DataFrame:
    """a, b, rule_id, n_nodes, n_edges, xml: the table function on explanation_rows, one partition of it an explanation."""
    spark = rows.sparkSession
    register(spark)
    return spark.sql("SELECT * FROM explanation_graph(TABLE(SELECT * FROM {rows}) PARTITION BY (a, b, rule_id) ORDER BY eid)", rows=rows)


def publish_paths(spark: SparkSession, paths: DataFrame, view: str = "pathloom_paths") -> None:
    """paths (a, b, mp, mids, score) as a view, and metapaths(first, second): the metapaths of a pair with their paths' number and best score.

    The table function is plain SQL, so the pair reaches the scan of the paths as a filter.
    """
    paths.createOrReplaceTempView(view)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION metapaths(first STRING, second STRING)
        RETURNS TABLE(edges ARRAY<STRING>, nodes ARRAY<STRING>, n_paths BIGINT, score DOUBLE)
        RETURN SELECT mp.edges, mp.nodes, count(*), max(score) FROM {view} WHERE a = metapaths.first AND b = metapaths.second GROUP BY mp"""
    )
