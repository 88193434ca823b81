"""Explanations name the edges of groups without listing all of them."""

import pytest
from pyspark.sql import functions as F

from pathloom import queries
from pathloom.operators import matching
from pathloom.sources.tables import Cliques, Graph

SF = "/root/testdata/sf0.001"


def test_explanations_through_groups(spark):
    members = [(g, f"P{g}{i}", 10 * g + i, float(1 + (i * 7 + g) % 4)) for g in range(3) for i in range(4)]
    cliques = Cliques(spark.createDataFrame(members, "grp int, id string, place int, value double"), ("Part", "resembles", "Part"))
    nodes = spark.createDataFrame([(m[1], "Part", m[1]) for m in members] + [("C1", "Customer", "x"), ("C2", "Customer", "y")], "id string, type string, name string")
    bought = [(f"e{c}{m[1]}", f"C{c}", m[1], "purchases", 0.5, m[1], None) for c in (1, 2) for m in members]
    edges = spark.createDataFrame([*bought, ("twice", "P01", "C1", "purchases", 0.1, "C1", None)], "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>")
    mp = (["purchases", "resembles", "purchases"], ["Customer", "Part", "Part", "Customer"], [1, 1, -1])
    ids = spark.createDataFrame([(1, mp)], "mp_id int, mp struct<edges:array<string>,nodes:array<string>,dirs:array<int>>")
    walks = [("C1", "C2", ["P00", "P03"]), ("C1", "C2", ["P01", "P03"]), ("C2", "C1", ["P21", "P20"]), ("C2", "C1", ["P01", "P12"])]  # the last is no edge
    found = spark.createDataFrame([(r, a, b, 1, mids) for r in (1, 2) for a, b, mids in walks], "rule_id int, a string, b string, mp_id int, mids array<string>")
    rows = lambda df: sorted(map(repr, df.collect()))
    whole = Graph(nodes, edges.unionByName(cliques.edges()))
    want = rows(matching.explanation_edges(whole, found, ids))
    assert rows(matching.explanation_edges(Graph(nodes, edges), found, ids, cliques)) == want
    assert sum("resembles" in r for r in want) == 6 and sum("'twice'" in r for r in want) == 2
    steps = matching.explanation_steps(Graph(nodes, edges), found, ids, cliques)
    told = steps.select("rule_id", "a", "b", "eid").distinct().join(whole.edges, "eid").select("rule_id", "a", "b", *matching.EDGE)
    assert rows(steps) == rows(told)


@pytest.mark.parametrize("name", ["explanation_subgraph", "explanation_graphml"])
def test_groups_are_not_listed_for_explanations(spark, monkeypatch, name):
    edges = Cliques.edges
    monkeypatch.setattr(Cliques, "edges", lambda self: edges(self).withColumn("src", F.raise_error(F.lit("pairs were listed")).cast("string")))
    store = queries.stage

    def fresh(spark, d, name, make, **made_from):
        return make().localCheckpoint() if name == "edges" else store(spark, d, name, make, **made_from)

    monkeypatch.setattr(queries, "stage", fresh)
    assert queries.QUERIES[name](spark, SF).count() > 0
