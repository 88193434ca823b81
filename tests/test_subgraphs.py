"""Parts of a graph: kinds of edges that a part has none of are not made, and groups are listed for the nodes that stay."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom import queries
from pathloom.operators import graph
from pathloom.sources import tables
from pathloom.sources.tables import Cliques, Graph

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["typed_subgraph", "subgraph_dropped"])
def test_groups_are_not_listed_for_parts_without_them(spark, monkeypatch, name):
    edges = Cliques.edges
    monkeypatch.setattr(queries, "stage", lambda spark, d, name, make, **made_from: make().localCheckpoint())
    monkeypatch.setattr(Cliques, "edges", lambda self: edges(self).withColumn("src", F.raise_error(F.lit("pairs were listed")).cast("string")))
    assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("types", "names", "keep"), [(["Customer", "Part"], ["purchases", "refers"], True), (["Part"], ["locatedIn"], False), (["Part", "Nation"], ["resembles", "sameRegion"], True), ([], [], False)])
def test_lasting_kinds_leave_the_same_part(spark, types, names, keep):
    nodes = tables.nodes(spark, SF)
    rows = lambda kinds: sorted(map(repr, graph.typed_subgraph(Graph(nodes, tables.edges(spark, SF, kinds)), types, names, keep).edges.select("eid", "score").collect()))
    assert rows(graph.lasting_kinds(tables.KINDS, types, names, keep)) == rows(tables.KINDS)


def test_induced_lists_groups_of_the_nodes_that_stay(spark, monkeypatch):
    rng = random.Random(2)
    members = [(i % 4, f"P{i}", i, float(rng.randint(1, 9))) for i in range(40)]
    nodes = spark.createDataFrame([(m[1], "Part", m[3]) for m in members] + [("C1", "Customer", 2.0)], "id string, type string, orient_val double")
    listed = spark.createDataFrame([(f"purchases|C1|{m[1]}", "C1", m[1], "purchases", 0.5, m[1], None) for m in members[::3]], "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>")
    cliques = Cliques(spark.createDataFrame(members, "grp int, id string, place int, value double"), ("Part", "resembles", "Part"))
    whole = listed.unionByName(cliques.edges())
    some = nodes.filter("orient_val < 5")
    rows = lambda df: sorted(map(repr, df.select(*listed.columns).collect()))
    want = rows(graph.induced(Graph(nodes, whole), some, whole).edges)
    assert any("resembles" in r for r in want)
    edges = Cliques.edges

    def few(self):
        assert self.members.join(some, "id", "left_anti").isEmpty()
        return edges(self)

    monkeypatch.setattr(Cliques, "edges", few)
    assert rows(graph.induced(Graph(nodes, listed), some, listed, cliques).edges) == want


def test_pairs_of_a_group_are_not_left_to_a_scan(spark, tmp_path):
    """A small file has many pairs: it is neither broadcast nor are its pairs made where it is read."""
    path = str(tmp_path / "members")
    spark.createDataFrame([(i % 3, f"P{i}", i, 1.0) for i in range(30)], "grp int, id string, place int, value double").coalesce(1).write.parquet(path)
    found = Cliques(spark.read.parquet(path), ("Part", "resembles", "Part")).edges()
    assert found.count() == 135 and "Broadcast" not in found._jdf.queryExecution().toString()
