"""Table functions of SQL, matchers of one's own, and the named networks of a gene graph."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions.tables import explanation_rows, explanation_texts, publish_paths, register
from pathloom.operators import matching, networks, paths
from pathloom.operators.graph import classify_networks
from pathloom.plans.engine import Engine, Parameters
from pathloom.sources.sinks import explanation_graphs
from pathloom.sources.tables import Graph

NODE = "id string, type string, name string, abbrev string, orient_val double"
EDGE = "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>"


@pytest.fixture(scope="module")
def learned(spark):
    """Twelve positive pairs share a node of type T1 and a direct edge; twelve negative ones have only the edge."""
    nodes, edges, rows = [], [], []
    for i in range(24):
        a, b, x = f"a{i}", f"b{i}", f"x{i}"
        nodes += [(a, "Gene", f"<{a}> & 'co'", "G", 0.0), (b, "Gene", b, "G", 1.0), (x, "T1", None, "T", 0.0)]
        edges.append((f"d{i}", a, b, "binds", 0.5, b, None))
        if i % 2 == 0:
            edges += [(f"h{i}", a, x, "has", 0.9, None, None), (f"k{i}", x, b, "has", 0.9, None, None)]
        rows.append((a, b, int(i % 2 == 0), 1.0))
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)), spark.createDataFrame(rows, "a string, b string, label int, weight double")


def test_table_function_gives_the_graphs_of_the_sink(spark, learned):
    graph, samples = learned
    with Engine(graph, Parameters(minsup_ratio=0.3, optimise_thresholds=None)) as engine:
        model = engine.train(samples)
        ranked, edges = engine.explain(model, samples.filter("label = 1"))
        want = {r["xml"] for r in explanation_graphs(graph, ranked, edges).collect()}
        got = explanation_texts(explanation_rows(graph, edges)).collect()
        assert len(got) == ranked.count() >= 12 and {r["xml"] for r in got} == want
        assert all(r["n_edges"] == r["xml"].count("<edge ") and r["n_nodes"] == r["xml"].count("<node ") for r in got)
        assert "&lt;a0&gt; &amp;" in next(r["xml"] for r in got if r["a"] == "a0")
        explanation_rows(graph, edges).createOrReplaceTempView("explained")
        register(spark)
        per = spark.sql("SELECT a, sum(n_edges) AS n FROM explanation_graph(TABLE(explained) PARTITION BY (a, b, rule_id) ORDER BY eid) GROUP BY a").collect()
        assert sum(r["n"] for r in per) == edges.count()
        assert spark.sql("SELECT * FROM explanation_graph(TABLE(SELECT * FROM explained WHERE a = 'none') PARTITION BY (a, b, rule_id) ORDER BY eid)").count() == 0


def test_metapaths_of_a_pair_by_sql(spark, learned):
    graph, samples = learned
    walked = paths.enumerate_paths(graph, samples, 2)
    best = {tuple(r["mp"]["edges"]): r["score"] for r in walked.filter("a = 'a0'").collect()}
    publish_paths(spark, walked)
    rows = spark.sql("SELECT edges, n_paths, score FROM metapaths('a0', 'b0') ORDER BY size(edges)").collect()
    assert [(r["edges"], r["n_paths"], r["score"]) for r in rows] == [(["binds"], 1, best["binds",]), (["has", "has"], 1, best["has", "has"])]
    assert spark.sql("SELECT * FROM metapaths('a1', 'b2')").count() == 0
    asked = spark.sql("SELECT s.a, count(*) AS n FROM VALUES ('a0', 'b0'), ('a1', 'b1') AS s(a, b), LATERAL metapaths(s.a, s.b) GROUP BY s.a ORDER BY s.a").collect()
    assert [tuple(r) for r in asked] == [("a0", 2), ("a1", 1)]


class AnyItem:
    """A rule holds a pair that has a path of any of its items."""

    def match(self, rules, found):
        return found.join(matching.slots(rules), "mp_id").select("rule_id", "a", "b").distinct()

    def matching_paths(self, rules, found):
        return matching.matching_paths(rules, found, self.match(rules, found))


def test_engine_takes_another_matcher(spark, learned):
    graph, samples = learned
    p = Parameters(minsup_ratio=0.3, optimise_thresholds=None, compute_unifications=False)
    with Engine(graph, p) as plain, Engine(graph, p, matcher=AnyItem()) as loose:
        model = plain.train(samples)
        sure = [r["probability"] for r in model.rules.collect()]
        model.rules = _pair_rule(model, samples, plain)
        strict, wide = ({(r["a"], r["rule_id"]) for r in e.explain(model, samples)[0].collect()} for e in (plain, loose))
        assert {a for a, _ in strict} == {f"a{i}" for i in range(0, 24, 2)} and strict < wide
        assert {a for a, _ in wide} == {f"a{i}" for i in range(24)}
        shown = {r["eid"] for r in loose.explain(model, samples.filter("a = 'a1'"))[1].collect()}
        assert shown == {"d1"}
        unsure = [r["probability"] for r in loose.train(samples).rules.collect()]
        assert sure == [1.0] and unsure == [pytest.approx(0.5)]  # the closed rule of both items holds every pair now


def _pair_rule(model, samples, engine):
    """One rule of both metapaths, with the columns of the model's rules."""
    found, dictionary = paths.intern(engine.paths(samples))
    mps = dictionary.agg(F.sort_array(F.collect_list(F.struct("mp_id", "mp"))).alias("m"))
    return mps.select(
        F.lit(0).cast(model.rules.schema["rule_id"].dataType).alias("rule_id"), F.transform("m", lambda e: e["mp_id"]).cast(model.rules.schema["items"].dataType).alias("items"),
        F.array().cast(model.rules.schema["clause"].dataType).alias("clause"), F.lit(None).cast("array<double>").alias("thr"), F.transform("m", lambda e: e["mp"]).alias("mps"), F.lit(0.9).alias("probability"),
    )


def test_gene_networks(spark):
    nodes = [(i, t, i, t, 0.0) for i, t in (("g1", "Gene"), ("g2", "Gene"), ("g3", "Gene"), ("d", "ProteinDomain"), ("p", "Phenotype"), ("o", "OligogenicCombination"))]
    edges = [("1", "g1", "g2", "coexpresses"), ("2", "g1", "d", "hasUnit"), ("3", "g2", "d", "hasUnit"), ("4", "g3", "p", "associated"), ("5", "g1", "o", "involves"), ("6", "g2", "g3", "physInteracts")]
    graph = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, 1.0, None, None) for e in edges], EDGE))
    kept = {name: {r["eid"] for r in networks.named_network(graph, name).edges.collect()} for name, *_ in networks.GENE_NETWORKS}
    assert len(kept) == 14
    want = {"COEXP": "1", "PPI": "6", "GENE-CENTRIC": "16", "DOMAIN": "23", "PHENO": "4", "COMPOSITE": "234", "ALL": "12346", "ALL_NOPHENO": "1236"}
    assert {k: "".join(sorted(v)) for k, v in kept.items() if v} == want
    walks = spark.createDataFrame([(1, ["Gene", "hasUnit", "ProteinDomain"]), (2, ["Gene", "coexpresses"]), (3, ["Gene", "involves", "OligogenicCombination"]), (4, ["Gene", "associated", "Phenotype"])], "k int, types array<string>")
    found = {}
    for r in classify_networks(walks, networks.by_types()).collect():
        found.setdefault(r["k"], set()).add(r["network"])
    assert found == {1: {"DOMAIN", "COMPOSITE", "ALL", "ALL_NOPHENO"}, 2: {"COEXP", "GENE-CENTRIC", "ALL", "ALL_NOPHENO"}, 4: {"PHENO", "COMPOSITE", "ALL"}}
    pairs = spark.createDataFrame([("g1", "g2"), ("g1", "g3")], "a string, b string")
    hops = {(r["network"], r["b"]): r["distance"] for r in paths.network_distances(graph, pairs, networks.by_types()).collect() if r["distance"] is not None}
    assert hops[("DOMAIN", "g2")] == 2 and hops[("COEXP", "g2")] == 1 and hops[("GENE-CENTRIC", "g3")] == 2 and ("DOMAIN", "g3") not in hops
    missing = {(r["network"], r["type"]) for r in networks.unknown_types(graph).collect()}
    assert ("SEQSIM", "seqSimilar") in missing and ("ALL", "Disease") in missing and not any(t in ("Gene", "hasUnit") for _, t in missing)
    assert networks.unknown_types(graph, networks.GENE_NETWORKS[1:3]).count() == 0


def test_reach_on_the_command_line(spark, tmp_path):
    from pathloom import cli
    from pathloom.sources import graphml

    nodes = [{"id": i, "type": t, "name": i} for i, t in (("g1", "Gene"), ("g2", "Gene"), ("g3", "Gene"), ("d", "ProteinDomain"))]
    edges = [{"src": s, "dst": t, "label": e, "score": 1.0, "target_id": None} for s, t, e in (("g1", "g2", "coexpresses"), ("g1", "d", "hasUnit"), ("g3", "d", "hasUnit"))]
    (tmp_path / "kg.graphml").write_text(graphml.to_xml(nodes, edges))
    (tmp_path / "pairs.tsv").write_text("g1\tg2\ng1\tg3\n")
    cli.main(["reach", "--kg", str(tmp_path / "kg.graphml"), "--input", str(tmp_path / "pairs.tsv"), "--output", str(tmp_path)])
    rows = spark.read.csv(str(tmp_path / "reachability"), header=True, sep="\t", inferSchema=True).collect()
    got = {(r["network"], r["hops"]): r["cumulative"] for r in rows}
    assert (got["COEXP", 1], got["COEXP", 4], got["DOMAIN", 1], got["DOMAIN", 2], got["ALL", 1], got["ALL", 2], got["SEQSIM", 4]) == (1, 1, 0, 1, 1, 2, 0)
    assert "seqSimilar" in {r["type"] for r in spark.read.csv(str(tmp_path / "unknown_types"), header=True, sep="\t").collect()}
