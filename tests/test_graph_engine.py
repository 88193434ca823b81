"""The graph engine on a hand-made graph, against small brute-force versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions.expressions import evidence_level, first_of_pair
from pathloom.operators import cover, evaluation, graph, labels, matching, mining, paths, studies, thresholds
from pathloom.plans.engine import Engine, Model, Parameters
from pathloom.sources import graphml
from pathloom.sources.pairs import one_pair, prediction_table, read_delimited, read_method_predictions, read_pairs, read_scored_folds, read_tuple_index, write_predictions
from pathloom.sources.sinks import append_run, explanation_graphs, held_out_table, read_runs, write_explanation_graphs, write_graph_files
from pathloom.sources.store import StageStore
from pathloom.sources.tables import Graph

NODES = [("A", "Gene", 1.0), ("B", "Gene", 2.0), ("D", "Gene", 2.0), ("E", "Gene", float("nan")), ("X", "T1", 0.0), ("Y", "T2", 0.0), ("Z", "T1", 0.0), ("W", "Bad", 0.0)]
# eid, src, dst, label, score, target, ctx
EDGES = [
    ("e1", "A", "B", "binds", 0.9, "B", None), ("e2", "A", "X", "has", 0.5, None, None), ("e3", "A", "X", "has", 0.8, None, None), ("e4", "X", "B", "has", 0.4, None, ["u"]),
    ("e5", "X", "Y", "near", 0.6, "X", ["u", "v"]), ("e6", "Y", "B", "sees", 0.7, None, ["v"]), ("e7", "A", "Z", "has", 0.3, None, ["u"]), ("e8", "Z", "B", "has", 0.2, None, ["v"]),
    ("e9", "A", "W", "odd", 0.5, None, None), ("e10", "W", "B", "odd", 0.5, None, None), ("e11", "X", "Z", "near", 0.1, "Z", None), ("e12", "X", "D", "has", 0.6, None, None), ("e13", "B", "D", "binds", 0.2, "B", None),
]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(i, t, i.lower(), t[0], v) for i, t, v in NODES], "id string, type string, name string, abbrev string, orient_val double")
    edges = spark.createDataFrame(EDGES, "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>")
    return Graph(nodes, edges)


def walks(a, b, cutoff, excluded=(), context=True):
    kind = {i: t for i, t, _ in NODES}
    steps = [(u, v, label, s, c, 0 if t is None else 1 if t == v else -1) for _, x, y, label, s, t, c in EDGES for u, v in ((x, y), (y, x))]
    best = {}

    def go(at, path, seen):
        if at == b and path:
            ctx = [set(p[4]) for p in path if p[4] is not None]
            if context and ctx and not set.intersection(*ctx):
                return
            mp = (tuple(p[2] for p in path), (kind[a], *(kind[p[1]] for p in path)), tuple(p[5] for p in path))
            key = (mp, tuple(p[1] for p in path[:-1]))
            score = math.exp(sum(math.log(p[3] + 1e-7) for p in path) / len(path))
            best[key] = max(best.get(key, 0), score)
            return
        if len(path) < cutoff:
            for s in steps:
                if s[0] == at and s[1] not in seen and kind[s[1]] not in excluded:
                    go(s[1], [*path, s], seen | {s[1]})

    go(a, [], {a})
    return best


PAIRS = [("A", "B"), ("A", "D"), ("B", "D"), ("A", "E")]


@pytest.mark.parametrize("cutoff", [1, 2, 3, 4])
@pytest.mark.parametrize("excluded,context", [((), True), (("Bad",), True), (("Bad", "T2"), False)])
def test_paths(spark, g, cutoff, excluded, context):
    pairs = spark.createDataFrame(PAIRS, "a string, b string")
    rows = paths.enumerate_paths(g, pairs, cutoff, excluded, context).collect()
    got = {(r["a"], r["b"], (tuple(r["mp"]["edges"]), tuple(r["mp"]["nodes"]), tuple(r["mp"]["dirs"])), tuple(r["mids"])): r["score"] for r in rows}
    want = {(a, b, *k): s for a, b in PAIRS for k, s in walks(a, b, cutoff, excluded, context).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert len(rows) == len(got)


def test_pairs_without_path_and_distances(spark, g):
    pairs = spark.createDataFrame(PAIRS, "a string, b string")
    found = paths.enumerate_paths(g, pairs, 3)
    assert [(r["a"], r["b"]) for r in paths.pairs_without_path(pairs, found).collect()] == [("A", "E")]
    d = {(r["a"], r["b"]): r["distance"] for r in paths.distances(g, pairs, 4).collect()}
    assert d == {("A", "B"): 1, ("A", "D"): 2, ("B", "D"): 1, ("A", "E"): None}


def test_orientation_ties_and_nan(spark, g):
    raw = spark.createDataFrame([("B", "A"), ("D", "B"), ("E", "A"), ("A", "missing")], "id1 string, id2 string")
    assert sorted((r["a"], r["b"]) for r in graph.orient(g, raw).collect()) == [("A", "B"), ("A", "E"), ("B", "D")]
    row = spark.range(1).select(first_of_pair(F.lit("b"), F.lit(float("nan")), F.lit("a"), F.lit(1.0)).alias("x")).first()
    assert row["x"] is False


def test_subgraphs(g):
    kept = graph.typed_subgraph(g, ["Gene", "T1"], ["has"])
    assert {r["eid"] for r in kept.edges.collect()} == {"e2", "e3", "e4", "e7", "e8", "e12"}
    assert graph.induced(g, g.nodes, None).edges.count() == 0
    assert {r["eid"] for r in graph.typed_subgraph(g, ["Bad"], ["near"], keep=False).edges.collect()}.isdisjoint({"e9", "e10", "e5", "e11"})


def test_evidence_levels(spark):
    rows = [(f, m, n) for f in range(5) for m in range(4) for n in range(3)]
    got = [r["x"] for r in spark.createDataFrame(rows, "f int, m int, n int").select("f", "m", "n", evidence_level(F.col("f"), F.col("m"), F.col("n")).alias("x")).collect()]
    want = [3 if f >= 3 or m >= 2 else 2 if f >= 2 or m >= 2 else 1 if f >= 1 or (m >= 1 and n >= 1) else 0 for f, m, n in rows]
    assert got == want


def test_recent_distinct(spark):
    c = spark.createDataFrame([("a", "b", 5), ("b", "c", 9), ("d", "e", 7), ("c", "f", 8), ("g", "h", 1)], "a string, b string, ts long")
    assert [(r["a"], r["b"]) for r in labels.recent_distinct(c, 3).orderBy(F.desc("ts")).collect()] == [("b", "c"), ("d", "e"), ("g", "h")]
    assert labels.recent_distinct(c, 0).count() == 0
    assert labels.recent_distinct(c.limit(0), 2).count() == 0


def test_folds_are_even_and_stable(spark):
    s = spark.createDataFrame([(f"a{i}", f"b{i}", i % 3 == 0) for i in range(100)], "a string, b string, l boolean").withColumn("label", F.col("l").cast("int"))
    one = {(r["a"], r["fold"]) for r in labels.folds(s, 5).collect()}
    assert one == {(r["a"], r["fold"]) for r in labels.folds(s.repartition(7), 5).collect()}
    counts = {(r["label"], r["fold"]): r["count"] for r in labels.folds(s, 5).groupBy("label", "fold").count().collect()}
    assert len(counts) == 10
    for label in (0, 1):
        mine = [n for (y, _), n in counts.items() if y == label]
        assert max(mine) - min(mine) <= 1


# Transactions: pair -> metapaths with the nodes of their paths.
TRANSACTIONS = {0: {1: [["x"], ["y"]], 2: [["x", "q"]], 3: [["z"]]}, 1: {1: [["x"]], 2: [["q", "x"]]}, 2: {1: [["m"]], 2: [["m", "n"]], 3: [["m"]]}, 3: {2: [["k", "l"]], 3: [["k"]]}, 4: {1: [["s"]], 3: [["t"]]}}
WEIGHTS = {0: 1.0, 1: 0.5, 2: 1.0, 3: 0.25, 4: 0.5}


@pytest.fixture(scope="module")
def tx(spark):
    rows = [(f"a{p}", f"b{p}", mp, mids, 0.1 * (i + 1) + 0.2 * mp) for p, t in TRANSACTIONS.items() for mp, ways in t.items() for i, mids in enumerate(ways)]
    found = spark.createDataFrame(rows, "a string, b string, mp_id int, mids array<string>, score double")
    return found, spark.createDataFrame([(f"a{p}", f"b{p}", w) for p, w in WEIGHTS.items()], "a string, b string, weight double")


@pytest.mark.parametrize("ratio", [0.1, 0.3, 0.5, 0.9])
def test_apriori(tx, ratio):
    found, weights = tx
    least = mining.least_support(weights, ratio)
    want = {}
    for n in (1, 2, 3):
        for s in itertools.combinations((1, 2, 3), n):
            w = sum(WEIGHTS[p] for p, t in TRANSACTIONS.items() if set(s) <= set(t))
            if w >= least - 1e-9 and w > 0:
                want[s] = w
    got = {tuple(r["items"]): r["support"] for level, _ in mining.apriori(mining.items_of(found, weights), least, 3) for r in level.collect()}
    assert got == pytest.approx(want)
    for s in got:  # support never rises with size
        assert all(got[s] <= got[t] + 1e-9 for t in itertools.combinations(s, len(s) - 1) if t)


def test_unifications_and_closedness(tx):
    found, weights = tx
    fixed = lambda df: found.sparkSession.createDataFrame(df.collect(), df.schema)
    occurrences = fixed(mining.mined(mining.apriori(mining.items_of(found, weights), 0.1, 3)))
    want = set()
    for p, t in TRANSACTIONS.items():
        for n in (2, 3):
            for s in itertools.combinations(sorted(t), n):
                for node in {x for ways in t.values() for mids in ways for x in mids}:
                    places = {mp: {mids.index(node) + 1 for mids in t[mp] if node in mids} for mp in s}
                    with_node = [mp for mp in s if places[mp]]
                    for k in range(2, len(with_node) + 1):
                        for part in itertools.combinations(with_node, k):
                            for choice in itertools.product(*(sorted(places[mp]) for mp in part)):
                                want.add((p, s, tuple(zip(part, choice))))
    got = {(int(r["a"][1:]), tuple(r["items"]), tuple((c["mp"], c["pos"]) for c in r["clause"])) for r in mining.unifications(occurrences, mining.path_nodes(found)).collect()}
    assert got == want
    table = fixed(mining.pattern_table(mining.with_unifications(occurrences, mining.unifications(occurrences, mining.path_nodes(found)), 0.1)))
    rows = table.collect()
    pats = [(tuple(r["items"]), tuple((c["mp"], c["pos"]) for c in r["clause"]), r["n_matches"]) for r in rows]
    level = lambda p: len(p[0]) + bool(p[1])
    for strict in (False, True):
        over = lambda p, q: level(q) == level(p) + 1 and q[2] >= p[2] and (set(p[0]) <= set(q[0]) and set(p[1]) <= set(q[1]) if strict else p[0][0] in q[0])  # noqa: E731, B023
        keep = {p[:2] for p in pats if not any(over(p, q) for q in pats)}
        assert {(tuple(r["items"]), tuple((c["mp"], c["pos"]) for c in r["clause"])) for r in mining.closed(table, strict).collect()} == keep


RULES = [(1, [1, 2], [], None), (2, [1, 2], [(1, 1), (2, 1)], None), (3, [1, 2], [(1, 1), (2, 2)], None), (4, [1, 3], [], [0.3, 0.7]), (5, [1, 2, 3], [(1, 1), (2, 1)], [0.3, 0.4, 0.0])]


def test_matching(spark, tx):
    found, _ = tx
    rules = spark.createDataFrame(RULES, "rule_id int, items array<int>, clause array<struct<mp:int,pos:int>>, thr array<double>")
    scores = {(p, mp): [(mids, 0.1 * (i + 1) + 0.2 * mp) for i, mids in enumerate(ways)] for p, t in TRANSACTIONS.items() for mp, ways in t.items()}
    want = set()
    for rule, items, clause, thr in RULES:
        for p in TRANSACTIONS:
            ways = {mp: [m for m, s in scores.get((p, mp), []) if thr is None or s >= thr[k]] for k, mp in enumerate(items)}
            if all(ways.values()):
                nodes = set.intersection(*({m[pos - 1] for m in ways[mp] if len(m) >= pos} for mp, pos in clause)) if clause else {None}
                if nodes:
                    want.add((rule, p))
    assert {(r["rule_id"], int(r["a"][1:])) for r in matching.match(rules, found).collect()} == want
    shown = {(r["rule_id"], int(r["a"][1:])) for r in matching.matching_paths(rules, found).collect()}
    assert shown == want  # the matcher that returns paths agrees with the boolean one


def test_threshold_example(spark):
    """One item, two matches with scores {.2, .8} and {.5}."""
    scores = spark.createDataFrame([(1, "a1", "b1", 0, 0.2), (1, "a1", "b1", 0, 0.8), (1, "a2", "b2", 0, 0.5)], "pat_id int, a string, b string, slot int, score double")
    weights = spark.createDataFrame([("a1", "b1", 1.0), ("a2", "b2", 1.0)], "a string, b string, weight double")
    m = thresholds.count_arrays(scores, weights)
    asked = spark.createDataFrame([(1, x, [x]) for x in (0, 50, 60, 21, 20)], "pat_id int, candidate int, x array<int>")
    got = {r["candidate"]: round(r["cost"], 4) for r in thresholds.costs(m, asked, 1.0).collect()}
    assert got == {0: 0.5, 50: 0.3333, 60: 0.5833, 21: 0.3333, 20: 0.5}
    best = thresholds.greedy(m, 1.0).first()
    assert best["x"] == [21] and best["cost"] == pytest.approx(1 / 3)
    evolved = thresholds.evolve(m, 1.0).first()
    assert evolved["cost"] <= 0.5 and thresholds.evolve(m, 1.0).first() == evolved


def test_set_cover_example(spark):
    rows = [(1, "p1", "x", 1, 1.0), (1, "n1", "x", 0, 0.5), (2, "p1", "x", 1, 1.0), (2, "p2", "x", 1, 1.0)]
    c = spark.createDataFrame(rows, "rule_id int, a string, b string, label int, weight double")
    t = {"wp": 2.0, "wn": 1.0, "np": 2, "nn": 2}
    assert cover.set_cover(c, t, 0.5) == [(2, -1.0)]
    assert cover.set_weight(c, t) == pytest.approx(0.25)
    assert cover.set_weight(c.limit(0), t) == 1.0


def test_areas(spark):
    rows = [(1, 0.9, 1.0), (0, 0.8, 2.0), (1, 0.8, 0.5), (1, 0.3, 1.5), (0, 0.1, 1.0), (0, 0.3, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double, weight double")
    wins = sum(w * v * ((s > z) + 0.5 * (s == z)) for y, s, w in rows if y for q, z, v in rows if not q)
    assert evaluation.roc_auc(df).first()["roc_auc"] == pytest.approx(wins / (3.0 * 3.5))
    area, before = 0.0, (0.0, 1.0)
    for s in sorted({r[1] for r in rows}, reverse=True):
        tp, fp = (sum(w for y, z, w in rows if y == label and z >= s) for label in (1, 0))
        now = (tp / 3.0, tp / (tp + fp))
        area += (now[0] - before[0]) * (now[1] + before[1]) / 2
        before = now
    assert evaluation.pr_auc(df).first()["pr_auc"] == pytest.approx(area)
    one = df.filter("label = 1")
    assert evaluation.roc_auc(one).first()["roc_auc"] is None and evaluation.pr_auc(one).first()["pr_auc"] is None


def test_fisher(spark):
    rows = [(1, 8, 2), (2, 3, 3), (3, 10, 0)]
    got = {r["rule_id"]: r["p_value"] for r in matching.significant(spark.createDataFrame(rows, "rule_id int, tp long, fp long"), "tp", "fp", 12, 20, 1.0).collect()}
    for i, tp, fp in rows:
        n = tp + fp
        want = sum(math.comb(12, x) * math.comb(20, n - x) for x in range(tp, min(n, 12) + 1)) / math.comb(32, n)
        assert got[i] == pytest.approx(want, rel=1e-5)


def test_rank_sum(spark):
    rows = [("g", float(v), v > 3) for v in (1, 2, 3, 4, 5, 6)]
    r = studies.rank_sum(spark.createDataFrame(rows, "k string, v double, m boolean"), "k", "v", "m").first()
    assert r["u"] == 9 and r["effect"] == pytest.approx(1.0) and r["p_value"] < 0.05


@pytest.fixture(scope="module")
def learned(spark):
    """Positives share a hub of type T1 and a direct edge, negatives only one of the two."""
    nodes, edges, rows = [], [], []
    for i in range(24):
        a, b, x = f"a{i}", f"b{i}", f"x{i}"
        nodes += [(a, "Gene", a, "G", 0.0), (b, "Gene", b, "G", 1.0), (x, "T1", x, "T", 0.0)]
        good = i % 2 == 0
        if good or i % 4 == 1:
            edges.append((f"d{i}", a, b, "binds", 0.5, None, None))
        if good or i % 4 == 3:
            edges += [(f"h{i}", a, x, "has", 0.9, None, None), (f"k{i}", x, b, "has", 0.9, None, None)]
        rows.append((a, b, int(good), 1.0))
    graph_ = Graph(spark.createDataFrame(nodes, "id string, type string, name string, abbrev string, orient_val double"), spark.createDataFrame(edges, "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>"))
    return graph_, spark.createDataFrame(rows, "a string, b string, label int, weight double")


def test_engine_end_to_end(spark, learned, tmp_path):
    graph_, samples = learned
    engine = Engine(graph_, Parameters(minsup_ratio=0.3, optimise_thresholds="GREEDY"))
    model = engine.train(samples)
    found = {r["a"]: r["predicted"] for r in engine.predict(model, samples).collect()}
    assert all(found[r["a"]] == r["label"] for r in samples.collect())
    model.save(str(tmp_path / "model"))
    again = Model.load(spark, str(tmp_path / "model"))
    assert {r["a"]: r["predicted"] for r in engine.predict(again, samples).collect()} == found
    with pytest.raises(Exception):
        model.save(str(tmp_path / "model"))
    ranked, edges = engine.explain(model, samples.filter("a = 'a0'"))
    graphs = explanation_graphs(graph_, ranked, edges).collect()
    assert len(graphs) == ranked.count() and graphs[0]["name"].startswith("a0-b0-1-1.000-") and graphs[0]["xml"].count("<edge ") == 3
    assert ranked.first()["n_nodes"] == 3 and {r["eid"] for r in edges.collect()} == {"d0", "h0", "k0"}
    areas, scored = engine.evaluate(samples, 3)
    assert [round(r["roc_auc"], 6) for r in areas.collect()] == [1.0] * 3 and scored.count() == 24
    with pytest.raises(ValueError):
        engine.train(samples.filter("label = 1"))


def test_engines_keep_their_tables_apart(spark, learned):
    """One engine after another, some of them gone: each has tables of its own."""
    graph_, samples = learned
    store, answers = StageStore(spark), []
    for cutoff in (2, 1, 2, 1):
        engine = Engine(graph_, Parameters(path_cutoff=cutoff, minsup_ratio=0.3, optimise_thresholds=None), store)
        answers.append(engine.paths(samples).count())
        del engine
    assert answers[0] == answers[2] > answers[1] == answers[3]


def test_stages_follow_their_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    store = StageStore(spark)
    make = lambda: store.get_or_make("n", lambda: spark.read.parquet(str(tmp_path / "t")), version=store.version(str(tmp_path / "t"))).count()
    assert make() == 3
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "t"))
    mark = len(store.made)
    assert make() == 5 and len(store.made) == mark + 1
    store.drop_since(mark)
    assert len(store.made) == mark and make() == 5


def test_pairs_without_orientation(spark, learned):
    """Some pairs are given from the other end: without orientation they are learned from and found all the same."""
    graph_, samples = learned
    graph_ = Graph(graph_.nodes, graph_.edges.withColumn("target_id", F.when(F.col("label") == "binds", F.col("dst"))))
    turned_ = F.substring("a", 2, 5).cast("int") % 6 == 0
    mixed = samples.select(F.when(turned_, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned_, F.col("a")).otherwise(F.col("b")).alias("b"), "label", "weight")
    for strategy in (None, "GREEDY"):
        engine = Engine(graph_, Parameters(minsup_ratio=0.9, orient_pairs=False, optimise_thresholds=strategy))
        model = engine.train(mixed)
        found = {(r["a"], r["b"]): r["predicted"] for r in engine.predict(model, mixed).collect()}
        assert found == {(r["a"], r["b"]): r["label"] for r in mixed.collect()}
        ranked, edges = engine.explain(model, mixed.filter("b = 'a0'"))
        assert {(r["a"], r["b"], r["n_nodes"]) for r in ranked.collect()} == {("b0", "a0", 3)} and {r["eid"] for r in edges.collect()} == {"d0", "h0", "k0"}
    oriented = Engine(graph_, Parameters(minsup_ratio=0.9, optimise_thresholds=None))
    assert oriented.mine(*_found(oriented, mixed)).isEmpty()  # no set holds nine of ten pairs from one end


def _found(engine, samples):
    found, _ = paths.intern(engine.paths(samples))
    return found, samples.filter("label = 1")


def test_sets_of_either_direction_by_hand(spark):
    """Every pattern holds a pair if all of its metapaths stand there as walked from one and the same end."""
    rng = random.Random(6)
    kinds = [(["e"], ["X", "Y"], [1]), (["e"], ["Y", "X"], [-1]), (["f", "g"], ["X", "Z", "Y"], [0, 1]), (["g", "f"], ["Y", "Z", "X"], [-1, 0]), (["h"], ["X", "X"], [0])]
    turn = lambda k: (k[0][::-1], k[1][::-1], [-d for d in k[2][::-1]])
    rows = [(f"p{i}", f"q{i}", k, ["z"] * (len(k[0]) - 1), 0.5) for i in range(30) for k in kinds if rng.random() < 0.5]
    walked = spark.createDataFrame(rows, "a string, b string, mp struct<edges:array<string>,nodes:array<string>,dirs:array<int>>, mids array<string>, score double")
    weights = spark.createDataFrame([(f"p{i}", f"q{i}", 1.0 + i % 3) for i in range(30)], "a string, b string, weight double")
    found, names = paths.intern(mining.both_ways(walked))
    levels = mining.apriori(mining.items_of(found, mining.turned(weights)), 8.0, 3, True)
    spelled = {r["mp_id"]: (tuple(r["mp"]["edges"]), tuple(r["mp"]["nodes"]), tuple(r["mp"]["dirs"])) for r in names.collect()}
    got = {tuple(sorted(spelled[i] for i in r["items"])): (r["support"], r["n_matches"]) for level, _ in levels for r in level.collect()}
    fixed_ = lambda k: tuple(map(tuple, k))
    held = {}
    for a, _, k, *_ in rows:
        for way, form in ((1, k), (-1, turn(k))):
            held.setdefault((a, way), set()).add(fixed_(form))
    every, want = sorted({x for v in held.values() for x in v}), {}
    for n in (1, 2, 3):
        for items in itertools.combinations(every, n):
            mine = {a for (a, _), v in held.items() if set(items) <= v}
            weight = sum(1.0 + int(a[1:]) % 3 for a in mine)
            if weight >= 8.0:
                want[tuple(sorted(items))] = (weight, len(mine))
    assert got == want and len({len(k) for k in want}) == 3


def test_positives_of_the_graph(spark):
    nodes = [(g, "Gene", g, "G", v, {}) for g, v in (("g1", 3.0), ("g2", 1.0), ("g3", 2.0), ("g4", 5.0), ("g5", float("nan")))] + [(d, "Disease", d, "D", 0.0, {}) for d in ("d1", "d2")]
    level = lambda fam, ts: {"FAMmanual": str(fam), "STATmeta": "0", "STATmanual": "x", "timestamp": str(ts)}
    nodes += [(o, "OligogenicCombination", o, "O", 0.0, level(*x)) for o, x in (("o1", (1, 50)), ("o2", (3, 90.0)), ("o3", (2, 70)), ("o4", (3, 99)), ("o5", (2, 80)), ("o6", (0, 10)))]
    ends = {"o1": "g1 g2 d1", "o2": "g2 g1 d1 d2", "o3": "g3 g4", "o4": "g1 g2 g3", "o5": "g4 g5 d2", "o6": "g2 g3"}
    edges = [(f"{o}{x}", o, x, "involves", 1.0, None, None) for o, xs in ends.items() for x in xs.split()]
    graph_ = Graph(spark.createDataFrame(nodes, "id string, type string, name string, abbrev string, orient_val double, props map<string,string>"), spark.createDataFrame(edges, "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>"))
    index = labels.evidence_index(graph_)
    got = {r["evidence_id"]: (r["a"], r["b"], r["fam"], r["smanual"], r["ts"], sorted(r["contexts"])) for r in index.collect()}
    assert got == {"o1": ("g2", "g1", 1, 0, 50, ["d1"]), "o2": ("g2", "g1", 3, 0, 90, ["d1", "d2"]), "o3": ("g3", "g4", 2, 0, 70, []), "o5": ("g4", "g5", 2, 0, 80, ["d2"]), "o6": ("g2", "g3", 0, 0, 10, [])}
    rest, held = labels.graph_positives(index, n_held_out=1)
    assert [(r["a"], r["b"], r["ts"]) for r in held.collect()] == [("g4", "g5", 80)]
    assert sorted((r["a"], r["b"], round(r["weight"], 3), r["ts"], tuple(r["contexts"])) for r in rest.collect()) == [("g2", "g1", 1.0, 50, ("d1", "d2")), ("g3", "g4", 0.667, 70, ())]


def test_greedy_thresholds_by_hand(spark):
    """Sums from above over the scores that occur give the costs of all 101 values; three items, ties, matches without paths left."""
    rng = random.Random(11)
    rows, weights = [], []
    for p in (1, 2, 3):
        for i in range(12):
            counts = []
            for _ in range(p):
                scores = [rng.choice([0, 10, 10, 35, 60, 99, 100]) for _ in range(rng.randint(1, 5))]
                counts.append([sum(s >= v for s in scores) for v in range(101)])
            rows.append((p, f"a{i}", f"b{i}", 1.0 + i % 2, counts))
    m = spark.createDataFrame(rows, "pat_id int, a string, b string, weight double, counts array<array<bigint>>")
    least = 4.0
    for r in thresholds.greedy(m, least).collect():
        mine = [(w, c) for p, _, _, w, c in rows if p == r["pat_id"]]
        s0, wn0 = sum(w for w, _ in mine), sum(w * sum(k[0] for k in c) for w, c in mine)

        def cost(x):
            n = [(w, [k[v] for k, v in zip(c, x)]) for w, c in mine]
            n = [(w, sum(k)) for w, k in n if all(k)]
            s = sum(w for w, _ in n)
            return 1.0 if s < least else round(((1 - s / s0) + sum(w * k for w, k in n) / s / (wn0 / s0)) / 2, 12)

        x, free, best = [0] * r["pat_id"], set(range(r["pat_id"])), None
        while free:
            c, j, v = min((cost([v if k == j else x[k] for k in range(len(x))]), j, v) for j in sorted(free) for v in range(101))
            if best is not None and c > best:
                break
            best = c
            x[j] = v
            free.discard(j)
        assert r["x"] == x and r["cost"] == pytest.approx(best)
        assert thresholds.evolve(m.filter(f"pat_id = {r['pat_id']}"), least).first()["cost"] <= 0.5


def test_stream(spark, learned, tmp_path):
    from pathloom.streaming.scoring import score_stream

    graph_, samples = learned
    engine = Engine(graph_, Parameters(minsup_ratio=0.3, optimise_thresholds=None))
    model = engine.train(samples)
    samples.select("a", "b").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string, b string").parquet(str(tmp_path / "in"))
    q = score_stream(engine, model, stream, str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24


def test_graphml_round_trip(spark, g, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text(graphml.to_xml([r.asDict() for r in g.nodes.collect()], [r.asDict() for r in g.edges.drop("ctx").collect()]))
    back = graphml.read(spark, str(path))
    assert {(r["id"], r["type"], r["name"]) for r in back.nodes.collect()} == {(i, t, i.lower()) for i, t, _ in NODES}
    assert sorted((r["src"], r["dst"], r["label"], r["score"], r["target_id"] or "") for r in back.edges.collect()) == sorted((e[1], e[2], e[3], e[4], e[5] or "") for e in EDGES)
    row = spark.range(1).select(graphml.context_list(F.lit("['u', \"v\"]")).alias("x"), graphml.context_list(F.lit(None).cast("string")).alias("y")).first()
    assert row["x"] == ["u", "v"] and row["y"] is None
    assert [spark.range(1).select(graphml.context_list(F.lit(x)).alias("x")).first()["x"] for x in ("[]", "", "['']")] == [None, None, [""]]  # nothing listed is any context


def test_pair_files(spark, g, tmp_path):
    (tmp_path / "p.tsv").write_text("b\ta\t0.5\na\tb\t0.7\nd\tb\t0.2\nnone\ta\t1\n")
    pairs, unresolved = read_pairs(spark, g, str(tmp_path / "p.tsv"))
    assert {(r["a"], r["b"], r["weight"]) for r in pairs.collect()} == {("A", "B", 0.7), ("B", "D", 0.2)}
    assert [tuple(r) for r in unresolved.collect()] == [("none", "a")]
    single, missing = one_pair(spark, g, "b,a")
    assert single.first()["a"] == "A" and missing.count() == 0
    with pytest.raises(ValueError):
        read_pairs(spark, g, str(tmp_path / "p.tsv"), "other")
    table = prediction_table(g, pairs.withColumn("probability", F.col("weight")), unresolved)
    assert [r["probability"] for r in table.collect()] == [0.7, 0.2, None]
    write_predictions(table, str(tmp_path / "out"))
    assert "NaN" in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


def test_result_tables(spark, g, tmp_path):
    (tmp_path / "f.tsv").write_text('predictions\ty\tsample_weights\n"[0.1, 0.9]"\t"[0, 1]"\t"[1, 0.5]"\n')
    assert sorted(tuple(r)[1:] for r in read_scored_folds(spark, str(tmp_path / "f.tsv")).collect()) == [(0.1, 0, 1.0), (0.9, 1, 0.5)]
    (tmp_path / "t.tsv").write_text("\tvalue\n('A', 'B')\t0.25\n")
    assert [tuple(r) for r in read_tuple_index(spark, str(tmp_path / "t.tsv"), "value").collect()] == [("A", "B", 0.25)]
    (tmp_path / "c.tsv").write_text('# one\n# two\nname\tvalue\n#kept\t1\n"x y"\t2\n')
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "c.tsv"), comment="#", leading_only=True).collect()] == [("#kept", "1"), ("x y", "2")]
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "c.tsv"), comment="#").collect()] == [("x y", "2")]
    (tmp_path / "m.csv").write_text(",p\n\"('b', 'a')\",0.25\n\"('a', 'no')\",1\n")
    found, lost = read_method_predictions(spark, g, str(tmp_path / "m.csv"), "p")
    assert [tuple(r) for r in found.collect()] == [("A", "B", 0.25)] and [tuple(r) for r in lost.collect()] == [("a", "no")]


def test_run_tables(spark, g, tmp_path):
    for fold in (0, 1):
        append_run(spark, str(tmp_path / "runs"), "one", Parameters(alpha=0.25), {"roc_auc": 0.5 + fold / 4, "seconds": 2}, fold)
    rows = read_runs(spark, str(tmp_path / "runs"))
    assert rows.count() == 4 and rows.filter("figure = 'roc_auc'").agg(F.avg("value")).first()[0] == 0.625
    held = spark.createDataFrame([("A", "B", 1.0)], "a string, b string, weight double")
    xmls = spark.createDataFrame([(f"n{i}", "<x/>") for i in range(5)], "name string, xml string")
    write_explanation_graphs(xmls, str(tmp_path / "graphs"))
    write_graph_files(xmls, str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "graphs")).count() == 5 and len(list((tmp_path / "files").glob("name=*"))) == 5
    assert tuple(held_out_table(g, held).first()) == ("a", "b", 1.0) and tuple(held_out_table(g, held, "id").first())[:2] == ("A", "B")


def test_baseline_and_comparison(spark):
    rows = [(f"a{i}", f"b{i}", int(i % 4 < 2), 1.0, i % 3, float(i % 4 < 2) + (i % 5) / 10) for i in range(60)]
    s = spark.createDataFrame(rows, "a string, b string, label int, weight double, fold int, walk double")
    scored = studies.baseline_scores(s, ["walk"], 3)
    assert scored.count() == 60 and evaluation.roc_auc(scored).first()["roc_auc"] == 1.0
    p = scored.select("a", "b", F.col("score").alias("probability"))
    near = spark.createDataFrame([("a0", "b0", 2, 0, 0.0)], "a string, b string, n_a int, n_b int, similarity double")
    mps = spark.createDataFrame([(1, [(["e"], ["Gene", "T1"], [0])])], "rule_id int, mps array<struct<edges:array<string>,nodes:array<string>,dirs:array<int>>>")
    out = studies.compared({"ours": p, "other": p.filter("a <> 'a0'")}, near, mps, spark.createDataFrame([(1, "a1", "b1")], "rule_id int, a string, b string"), "T1")
    by = {r["a"]: r for r in out.collect()}
    assert len(by) == 60 and by["a0"]["other"] is None and by["a0"]["min_neighbours"] == 0 and by["a1"]["passes_type"] and not by["a2"]["passes_type"]
    curve = spark.createDataFrame([(0.0, 0.2), (0.25, 0.8), (1.0, 1.0)], "at double, mean double")
    assert studies.best_mean_rates(curve).first()["fpr"] == 0.25
