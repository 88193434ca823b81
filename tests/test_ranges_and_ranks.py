"""Curves and ranks over ranges that follow the values, and the tail of the normal distribution."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import evaluation, studies


def test_ranges_follow_concentrated_values(spark):
    rng = random.Random(2)
    rows = [(1, 0.5 + 0.01 * rng.random()) for _ in range(3000)] + [(2, v) for v in (0.0, 1.0, 1e9, -1e9)]
    df = spark.createDataFrame(rows, "g int, v double").distinct()
    got = evaluation.ranged(df, "v", "g").collect()
    sizes = {}
    for r in got:
        sizes[(r["g"], r["range"])] = sizes.get((r["g"], r["range"]), 0) + 1
    assert max(sizes.values()) < 100  # a hundredth each would be 30
    one = sorted((r["v"], r["range"]) for r in got if r["g"] == 1)
    assert all(x[1] <= y[1] for x, y in zip(one, one[1:]))


@pytest.mark.parametrize("low,high", [(0.5, 0.51), (-3.0, 40.0)])
def test_areas_of_concentrated_scores(spark, low, high):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), round(low + (high - low) * rng.random(), 6), rng.choice([0.5, 1.0, 2.0])) for _ in range(700)]
    df = spark.createDataFrame(rows, "label int, score double, weight double")
    pos, neg = [(s, w) for y, s, w in rows if y], [(s, w) for y, s, w in rows if not y]
    wins = sum(w * v * ((s > z) + 0.5 * (s == z)) for s, w in pos for z, v in neg)
    wp, wn = sum(w for _, w in pos), sum(w for _, w in neg)
    assert evaluation.roc_auc(df).first()["roc_auc"] == pytest.approx(wins / (wp * wn))
    area, before = 0.0, (0.0, 1.0)
    for s in sorted({r[1] for r in rows}, reverse=True):
        tp, fp = (sum(w for z, w in side if z >= s) for side in (pos, neg))
        now = (tp / wp, tp / (tp + fp))
        area += (now[0] - before[0]) * (now[1] + before[1]) / 2
        before = now
    assert evaluation.pr_auc(df).first()["pr_auc"] == pytest.approx(area)
    curve = evaluation.interpolated(evaluation.roc_points(df), "fpr", "tpr", 11).collect()
    assert sorted(round(r["at"], 6) for r in curve) == [round(k / 10, 6) for k in range(11)]


def test_normal_tail(spark):
    zs = [-9.0, -3.2, -3.0, 2.999999, 3.0, 3.1, -1.0, -1e-9, 0.0, 0.5, 1.96, 2.6, 4.0, 6.0, 9.0, 12.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", studies.normal_tail(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-11)


def _plain(values, member):
    """u, effect, correlation and p of ranks taken one by one."""
    order = sorted(values)
    rank = {v: (order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in set(values)}
    r = [rank[v] for v in values]
    n, n1 = len(values), sum(member)
    n2 = n - n1
    r1 = sum(x for x, m in zip(r, member) if m)
    u = r1 - n1 * (n1 + 1) / 2
    mean = (n + 1) / 2
    cov = sum((x - mean) * (m - n1 / n) for x, m in zip(r, member))
    correlation = cov / math.sqrt(sum((x - mean) ** 2 for x in r) * sum((m - n1 / n) ** 2 for m in member))
    z = (u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n + 1) / 12)
    return u, 2 * u / (n1 * n2) - 1, correlation, 0.5 * math.erfc(z / math.sqrt(2))


def test_rank_sum_against_plain(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0.1, 0.2, 0.5, rng.random()]), rng.random() < 0.3) for g in "ab" for _ in range(150)]
    got = {r["g"]: r for r in studies.rank_sum(spark.createDataFrame(rows, "g string, v double, m boolean"), "g", "v", "m").collect()}
    for g in "ab":
        want = _plain([v for k, v, _ in rows if k == g], [m for k, _, m in rows if k == g])
        assert [got[g][c] for c in ("u", "effect", "correlation", "p_value")] == pytest.approx(want, rel=1e-6)
        assert got[g]["p_adjusted"] == pytest.approx(min(1.0, 2 * want[3]), rel=1e-6)


def test_influence_against_plain(spark):
    rng = random.Random(6)
    rules = [(i, sorted(rng.sample(range(1, 7), rng.randint(2, 3)))) for i in range(60)]
    confidence = {i: rng.choice([0.5, 0.75, rng.random() + (0.3 if 1 in items else 0)]) for i, items in rules}
    found = studies.influence(spark.createDataFrame(rules, "rule_id int, items array<int>"), spark.createDataFrame(list(confidence.items()), "rule_id int, confidence double"))
    got = {r["mp_id"]: r for r in found.collect()}
    for mp in range(1, 7):
        want = _plain([confidence[i] for i, _ in rules], [mp in items for _, items in rules])
        assert [got[mp][c] for c in ("u", "effect", "correlation", "p_value")] == pytest.approx(want, rel=1e-6)
    names = spark.createDataFrame([(1, "GaTbG"), (2, "GcT"), (3, "G<aG")], "mp_id int, notation string")
    tested = spark.createDataFrame([(1, 0.001), (2, 0.002), (3, 0.5)], "mp_id int, p_adjusted double")
    assert {r["element"]: (r["n"], r["share"]) for r in studies.element_shares(tested, names).collect()} == {"a": (1, 50.0), "T": (1, 50.0), "b": (1, 50.0), "c": (1, 50.0)}


def test_level_statistics_and_details(spark):
    """A pair counts at its highest level, its rows and their contexts at their own."""
    from pathloom.operators import labels

    rows = [("a", "b", 1, 0, 0, 50, ["d1"], ["7"]), ("a", "b", 3, 0, 0, 40, ["d2"], ["9", "7"]), ("a", "c", 0, 0, 0, 30, ["d3"], []), ("c", "d", 2, 0, 0, 20, ["d2"], None)]
    e = spark.createDataFrame(rows, "a string, b string, fam int, smeta int, smanual int, ts long, contexts array<string>, publications array<string>")
    got = {r["grp"]: tuple(r)[1:] for r in labels.level_statistics(e).collect()}
    assert got == {"0": (1, 1, 2, 1), "1": (1, 0, 0, 1), "2": (1, 1, 2, 1), "3": (1, 1, 2, 1), "selected": (3, 2, 4, 2)}
    nodes = spark.createDataFrame([(x, x.upper()) for x in ("a", "b", "c", "d", "d1", "d2", "d3")], "id string, name string")
    found = {r["a"] + r["b"]: (r["level"], r["date"], r["contexts"], r["publications"]) for r in labels.holdout_details(e, nodes, e.filter("fam > 1").select("a", "b")).collect()}
    assert found == {"ab": (3, "01/01/1970", "D1-D2", "7;9"), "cd": (2, "01/01/1970", "D2", "")}
    assert labels.level_statistics(e.drop("contexts")).filter("n_contexts > 0").count() == 0


def test_notation(spark):
    from pathloom.functions.expressions import abbreviated_metaedge, abbreviated_metapath, pretty_metaedge

    names, edges = F.create_map(F.lit("Gene"), F.lit("G"), F.lit("Term"), F.lit("T")), F.create_map(F.lit("binds"), F.lit("b"), F.lit("has"), F.lit("h"))
    mp = F.struct(F.array(F.lit("binds"), F.lit("has"), F.lit("other")).alias("edges"), F.array(F.lit("Gene#1"), F.lit("Gene"), F.lit("Term#x"), F.lit("Odd")).alias("nodes"), F.array(F.lit(-1), F.lit(1), F.lit(0)).alias("dirs"))
    edge = lambda f, d, *more: f(F.lit("Gene"), F.lit("binds"), F.lit("Gene"), F.lit(d), *more)
    r = spark.range(1).select(abbreviated_metapath(mp, names, edges), edge(abbreviated_metaedge, -1, names, edges), edge(abbreviated_metaedge, 0, names, edges), edge(pretty_metaedge, 1), pretty_metaedge(F.lit("Gene"), F.lit("has"), F.lit("Term"), F.lit(1))).first()
    assert tuple(r) == ("G_1<bGhT_xotherOdd", "G<bG", "GbG", "Gene--binds>--Gene", "Gene--has--Term")
