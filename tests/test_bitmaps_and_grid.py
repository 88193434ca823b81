"""Bitmaps of rows, mining over them, and the exact grid of thresholds, against brute-force versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import bitmaps, mining, thresholds


@pytest.mark.parametrize("words", [1, 1024])
def test_bitmaps(spark, words, monkeypatch):
    monkeypatch.setattr(bitmaps, "BUCKET_WORDS", words)
    rows = spark.createDataFrame([(f"k{i}", i / 7, i % 5) for i in range(1000)], "k string, w double, g int").repartition(3)
    placed = bitmaps.numbered(rows, ["k"])
    got = placed.collect()
    assert len({(r["word"], r["bit"]) for r in got}) == 1000 and all(0 <= r["bit"] < 64 for r in got)
    tables = bitmaps.weight_tables(placed, w=F.col("w"), one=F.lit(1.0))
    sets = placed.groupBy("g", "word").agg(bitmaps.set_of().alias("bits"), bitmaps.set_of(where=F.col("w") > 50).alias("some"))
    sums = sets.join(tables, "word").groupBy("g").agg(F.sum(bitmaps.weight_of(F.col("bits"), "w")).alias("w"), F.sum(bitmaps.weight_of(F.col("bits"), "one")).alias("n"), F.sum(F.bit_count("some")).alias("m"))
    for r in sums.collect():
        mine = [i for i in range(1000) if i % 5 == r["g"]]
        assert r["w"] == pytest.approx(sum(i / 7 for i in mine)) and r["n"] == len(mine) and r["m"] == sum(i / 7 > 50 for i in mine)


@pytest.mark.parametrize("turning", [False, True])
def test_mining_over_bitmaps(spark, turning):
    """Supports and occurrences of every set of up to four items, held pair by pair or by pair and turned pair."""
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(400)]
    pairs = sorted({p for p in pairs if p[0] != p[1] and (p[1], p[0]) not in pairs})
    weight = {p: rng.choice([0.2, 0.7, 1.0]) for p in pairs}
    held = {(*p, way): {m for m in range(1, 8) if rng.random() < 0.45} for p in pairs for way in ((1, -1) if turning else (1,))}
    rows = [((a, b) if way == 1 else (b, a)) + (m, weight[(a, b)]) for (a, b, way), ms in held.items() for m in ms]
    items = spark.createDataFrame(rows, "a string, b string, mp_id int, weight double")
    least, want = 6.0, {}
    for k in range(1, 5):
        for s in itertools.combinations(range(1, 8), k):
            hit = {p for p in pairs if any(set(s) <= ms for (a, b, _), ms in held.items() if (a, b) == p)}
            total = sum(weight[p] for p in hit)
            if round(total, 9) >= least and all(c in want for c in itertools.combinations(s, k - 1) if k > 1):
                want[s] = (round(total, 6), len(hit))
    levels = mining.apriori(items, least, 4, turning)
    got = {tuple(r["items"]): (round(r["support"], 6), r["n_matches"]) for level, _ in levels for r in level.collect()}
    assert got == want and len(want) > 20
    for level, occurrences in levels[1:]:
        known = {tuple(r["items"]) for r in level.collect()}
        found = {(tuple(r["items"]), r["a"], r["b"], r["weight"]) for r in occurrences.collect()}
        assert found == {(s, *((a, b) if way == 1 else (b, a)), weight[(a, b)]) for s in known for (a, b, way), ms in held.items() if set(s) <= ms}


def _histories(rng, n_items, n):
    out = []
    for _ in range(n):
        counts = []
        for _ in range(n_items):
            scores = [rng.choice([0, 3, 17, 18, 40, 41, 88, 100]) for _ in range(rng.randint(1, 5))]
            counts.append([sum(s >= v for s in scores) for v in range(101)])
        out.append(counts)
    return out


@pytest.mark.parametrize("n_items", [1, 2, 3])
def test_grid_is_the_best_of_all(spark, n_items):
    rng = random.Random(n_items)
    rows = []
    for p in range(4):
        for i, counts in enumerate(_histories(rng, n_items, 12)):
            rows.append((p, f"a{i}", "b", rng.choice([0.3, 1.0]), counts))
    m = spark.createDataFrame(rows, "pat_id int, a string, b string, weight double, counts array<array<bigint>>")
    least = 3.0
    got = {r["pat_id"]: r for r in thresholds.grid(m, least).collect()}
    evolved = {r["pat_id"]: r["cost"] for r in thresholds.evolve(m, least).collect()} if n_items == 2 else {}
    values = range(101) if n_items < 3 else (0, 1, 4, 18, 19, 41, 42, 89)  # costs change only after a score
    for p in range(4):
        mine = [(w, c) for q, _, _, w, c in rows if q == p]
        s0, wn0 = sum(w for w, _ in mine), sum(w * sum(k[0] for k in c) for w, c in mine)

        def cost(x):
            n = [(w, [k[v] for k, v in zip(c, x)]) for w, c in mine]
            n = [(w, sum(k)) for w, k in n if all(k)]
            s = sum(w for w, _ in n)
            return 1.0 if round(s, 9) < least else round(((1 - s / s0) + sum(w * k for w, k in n) / s / (wn0 / s0)) / 2, 12)

        best, x = min((cost(x), x) for x in itertools.product(values, repeat=n_items))
        assert tuple(got[p]["x"]) == x and got[p]["cost"] == pytest.approx(best)
        assert not evolved or evolved[p] >= got[p]["cost"] - 1e-9


def test_grid_takes_patterns_of_several_lengths(spark):
    rng = random.Random(9)
    rows = [(p, f"a{i}", "b", 1.0, c) for p, k in ((1, 1), (2, 3), (3, 2), (4, 4)) for i, c in enumerate(_histories(rng, k, 6))]
    m = spark.createDataFrame(rows, "pat_id int, a string, b string, weight double, counts array<array<bigint>>")
    together = {r["pat_id"]: (r["x"], r["cost"]) for r in thresholds.optimise(m, 1.0, "GRID").collect()}
    assert sorted(together) == [1, 2, 3, 4]
    for p in (1, 2, 3):
        alone = thresholds.grid(m.filter(f"pat_id = {p}"), 1.0).first()
        assert together[p][0] == alone["x"] and together[p][1] == pytest.approx(alone["cost"])
    with pytest.raises(ValueError):
        thresholds.grid(m, 1.0)
