"""Costs of vectors of thresholds come from the grid points of the matches; the matches' counts stay where they are read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pathloom.operators import thresholds


def _matches(spark, path, n_items, rng):
    rows = []
    for p in range(3):
        for i in range(12):
            scores = [[rng.choice([0, 3, 17, 18, 40, 41, 88, 100]) for _ in range(rng.randint(1, 5))] for _ in range(n_items)]
            rows.append((p, f"a{i}", "b", rng.choice([0.3, 1.0]), [[sum(s >= v for s in of) for v in range(101)] for of in scores]))
    spark.createDataFrame(rows, "pat_id int, a string, b string, weight double, counts array<array<bigint>>").write.parquet(path)
    return rows, spark.read.parquet(path)


def _moved(df):
    """Inputs of the exchanges of a plan, broadcasts among them."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [block for block in re.split(r"\n\n+", text) if re.match(r"\(\d+\) \w*Exchange", block.strip())]


@pytest.mark.parametrize("n_items", [1, 2, 3, 4])
def test_costs_by_points(spark, tmp_path, n_items):
    rng = random.Random(n_items)
    rows, m = _matches(spark, str(tmp_path / "counts"), n_items, rng)
    asked = [(p, k, [rng.choice([0, 3, 4, 18, 19, 60, 100]) for _ in range(n_items)]) for p in range(3) for k in range(9)]
    found = thresholds.costs(m, spark.createDataFrame(asked, "pat_id int, candidate int, x array<int>"), 1.0)
    got = {(r["pat_id"], r["candidate"]): r["cost"] for r in found.collect()}
    assert len(got) == len(asked)
    for p, k, x in asked:
        mine = [(w, c) for q, _, _, w, c in rows if q == p]
        s0, wn0 = sum(w for w, _ in mine), sum(w * sum(c[0] for c in of) for w, of in mine)
        left = [(w, [c[v] for c, v in zip(of, x, strict=True)]) for w, of in mine]
        left = [(w, sum(n)) for w, n in left if all(n)]
        s = sum(w for w, _ in left)
        want = 1.0 if round(s, 9) < 1.0 else ((1 - s / s0) + sum(w * n for w, n in left) / s / (wn0 / s0)) / 2
        assert got[(p, k)] == pytest.approx(want)


def test_counts_are_not_sent(spark, tmp_path):
    """A written table of counts is small and the rows in it are not: by its files' size alone Spark broadcasts it."""
    _, m = _matches(spark, str(tmp_path / "counts"), 2, random.Random(7))
    asked = spark.createDataFrame([(p, 0, [0, 30]) for p in range(3)], "pat_id int, candidate int, x array<int>")
    for df in (thresholds.costs(m, asked, 1.0), thresholds.surviving(m, asked.withColumn("x", F.array(F.lit(0), F.lit(0))))):
        moved = _moved(df)
        assert moved and not any("counts#" in block for block in moved)


def test_a_match_without_paths_of_an_item(spark):
    some, none = [2] * 41 + [0] * 60, [0] * 101
    m = spark.createDataFrame([(1, "a", "b", 1.0, [some, some]), (1, "c", "d", 1.0, [some, none])], "pat_id int, a string, b string, weight double, counts array<array<bigint>>")
    points = thresholds.grid_points(m).agg(F.sum("s").alias("s"), F.sum("wn").alias("wn")).first()
    assert (points["s"], points["wn"]) == (1.0, 4.0)


def test_evolution_asks_points(spark, tmp_path, monkeypatch):
    _, m = _matches(spark, str(tmp_path / "counts"), 2, random.Random(3))

    def from_matches(*_, **__):
        raise AssertionError("a generation went over the matches")

    monkeypatch.setattr(thresholds, "costs", from_matches)
    zeros = {r["pat_id"]: r["cost"] for r in thresholds.point_costs(thresholds.grid_points(m), thresholds.base_values(m), spark.createDataFrame([(p, 0, [0, 0]) for p in range(3)], "pat_id int, candidate int, x array<int>"), 1.0).collect()}
    for r in thresholds.evolve(m, 1.0, generations=3).collect():
        assert r["cost"] <= zeros[r["pat_id"]] + 1e-9
