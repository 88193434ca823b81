"""Stages known by what they are made from, and closedness over whole keys."""

import itertools
import random

import pytest

from pathloom.operators import mining
from pathloom.plans.engine import Engine, Parameters
from pathloom.sources.store import StageStore, fingerprint
from pathloom.sources.tables import Graph

NODES = [(f"g{i}", "Gene", "n", "G", float(i)) for i in range(6)] + [("t", "Term", "t", "T", 0.0)]
EDGES = [(f"e{i}", f"g{i}", "t", "has", 0.5, None, ["u"] if i % 2 else None) for i in range(6)] + [("d", "g0", "g1", "binds", 0.5, "g1", None)]


def made(spark, nodes=NODES, edges=EDGES, parts=1):
    return Graph(
        spark.createDataFrame(nodes, "id string, type string, name string, abbrev string, orient_val double").repartition(parts),
        spark.createDataFrame(edges, "eid string, src string, dst string, label string, score double, target_id string, ctx array<string>").repartition(parts),
    )


def test_fingerprint(spark):
    rows = [(1, "a", None, {"k": "v", "l": "w"}), (2, None, "a", {}), (2, None, "a", {}), (3, "x", "y", None)]
    schema = "i int, s string, t string, m map<string,string>"
    one = fingerprint(spark.createDataFrame(rows, schema))
    assert one == fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(3))
    for other in (rows[:-1], rows + rows[1:2], [(1, None, "a", {"k": "v", "l": "w"}), *rows[1:]], [(1, "a", None, {"k": "v", "l": "x"}), *rows[1:]]):
        assert fingerprint(spark.createDataFrame(other, schema)) != one
    assert fingerprint(spark.createDataFrame(rows, schema.replace("s string", "r string"))) != one


def test_paths_are_walked_once_for_equal_input(spark, tmp_path):
    pairs = spark.createDataFrame([("g0", "g1"), ("g2", "g3")], "a string, b string")
    root = str(tmp_path / "stages")
    first = Engine(made(spark), Parameters(), StageStore(spark, root))
    want = first.paths(pairs).collect()
    assert len(first.store.made) == 2
    again = Engine(made(spark, NODES[::-1], EDGES[::-1], 3), Parameters(alpha=0.9, minsup_ratio=0.7, excluded_types=("Disease",)), StageStore(spark, root))
    assert sorted(again.paths(pairs.repartition(2)).collect()) == sorted(want) and again.store.made == []  # nothing walked, nothing written
    for engine, asked in (
        (Engine(made(spark, NODES, [*EDGES[:-1], ("d", "g0", "g1", "binds", 0.6, "g1", None)]), Parameters(), StageStore(spark, root)), pairs),
        (Engine(made(spark), Parameters(path_cutoff=2), StageStore(spark, root)), pairs),
        (Engine(made(spark), Parameters(excluded_types=("Term",)), StageStore(spark, root)), pairs),
        (Engine(made(spark), Parameters(), StageStore(spark, root)), pairs.limit(1)),
    ):
        engine.paths(asked)
        assert any("/paths-" in p for p in engine.store.made)
    first.close(shared=True)
    assert first.store.made == []
    walked_anew = Engine(made(spark), Parameters(), StageStore(spark, root))
    assert sorted(walked_anew.paths(pairs).collect()) == sorted(want) and any("/paths-" in p for p in walked_anew.store.made)


def test_close_deletes_own_stages(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "stages"))
    with Engine(made(spark), Parameters(), store) as engine:
        paths = engine.paths(spark.createDataFrame([("g0", "g1")], "a string, b string"))
        engine._kept("extra", paths)
        assert len(store.made) == 3
    assert len(store.made) == 2 and not any("/extra-" in p for p in store.made)
    assert len(list((tmp_path / "stages").iterdir())) == 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strict_closedness_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in (1, 2, 3, 4):
        for items in itertools.combinations(range(1, 7), k):
            if rng.random() < 0.5:
                rows.append((list(items), [], rng.randint(1, 5)))
            for size in range(2, k + 1):
                for mps in itertools.combinations(items, size):
                    if rng.random() < 0.3:
                        rows.append((list(items), [(mp, rng.randint(1, 2)) for mp in mps], rng.randint(1, 5)))
    level = lambda r: len(r[0]) + bool(r[1])
    holds = lambda q, p: level(q) == level(p) + 1 and set(p[0]) <= set(q[0]) and set(p[1]) <= set(q[1]) and q[2] >= p[2]
    want = {(tuple(p[0]), tuple(p[1]), p[2]) for p in rows if not any(holds(q, p) for q in rows)}
    df = spark.createDataFrame(rows, f"items array<int>, clause {mining.CLAUSE}, n_matches int")
    got = {(tuple(r["items"]), tuple(tuple(c) for c in r["clause"]), r["n_matches"]) for r in mining.closed(df, True).collect()}
    assert got == want and len(want) < len(rows)
