"""What a stage needs on its way does not stay on disk, and wide rows travel in slices."""

import glob
import os

from pyspark.sql import functions as F

from pathloom import queries
from pathloom.operators import paths
from pathloom.sources.store import StageStore, written_once

SF = "/root/testdata/sf0.001"


def test_tables_on_the_way_to_a_stage_go(spark, tmp_path):
    store, ways = StageStore(spark, str(tmp_path / "stages")), []

    def make():
        way = written_once(spark.range(100).withColumn("k", F.col("id") % 7), "way")
        ways.extend(way.inputFiles())
        inner = store.get_or_make("inner", lambda: way.groupBy("k").count(), n=1)
        return inner.join(way, "k")

    assert store.get_or_make("outer", make, n=1).count() == 100
    assert ways and not any(os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in ways)
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "stages").iterdir()) == ["inner", "outer"]
    outside = written_once(spark.range(3))
    assert outside.count() == 3


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(key), []
    found = lambda: set(glob.glob("/tmp/blockmgr-*/*/shuffle_*.data"))
    old = found()
    store = StageStore(spark, str(tmp_path / "stages"))
    store.get_or_make("wide", lambda: seen.append(1) or spark.range(10_000).repartition(4, "id"), n=2)
    assert seen and found() <= old and spark.conf.get(key) == before


def test_lists_meet_in_slices(spark, monkeypatch):
    monkeypatch.setattr(queries, "stage", lambda spark, d, name, make, **made_from: make().localCheckpoint())
    rows = lambda: sorted(map(repr, queries.QUERIES["paths_len3"](spark, SF).collect()))
    want, met, one = rows(), [], paths._met
    monkeypatch.setattr(paths, "SLICE", 10)
    monkeypatch.setattr(paths, "_met", lambda *a: met.append(1) or one(*a))
    assert rows() == want and len(met) == paths.SLICES


def test_mining_leaves_its_stages_alone(spark):
    root = StageStore(spark).root.removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    for name in ("frequent_metapaths", "rule_matches_unified", "closed_patterns_strict"):
        queries.QUERIES[name](spark, f"{SF}/.").count()  # a path of its own, so that all stages are made
    kinds = {p.rsplit("-", 1)[0] for p in set(os.listdir(root)) - before}
    assert kinds == {"nodes", "adjacency", "samples", "paths", "sets", "unifications"}
