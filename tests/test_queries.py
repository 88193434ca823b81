"""Every registered query with an SQL twin gives the twin's rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from pathloom import queries

SF = "/root/testdata/sf0.001"
NAMES = [n for n in queries.ORACLES if n in queries.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared test tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = con.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in at)) for row in rel.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_set_cover_goes_on_while_it_gains(spark, monkeypatch):
    """Five rules are needed here; a brute-force greedy cover says which, in which order."""
    matched = {r: {*range(10 * r, 10 * r + 8 - r)} | {100 + k for k in range(r % 3)} for r in range(5)} | {5: {0, 1, 10, 100, 101, 102}}
    labels = {k: 1 for k in range(50)} | {100 + k: 0 for k in range(20)}
    samples = spark.createDataFrame([(k, -k, y, 1.0) for k, y in labels.items()], "a long, b long, label int, weight double")
    rows = [(r, k, -k, labels[k], 1.0) for r, m in matched.items() for k in m]
    coverage = spark.createDataFrame(rows, "rule_id int, a long, b long, label int, weight double")
    monkeypatch.setattr(queries, "stage_samples", lambda spark, d: samples)
    monkeypatch.setattr(queries, "coverage", lambda spark, d: coverage)
    positive, negative = ({k for k, y in labels.items() if y == v} for v in (1, 0))
    weight = lambda covered: 0.5 * (1 - len(covered & positive) / 50) + 0.5 * len(covered & negative) / 20 if covered else 1.0
    confidence = {r: len(m & positive) / len(m) for r, m in matched.items()}
    want, covered = [], set()
    while left := [r for r in matched if r not in [x[1] for x in want]]:
        gain = {r: round(weight(covered | matched[r]) - weight(covered), 12) for r in left}
        best = min(left, key=lambda r: (gain[r], -confidence[r], -r))
        if gain[best] >= 0:
            break
        covered |= matched[best]
        want.append((len(want) + 1, best, round(gain[best], 6)))
    assert len(want) > 3
    assert [tuple(r) for r in queries.QUERIES["set_cover_steps"](spark, "").orderBy("step").collect()] == want
