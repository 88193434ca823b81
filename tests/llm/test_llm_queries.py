"""The registered queries on the smallest tables: SQL twins where there are any, counts elsewhere; the pipeline's stages."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pathloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_all_operators_are_registered():
    found = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 14)) and "pipeline" in found


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated and missing ids, empty and long texts, columns with names that the operators use, an empty table."""
    rows = [(1, "A b c d e f g h.", "en", "w", 9), (1, "A b c d e f g h.", "en", "w", 9), (None, None, None, None, None), (None, "Some words of their own, not seen before.", "en", "w", 1), (2, "", "en", "w", 0), (3, "Long text of many words. " * 20_000, "en", "w", 7)]
    schema = "doc_id long, text string, lang string, _key string, n_chars int"
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for data in (rows, []):
        at = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, str(tmp_path))
            assert out.columns == at.columns
            at = spark.createDataFrame(out.collect(), at.schema)
        texts = sorted(r["text"] or "" for r in at.collect())
        assert len(texts) == (4 if data else 0) and all(len(t) < 200 for t in texts)
        packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
        assert len(packed) == len(texts)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, at = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        at = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < at.count() <= rows
        rows = at.count()
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in at.collect()}
    assert {tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r)[:4] for r in last.collect()}
