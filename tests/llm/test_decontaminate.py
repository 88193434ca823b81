"""Decontamination against a brute-force version, over one block and many, and what it removes."""

import hashlib
import random
import re

import pytest

from pathloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    some = [f"{a}{b}" for a in ("ka", "Lö", "mi", "x1") for b in ("ra", "TE", "ß")] + ["w" * 90]
    text = lambda n: "".join(rng.choice(some) + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 9, 10, 11, 40, 300]))) for k in range(40)] + [(None, text(30)), (7, text(25)), (7, text(25)), (90, None), (91, ""), (92, " .,- ")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)]
    docs += [(100 + k, text(20) + " " + items[k % 40][1].upper() + "; " + text(20)) for k in range(60)]
    docs += [(None, items[3][1]), (5, docs[5][1]), (5, docs[5][1]), (6, None), (8, ""), (200, text(30_000) + items[20][1])]
    return docs, items


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 15_000])
def test_against_brute_force(spark, tables, block, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(D, "STRETCH", 500)
    monkeypatch.setattr(D, "PIECE_BYTES", 400)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert len(D.blocks_of(b, "item_id", "text", block)) > 1 or block == D.BLOCK_BYTES
    found = D.report(d, b, block_bytes=block)
    got = [tuple(r)[:6] for r in found.collect()]
    assert sorted(got, key=repr) == brute(docs, items)
    for r in found.collect():
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_hit"]
        assert all(x["end"] < y["first"] for x, y in zip(r["spans"], r["spans"][1:]))


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 60])
def test_removal(spark, block):
    item = "One two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before: {item.upper()}! After.", "x"), (2, "Clean text, kept as it is.", "y"), (3, None, "z"), (4, item, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    items = spark.createDataFrame([(1, item), (2, "quite other words")], "item_id long, text string")
    assert sorted(tuple(r) for r in D.cleaned(docs, items, block_bytes=block).collect()) == [(1, "Before: ! After.", "x"), (2, rows[1][1], "y"), (3, None, "z"), (4, "", None)]
    assert sorted(r["doc_id"] for r in D.cleaned(docs, items, "documents", block_bytes=block).collect()) == [2, 3]
    assert D.cleaned(docs, items).columns == docs.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in D.report(docs, none).collect()] == [(3, 0, False)]
    assert D.report(docs.limit(0), none).count() == 0


def test_clashing_hashes_are_avoided(monkeypatch):
    """Two windows of one hash under the first factors get others."""

    class Rng:
        def __init__(self, seed):
            self.seed = seed

        def integers(self, lo, hi, n, kind):
            import numpy as np

            return np.ones(n, np.uint64) if self.seed[1] == 0 else np.arange(1, n + 1, dtype=np.uint64) * np.uint64(1_000_003)

    monkeypatch.setattr(D.np.random, "default_rng", Rng)
    w = D.WindowSet([("1", [b"a", b"b"]), ("2", [b"b", b"a"])])
    assert w.scan(w.numbers(b"a b"))[1] == ["1"] and w.scan(w.numbers(b"b a"))[1] == ["2"]
