"""Exact copies, near copies and repeated passages against brute force; nulls, empties, ties, extra columns, empty tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pathloom.llm import components, exact_dedup, ngram_join, suffix_dedup

DOCS = "doc_id long, text string, n_chars long, node long, _id string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, len(t or ""), 7, "x") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (1, 3, 4, 5, 6, 9, 40, 80, 120, 400, 3000)]
    passage = prose(rng, 60)
    rows = list(enumerate(base))
    for k in range(120):
        words = rng.choice(base[5:10]).split()
        for _ in range(rng.randint(0, max(1, len(words) // 30))):
            words[rng.randrange(len(words))] = rng.choice(["zz", "Abc", "q"])
        text = " ".join(words)
        if rng.random() < 0.3:
            text = prose(rng, 20) + " " + passage + " " + text
        rows.append((1000 - k, text))
    rows += [(2000 + i, t) for i, t in enumerate([None, "", "  \n\t", "same", "SAME", "same ", "a b c d e", "a  b\tc d e", "é ü ñ " * 30, "x" * 500, "x" * 350])]
    return rows


def test_exact(spark, corpus):
    normal = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in corpus}
    groups = defaultdict(list)
    for i, t in normal.items():
        groups[t].append(i)
    want = {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in normal.items()}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.dedup_table(table(spark, corpus)).collect()}
    assert got == want
    kept = exact_dedup.keep_first(table(spark, corpus))
    assert kept.columns == ["doc_id", "text", "n_chars", "node", "_id"] and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if w[2]}
    assert exact_dedup.dedup_table(table(spark, [])).count() == 0


def test_exact_batch_against_snapshot(spark, tmp_path):
    old, new = [(1, "a"), (2, "b"), (9, "c")], [(3, "b"), (4, "d"), (5, "d"), (0, "c"), (6, None), (7, "")]
    snapshot = exact_dedup.Snapshot.create(table(spark, old))
    snapshot.save(str(tmp_path / "snapshot"))
    snapshot = exact_dedup.Snapshot.load(spark, str(tmp_path / "snapshot"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["is_new"]) for r in exact_dedup.dedup_batch(snapshot, table(spark, new)).collect()}
    more = exact_dedup.dedup_batch(snapshot, table(spark, [(8, "c"), (8, "zz")])).filter("is_new").collect()  # an immutable snapshot takes any number of batches
    assert sorted((r["keep_id"], r["group_size"], r["kept"]) for r in more) == [(8, 1, True), (8, 2, True)]
    assert got == {1: (1, 1, False), 2: (2, 2, False), 9: (0, 2, False), 3: (2, 2, True), 4: (4, 2, True), 5: (4, 2, True), 0: (0, 2, True), 6: (6, 2, True), 7: (6, 2, True)}


def test_exact_ids(spark):
    """Null ids, repeated ids and repeated rows: each text keeps exactly one row, that of the smallest id."""
    long = "long text " * 200_000
    rows = [(None, "a"), (None, "a"), (3, "b"), (None, "b"), (5, "c"), (5, "c"), (5, "d"), (1, long), (2, long + "x"), (2, long.replace(" ", "\t"))]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_table(table(spark, rows)).collect()), key=repr)
    want = [(None, None, 2, True), (None, None, 2, False), (3, 3, 2, True), (None, 3, 2, False), (5, 5, 2, True), (5, 5, 2, False), (5, 5, 1, True), (1, 1, 2, True), (2, 1, 2, False), (2, 2, 1, True)]
    assert got == sorted(want, key=repr)
    kept = exact_dedup.keep_first(table(spark, [*rows, (1, "A"), (5, "A"), (5, "B unique"), (7, "C"), (7, "C")]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.filter("length(text) < 10").collect()), key=repr) == sorted([(None, "a"), (3, "b"), (5, "c"), (5, "d"), (1, "A"), (5, "B unique"), (7, "C")], key=repr)


@pytest.mark.parametrize("n", [1, 2, 5, 100, 20_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    f = exact_dedup.BinaryFuse.build(keys)
    assert f.has(keys).all()
    assert f.has(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.01


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def near(corpus):
    sets, up = {i: shingles(t) for i, t in corpus}, {i: i for i, _ in corpus}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block,bitmaps,anchors", [(1200, 3000, 32), (3, 4, 2), (4, 1, 1), (2, 100, 3)])
def test_near(spark, corpus, monkeypatch, block, bitmaps, anchors):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    monkeypatch.setattr(ngram_join, "BITMAP_NODES", bitmaps)
    monkeypatch.setattr(ngram_join, "ANCHORS", anchors)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(table(spark, corpus)).collect()}
    assert got == near(corpus)


def test_signatures_meet():
    """Any two sets that link share a signature: of all sizes, with and without frequent elements, as far apart as they may be."""
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 4, 5, 7, 9, 14, 25, 60, 61, 150, 400, 1_000, 3_000):
        for _ in range(30 if size < 500 else 5):
            pool = np.unique(rng.integers(0, 1 << 62, 2 * size + 8).astype(np.uint64))
            rng.shuffle(pool)
            n = int(rng.integers(size, size * 100 // 80 + 1))  # the larger set
            gone = (100 * size - 80 * n) // 180  # elements of the smaller one that the larger lacks
            shared = size - gone
            x, y = np.sort(pool[:size]), np.sort(np.concatenate([pool[gone:size], pool[size : size + n - shared]]))
            assert 100 * shared >= 80 * (size + n - shared)
            for common in (np.zeros(0, np.uint64), np.sort(x[: size // 2]), x):
                assert len(np.intersect1d(ngram_join.signatures(x, common), ngram_join.signatures(y, common))), (size, n, shared, len(common))


def test_near_edges(spark, corpus):
    assert ngram_join.join(table(spark, [])).count() == 0
    one = [tuple(r) for r in ngram_join.join(table(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (5, None), (4, "a b c d e f")])).collect()]
    assert sorted(one, key=str) == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (5, 0, 5)], key=str)
    want = near(corpus)
    kept = ngram_join.keep_one(table(spark, corpus))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i} and kept.columns[0] == "doc_id"


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(1, 90)).astype(np.uint64)]))
        x, y = (np.frombuffer(ngram_join.bitmap(z), np.uint64) for z in (a, b))
        w = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, w), axis=0) for z in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2100)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(corpus):
    seen, out = set(), {}
    for i, t in sorted(corpus):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("most_runs,local,block", [(2_000, 2_500_000, 700_000), (2, 2_500_000, 700_000), (2_000, 3_000, 2_000), (2, 1_000, 600), (2_000, 0, 500)])
def test_passages(spark, corpus, monkeypatch, most_runs, local, block):
    """However much meets in a task, in a block or only by way of the chains, the result is that of brute force."""
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most_runs)
    monkeypatch.setattr(suffix_dedup, "LOCAL_BYTES", local)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup(table(spark, corpus)).collect()}
    want = removed(corpus)
    assert got == {i: w[:4] for i, w in want.items()} and any(w[1] for w in want.values())


def test_passages_cleaned(spark, corpus):
    clean = suffix_dedup.cleaned(table(spark, corpus))
    assert clean.columns == ["doc_id", "text", "n_chars", "node", "_id"]
    want = removed(corpus)
    for r in clean.collect():
        assert (r["text"] or "") == want[r["doc_id"]][4].decode("utf-8", "ignore")
        assert r["n_chars"] == len(r["text"] or "")
    assert suffix_dedup.dedup(table(spark, [])).count() == 0
    assert suffix_dedup.dedup(table(spark, [(None, "y" * 150), (3, "y" * 150)])).filter("doc_id = 3").first()["n_removed"] == 149


def test_rows_without_an_id_of_their_own(spark):
    """Rows that share an id, or have none, and differ in text."""
    rng = random.Random(9)
    a, b, c = (prose(rng, 90) for _ in range(3))
    rows = [(None, a), (None, b), (4, "short"), (7, c), (7, a), (7, "of its own"), (9, f"{b} and more"), (9, None)]
    texts = lambda df: sorted(str(r["text"]) for r in df.collect())
    first = exact_dedup.keep_first(table(spark, [*rows, (None, b), (7, c)]))
    assert texts(first) == sorted(str(t) for i, t in rows if (i, t) != (None, a)) and {r["doc_id"] for r in first.collect() if r["text"] in (a, b)} == {7, None}
    assert texts(ngram_join.keep_one(table(spark, rows))) == sorted(str(t) for i, t in rows if (i, t) not in ((None, a), (None, b)))
    rows = [(5, "short"), (5, f"{c} {a} and more"), (6, f"xy {c}"), (6, b), (6, c[:50]), (None, a), (None, f"{b} {a}")]
    want = {k: w for k, w in removed([(k, t) for k, (_, t) in enumerate(rows)]).items()}
    # rows of one id come in any order, so the two that repeat each other are told by their sums
    got = suffix_dedup.dedup(table(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"]) for r in got) == sorted((-1 if i is None else i, w[0]) for (i, _), w in zip(rows, want.values(), strict=True))
    assert [sum(r["n_removed"] for r in got if r["doc_id"] == i) for i in (None, 5, 6)] == [sum(w[1] for (j, _), w in zip(rows, want.values(), strict=True) if j == i) for i in (None, 5, 6)]
    clean = texts(suffix_dedup.cleaned(table(spark, rows)))
    assert len(clean) == len(rows) and "short" in clean and c[:50] in clean and sum(map(len, clean)) == sum(w[0] - w[1] for w in want.values())


@pytest.mark.parametrize("local", [2_500_000, 500])
def test_passages_of_repeated_rows(spark, monkeypatch, local):
    """A row that stands several times loses its text but once; periodic and very long texts."""
    monkeypatch.setattr(suffix_dedup, "LOCAL_BYTES", local)
    rng = random.Random(4)
    a, b = prose(rng, 200), prose(rng, 1_500)
    rows = [(1, a), (1, a), (1, a), (2, b), (2, b), (3, "ab" * 400), (4, (b[:333] + "|") * 12), (5, "x" * 99), (6, b[700:900] + a[:150]), (7, prose(rng, 40_000) + b)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(table(spark, rows)).collect())
    want = removed([(k, t) for k, (_, t) in enumerate(rows)])
    assert got == sorted((i, *want[k][:4]) for k, (i, _) in enumerate(rows))


def test_longest_previous_factors():
    rng = random.Random(0)
    for t in range(40):
        n, bound = rng.randint(1, 120), rng.choice([5, 8, 13, 100])
        a = np.array([rng.randint(0, rng.choice([1, 3])) for _ in range(n)])
        got = suffix_dedup.longest_previous(a, bound)
        for i in range(n):
            best = 0
            for j in range(i):
                k = 0
                while i + k < n and k < bound and a[i + k] == a[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best
        assert (suffix_dedup.longest_previous(a, bound, True) == np.where(got == bound, bound, 0)).all()
