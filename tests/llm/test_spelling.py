"""Spelling variants against a brute-force version, with segments that many words share, and the parts on their own."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from pathloom.llm import spelling as S


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    n = Counter()
    for i, text in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [] for w in n}
    shapes = {}
    for w in n:
        for k in range(len(w)):
            shapes.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
    for a, b in {p for ws in shapes.values() for p in combinations(sorted(ws), 2)} | {tuple(sorted((w[:k] + w[k + 1 :], w))) for w in n for k in range(len(w)) if w[:k] + w[k + 1 :] in n}:
        assert one_edit(a, b)
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def table():
    rng = random.Random(7)
    base = ["eauxtion", "mentrement", "leaueaux", "étionelle", "ÀÉïabcdef", "aaaaaaa", "abababab", "xy" * 15]
    letters = "abcdxyéàÿ×"
    docs = []
    for i in range(400):
        out = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.4:
                for _ in range(rng.choice([1, 1, 2, 3])):
                    k, c = rng.randrange(len(w)), rng.choice(letters)
                    w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            out.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "\n", "1"]).join(out)))
    return docs + [(3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (None, None), (9, ""), (10, "short few"), (11, " ".join(base) * 900)]


@pytest.fixture(scope="module")
def want():
    return brute(table())


@pytest.mark.parametrize("hot,few", [(10_000, 24), (20, 4), (6, 1), (6, 1000)])
def test_against_brute_force(spark, want, hot, few, monkeypatch):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "STRETCH", 300)
    monkeypatch.setattr(S, "HELD_WORDS", 50)
    docs = spark.createDataFrame([(i, t, "x") for i, t in table()], "doc_id long, text string, word string")
    got = S.variants(docs, hot_rows=hot, shard_rows=2_000)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(r[1] != r[2] and r[1] for r in want) and len(want) > 1000


def test_no_words(spark):
    docs = spark.createDataFrame([(1, "few short words"), (2, None)], "doc_id long, text string")
    assert S.variants(docs).count() == 0 and S.variants(docs.limit(0)).count() == 0


def test_pieces_hold_every_pair_once():
    """All words over few letters under one segment: each pair at one edit comes out once, however the pieces are halved."""
    words = {"".join(w) for w in __import__("itertools").product("ab", repeat=7)} | {"".join(w) for w in __import__("itertools").product("ab", repeat=8)}
    rows = []
    for w in words:
        for m in (len(w), len(w) - 1):
            if m >= 7:
                rows += [(w, m, m // 2, 0, S.OPEN), (w, m, 0, m - m // 2, m // 2)]
    found = [tuple(sorted(p)) for p in S.Shard(rows).pairs()]
    assert len(found) == len(set(found))
    assert set(found) == {p for p in combinations(sorted(words), 2) if one_edit(*p)}
