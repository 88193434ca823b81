"""HTML extraction, byte BPE, licence scan, language model, packing, search and the classifier."""

import base64
import hashlib
import html as html_
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from pathloom.llm import bpe, html_extract, license_scan, lm_score, packing, quality, topk_search
from pathloom.llm.html_blocks import blocks

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "Hello world", "The GNU General Public License, and MIT license; CC BY.", "a\nb\n\nc  d", "ünïcödé — 你好 🙂 test", "x" * 3000, "don't stop 123 4567", "CC BY cc by mit license mit", "tab\tand\x0bvt"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 3, "w") for i, t in enumerate(texts)], "doc_id long, text string, word long, _score string")


# ---------------------------------------------------------------- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav><div class="ad">Buy now, it is cheap and good.</div>
<article><h1>A   title &amp; more</h1><p>First <b>bold</b> paragraph, with&#160;some words in it to read.<p>Second paragraph&hellip; it goes on for a while longer.</p></article>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I liked this one a lot, thanks.</p></div></div><form><input>Subscribe</form><footer>&copy; 2024 Somebody</footer></body></html>"""


def test_html_page(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>never closed <a href='", "x"), (1, "u", PAGE, "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 5 and by[1]["text"] == "A title & more\nFirst bold paragraph, with some words in it to read.\nSecond paragraph… it goes on for a while longer."
    assert by[1]["n_chars"] == len(by[1]["text"]) and by[2]["text"] == "" and by[3]["n_chars"] == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_held_out_pages():
    maker, model = html_extract.PageMaker(1234), html_extract.trained()
    wrong = total = 0
    for _ in range(150):
        x, y = html_extract.labelled(maker.page())
        if len(x):
            wrong += int((model.label([x])[0] != y).sum())
            total += len(y)
    assert wrong / total < 0.01


def test_html_table_pages(spark):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    got = html_extract.texts_of([h for _, h in rows], html_extract.trained())
    for (_, h), text in zip(rows, got, strict=True):
        inside = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        want = [" ".join(html_.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inside)]
        assert text == "\n".join(x for x in want if x)


def test_blocks_survive_bad_markup():
    for bad in ("<", "<<<>>>", "<p", "<!-- open", "<script>never", "</p></div>", "<div><p>a<div>b</p>c", "a < b and c > d", "<p title='x>y", "&#0; &bogus; &amp"):
        assert isinstance(blocks(bad), list)
    assert [b.text for b in blocks("<div>a<p>b<p>c</div>d")] == ["a", "b", "c", "d"]


def test_hidden_inline_elements_end():
    texts = lambda html: [b.text for b in blocks(html)]
    assert texts('<article><i class="icon" aria-hidden="true"></i><p>one</p><p>two</p></article>') == ["one", "two"]
    assert texts('<p>a <span hidden>no</span> b <i aria-hidden="true">no</i>c</p><p>d</p>') == ["a b c", "d"]
    assert texts('<p>a <span style="display: none">no <span>no</span> no <b>no</b></span> b</p>') == ["a b"]
    assert texts("<div>a <span hidden>no <div>no <span>no</span></div> no</span> b</div>c") == ["a", "b", "c"]
    assert texts("<p>a <span hidden>no<p>b</p><div>c <em hidden>no</div>d") == ["a", "b", "c", "d"]
    assert texts('<div hidden><span hidden>no</span> no <i>no</i></div>a<wbr hidden>b<i aria-hidden="true"/>c') == ["abc"]


def test_html_reads_all_names_and_words():
    classes = "flex flex-col md:flex-row items-center justify-between px-4 py-2 sidebar"
    body = "".join(f"<p>Some words of a story that goes on, part {k}, for a while.</p>" for k in range(4))
    html = f'<html><body><article><h1>A title</h1>{body}</article><div class="{classes}"><p>Read more of what others like here.</p></div><footer>&copy; x</footer></body></html>'
    assert ".sidebar" in blocks(html)[5].path[-2]
    assert html_extract.texts_of([html], html_extract.trained())[0].count("\n") == 4
    long = " ".join(f"w{k}" for k in range(40))
    a, b = (html_extract.vectors(blocks(f"<p>{long} {more}</p>"))[0] for more in ("x1 " * 9, "y1 " * 9))
    assert (a != b).any()


def test_html_long_pages():
    """A page read in slices, with the states handed on, has the labels of the page read at once."""
    maker, model = html_extract.PageMaker(77), html_extract.trained()
    for _ in range(20):
        page = blocks(maker.page().replace(maker.MARK, ""))
        if page:
            whole = model.label([html_extract.vectors(page)])[0]
            assert (model.label_long(page, 3) == whole).all() and (model.label_blocks([page, [], page])[2] == whole).all()
    body = "".join(f"<p id='p{k}'>Part {k} of a story that goes on.</p>" for k in range(30_000))
    assert html_extract.texts_of([f"<html><body><nav><a href=x>Home</a></nav><article>{body}</article><footer>&copy; Somebody</footer></body></html>"], model)[0].count("\n") > 29_990


def test_html_layout_tables():
    """A menu in a cell without a name beside the article."""
    side = "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate("Home News Sports Weather Contact".split()))
    body = "".join(f"<p>Some words of a story that goes on, part {k}, for a while longer.</p>" for k in range(4))
    got = html_extract.texts_of([f"<html><body><table><tr><td><ul>{side}</ul></td><td><h1>A title of it</h1>{body}</td></tr></table><footer>&copy; x</footer></body></html>"], html_extract.trained())[0]
    assert got.startswith("A title of it\nSome words") and got.count("\n") == 4


# ---------------------------------------------------------------- bpe


def test_bpe_matches_the_library(spark):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    real = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [*TEXTS, *("".join(rng.choices("abe tionß\n 0!'s中é", k=rng.randint(1, 200))) for _ in range(200))]
    out = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, texts), "byte_bpe_50k.tiktoken", tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = real.encode_ordinary(t or "")
        assert out[i]["ids"] == ids and out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_append_and_edit():
    tokenizers = pytest.importorskip("public_tokenizers")
    c, rng = bpe.coder(tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(4)
    for _ in range(60):
        data = bytes(rng.choices(b"abet ion", k=rng.randint(1, 80)))
        whole = c.prefixes(data)
        cut = rng.randint(0, len(data))
        assert c.prefixes(data, c.prefixes(data[:cut])) == whole
        at, gone, put = rng.randint(0, len(data)), rng.randint(0, 5), bytes(rng.choices(b"xyz the", k=rng.randint(0, 6)))
        new, table = c.edited(data, whole, at, min(gone, len(data) - at), put)
        assert table == c.prefixes(new) and c.decode(c.tokens(new)) == new


# ---------------------------------------------------------------- licences


def test_license_counts(spark):
    got = {r["doc_id"]: r for r in license_scan.scan_documents(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_license_spans_of_templates():
    for label, text in license_scan.TEMPLATES:
        if len(license_scan.words_of(text)) < 12:  # one changed word costs a short template too much
            continue
        words = license_scan.words_of("some text before it " + text.replace(" the ", " these ", 1) + " and after")
        assert max((s for s in license_scan.automaton().spans(words) if s[0] == label), key=lambda s: s[4])[4] > 0.7


def test_license_templates_are_told_apart():
    """Each wording gives its own label and no other, also between words of its own and with a word changed; tags are read whole."""
    for label, text in license_scan.TEMPLATES:
        for form in (text, f"some words before {text} and some after", text.upper()):
            got = license_scan.scan_text(form)
            assert label in got["labels"].split(",") and set(got["labels"].split(",")) <= {label, *filter(None, got["base_labels"].split(","))}, (label, text, got["labels"])
            assert got["score"] == 1.0 and any(s["label"] == label and s["covered"] == 1.0 for s in got["spans"])
    for text in ("SPDX-License-Identifier: Nothing-1.0", "spdx license identifier", "this program is free software", "", "you may not use this file"):
        assert license_scan.scan_text(text)["labels"] == "" and license_scan.scan_text(text)["score"] == 0.0
    two = license_scan.scan_text("SPDX-License-Identifier: ISC " + "x " * 50 + "SPDX-License-Identifier: MPL-2.0")
    assert two["labels"] == "isc,mpl" and [s["first_word"] for s in two["spans"]] == [0, 54]


def test_license_edges(spark):
    assert license_scan.scan_documents(docs(spark, [])).count() == 0
    long = "word " * 400_000 + "mit license " + "w " * 400_000
    rows = license_scan.scan_documents(docs(spark, [long, "mit license", "mit license"])).collect()
    assert [(r["n_base"], r["first_word"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(1, 400_000), (1, 0), (1, 0)]


def test_matching_statistics():
    a = license_scan.LicenceAutomaton([("x", "a b c a b d"), ("y", "b c e")])
    words = [w.encode() for w in "b c a b d q a b c e".split()]
    runs = [t.split() for t in ("a b c a b d", "b c e")]
    for i, _, size in a.statistics(words):
        best = max(n for n in range(1, i + 2) for r in runs for k in range(len(r) - n + 1) if [x.encode() for x in r[k : k + n]] == words[i - n + 1 : i + 1])
        assert size == best


# ---------------------------------------------------------------- language model


def test_lm_base_scores(spark):
    rng = random.Random(8)
    vocabulary = "the of and Word other rare1 rare2".split()

    def chain(n):
        """Each word is mostly followed by the next of the vocabulary."""
        at = [rng.randrange(7)]
        while len(at) < n:
            at.append((at[-1] + 1) % 7 if rng.random() < 0.8 else rng.randrange(7))
        return " ".join(vocabulary[k] for k in at[:n])

    texts = [*TEXTS, *(chain(rng.randint(0, 60)) for _ in range(150))]
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs(spark, texts)).collect()}
    toks = {i: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    counts: dict = {}
    for i, ts in toks.items():
        if not out[i]:
            for t in ts:
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, ts in toks.items():
        base = sum(math.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in ts)
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (out[i], len(ts), sum(t in counts for t in ts), n)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-6) and got[i]["score"] < 0
    held = [i for i in toks if out[i]]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)  # contexts tell something
    assert lm_score.score_documents(docs(spark, [])).count() == 0


def test_lm_distributions_sum_to_one(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "c", "d"], weights=[4, 3, 2, 1], k=50)) for _ in range(40)]
    tree, counts, total, distinct = lm_score.train(docs(spark, texts), "doc_id", "text")
    assert tree.size == distinct  # all words are frequent here, so the tree holds the whole distribution but for one unseen word
    for one in range(tree.size):
        p = sum(tree.given1(np.array([one]), np.array([x]))[0] for x in range(tree.size))
        unseen = (tree.rest1[one] if tree.keep1[one] else 1.0) / tree.norm
        assert p + unseen == pytest.approx(1, abs=1e-9)


def test_lm_rare_and_deep_contexts(spark):
    """Contexts and next words count from two on, however large the corpus is; three words of context are told apart."""
    rng = random.Random(12)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 30))) for _ in range(60)]
    texts += ["q1 q2 q3 q4"] * 3 + ["z2 q2 q3 q5"] * 3 + [" ".join(f"fill{rng.randrange(30_000)}" for _ in range(2_500)) for _ in range(70)]
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs(spark, texts)).collect()}
    toks = {i: t.split() + [None] for i, t in enumerate(texts)}
    seen: dict = {}
    for i, ts in toks.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for at, x in enumerate(ts):
                for k in range(min(at, 3) + 1):
                    after = seen.setdefault(tuple(ts[at - k : at]), {})
                    after[x] = after.get(x, 0) + 1
    norm = sum(seen[()].values()) + len(seen[()]) + 1
    assert sum(seen[()].values()) * 2e-5 > 3  # so these contexts are below that share of the corpus

    def p(s, x, kept):
        if not s:
            return (seen[()].get(x, 0) + 1) / norm
        if s not in kept:
            return p(s[1:], x, kept)
        total, stored = sum(seen[s].values()), {y: c for y, c in seen[s].items() if c >= 2}
        return (stored.get(x, 0) + (total - sum(stored.values()) + 1) * p(s[1:], x, kept)) / (total + 1)

    kept: set = set()
    for k in (1, 2, 3):
        more = set()
        for s, after in seen.items():
            total = sum(after.values())
            if len(s) == k and total >= 2:
                stored = {x: (c / total, p(s[1:], x, kept)) for x, c in after.items() if c >= 2}
                mine, theirs = (min(1.0, max(1e-12, 1 - sum(v[j] for v in stored.values()))) for j in (0, 1))
                if sum(a * math.log(a / b) for a, b in stored.values()) + mine * math.log(mine / theirs) >= 0.02:
                    more.add(s)
        kept |= more
    kept |= {s[j:] for s in kept for j in range(1, len(s))}
    assert {len(s) for s in kept} == {1, 2, 3}
    for i, ts in toks.items():
        want = sum(math.log10(p(tuple(ts[max(0, at - 3) : at]), x, kept)) for at, x in enumerate(ts))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_lm_hot_words(spark, monkeypatch):
    """Tokens after a very common word are dealt out, and the sums of its contexts meet again: the scores stay the same."""
    rng = random.Random(21)
    texts = [" ".join(rng.choices(["the", "of", "a", "cat", "dog", "sat", f"w{rng.randrange(40)}"], weights=[9, 4, 3, 2, 2, 1, 2], k=rng.randint(0, 60))) for _ in range(120)]
    scores = lambda: {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs(spark, texts)).collect()}
    want = scores()
    monkeypatch.setattr(lm_score, "HOT", 100)
    monkeypatch.setattr(lm_score, "BUCKET", 500)
    assert len(lm_score.train(docs(spark, texts), "doc_id", "text")[1].hot) > 3
    assert scores() == pytest.approx(want, rel=1e-12)


def test_lm_tables_stay_small(spark, monkeypatch):
    """What is written on the way follows the text, not its different grams: under twice its bytes; its grams, a row each, took more than that."""
    rng = random.Random(22)
    texts = [" ".join(f"word{int(rng.paretovariate(0.5)) % 5_000}" for _ in range(4_000)) for _ in range(40)]
    sizes, plain = [], lm_score.written

    def measured(df, name):
        out = plain(df, name)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(lm_score, "written", measured)
    assert lm_score.score_documents(docs(spark, texts)).count() == 40
    assert sum(sizes) < 2 * sum(map(len, texts))


# ---------------------------------------------------------------- packing


def test_packing(spark):
    rng = random.Random(1)
    texts = [None, "", *(" ".join(["w"] * rng.choice([1, 3, 50, 200, 255, 256, 700, 1023, 5000])) for _ in range(200))]
    rows = packing.pack(docs(spark, texts)).collect()
    need = {i: len((t or "").split()) + 1 for i, t in enumerate(texts)}
    placed, bins = {}, {}
    for r in rows:
        placed.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        bins.setdefault((r["bin_id"], r["bin_capacity"]), []).append((r["bin_offset"], r["n_tokens"]))
    for i, n in need.items():
        at = 0
        for start, size in sorted(placed[i]):
            assert start == at
            at += size
        assert at == n
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), items in bins.items():
        end = 0
        for offset, size in sorted(items):
            assert offset >= end
            end = offset + size
        used = sum(s for _, s in items)
        assert end <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= used)
    waste = sum(c for _, c in bins) / sum(need.values())
    assert waste < 1.25
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("capacity", [256, 1024])
def test_packing_is_best_fit(capacity):
    """With one permitted length, the filling of the bins is that of best-fit decreasing item by item."""
    rng = random.Random(capacity)
    for _ in range(30):
        sizes = [rng.choice([1, 2, 5, 33, 90, 120, 128, 129, 200, 255, 256, rng.randint(1, 256)]) for _ in range(rng.randint(1, 150))]
        plan = packing.PackingPlan({n: sizes.count(n) for n in set(sizes)}, (capacity,))
        rooms: list[int] = []
        for n in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - n)
        assert sorted(capacity - r for r in rooms) == sorted(used for _, n, _, used in plan.runs for _ in range(n))


def test_packing_opens_the_cheapest_length():
    """The permitted length of least cost a token, the items of this length first, shorter ones as far as they go."""
    rng = random.Random(3)
    plan = packing.PackingPlan({})
    for _ in range(200):
        length, count, mass = rng.randint(1, 4096), rng.randint(1, 50), rng.choice([0, 100, 10_000, 10**7])
        costs = {}
        for c in (x for x in packing.CAPACITIES if x >= length):
            bins, each = math.ceil(count / (c // length)), min(c // length, count)
            costs[c] = packing.bin_cost(c) / (each * length + min(c - each * length, mass / bins))
        assert plan._opened(length, count, mass) == min(costs, key=costs.get)


def test_repeated_rows(spark):
    """Rows that stand twice get a result each, in every operator over texts."""
    rows = [(1, "the same words here"), (1, "the same words here"), (None, None), (None, None), (2, "long " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokenizers = pytest.importorskip("public_tokenizers")
    encoded = bpe.encode_documents(df, "byte_bpe_50k.tiktoken", tokenizers.PATTERN)
    for out in (encoded, lm_score.score_documents(df), license_scan.scan_documents(df)):
        got = [tuple(str(x) for x in r) for r in out.collect()]
        assert len(got) == 5 and len(set(got)) == 3
    packed = packing.pack(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in packed if r["doc_id"] != 2) == [(0, 1), (0, 1), (1, 5), (1, 5)] and sum(r["n_tokens"] for r in packed) == 60_013
    assert len({(r["bin_id"], r["bin_offset"]) for r in packed}) == len(packed)
    assert bpe.encode_documents(df.limit(0), "byte_bpe_50k.tiktoken", tokenizers.PATTERN).count() == 0


# ---------------------------------------------------------------- search


@pytest.mark.parametrize("group,dims", [(8 << 20, 8), (200, 8), (8 << 20, 1)])
def test_topk(spark, monkeypatch, group, dims):
    monkeypatch.setattr(topk_search, "QUERY_BYTES", group)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, dims)]) for i in range(400)]
    rows += [(1000 + 10 * i, [0.5] * dims) for i in range(40)] + [(5000, None), (5050, [float("nan")] * dims), (5100, [None] * dims), (None, [0.1] * dims), (5150, [float("inf")] * dims)]
    got = [tuple(r) for r in topk_search.search(spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, score long, x double")).collect()]
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in ok:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_topk_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk_search.search(few).collect()) == [(0, 1, 2, 65536), (0, 2, 1, 32768)]
    assert topk_search.search(few.limit(0)).count() == 0


def brute_topk(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, (i, v) in enumerate(ok):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(ok) if c != q)[:k]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("large", [2.0, 1e5, 1e6])
def test_topk_repeated_ids_and_large_components(spark, large):
    """Rows that share an id are candidates and queries of their own; no component and no score is rounded."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 12)) * 25, [float(x) for x in rng.normal(0, large, 3)]) for _ in range(90)]
    rows += [(50, [large, 0.0, 1.0]), (50, [large, 0.0, 1.0]), (50, [large, 0.0, 1.0]), (7, [2e7, 0.0, 0.0])]
    got = sorted(tuple(r) for r in topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute_topk(rows)
    assert large < 1e6 or math.floor(256 * large) ** 2 > 2**53  # doubles would not do


def test_topk_stops_at_64_bits(spark):
    for rows in ([(0, [1e300]), (1, [1.0])], [(0, [1e12]), (1, [1e12])]):
        with pytest.raises(Exception, match="does not fit 64 bits"):
            topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


# ---------------------------------------------------------------- classifier


def test_classifier(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(d, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_prior_of_planted_mixtures():
    """Positives and unlabelled rows alone give the share, within 0.1 of the truth."""
    rng = np.random.default_rng(11)
    for share in (0.2, 0.5, 0.8):
        n = int(4_000 * share)
        mixed = rng.permutation(np.concatenate([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (4_000 - n, 4))]))
        assert quality.class_prior(rng.normal(1.5, 1, (2_000, 4)), mixed) == pytest.approx(share, abs=0.1)
    assert quality.class_prior(rng.normal(1, 1, (4, 4)), mixed) == 0.5


def test_apart_gradient_by_differences():
    rng = np.random.default_rng(4)
    z = rng.normal(0, 1, 20)
    cost = lambda z: (np.logaddexp(0, -z[:8]).mean() + np.logaddexp(0, z[8:]).mean()) / 2
    for k, g in enumerate(quality.apart_gradient(z, 8)):
        step = np.zeros(20)
        step[k] = 1e-6
        assert g == pytest.approx((cost(z + step) - cost(z - step)) / 2e-6, abs=1e-7)


def test_classifier_without_negative_labels(spark):
    """Labels of 1 alone: junk is rejected all the same."""
    rng = np.random.default_rng(2)
    words = ["the", "river", "carries", "water", "from", "hills", "to", "towns", "and", "people", "drink", "it", "every", "day"]
    good = [" ".join(rng.choice(words, 40)).capitalize() + "." for _ in range(900)]
    junk = ["".join(rng.choice(list("$#@!0123456789 |"), 200)) for _ in range(600)]
    d = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    rows = quality.classify(d, labels).collect()
    assert quality.train(d, labels).prior == pytest.approx(0.6, abs=0.1)
    assert np.mean([r["predicted"] for r in rows if r["doc_id"] >= 900]) < 0.02
    assert np.mean([r["predicted"] for r in rows if r["doc_id"] < 900]) > 0.98


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs(spark), labels).collect()} == {0.5}
    assert quality.classify(docs(spark, []), labels).count() == 0
    kept = quality.keep_good(docs(spark), labels)
    assert kept.columns == ["doc_id", "text", "word", "_score"] and kept.count() == len(TEXTS)


def test_classifier_rows_that_share_an_id(spark, monkeypatch):
    """What is learned from stays within its bound, however often ids and rows are repeated."""
    sizes = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: sizes.append((len(p), len(u))) or fit(p, u, prior))
    monkeypatch.setattr(quality, "MAX_UNLABELLED", 20)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[0], f"text {k} of one id", 3, "w") for k in range(300)] + [(i, f"some words {i}", 3, "w") for i in ids] + [(None, "none", 3, "w"), (None, "x" * 300_000, 3, "w")]
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)] + [(ids[1], 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, word long, _score string"), labels).collect()
    assert len(got) == len(rows) and sizes == [(len(ids) // 2, 20)]


def test_risk_by_hand():
    """The risk and its gradient against plain sums and finite differences, on both sides of zero."""
    rng = np.random.default_rng(3)
    for shift in (0.0, -4.0):
        z = rng.normal(0, 1, 30)
        z[12:] += shift
        cost = lambda z: [0.4 * np.mean([math.log1p(math.exp(-x)) for x in z[:12]]), np.mean([math.log1p(math.exp(x)) for x in z[12:]]) - 0.4 * np.mean([math.log1p(math.exp(x)) for x in z[:12]])]
        good, bad = cost(z)
        risk, g = quality.risk_gradient(z, 12, 0.4)
        assert risk == pytest.approx(good + max(0.0, bad)) and (bad < 0) == (shift < 0)
        of = (lambda z: sum(cost(z))) if bad >= 0 else (lambda z: -cost(z)[1])
        for k in (0, 5, 12, 29):
            step = np.zeros(30)
            step[k] = 1e-6
            assert g[k] == pytest.approx((of(z + step) - of(z - step)) / 2e-6, abs=1e-7)


def test_risk_is_not_negative_and_learns():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (900, 4)), rng.normal(-1, 1, (900, 4))
    model = quality.fit(good[:300], np.concatenate([good[300:600], bad[:600]]), 1 / 3)
    right = (model.scores(good[600:]) > 0.5).mean() + (model.scores(bad[600:]) <= 0.5).mean()
    assert right > 1.8


def test_hidden_is_read_from_names_and_style_only():
    from pathloom.llm.html_blocks import blocks

    shown = '<article title="the hidden cost of tea">a</article><div class="md:flex hidden lg:block">b</div><div data-state="hidden" aria-hidden="false">c</div><p title="display:none" id=hidden>d</p><p data-hidden>e</p>'
    gone = '<p hidden>x</p><p HIDDEN="">x</p><p aria-hidden="TRUE">x</p><p style="color:red;display : none">x</p><div hidden=until-found><p>x</p></div>f<b hidden>x</b>'
    assert [b.text for b in blocks(shown + gone)] == list("abcdef")


def test_broken_tags_keep_the_text_behind_them():
    from pathloom.llm.html_blocks import blocks

    text = lambda html: "|".join(b.text for b in blocks(html))
    assert text('<p title="oops>one</p><p>two</p>') == "one|two"
    assert text("a < b and <c") == "a < b and <c"
    assert text("<p>x</p><p y='") == "x|<p y='"
    assert text("<a href=/x/>in<br/>side") == "in side"
    assert text("<ul><li>one<li>two</ul><table><tr><td>3<td>4</table>") == "one|two|3|4"


@pytest.mark.parametrize("html", ["<a " * 330_000, '<a t="' * 140_001, "<p title='" * 100_001 + ">", "<a x=" * 200_000 + ">", "<div>" * 100_000 + "</x>" * 100_000, "<li><div>" * 100_000, "<p><td>" + "<div>" * 100_000 + "</p>" * 100_000, "<b hidden>" * 100_000, "<a" + " " * 1_000_000])
def test_hostile_pages_take_linear_time(html):
    import time

    from pathloom.llm.html_blocks import blocks

    began = time.thread_time()
    blocks(html + "<p>the end</p>")
    assert time.thread_time() - began < 6  # a quadratic scan of a megabyte takes hours
