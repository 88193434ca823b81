"""Main text of web pages by a recurrent block labeller.

A page is cut into text blocks; a bidirectional LSTM (numpy) reads the sequence of all blocks, each as hashed vectors of
its tag path and words with a few shares, and labels every block as main text or not with the whole page as context.  The
model is trained on pages that a seeded generator makes up: articles in several layouts among menus, headers, footers,
sidebars, notices, adverts, forms and comments, with invented words.  Training takes seconds, on the driver, once for each
process; the weights (under 1 MB) go to the tasks.

Defined results: null and empty pages give an empty text; very long pages are read whole, a bounded number of blocks at a
time with the states of both networks handed on; repeated rows are read each; an empty table gives no rows; unclosed tags and open quotes end with the page; white space is what Python's split takes for it; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm._common import short
from pathloom.llm.html_blocks import Block, blocks

PATH_SLOTS, LEAF_SLOTS, WORD_SLOTS, SHARES = 512, 32, 32, 9
WIDTH = PATH_SLOTS + LEAF_SLOTS + WORD_SLOTS + SHARES
HIDDEN, EPOCHS, PAGES, BATCH, RATE, SEED = 16, 9, 3000, 64, 0.01, 11
#: Pages labelled at once, and blocks in all of them at most (a page of more blocks goes alone, so many at a time).
LABEL_PAGES, LABEL_BLOCKS = 256, 20_000
#: Paths whose vectors are kept while a page is read.
KEPT_PATHS = 2_000


@lru_cache(maxsize=100_000)
def _slot(name: str, probe: int, slots: int) -> int:
    return crc32(f"{probe}:{name}".encode()) % slots


_PUNCTUATION = re.compile(r"[.,;:!?]")


def vectors(page: list[Block], low: int = 0, high: int | None = None, total: int | None = None) -> np.ndarray:
    """One row per block, of those from low to high; total: characters of the page."""
    mine = page[low:high]
    x = np.zeros((len(mine), WIDTH), np.float32)
    total = max(1, sum(len(b.text) for b in page)) if total is None else total
    known: dict[tuple, np.ndarray] = {}
    for i, b in enumerate(mine):
        row = known.get(b.path)
        if row is None:
            if len(known) >= KEPT_PATHS:
                known.clear()
            row = np.zeros(PATH_SLOTS + LEAF_SLOTS, np.float32)
            for element in b.path:
                for name in element:
                    for probe in (0, 1):
                        row[_slot(name, probe, PATH_SLOTS)] = 1
            if b.path:
                row[PATH_SLOTS + _slot(b.path[-1][0], 2, LEAF_SLOTS)] = 1
            known[b.path] = row
        x[i, : len(row)] = row
        words = b.text.split()
        for w in set(words):  # a vector of shares
            x[i, len(row) + crc32(w.lower().encode("utf-8", "replace")) % WORD_SLOTS] += 0.5 / len(words)
        n = len(b.text)
        x[i, -SHARES:] = (
            min(1, n / 100), min(1, n / 400), min(1, len(words) / 8), b.linked / n, len(_PUNCTUATION.findall(b.text)) / max(1, len(words)),
            b.text[-1] in ".!?…", len(b.path) / 10, (low + i) / len(page), n / total,
        )
    return x


# ---------------------------------------------------------------- the model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one from each end, and a linear layer over both states."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN))
            w[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["out"], w["bias"] = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool, state: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """States (time, page, HIDDEN); padding leaves a state as it is.  state: what to start from, replaced by where it ends."""
        wx, wh, c0 = (self.weights[k + d] for k in "xhc")
        steps, n = mask.shape
        inner = x @ wx + c0
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inner[t] + h @ wh
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[t][:, None]
            c_new = f * c + i * g
            tanh = np.tanh(c_new)
            if keep:
                tape.append((t, i, f, o, g, tanh, c, h, m))
            h, c = np.where(m, o * tanh, h), np.where(m, c_new, c)
            out[t] = h
        if state is not None:
            state[:] = [h, c]
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(d, x, mask, False)[0] for d in "fb"], axis=2)
        return both @ self.weights["out"] + self.weights["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over all blocks, through time."""
        runs = {d: self._run(d, x, mask, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        error = (np.where(mask, _sigmoid(both @ self.weights["out"] + self.weights["bias"]) - y, 0) / mask.sum()).astype(np.float32)
        grads = {"out": np.einsum("tn,tnh->h", error, both), "bias": np.array([error.sum()])}
        for k, d in enumerate("fb"):
            wh, back = self.weights[f"h{d}"], error[:, :, None] * self.weights["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all, g_wh = np.zeros((*mask.shape, 4 * HIDDEN), np.float32), np.zeros_like(wh)
            dh, dc = np.zeros(back.shape[1:], np.float32), np.zeros(back.shape[1:], np.float32)
            for t, i, f, o, g, tanh, c_before, h_before, m in reversed(runs[d][1]):
                dh = dh + back[t]
                inside = np.where(m, dh, 0)
                dcell = np.where(m, dc, 0) + inside * o * (1 - tanh**2)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * c_before * f * (1 - f), inside * tanh * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                g_wh += h_before.T @ dz
                dh = dz @ wh.T + np.where(m, 0, dh)
                dc = np.where(m, dcell * f, dc)
            grads[f"x{d}"] = x.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * HIDDEN)
            grads[f"h{d}"], grads[f"c{d}"] = g_wh, dz_all.sum((0, 1))
        return grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Per page, whether each block is main text; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            take = max(1, min(LABEL_PAGES, LABEL_BLOCKS // len(pages[order[-1]])))
            mine, order = order[-take:], order[:-take]
            x, mask = padded([pages[i] for i in mine])
            good = self.logits(x, mask) > 0
            for k, i in enumerate(mine):
                out[i] = good[: len(pages[i]), k]
        return out


    def label_long(self, page: list[Block], size: int = LABEL_BLOCKS) -> np.ndarray:
        """Whether each block of a page is main text, with the vectors of size blocks in memory at a time."""
        total = max(1, sum(len(b.text) for b in page))
        logits = np.full(len(page), self.weights["bias"][0], np.float32)
        for k, d in enumerate("fb"):
            weight, state = self.weights["out"][k * HIDDEN : (k + 1) * HIDDEN], [np.zeros((1, HIDDEN), np.float32)] * 2
            lows = range(0, len(page), size)
            for low in lows if d == "f" else reversed(lows):
                x = vectors(page, low, low + size, total)[:, None]
                logits[low : low + size] += self._run(d, x, np.ones(x.shape[:2], bool), False, state)[0][:, 0] @ weight
        return logits > 0

    def label_blocks(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """label for pages as blocks; no more than LABEL_BLOCKS vectors are made at a time."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            most = len(pages[order[-1]])
            take = max(1, min(LABEL_PAGES, LABEL_BLOCKS // most))
            mine, order = order[-take:], order[:-take]
            found = [self.label_long(pages[mine[0]])] if most > LABEL_BLOCKS else self.label([vectors(pages[i]) for i in mine])
            for i, good in zip(mine, found, strict=True):
                out[i] = good
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# ---------------------------------------------------------------- training pages


class PageMaker:
    """Makes up pages of which each block is known to be main text or not.

    Main blocks carry the private-use sign MARK in front, which is taken off before anything else reads them.
    """

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        letters = self.pick("etaoinshrdlu", "enisratdhul", "easnrolctid", "aeioubcdfglmnprst")
        return "".join(letters[i] for i in self.rng.integers(0, len(letters), int(self.rng.integers(2, 10))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high + 1))))

    def odd(self) -> str:
        """Repeated words, words with signs, numbers, one-word lines."""
        w = self.word()
        return self.pick(
            " ".join([w.capitalize()] * int(self.rng.integers(3, 30))),
            " ".join(f"{self.word()}{self.pick('%%%', '***', '###', '&amp;&amp;&amp;', '$$$')}" for _ in range(int(self.rng.integers(1, 40)))),
            " ".join(f"{a} " * int(self.rng.integers(4, 15)) for a in self.words(1, 4).split()),
            " ".join(str(n) for n in self.rng.integers(0, 9999, int(self.rng.integers(1, 12)))),
            f"{w}@{self.word()}.com, {self.rng.integers(100, 999)}-{self.rng.integers(1000, 9999)}",
            f"{w.capitalize()}.", w.upper(), f"{self.words(3, 9)} {self.rng.integers(0, 9)}.0.",
        )

    def prose(self, low: int = 5, high: int = 60) -> str:
        if self.chance(0.15):
            return self.odd()
        text = ". ".join(self.words(low, max(low, high // 3)).capitalize() for _ in range(int(self.rng.integers(1, 4)))) + self.pick(".", ".", ".", "?", "!", "")
        if self.chance(0.2):
            text = f"{text} <{(t := self.pick('b', 'em', 'a href=x', 'span', 'code'))}>{self.words(1, 4)}</{t.split()[0]}> {self.words(1, 8)}."
        return text

    def links(self, wrap: str = "ul") -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(int(self.rng.integers(2, 9)))]
        return f"<{wrap}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{wrap}>" if self.chance(0.7) else " | ".join(items)

    def named(self, tag: str, *names: str) -> str:
        name = f'{self.pick(*names)}{self.pick("", "", "-" + self.word(), " " + self.word())}'
        if self.chance(0.15):  # among many class words that tell nothing
            around = self.words(3, 16).split()
            at = int(self.rng.integers(0, len(around) + 1))
            return f'<{tag} class="{" ".join([*around[:at], name, *around[at:]])}">'
        return f'<{tag} {self.pick("class", "class", "id")}="{name}">'

    def main(self) -> str:
        """Blocks of an article."""
        m, out = self.MARK, []
        if self.chance(0.8):
            out.append(f"<{(h := self.pick('h1', 'h1', 'h2'))}>{m}{self.odd() if self.chance(0.1) else self.words(2, 14)}</{h}>")
        for _ in range(int(self.rng.choice([0, 1, 2, 3, 5, 8, 14], p=[0.06, 0.14, 0.15, 0.2, 0.2, 0.15, 0.1]))):
            kind = self.rng.random()
            if kind < 0.66:
                out.append(f"<p>{m}{self.prose(1 if self.chance(0.25) else 5)}" + self.pick("</p>", "</p>", ""))
            elif kind < 0.74:
                out.append(f"<p><b>{m}{self.prose()}<br>")
            elif kind < 0.82:
                out.append(f"<{(h := self.pick('h2', 'h3', 'h4'))}>{m}{self.words(1, 8)}</{h}>")
            elif kind < 0.88:
                out.append(f"<{(u := self.pick('ul', 'ol'))}>" + "".join(f"<li>{m}{self.words(1, 20)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + f"</{u}>")
            elif kind < 0.92:
                out.append(f"<blockquote>{m}{self.prose()}</blockquote>")
            elif kind < 0.95:
                out.append(f"<pre>{m}{self.words(3, 20)}</pre>")
            elif kind < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.words(1, 4)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(self.advert())
        return "".join(out)

    def advert(self) -> str:
        return self.named(t := self.pick("div", "div", "aside", "section"), "ad", "ads", "advert", "sponsored", "promo", "banner ad", "advertisement") + self.pick(self.prose(), self.words(2, 12), f"<p>{self.prose()}</p>") + f"</{t}>"

    def menu(self) -> str:
        if self.chance(0.6):
            return f"<nav>{self.links()}</nav>"
        return self.named("div", "nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "navigation", "toc", "pagination", "tags", "share") + self.links() + "</div>"

    def header(self) -> str:
        inner = self.pick(f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 6)}</div>", f"<p>{self.prose()}</p>") + self.pick("", self.menu())
        return f"<header>{inner}</header>" if self.chance(0.6) else self.named("div", "header", "masthead", "topbar", "site-header") + inner + "</div>"

    def footer(self) -> str:
        inner = self.pick(f"&copy; {self.words(1, 3)} &middot; {self.prose()}", f"<p>&copy; {self.words(1, 8)}</p>", self.prose(), self.links(), f"<p>{self.prose()}</p>{self.links()}")
        return f"<footer>{inner}</footer>" if self.chance(0.7) else self.named("div", "footer", "site-footer", "copyright", "bottom legal") + inner + "</div>"

    def sidebar(self) -> str:
        inner = self.pick(f"<h3>{self.words(1, 4)}</h3>{self.links()}", f"<p>{self.prose()}</p>", f"<h2>{self.words(1, 4)}</h2><p>{self.prose()}</p>", f"<div>{self.words(1, 12)}</div>{self.links()}")
        return f"<aside>{inner}</aside>" if self.chance(0.5) else self.named("div", "sidebar", "widget", "related", "recommended", "popular", "newsletter", "author-box", "side", "trending") + inner + "</div>"

    def notice(self) -> str:
        return self.named(t := self.pick("div", "section", "div"), "cookie", "cookie-notice", "consent", "banner notice", "gdpr", "alert", "paywall", "subscribe", "popup", "modal", "notice") + self.pick(f"<p>{self.prose()}</p>", self.prose(), self.words(4, 20)) + f"</{t}>"

    def form(self) -> str:
        return f'<form action="/{self.word()}">' + self.pick("", f"<label>{self.words(1, 4)}</label>", f"<p>{self.prose()}</p>") + f'<input name="q">{self.words(1, 5)}<button>{self.word()}</button></form>'

    def comments(self) -> str:
        each = lambda: self.named(u := self.pick("div", "article", "li"), "comment", "comment-body", "reply") + f"<p>{self.prose()}</p>" + self.pick("", f"<span>{self.words(1, 3)}</span>") + f"</{u}>"
        inner = "".join(each() for _ in range(int(self.rng.integers(1, 5)))) if self.chance(0.7) else "".join(f"<p>{self.prose()}</p>" for _ in range(int(self.rng.integers(1, 4))))
        return self.named(t := self.pick("div", "section"), "comments", "comment-list", "disqus", "discussion", "responses", "user-comments") + self.pick("", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 3)}</h3>") + inner + f"</{t}>"

    def page(self) -> str:
        body = self.main()
        shell = self.rng.random()
        inside = self.pick("", "", "", self.comments(), self.sidebar(), self.notice(), self.form())
        if shell < 0.55:
            body = self.pick("<article>", "<article>", self.named("article", "post", "entry", self.word())) + body + inside + "</article>"
        elif shell < 0.65:
            body = f"<main>{body}</main>"
        elif shell < 0.7:  # a layout table, its cells without names
            side = self.pick(self.links(), self.links("ol"), f"<h3>{self.words(1, 3)}</h3>{self.links()}")
            cells = [f"<td>{side}</td>", f"<td>{body}</td>"]
            body = "<table><tr>" + "".join(cells if self.chance(0.7) else cells[::-1]) + "</tr></table>"
        elif shell < 0.92:
            body = self.named("div", "content", "post", "entry-content", "article-body", "main-content", "post-body", "story", "text", "article", "main") + body + "</div>"
        else:
            body = f"<div>{body}</div>"
        if self.chance(0.25):
            body = f"<main>{body}</main>" if self.chance(0.5) else f"<div class='{self.pick('wrapper', 'container', 'page', 'row', self.word())}'>{body}</div>"
        makers = (self.menu, self.advert, self.header, self.notice, self.sidebar, self.form)
        before = "".join(self.pick(*makers)() for _ in range(int(self.rng.integers(0, 4))))
        after = "".join(self.pick(self.comments, self.sidebar, self.advert, self.footer, self.form, self.notice, self.menu)() for _ in range(int(self.rng.integers(0, 4))))
        if self.chance(0.6):
            after += self.footer()
        return f"<html><body>{before}{body}{after}</body></html>"


def labelled(html: str) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(html)
    truth = np.array([b.text.startswith(PageMaker.MARK) for b in found], bool)
    for b in found:
        b.text = b.text.replace(PageMaker.MARK, "").strip() or "-"
    return vectors(found), truth


@lru_cache(maxsize=1)
def trained() -> Labeller:
    """The same seeds give the same pages, the same order and so the same model."""
    maker, rng = PageMaker(SEED), np.random.default_rng(SEED)
    pages = [p for p in (labelled(maker.page()) for _ in range(PAGES)) if len(p[0])]
    pages.sort(key=lambda p: len(p[0]))
    model = Labeller.fresh(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    step = 0
    groups = [pages[i : i + BATCH] for i in range(0, len(pages), BATCH)]
    for epoch in range(EPOCHS):
        for g in rng.permutation(len(groups)):
            x, mask = padded([p[0] for p in groups[g]])
            y = np.zeros(mask.shape)
            for k, p in enumerate(groups[g]):
                y[: len(p[1]), k] = p[1]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-3
            for k, grad in model.gradients(x, mask, y).items():
                grad = np.clip(grad, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                model.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# ---------------------------------------------------------------- the operator


def texts_of(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    return ["\n".join(b.text for b, ok in zip(page, good, strict=True) if ok) for page, good in zip(found, model.label_blocks(found), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches, 2 * LABEL_PAGES):
            texts: list[str] = []
            for lo in range(0, b.num_rows, LABEL_PAGES):
                texts += texts_of(b.column(2).slice(lo, LABEL_PAGES).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr(f"cast({id_col} as long) page_id", f"{url_col} as url", f"{html_col} as html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
