"""Benchmark decontamination: a broadcast hash set of the test items' word windows, scanned over training texts.

Texts are lower-cased (A-Z) and cut into words.  A window is WINDOW consecutive words of an item, or all words of a shorter
one.  The distinct windows of a block of items are a hash set: sorted 64-bit hashes over word numbers, without a clash, beside
the windows themselves.  Tasks scan every window of every training text whose words all occur in the block, look its hash
up, and compare the words of each hit with those of the window, so no result rests on a hash.  What comes out are the hit
words as spans, and the items; `cleaned` removes the spans, or the documents that have any.

The hash set is broadcast in blocks of items of at most BLOCK_BYTES of text, which is counted; items beyond that make
further blocks, each with a scan of its own, whose hits are joined by row.  Long items are cut into overlapping pieces and
long words are known by their digests, so that a block keeps its bound whatever the items are.

Defined results: a null text has no words; items without words have no window; rows that share an item id are one item of
several texts; items without an id mark words but are not listed; repeated rows of documents are scanned each; very long
texts are read whole, a stretch at a time; empty tables give no hits, or no rows; other columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pathloom.llm._common import keyed, small, unused, written

WINDOW = 10
#: Bytes of items in one broadcast block, of a piece of a long item, and of text that is cut into words at once.
BLOCK_BYTES, PIECE_BYTES, STRETCH = 4 << 20, 64 << 10, 1 << 20
#: Words of more bytes are known by their SHA-256.
LONG_WORD = 64
#: Places of a text that are looked up at once.
LOOKUPS = 1 << 18

_LETTERS = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_SPELLED = bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))


def spelled(text: bytes) -> bytes:
    """text in lower case, with a space for each byte between words; no byte moves."""
    return text.translate(_SPELLED)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a spelled text, a stretch at a time."""
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + STRETCH)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def word_key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b" " + hashlib.sha256(word).digest()  # no word starts with a space


def pieces(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (string), n (its words), words (array<binary>): items in pieces that share WINDOW - 1 words with the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = [word_key(w) for part in words_of(spelled((text.as_py() or "").encode())) for w in part]
                lo = 0
                while lo < len(words):
                    size, hi = 0, lo
                    while hi < len(words) and (size < PIECE_BYTES or hi < lo + WINDOW):
                        size, hi = size + len(words[hi]) + 1, hi + 1
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([words[lo:hi]], pa.list_(pa.binary()))], names=["item", "words"])
                    lo = hi - WINDOW + 1 if hi < len(words) else hi

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "item string, words array<binary>")


class WindowSet:
    """The distinct windows of a block of pieces, by size: sorted hashes, the windows' word numbers, and their items."""

    def __init__(self, block: Sequence[tuple[str | None, Sequence[bytes]]]):
        names = sorted({item for item, _ in block if item is not None})
        number = {item: k for k, item in enumerate(names)} | {None: -1}
        self.items, self.vocabulary = names, {}
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, words in block:
            ids = np.array([self.vocabulary.setdefault(bytes(w), len(self.vocabulary) + 1) for w in words], np.uint64)
            by_size.setdefault(min(WINDOW, len(ids)), []).append((ids, number[item]))
        self.long_words = any(w.startswith(b" ") for w in self.vocabulary)
        self.sizes = {n: self._set(n, parts) for n, parts in sorted(by_size.items())}

    @staticmethod
    def _set(n: int, parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...]:
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, n) for ids, _ in parts])
        owner = np.concatenate([np.full(len(ids) - n + 1, item) for ids, item in parts])
        seed = 0
        while True:  # hashes without a clash between different windows
            factors = np.random.default_rng([n, seed]).integers(0, 2**64, n, np.uint64) | np.uint64(1)
            hashes = (rows * factors).sum(axis=1, dtype=np.uint64)
            order = np.lexsort((owner, hashes))
            h, r, o = hashes[order], rows[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            if (new[1:] | (r[1:] == r[:-1]).all(axis=1)).all():
                break
            seed += 1
        return factors, h[new], r[new], np.append(np.flatnonzero(new), len(h)), o

    def numbers(self, text: bytes) -> np.ndarray:
        """The word numbers of a spelled text, 0 for words that no item has."""
        get = self.vocabulary.get
        key = word_key if self.long_words else None
        out = [np.fromiter(map(get, map(key, words) if key else words, repeat(0)), np.uint32, len(words)) for words in words_of(text)]
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(rows of first word and end of each maximal run of hit words, the items whose windows occur)."""
        cover, items = np.zeros(len(ids) + 1, np.int64), set()
        strange = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (factors, hashes, windows, first, owner) in self.sizes.items():
            if len(ids) < n:
                continue
            places = np.flatnonzero(strange[n:] == strange[:-n])
            seen = [np.zeros(0, np.int64)]
            for lo in range(0, len(places), LOOKUPS):
                at = places[lo : lo + LOOKUPS]
                mine = ids[at[:, None] + np.arange(n)].astype(np.uint64)
                h = (mine * factors).sum(axis=1, dtype=np.uint64)
                row = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[row] == h)
                hit = hit[(windows[row[hit]] == mine[hit]).all(axis=1)]
                np.add.at(cover, at[hit], 1)
                np.add.at(cover, at[hit] + n, -1)
                seen.append(np.unique(row[hit]))
            for r in np.unique(np.concatenate(seen)):
                items.update(owner[first[r] : first[r + 1]].tolist())
        hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        return edges.reshape(-1, 2), [self.items[k] for k in sorted(items - {-1})]


_SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _spans(runs: list[np.ndarray]) -> pa.Array:
    """Spans of several rows as one Arrow list column."""
    flat = np.concatenate([np.zeros((0, 2), np.int64), *runs])
    values = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], names=["first", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) for r in runs)]), pa.int32()), values).cast(_SPANS)


def _scanned(rows: DataFrame, text_col: str, block: Sequence[tuple[str | None, Sequence[bytes]]], passing: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The columns passing, n_words, spans and items (under names) of each row, against one block."""
    shared = rows.sparkSession.sparkContext.broadcast(WindowSet(block))  # of at most BLOCK_BYTES of items
    schema = T.StructType([*(rows.schema[c] for c in passing), *(T.StructField(n, f.dataType) for n, f in zip(names, _FOUND, strict=True))])
    columns = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column(0).cast(pa.binary()):
                ids = windows.numbers(spelled(text.as_py() or b""))
                runs, found = windows.scan(ids)
                n_words.append(len(ids))
                spans.append(runs)
                items.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n_words, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.string()))], names=columns)

    return rows.select(F.col(text_col).cast("string").alias("_scanned"), *passing).mapInArrow(run, schema)


def joined_spans(spans: list[dict]) -> np.ndarray:
    """Spans in any order as maximal runs."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    x = np.array(sorted((s["first"], s["end"]) for s in spans), np.int64)
    end = np.maximum.accumulate(x[:, 1])
    new = np.concatenate([[True], x[1:, 0] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)
    return np.stack([x[new, 0], end[last]], axis=1)


def blocks_of(items: DataFrame, id_col: str, text_col: str, most: int) -> list[DataFrame]:
    """Pieces of items, dealt into as many blocks as it takes for each to hold at most so many bytes; all is counted."""
    held = written(pieces(items, id_col, text_col).distinct(), "test-items")
    size = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.octet_length(w) + 1) + F.coalesce(F.octet_length("item"), F.lit(0))
    total, largest = held.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    most = max(most, largest)  # a piece is some PIECE_BYTES at most
    n = max(1, -(-2 * total // most)) if total > most else 1
    while True:
        at = F.pmod(F.xxhash64("item", "words"), F.lit(n))
        if n == 1 or held.groupBy(at.alias("at")).agg(F.sum(size).alias("s")).filter(F.col("s") > most).isEmpty():
            return [held.filter(at == b) for b in range(n)]
        n *= 2


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", passing: Sequence[str] | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, tuple[str, str, str]]:
    """(The columns passing (all, if not given) of docs with three more, the names of those: n_words, spans and items).

    spans are the maximal runs of hit words, items the distinct ids of the items whose windows occur.
    """
    passing = list(docs.columns if passing is None else passing)
    names = tuple(unused(f.name, passing) for f in _FOUND)
    blocks = blocks_of(items, item_id, item_text, block_bytes)
    taken = [[(r["item"], r["words"]) for r in b.collect()] for b in blocks[:1]]  # block_bytes at most
    if len(blocks) == 1:
        return _scanned(docs, text_col, taken[0], passing, names), names
    rows, key = keyed(docs, list(names))
    first = _scanned(rows, text_col, taken[0], [*passing, key], names)
    other = [unused(f"{key}_{n}", [*passing, *names]) for n in names]
    more = []
    for b in blocks[1:]:
        block = [(r["item"], r["words"]) for r in b.collect()]  # block_bytes at most
        more.append(written(_scanned(rows, text_col, block, [key], other).filter(F.size(other[1]) > 0).drop(other[0]), "hits"))
    lists = reduce(DataFrame.unionByName, more).groupBy(key).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in other[1:]))  # hits of one row
    both = first.join(small(written(lists, "hits")), key, "left").drop(key)
    every = F.array_sort(F.array_distinct(F.concat(names[2], F.coalesce(other[2], F.array().cast("array<string>")))))
    both = both.withColumns({names[1]: F.concat(names[1], F.coalesce(other[1], F.array().cast(_FOUND["spans"].dataType))), names[2]: every}).select(*passing, *names)
    schema, place = both.schema, len(passing) + 1

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = _spans([joined_spans(s) for s in batch.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], runs, batch.column(place + 1)], names=batch.schema.names)

    return both.mapInArrow(join, schema), names


def without(text: bytes, spans: list[dict]) -> bytes:
    """text without the bytes from the first to the last word of each span."""
    letters = np.concatenate([[False], np.frombuffer(spelled(text), np.uint8) != 0x20, [False]])
    edges = np.flatnonzero(letters[1:] != letters[:-1])
    out, at = [], 0
    for s in spans:
        out.append(text[at : edges[2 * s["first"]]])
        at = int(edges[2 * s["end"] - 1])
    return b"".join([*out, text[at:]])


def cleaned(docs: DataFrame, items: DataFrame, remove: str = "spans", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without hit words (remove="spans"), or without the documents that have any (remove="documents"); same columns."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"unknown way {remove!r}")
    found, (n_words, spans, hit_items) = scan(docs, items, text_col, item_id, item_text, None, block_bytes)
    if remove == "documents":
        return found.filter(F.size(spans) == 0).select(*docs.columns)
    found = found.drop(n_words, hit_items)
    place, schema = docs.columns.index(text_col), docs.schema
    arrow = to_arrow_schema(schema).field(place).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            runs = columns.pop()
            if any(len(s) for s in runs):
                texts = [without(t.encode(), s).decode() if s else t for t, s in zip(columns[place].to_pylist(), runs.to_pylist(), strict=True)]
                columns[place] = pa.array(texts, arrow)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(run, schema)


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items: a row a document."""
    found, (n_words, spans, hit_items) = scan(docs, items, passing=[id_col], block_bytes=block_bytes)
    ids = F.array_sort(hit_items)
    return found.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(n_words).alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"]).alias("n_hit"), F.size(hit_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"), F.col(spans).alias("spans"), ids.alias("items"),
    )
