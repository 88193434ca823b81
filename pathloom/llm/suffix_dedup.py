"""Removal of repeated passages of at least 100 bytes with longest-previous-factor arrays.

Every 100-byte window holds 69 32-byte grams; the one of least hash is its anchor.  Consecutive windows with one anchor
form a run (at most 69 windows, 168 bytes).  Equal windows have equal anchors, so only runs whose anchors are equal need
comparing.  Hashes only bring together what may be equal; that a window occurs earlier is always read from a suffix order
of the bytes, whose previous and next smaller positions give the longest previous factor of each position: where it reaches
100, the window goes.  That happens in four places, all over packed arrays that are dealt by a hash:

1. In each task, over the stretches of its texts whose anchors it meets more than once, a bounded block at a time.  A passage
   that a third of all documents share goes on from there once a block.
2. Runs of different bytes with one anchor are brought together in reading order.
3. Of runs with equal bytes (by 128 bits of hash), each meets the one before it in reading order; neighbouring runs of two
   documents make one stretch.  So no source is asked for by more than one copy.
4. Anchors with very many different runs are not brought together: their windows are dealt one by one by 128 bits of hash,
   and each meets the one before it as in 3.

One text exchange serves the cutting of runs and stretches and the final removal.

Defined results: a null text counts as empty; texts under 100 bytes lose nothing; of equal windows the one of the smallest
id stays, in one document the earliest; a null id comes after all others; rows that share an id, or have none, are documents
of their own, in any order, so repeated rows lose what repeats; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import numbered, short, shuffle_partitions, small, unused, written

WINDOW, GRAM = 100, 32
GRAMS = WINDOW - GRAM + 1
#: Different runs that one anchor may have before its windows are dealt one by one.
MOST_RUNS = 2_000
#: An anchor with so many different runs in one task, or this share of all documents, is dealt by run from the start.
HOT_IN_TASK, HOT_SHARE = 8, 0.001
#: Runs that a task counts before it reports anchors.
COUNTED_RUNS = 1_000_000
#: Bytes worked on at once, anchors in one bucket and bytes of text in one bucket, on average.
CHUNK_BYTES, BUCKET_ANCHORS, BUCKET_BYTES = 500_000, 400_000, 2_000_000
#: Bytes of text that a task holds, and bytes and strings in one suffix order.
LOCAL_BYTES, BLOCK_BYTES, BLOCK_STRINGS = 2_500_000, 700_000, 20_000
_PLACE = np.uint64((1 << 30) - 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # public constants of the splitmix64 finaliser
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


_TABLES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES]


class Hashed:
    """Hashes of any stretch of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        size = 1 << max(19, len(data).bit_length())
        power, self.inverse = _powers(_BASES[which], size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of some texts: hash of the anchor, hash of the bytes, text, first window, windows."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = Hashed(data)
    gram = h.all(GRAM)
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    step = 1
    while step * 2 <= GRAMS:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(least) - (GRAMS - step)], least[GRAMS - step :])
    place = (least & _PLACE).astype(np.int64)
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        place[max(end - min(size, WINDOW - 1), 0) : end] = -1
    cuts = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [len(place)]])
    keep = place[first] >= 0
    first, last = first[keep], last[keep]
    text = np.searchsorted(ends, first, side="right")
    return gram[place[first]], h.of(first, last + (WINDOW - 1)), text, first - (ends - sizes)[text], last - first


# ---------------------------------------------------------------- longest previous factors


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.zeros(len(keys), np.uint64)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(new, dtype=np.uint64)
    return out


def _joined(ranks: list[np.ndarray]) -> np.ndarray:
    """Numbers in the order of some ranks, the first of them foremost."""
    out, most = ranks[0], int(ranks[0].max(initial=0))
    for r in ranks[1:]:
        top = int(r.max(initial=0)) + 1
        if (most + 1) * top >= 1 << 64:
            out, most = _ranks(out), len(out)
        out, most = out * np.uint64(top) + r, (most + 1) * top
    return out


def _nearest_smaller(order: np.ndarray, step: int) -> np.ndarray:
    """For each place of a suffix order, the nearest place before (step -1) or after (1) that holds a smaller position; -1 if none."""
    n = len(order)
    at = np.arange(n) + step
    at[(at < 0) | (at >= n)] = -1
    open_ = np.flatnonzero((at >= 0) & (order[at] > order))
    while len(open_):
        at[open_] = at[at[open_]]  # what is larger than its own nearest smaller is larger than all between
        open_ = open_[(at[open_] >= 0) & (order[at[open_]] > order[open_])]
    return at


def longest_previous(data: np.ndarray, bound: int = WINDOW, whole: bool = False) -> np.ndarray:
    """For each position of data (whole numbers), the length (up to bound) of the longest factor that also starts earlier.

    The suffix order, as far as bound needs, is made by ranks of 4, 12, 36 ... numbers.  whole: lengths below bound are
    given as 0; only what shares bound numbers with a neighbour in the order is then looked at.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 2 * bound, np.uint64)
    padded[:n] = data.astype(np.uint64) + 1
    levels, size = [(1, padded)], 1
    while size * 3 < bound:
        step = 4 if size == 1 else 3
        x = levels[-1][1]
        rest = len(x) - (step - 1) * size
        levels.append((size * step, _ranks(_joined([x[k * size : k * size + rest] for k in range(step)]))))
        size *= step
    top = levels[-1][1]
    cuts = sorted({*range(0, bound - size, size), bound - size}) if bound > size else [0]
    key = _joined([top[c : c + n] for c in cuts])
    order = np.argsort(key, kind="stable")
    near_equal = key[order[1:]] == key[order[:-1]]
    best = np.zeros(n, np.int64)
    if whole:
        tied = np.zeros(n, bool)
        tied[1:] |= near_equal
        tied[:-1] |= near_equal
        order = order[tied]
    for step in (-1, 1):
        near = _nearest_smaller(order, step)
        has = near >= 0
        i, j = order[has], order[near[has]]
        full = key[i] == key[j]
        best[i[full]] = bound
        if whole:
            continue
        i, j = i[~full], j[~full]
        common = np.zeros(len(i), np.int64)
        for size, rank in reversed(levels):
            for _ in range(4):
                a, b = i + common, j + common
                ok = np.maximum(a, b) < len(rank)
                a, b = np.minimum(a, len(rank) - 1), np.minimum(b, len(rank) - 1)
                common += np.where(ok & (rank[a] == rank[b]), size, 0)
        common = np.minimum(common, n - np.maximum(i, j))
        best[i] = np.maximum(best[i], np.minimum(common, bound))
    # What ends with the data shares only padding with others.
    return np.minimum(best, n - np.arange(n))


def repeated_windows(body: bytes, sizes: np.ndarray) -> np.ndarray:
    """Of some strings in reading order, put one after another: True where a window of one starts that also starts earlier."""
    k = len(sizes)
    where = np.arange(len(body)) + np.repeat(np.arange(k), sizes)
    symbols = np.zeros(len(body) + k, np.int64)
    symbols[np.cumsum(sizes) + np.arange(k)] = 256 + np.arange(k)  # each string ends in a number of its own
    symbols[where] = np.frombuffer(body, np.uint8)
    return longest_previous(symbols, WINDOW, True)[where] >= WINDOW


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    """Neighbouring strings of some sizes, a suffix order's worth at a time."""
    lo, total = 0, np.cumsum(sizes)
    while lo < len(sizes):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK_BYTES, "right"))
        hi = max(lo + 1, min(hi, lo + BLOCK_STRINGS))
        yield slice(lo, hi)
        lo = hi


def _spans(hit: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place in it, length) of the stretches of True over strings put one after another."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    ends = np.cumsum(sizes)
    of = np.searchsorted(ends, at, side="right")
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)]))
    return of[first], at[first] - (ends - sizes)[of[first]], np.diff(np.append(first, len(at)))


def _stretches(keys: tuple[np.ndarray, ...], start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, windows): runs in order, the places in it where a new stretch begins, and each stretch's windows.

    Runs of equal keys go into one stretch where each begins as the one before it ends, up to about a block.
    """
    order = np.lexsort((start, *keys[::-1]))
    new = np.ones(len(order), bool)
    s, m = start[order].astype(np.int64), n[order].astype(np.int64)
    new[1:] = s[1:] != s[:-1] + m[:-1]
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    part = np.cumsum(m) // (BLOCK_BYTES // 4)
    new[1:] |= part[1:] != part[:-1]
    first = np.flatnonzero(new)
    return order, first, np.add.reduceat(m, first) if len(first) else m


def local_repeats(texts: list[bytes], docs: np.ndarray, text: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some runs (text, start, n) of a task: whether all windows of each stand earlier in its block, and (doc, start, n) of all windows that do."""
    none = np.zeros(0, np.int64)
    order, first, windows = _stretches((docs[text], text), start, n)
    covered, gone = np.zeros(len(order), bool), [(none, none, none)]
    t, s = text[order[first]], start[order[first]].astype(np.int64)
    runs_in = np.diff(np.append(first, len(order)))
    for part in _blocks(windows + WINDOW - 1):
        size = windows[part] + WINDOW - 1
        if part.stop - part.start == 1 and size[0] < 2 * WINDOW:
            continue
        body = b"".join(texts[a][b : b + c] for a, b, c in zip(t[part].tolist(), s[part].tolist(), size.tolist(), strict=True))
        hit = repeated_windows(body, size)
        of, at, long = _spans(hit, size)
        gone.append((docs[t[part][of]], s[part][of] + at, long))
        sums = np.concatenate([[0], np.cumsum(hit)])
        mine = np.arange(first[part.start], first[part.stop] if part.stop < len(first) else len(order))
        base = np.repeat(np.cumsum(size) - size - s[part], runs_in[part])
        begin = base + start[order[mine]]
        covered[order[mine]] = sums[begin + n[order[mine]]] - sums[begin] == n[order[mine]]
    return covered, tuple(map(np.concatenate, zip(*gone, strict=True)))


# ---------------------------------------------------------------- packed arrays

_PACKED = "bucket int, part int, kind int, anchor binary, body_hash binary, doc binary, start binary, n binary, other binary, other_start binary, body binary"
_TYPES = {"anchor": np.uint64, "body_hash": np.uint64, "doc": np.int64, "start": np.int32, "n": np.int32, "other": np.int64, "other_start": np.int32}
#: RUN: a run (with its bytes, once they are cut); WINDOWS: single windows; REMOVED: windows that go; ASKED, ASKED_HOT: runs
#: whose bytes are wanted; COPY: windows (doc, start, n) that look like those at (other, other_start); SOURCE: the same, with the bytes of the latter.
RUN, WINDOWS, REMOVED, ASKED, ASKED_HOT, COPY, SOURCE = range(7)
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _packed(kind: int, part: np.ndarray, rows: dict[str, np.ndarray], bodies: list[bytes] | None = None, buckets: int | None = None) -> pa.RecordBatch:
    """One record per part, with the arrays of its rows; buckets: how many buckets the parts pass through on their way."""
    order = np.argsort(part, kind="stable")
    keys, at = np.unique(part[order], return_index=True)
    cut = np.split(order, at[1:]) if len(keys) else []
    columns = [[rows[k][p].astype(t).tobytes() if k in rows else None for p in cut] for k, t in _TYPES.items()]
    body = [b"".join(bodies[i] for i in p) if bodies is not None else None for p in cut]
    bucket = keys if buckets is None else keys % buckets
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(keys, pa.int32()), pa.array([kind] * len(keys), pa.int32()), *(pa.array(c, pa.binary()) for c in columns), pa.array(body, pa.binary())],
        names=_NAMES,
    )


def _of_kind(table: pa.Table | pa.RecordBatch, kind: int) -> list[int]:
    return [i for i, k in enumerate(table.column(_NAMES.index("kind")).to_pylist()) if k == kind]


def _unpacked(table: pa.Table | pa.RecordBatch, kind: int) -> dict[str, np.ndarray]:
    mine = _of_kind(table, kind)
    out = {}
    for name, t in _TYPES.items():
        column = table.column(_NAMES.index(name))
        out[name] = np.frombuffer(b"".join(column[i].as_py() or b"" for i in mine), t)
    return out


def _bodies(table: pa.Table | pa.RecordBatch, kind: int) -> bytes:
    column = table.column(_NAMES.index("body"))
    return b"".join(column[i].as_py() or b"" for i in _of_kind(table, kind))


def _passed(table: pa.Table, *kinds: int) -> Iterator[pa.RecordBatch]:
    """The records of some kinds, on to their parts."""
    rows = [i for k in kinds for i in _of_kind(table, k)]
    if rows:
        mine = table.take(pa.array(sorted(rows), pa.int64()))
        yield from mine.set_column(0, "bucket", mine.column(1)).to_batches()


def _part(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((mixed(key) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _doc_part(doc: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(doc, buckets)


def _chained(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of rows of equal anchor and body hash: the places of the first of each in reading order, and every other with the one before it."""
    order = np.lexsort((rows["start"], rows["doc"], rows["body_hash"], rows["anchor"]))
    later = np.zeros(len(order), bool)
    later[1:] = (rows["anchor"][order[1:]] == rows["anchor"][order[:-1]]) & (rows["body_hash"][order[1:]] == rows["body_hash"][order[:-1]])
    at = np.flatnonzero(later)
    mine, before = order[at], order[at - 1]
    copies = {k: rows[k][mine] for k in ("doc", "start", "n") if k in rows}
    return order[~later], copies | {"other": rows["doc"][before], "other_start": rows["start"][before]}


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    out, size = [], 0
    for text in column:
        out.append((text.as_py() or "").encode())
        size += len(out[-1])
        if size >= CHUNK_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


# ---------------------------------------------------------------- the steps


def _statistics(docs: DataFrame) -> DataFrame:
    """Per stretch of a task: (docs, bytes, anchors), and (anchor, c) of anchors with many different runs there."""
    names = ["docs", "bytes", "anchors", "anchor", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = count = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            anchor, body = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64),) * 2, *held, strict=True))
            order = np.lexsort((body, anchor))
            anchor, body = anchor[order], body[order]
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1])
            keys, c = np.unique(anchor[fresh], return_counts=True)
            hot = c >= max(HOT_IN_TASK, HOT_SHARE * n)
            keys, c = keys[hot].view(np.int64).tolist(), c[hot].tolist()
            columns = ([n] + [None] * len(keys), [size] + [None] * len(keys), [count] + [None] * len(keys), [None, *keys], [None, *c])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

        for batch in short(batches):
            n += batch.num_rows
            for texts in _texts(batch.column(1)):
                size += sum(map(len, texts))
                anchor, body, *_ = runs(texts)
                count += len(anchor)
                held.append((anchor, body))
            if count > COUNTED_RUNS:
                yield out()
                n = size = count = 0
                held.clear()
        yield out()

    return docs.mapInArrow(run, "docs long, bytes long, anchors long, anchor long, c long")


def _equal_runs(docs: DataFrame, hot: np.ndarray, buckets: int, doc_buckets: int) -> DataFrame:
    """What each task removes of its own, and the runs whose bytes are asked for, packed by document."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        ids: list[np.ndarray] = []
        found: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            docs_, (anchor, body, text, start, n) = np.concatenate(ids), map(np.concatenate, zip(*found, strict=True))
            _, of, count = np.unique(anchor, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[of] > 1)
            covered, (doc, at, long) = local_repeats(texts, docs_, text[again], start[again], n[again])
            yield _packed(REMOVED, _doc_part(doc, doc_buckets), {"doc": doc, "start": at, "n": long}, None, buckets)
            left = np.ones(len(anchor), bool)
            left[again[covered]] = False
            rows = {"anchor": anchor[left], "body_hash": body[left], "doc": docs_[text[left]], "start": start[left], "n": n[left]}
            spread = np.isin(rows["anchor"], hot)
            yield _packed(RUN, _part(np.where(spread, rows["anchor"] ^ rows["body_hash"], rows["anchor"]), buckets), rows)

        for batch in short(batches):
            done = 0
            for part in _texts(batch.column(1)):
                anchor, body, text, start, n = runs(part)
                found.append((anchor, body, text + len(texts), start, n))
                ids.append(batch.column(0).slice(done, len(part)).to_numpy())
                texts += part
                done += len(part)
                if sum(map(len, texts)) > LOCAL_BYTES:
                    yield from out()
                    texts, ids, found = [], [], []
        if texts:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        yield from _passed(table, REMOVED)
        rows = _unpacked(table, RUN)
        first, copies = _chained(rows)
        yield _packed(COPY, _doc_part(copies["other"], doc_buckets), copies)
        rows = {k: x[first] for k, x in rows.items() if len(x)}
        if not len(first):
            return
        _, of, count = np.unique(rows["anchor"], return_inverse=True, return_counts=True)
        spread = np.isin(rows["anchor"], hot) | (count[of] > MOST_RUNS)
        for kind, mine in ((ASKED, ~spread & (count[of] > 1)), (ASKED_HOT, spread)):
            asked = {k: rows[k][mine] for k in ("anchor", "doc", "start", "n")}
            yield _packed(kind, _doc_part(asked["doc"], doc_buckets), asked)

    return docs.mapInArrow(deal, _PACKED).repartitionById(buckets, "bucket").mapInArrow(meet, _PACKED)


def _cut_out(texts: DataFrame, asked: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    """The bytes that were asked for: of runs, packed by anchor, or by window where the anchor is hot; of sources, packed by the document of the copy."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        body = {i: (t or "").encode() for i, t in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True)}
        out = []
        rows = _unpacked(right, ASKED)
        strings = [body[d][s : s + n + WINDOW - 1] for d, s, n in zip(rows["doc"].tolist(), rows["start"].tolist(), rows["n"].tolist(), strict=True)]
        out.append(_packed(RUN, _part(rows["anchor"], buckets), {k: rows[k] for k in ("anchor", "doc", "start", "n")}, strings))
        rows = _unpacked(right, ASKED_HOT)
        for lo in range(0, len(rows["doc"]), 20_000):
            part = {k: rows[k][lo : lo + 20_000] for k in ("doc", "start", "n")}
            n = part["n"].astype(np.int64)
            joined = np.frombuffer(b"".join(body[d][s : s + m + WINDOW - 1] for d, s, m in zip(part["doc"].tolist(), part["start"].tolist(), n.tolist(), strict=True)), np.uint8)
            size = n + WINDOW - 1
            shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(np.cumsum(size) - size, n) + shift
            windows = {"anchor": Hashed(joined, 0).of(at, at + WINDOW), "body_hash": Hashed(joined, 1).of(at, at + WINDOW), "doc": np.repeat(part["doc"], n), "start": np.repeat(part["start"], n) + shift}
            out.append(_packed(WINDOWS, _part(windows["anchor"], buckets), windows))
        rows = _unpacked(right, COPY)
        order, first, windows = _stretches((rows["other"], rows["doc"], rows["other_start"] - rows["start"]), rows["start"], rows["n"])
        found = {k: rows[k][order[first]] for k in ("doc", "start", "other", "other_start")} | {"n": windows}
        strings = [body[d][s : s + n + WINDOW - 1] for d, s, n in zip(found["other"].tolist(), found["other_start"].tolist(), windows.tolist(), strict=True)]
        out.append(_packed(SOURCE, _doc_part(found["doc"], doc_buckets), found, strings, buckets))
        return pa.Table.from_batches(out)

    return texts.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(cut, _PACKED)


def _earlier(pieces: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    """What is removed of the runs that _cut_out has brought together, and which windows look alike, packed by document; sources go on."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        yield from _passed(table, SOURCE)
        rows = _unpacked(table, WINDOWS)
        _, copies = _chained({k: rows[k] for k in ("anchor", "body_hash", "doc", "start")})
        copies["n"] = np.ones(len(copies["doc"]), np.int32)
        yield _packed(COPY, _doc_part(copies["other"], doc_buckets), copies)
        rows, body = _unpacked(table, RUN), _bodies(table, RUN)
        size = rows["n"].astype(np.int64) + WINDOW - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((rows["start"], rows["doc"], rows["anchor"]))
        none = np.zeros(0, np.int64)
        gone, lo = [(none, none, none)], 0
        while lo < len(order):  # whole anchors, about 2,500 runs (350 kB) at a time
            hi = min(lo + 2_500, len(order))
            while hi < len(order) and rows["anchor"][order[hi]] == rows["anchor"][order[hi - 1]]:
                hi += 1
            mine = order[lo:hi]
            lo = hi
            hit = repeated_windows(b"".join(body[begin[i] : begin[i] + size[i]] for i in mine.tolist()), size[mine])
            of, at, long = _spans(hit, size[mine])
            gone.append((rows["doc"][mine][of], rows["start"][mine][of] + at, long))
        doc, start, n = map(np.concatenate, zip(*gone, strict=True))
        yield _packed(REMOVED, _doc_part(doc, doc_buckets), {"doc": doc, "start": start, "n": n})

    return pieces.repartitionById(buckets, "bucket").mapInArrow(meet, _PACKED)


def _confirmed(table: pa.Table, body: dict[int, bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, start, n) of the windows of copies that stand in their sources, read from suffix orders of both."""
    rows, text = _unpacked(table, SOURCE), _bodies(table, SOURCE)
    size = rows["n"].astype(np.int64) + WINDOW - 1
    begin = np.cumsum(size) - size
    for part in _blocks(2 * size):
        at = np.arange(part.start, part.stop)
        strings = [text[b : b + c] for b, c in zip(begin[part].tolist(), size[part].tolist(), strict=True)]
        strings += [body[d][s : s + c] for d, s, c in zip(rows["doc"][part].tolist(), rows["start"][part].tolist(), size[part].tolist(), strict=True)]
        doc, start = np.concatenate([rows["other"][part], rows["doc"][part]]), np.concatenate([rows["other_start"][part], rows["start"][part]])
        order = np.lexsort((np.repeat([0, 1], len(at)), start, doc))  # reading order, so what stands earlier here does so in the table
        sizes = np.concatenate([size[part], size[part]])[order]
        of, place, long = _spans(repeated_windows(b"".join(strings[i] for i in order.tolist()), sizes), sizes)
        copy = order[of] >= len(at)
        yield doc[order[of[copy]]], start[order[of[copy]]] + place[copy], long[copy]


def _kept(texts: DataFrame, removed: DataFrame, with_text: bool) -> DataFrame:
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        body = {i: (t or "").encode() for i, t in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True)}
        rows = _unpacked(right, REMOVED)
        parts = [tuple(rows[k].astype(np.int64) for k in ("doc", "start", "n")), *_confirmed(right, body)]
        doc, start, n = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((start, doc))
        doc, start, n = doc[order], start[order], n[order]
        out = []
        for i, data in body.items():
            lo, hi = np.searchsorted(doc, i, "left"), np.searchsorted(doc, i, "right")
            spans = 0
            kept = data
            if hi > lo:
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, np.minimum(start[lo:hi], len(data)), 1)
                np.add.at(edge, np.minimum(start[lo:hi] + n[lo:hi] + WINDOW - 1, len(data)), -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            out.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.groupBy("part").cogroup(removed.groupBy("part")).applyInArrow(finish, schema)


def _dedup(docs: DataFrame, with_text: bool) -> DataFrame:
    """Per row of docs (doc_id, text), of which no two share a doc_id: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept."""
    spark = docs.sparkSession
    statistics = written(_statistics(docs), "anchors")
    total = statistics.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "bytes", "anchors"))).first()
    least = max(MOST_RUNS / 4, HOT_SHARE * total["docs"])
    hot = statistics.filter("anchor is not null").groupBy("anchor").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("anchor").collect()  # at most mean anchors of a document / HOT_SHARE
    hot = np.sort(np.array([r["anchor"] for r in hot], np.int64).view(np.uint64))
    buckets = max(shuffle_partitions(spark), total["anchors"] // BUCKET_ANCHORS)  # each is a partition
    doc_buckets = max(2 * shuffle_partitions(spark), total["bytes"] // BUCKET_BYTES)
    texts = docs.withColumn("part", F.pmod("doc_id", F.lit(doc_buckets)).cast("int"))
    found = written(_equal_runs(docs, hot, buckets, doc_buckets), "equal-runs")
    pieces = _cut_out(texts, found.filter(F.col("kind").isin(ASKED, ASKED_HOT, COPY)), buckets, doc_buckets)
    met = written(_earlier(pieces, buckets, doc_buckets), "met")
    removed = found.filter(F.col("kind") == REMOVED).unionByName(met.filter(F.col("kind").isin(REMOVED, SOURCE)))
    alike = met.filter(F.col("kind") == COPY)
    if not alike.isEmpty():
        removed = removed.unionByName(written(_cut_out(texts, alike, buckets, doc_buckets).filter(F.col("kind") == SOURCE), "alike"))
    return _kept(texts, removed, with_text)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) with with_text."""
    rows, key = numbered(docs, id_col)
    out = _dedup(rows.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), with_text).withColumnRenamed("doc_id", key)
    ids = written(rows.select(key, F.col(id_col).cast("long").alias("doc_id")), "ids")
    out = out.join(small(ids), key).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out if with_text else out.drop("kept")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from text, n_chars (where there is such a column) counted anew; other columns stay.

    A character of which a cut took some bytes goes whole.  Texts that lost nothing stay as they are.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.as_py().decode("utf-8", "ignore") for x in b.column(1)], pa.string())], names=["_id", "_kept"])

    rows, key = numbered(docs)
    kept = unused("_kept", rows.columns)
    texts = rows.select(F.col(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lost = _dedup(texts, True).filter("n_removed > 0").select("doc_id", "kept").mapInArrow(decode, "_id long, _kept string").toDF(key, kept)
    out = rows.join(lost, key, "left")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.char_length(kept).cast(docs.schema["n_chars"].dataType))
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
