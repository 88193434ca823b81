"""Spelling variant grouping: words one edit apart, found by their halves with sharded Aho-Corasick automata.

Of two words at one edit, the shorter (of equal ones, either) is cut into two segments, and one of these is whole in the other
word: the first at its start, or the second at its end.  So every word is held under its two segments, and looks, as the
longer word of a pair, for those of words one letter shorter.  Rows are dealt into shards by segment, so a word goes to the
four shards at most that can hold a partner of it.  A shard's automaton holds all of its segments; every word of the shard
is scanned, each segment found is checked for its offset and for the lengths of both words, and words under one segment are
compared.

Many words may share a segment.  Where more than HOT_ROWS do, the segment is given up for two longer pieces: what is left
between the known ends is halved again, and of two words at one edit one half is whole.  The same goes on inside a task
wherever more than FEW words meet, down to a single open letter, so no group is compared all with all.  A pair that several
pieces would find belongs to one of them: the one with the longest start that both words share (`limit`).

Words are counted in each task first; a shard sends one row a word: how many near words it saw, and the best.

Defined results: a null text has no words, and a null id is spelled as nothing; rows that share an id are rows of their own;
very long texts are read whole, a stretch at a time; of near words equally often the smaller one is the form; tables without
words, and empty ones, give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import settled, shuffle_partitions, small, written

SHORTEST, LEAST, DROP_EVERY, TIMES = 7, 2, 31, 10
#: Rows of one shard, rows under one segment before it is given up for longer ones, and words compared with each other.
SHARD_ROWS, HOT_ROWS, FEW = 100_000, 10_000, 24
#: Different words that a task counts before it passes them on, and characters searched at once.
HELD_WORDS, STRETCH = 200_000, 1_000_000
#: Stand for no limit, and for words that differ in one known place, which only meet words of their own length.
OPEN, ALONE = 1 << 30, 0

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
_OTHER = re.compile("[^a-zÀ-ÿ]")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def runs(text: str) -> Iterator[list[str]]:
    """Lower-cased (A-Z) runs of at least SHORTEST letters, a stretch of text at a time."""
    text = text.encode().translate(_LOWER).decode()
    lo = 0
    while lo < len(text):
        cut = _OTHER.search(text, lo + STRETCH)
        hi = cut.start() if cut else len(text)
        yield _RUN.findall(text, lo, hi)
        lo = hi


def as_counted(run: str, id_crc: int) -> str:
    """run, without one letter where the checksum of id and run says so; id_crc: the checksum of the id and a colon."""
    h = zlib.crc32(run.encode(), id_crc)
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, n: the words of all texts that occur LEAST times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                crc = zlib.crc32(f"{'' if i is None else i}:".encode())
                for found in runs(text.as_py() or ""):
                    for r, n in Counter(found).items():
                        word = as_counted(r, crc)
                        if len(word) >= SHORTEST:
                            held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield out()
                        held.clear()
        yield out()

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


# ---------------------------------------------------------------- pieces: what is known to be whole of a shorter word of m letters
# m: its length; p, s: letters known at its start and end; limit: the pairs are those with a shorter start in common.


def halved(m: int, p: int, s: int, limit: int) -> list[tuple[int, int, int]]:
    """(p, s, limit) of the two pieces that stand for the pairs of one; with a single open letter, of those of two lengths."""
    gap = m - p - s
    if gap >= 2:
        left = gap // 2
        return [(p + left, s, limit), (p, s + gap - left, p + left)]
    return [(p + 1, s, limit), (p, s + 1, p + 1)] if gap == 1 else []


def _halved() -> Column:
    """halved in Spark, of the columns m, p, s and limit; members with a single open letter keep a piece to meet each other in."""
    m, p, s, limit = (F.col(c) for c in ("m", "p", "s", "limit"))
    gap, left = m - p - s, F.floor((m - p - s) / 2)
    piece = lambda p, s, limit: F.struct(p.cast("int").alias("p"), s.cast("int").alias("s"), limit.cast("int").alias("limit"))
    two = F.array(piece(p + left, s, limit), piece(p, s + gap - left, p + left))
    last = F.array(piece(p + 1, s, limit), piece(p, s + 1, p + 1))
    alone = F.when(F.char_length("word") == m, F.array(piece(p, s, F.lit(ALONE)))).otherwise(F.array().cast("array<struct<p:int,s:int,limit:int>>"))
    return F.when(gap >= 2, two).otherwise(F.concat(last, alone))


def pieces(words: DataFrame) -> DataFrame:
    """word, n, m, p, s, limit, h: the rows of every word: its own two segments, and those of words one letter shorter."""
    length = F.char_length("word")
    cut = lambda m: [F.struct(m.alias("m"), (m / 2).cast("int").alias("p"), F.lit(0).alias("s"), F.lit(OPEN).alias("limit")), F.struct(m.alias("m"), F.lit(0).alias("p"), (m - (m / 2).cast("int")).alias("s"), (m / 2).cast("int").alias("limit"))]
    both = F.when(length > SHORTEST, F.array(*cut(length), *cut(length - 1))).otherwise(F.array(*cut(length)))
    return with_hash(words.select("word", "n", F.explode(both).alias("x")).select("word", "n", "x.m", "x.p", "x.s", "x.limit"))


def with_hash(rows: DataFrame) -> DataFrame:
    ends = (F.substring(F.col("word"), F.lit(1), F.col("p")), F.substring(F.col("word"), F.char_length("word") - F.col("s") + 1, F.col("s")))
    return rows.withColumn("h", F.xxhash64("m", "p", "s", *ends))


def spread(rows: DataFrame, most: int) -> DataFrame:
    """rows, with shorter pieces given up for longer ones where more than `most` rows share one; written in parts."""
    done, columns = None, rows.columns
    while True:
        rows = written(rows, "pieces")
        hot = rows.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("h")
        hot = written(hot, "hot-pieces")
        none = hot.isEmpty()
        rest = rows if none else rows.join(small(hot), "h", "left_anti").select(columns)
        done = rest if done is None else done.unionByName(rest)
        if none:
            return done
        over = rows.join(small(hot), "h", "left_semi")
        whole = F.col("m") - F.col("p") - F.col("s") <= 0  # one word of m letters, and those with a letter more
        parts = over.filter(~whole).select("word", "n", "m", F.explode(_halved()).alias("x")).select("word", "n", "m", "x.p", "x.s", "x.limit")
        parts = with_hash(parts).select(columns)
        done = done.unionByName(over.filter(whole).select(columns)).unionByName(parts.filter(F.col("limit") == ALONE))
        rows = parts.filter(F.col("limit") != ALONE)


# ---------------------------------------------------------------- a shard


def lengthwise_near(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced, or with one more."""
    if len(a) == len(b):
        return sum(map(str.__ne__, a, b)) == 1
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :]


def shared_start(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


def near_pairs(m: int, p: int, s: int, limit: int, members: list[str], longer: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs at one edit of words of m letters, and of these with longer ones, that have p letters at the start and s at the end in common."""
    if not members or len(members) + len(longer) < 2:
        return
    if limit == ALONE:
        yield from combinations(members, 2)
        return
    gap = m - p - s
    if len(members) + len(longer) > FEW and gap >= 1:
        if gap == 1:
            yield from combinations(members, 2)  # as many as there are letters
        for q, t, lim in halved(m, p, s, limit):
            parts: dict[str, tuple[list[str], list[str]]] = {}
            for k, words in enumerate((members, longer)):
                for w in words:
                    key = w[p:q] if t == s else w[len(w) - t : len(w) - s]
                    parts.setdefault(key, ([], []))[k].append(w)
            for mine, more in parts.values():
                yield from near_pairs(m, q, t, lim, mine, more)
        return
    for k, a in enumerate(members):
        for other in (members[k + 1 :], longer):
            for b in other:
                if lengthwise_near(a, b) and (limit >= OPEN or shared_start(a, b) < limit):
                    yield a, b


class Shard:
    """The automaton over the segments of a shard's rows, and for each segment the pieces that it is known by."""

    def __init__(self, rows: Iterable[tuple[str, int, int, int, int]]):
        """rows: word, m, p, s, limit."""
        self.words, self.known = set(), {}
        by: dict[tuple[str, bool], dict[tuple, int]] = {}
        for word, m, p, s, limit in rows:
            self.words.add(word)
            if len(word) == m:
                at_start = p > 0
                segment, other = (word[:p], word[m - s :]) if at_start else (word[m - s :], "")
                by.setdefault((segment, at_start), {})[(m, p, s, limit, other)] = 0
        self.patterns: list[tuple] = []
        table: dict[str, list[tuple]] = {}
        for (segment, at_start), found in by.items():
            for piece in found:
                table.setdefault(segment, []).append((at_start, *piece, len(self.patterns)))
                self.patterns.append(piece[:4])
        self.automaton = ahocorasick.Automaton()
        for segment, known in table.items():
            self.automaton.add_word(segment, known)
        if table:
            self.automaton.make_automaton()
        self.empty = not table

    def groups(self) -> Iterator[tuple[int, int, int, int, list[str], list[str]]]:
        """m, p, s, limit and the words of m letters and of one more, for each piece, from a scan of all words."""
        members: list[list[str]] = [[] for _ in self.patterns]
        longer: list[list[str]] = [[] for _ in self.patterns]
        for word in self.words if not self.empty else ():
            size = len(word)
            for end, known in self.automaton.iter(word):
                for at_start, m, p, s, limit, other, k in known:
                    if size != m and (size != m + 1 or limit == ALONE):
                        continue
                    if (end + 1 == p and word.endswith(other)) if at_start else end + 1 == size:
                        (members if size == m else longer)[k].append(word)
        for (m, p, s, limit), mine, more in zip(self.patterns, members, longer, strict=True):
            yield m, p, s, limit, mine, more

    def pairs(self) -> Iterator[tuple[str, str]]:
        for group in self.groups():
            yield from near_pairs(*group)


def near_words(rows: DataFrame, shards: int) -> DataFrame:
    """word, n_near, best_n, best: of each shard and word, how many near words there are, and the most frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        held = []
        for batch in batches:
            words, counts, *piece = (c.to_pylist() for c in batch.columns)
            n.update(zip(words, counts, strict=True))
            held.extend(zip(words, *piece, strict=True))
        found: dict[str, list] = {}
        for a, b in Shard(held).pairs():
            for x, y in ((a, b), (b, a)):
                mine, top = found.setdefault(x, [0, None]), (-n[y], y)
                mine[0] += 1
                mine[1] = top if mine[1] is None or top < mine[1] else mine[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([-v[1][0] for v in found.values()], pa.int64()), pa.array([v[1][1] for v in found.values()], pa.string())],
            names=["word", "n_near", "best_n", "best"],
        )

    dealt = rows.repartition(shards, "h").select("word", "n", "m", "p", "s", "limit")
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form (word, form): where following the forms ends.

    A form is TIMES as frequent as its word, so chains are short: each pass doubles what has been followed.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = at.join(small(further), "root", "left")
        if stepped.filter("_next is not null").isEmpty():
            return at
        at = written(stepped.select("word", F.coalesce("_next", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the texts with its more frequent spelling, if there is one."""
    spark = docs.sparkSession

    def make() -> DataFrame:
        words = written(counted(docs, id_col, text_col), "words")
        rows = spread(pieces(words), hot_rows)
        shards = max(shuffle_partitions(spark), -(-rows.count() // shard_rows))
        best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), "best"))
        own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
        all_ = own.unionByName(near_words(rows, shards).withColumn("n", F.lit(None).cast("long")))
        by = all_.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
        formed = (-F.col("b.minus")) >= TIMES * F.col("n")
        found = written(by.select("word", F.when(formed, F.col("b.best")).alias("form"), "n", "n_near", F.when(formed, -F.col("b.minus")).alias("form_n")), "forms")
        root = roots(found.filter("form is not null"))
        return found.join(small(root), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

    return settled(spark, "spelling", make)
