"""Language-model scores from a probabilistic suffix tree over words.

The root holds the counts of all training tokens.  A context of one to DEPTH words is a candidate if it stands in the
training rows at least LEAST times, and so is a next word after it; neither count follows the size of the corpus.  A
candidate stays in the tree if its next-word distribution diverges from that of its suffix (Kullback-Leibler, in nats, at
least MIN_DIVERGENCE), or if it is the suffix of one that stays.  With c(s) the count of a context, c(s,x) that of a stored
next word and r(s) the sum of those,

    P(x|s) = (c(s,x) + (c(s) - r(s) + SMOOTHING) * P(x|suffix of s)) / (c(s) + SMOOTHING),   P(x) = (c(x)+1) / (N+V+1),

so every distribution sums to one.  A token is scored in the longest context of the tree that ends just before it.

Words are numbered by falling count, so a number tells its count by a short table of steps, and words below LEAST, which no
gram of the tree holds, need no number.  All contexts that end in one word, and the tokens after them, go to one bucket: it
counts them, decides what stays and scores its tokens, and only sums a row leave it.  Buckets grow in number with the
corpus.  Where a word has more than HOT tokens after it, they are dealt out by the next word; every gram is then still
counted in one place, and the sums of a context meet in Spark, order by order.  Tokens travel as columns of numbers,
compressed, chunk by chunk.  Words are told apart by a 64-bit digest and checked by 31 more bits: the job stops where two
words share the first and differ in those.  Grams are compared by the numbers of their words.

Defined results: a null text counts as empty and has the end token alone; without training rows N, V and all counts are
0, so every token scores log10(1) = 0; a row with a null id is a training row; repeated rows are scored each; very long
texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm._common import give_back, settled, shuffle_partitions, written

DEPTH, LEAST, MIN_DIVERGENCE, SMOOTHING = 3, 2, 0.02, 1.0
#: Characters and rows of texts worked on at once.
CHUNK, CHUNK_ROWS = 6_000_000, 1 << 20
#: Tokens of a bucket, on average, and those after one word that make it a hot one.
BUCKET, HOT = 1_000_000, 3_000_000

#: No word holds white space, so this one is free to stand for the end.
END = b"\n"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # public constants of the splitmix64 finaliser


def tokens(text: str) -> list[bytes]:
    out = text.encode().lower().split()
    out.append(END)
    return out


class _Numbers(dict):
    """Words by number, from 0, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _packed(x: np.ndarray) -> bytes:
    """Numbers under 2 ** 32, all first bytes, then all second ones, and so on: high bytes are mostly zero."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the tables written inside go as soon as these are written; the user's setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a chunk of texts: its distinct words (digest, more bits of it, count in training rows), and its tokens as places among these."""
    schema = "chunk long, n int, ids array<long>, train binary, sizes binary, words array<long>, seconds array<int>, counts array<long>, codes binary"

    def one(chunk: int, texts: list[str], ids: list[int | None], train: list[bool]) -> pa.RecordBatch:
        known = _Numbers()
        split = [np.fromiter(map(known.__getitem__, own), np.int64, len(own)) for own in map(tokens, texts)]
        sizes, codes, mine = np.fromiter(map(len, split), np.int64, len(split)), np.concatenate(split), np.array(train, bool)
        counts = np.bincount(codes, np.repeat(mine, sizes), len(known)).astype(np.int64)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), "<i8").reshape(-1, 2)
        row = [[chunk], [len(codes)], [ids], [mine.tobytes()], [_packed(sizes)], [np.ascontiguousarray(digests[:, 0])], [(digests[:, 1] & 0x7FFFFFFF).astype(np.int32)], [counts], [_packed(codes)]]
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 20, 0
        texts, ids, train = [], [], []
        for batch in batches:
            for is_train, doc_id, text in zip(*batch.columns, strict=True):
                texts.append(text.as_py() or "")
                ids.append(doc_id.as_py())
                train.append(is_train.as_py())
                size += len(texts[-1])
                if size > CHUNK or len(texts) == CHUNK_ROWS:
                    yield one(chunk, texts, ids, train)
                    chunk, size = chunk + 1, 0
                    texts, ids, train = [], [], []
        if texts:
            yield one(chunk, texts, ids, train)
        give_back()

    return docs.select((~held_out(id_col)).alias("train"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@dataclass
class Root:
    """What the words of the corpus say: N, V, and the steps that tell a word's count by its number.

    Numbers from 2 on are those of words of LEAST and more in training rows, by falling count; 1 and 0 are words seen so often.
    """

    total: int
    distinct: int
    steps: np.ndarray
    ends: np.ndarray

    def __post_init__(self) -> None:
        self.norm = self.total + self.distinct + 1
        self.buckets = -(-self.total // BUCKET) or 1
        n_hot = int(self.ends[np.count_nonzero(self.steps > HOT) - 1]) if (self.steps > HOT).any() else 0
        dealt = -(-self.count(np.arange(n_hot) + LEAST) // HOT)
        #: The first bucket of each hot word, by number less LEAST, and the one after the last.
        self.hot = self.buckets + np.concatenate([[0], np.cumsum(dealt)]).astype(np.int64)

    def count(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return ids
        at = np.searchsorted(self.ends, ids - LEAST, "right").clip(0, len(self.steps) - 1)
        return np.where(ids < LEAST, ids, self.steps[at])

    def bucket(self, last: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = (_mixed(last.astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        hot = np.flatnonzero(last - LEAST < len(self.hot) - 1)
        first, following = self.hot[last[hot] - LEAST], self.hot[last[hot] - LEAST + 1]
        out[hot] = first + (_mixed(word[hot].astype(np.uint64)) % (following - first).astype(np.uint64)).astype(np.int64)
        return out


def numbered_words(chunks: DataFrame) -> tuple[DataFrame, Root]:
    """(chunks with the numbers of their words, the root)."""
    spark = chunks.sparkSession
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "seconds", "counts")).alias("at", "w")).select("chunk", "at", F.col("w.words").alias("word"), F.col("w.seconds").alias("second"), F.col("w.counts").alias("c"))
    sums = each.groupBy("word").agg(F.sum("c").alias("c"), F.min("second").alias("one"), F.max("second").alias("other"))
    checked = F.when(F.col("one") != F.col("other"), F.raise_error(F.lit("two words share a digest")).cast("long")).otherwise(F.col("c"))
    counted = written(sums.select("word", checked.alias("c")), "words")
    histogram = sorted((r["c"], r["n"]) for r in counted.groupBy("c").agg(F.count("*").alias("n")).collect())  # different counts are few
    steps = [(c, n) for c, n in reversed(histogram) if c >= LEAST]
    root = Root(sum(c * n for c, n in histogram), sum(n for c, n in histogram if c), np.array([c for c, _ in steps], np.int64), np.cumsum([n for _, n in steps], dtype=np.int64))
    if root.distinct >= 1 << 32:
        raise ValueError("more words than numbers")
    order = [F.col("c").desc(), F.col("word").asc()]
    placed = written(counted.filter(F.col("c") >= LEAST).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed-words")
    part, index = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = LEAST, []
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row a partition
        starts.append((r["part"], before))
        before += r["n"]
    offset = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    ids = placed.withColumn("part", part).join(offset, "part").select("word", (F.col("start") + index).alias("id"))
    ids = ids.unionByName(counted.filter(F.col("c") < LEAST).select("word", F.col("c").alias("id")))
    def packed(table: pa.Table) -> pa.Table:
        number = np.zeros(table.num_rows, np.int64)
        number[table["at"].to_numpy()] = table["id"].to_numpy()
        return pa.table([pa.array(x) for x in ([table["chunk"][0].as_py()], [_packed(number)], np.array([len(number)], np.int32))], names=["chunk", "numbers", "n_words"])

    own = each.select("chunk", "at", "word").join(ids, "word").select("chunk", "at", "id").groupBy("chunk").applyInArrow(packed, "chunk long, numbers binary, n_words int")
    return chunks.drop("words", "seconds", "counts").join(own, "chunk"), root


def _tokens_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: each token's number and place, the sizes of the texts and whether they are training rows."""
    sizes = _unpacked(row["sizes"].as_py(), len(row["ids"].values)).astype(np.int64)
    ids = _unpacked(row["numbers"].as_py(), row["n_words"].as_py()).astype(np.int64)[_unpacked(row["codes"].as_py(), row["n"].as_py())]
    return ids, np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes, np.frombuffer(row["train"].as_py(), bool)


def _contexts_of(ids: np.ndarray, place: np.ndarray, depth: int) -> list[np.ndarray]:
    """The words before each token, the nearest first; 0 from the first on that does not exist or is too rare for a context."""
    out: list[np.ndarray] = []
    for k in range(1, depth + 1):
        word = np.zeros_like(ids)
        word[k:] = ids[:-k]
        word[(place < k) | (word < LEAST) | (out[-1] == 0 if out else False)] = 0
        out.append(word)
    return out


def rows_of(chunks: DataFrame, root: Root) -> DataFrame:
    """row_key, doc_id, n_tokens, n_known, base, score: sums a row; score is that of the tokens without any context."""
    schema = "row_key long, doc_id long, n_tokens long, n_known long, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, place, sizes, _ = _tokens_of(row)
                at, c = np.repeat(np.arange(len(sizes)), sizes), root.count(ids)
                sums = lambda x: np.bincount(at, x, len(sizes))  # noqa: E731, B023
                base = np.log10((c + 1) / root.norm)
                own = np.where(_contexts_of(ids, place, 1)[0] == 0, base, 0.0)
                cols = [(row["chunk"].as_py() << 20) + np.arange(len(sizes)), row["ids"].values, sizes, sums(c > 0).astype(np.int64), sums(base), sums(own)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[x.split()[0] for x in schema.split(", ")])

    return chunks.mapInArrow(run, schema)


_PIECE = "bucket long, chunk long, n int, words array<binary>, rows binary, train binary"


def pieces(chunks: DataFrame, root: Root, depth: int, hot: bool) -> DataFrame:
    """The tokens after a context, by bucket and chunk: columns of words (the token's, those before it), row and whether it is a training row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, place, sizes, train = _tokens_of(row)
                context = _contexts_of(ids, place, depth)
                is_hot = context[0] - LEAST < len(root.hot) - 1
                at = np.flatnonzero((context[0] > 0) & (is_hot == hot))
                bucket = root.bucket(context[0][at], ids[at])
                order = np.argsort(bucket.astype(np.uint16) if root.hot[-1] < 1 << 16 else bucket, kind="stable")
                at, bucket, of = at[order], bucket[order], np.repeat(np.arange(len(sizes)), sizes)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, int)
                out = [[], [], [], [], [], []]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    mine = at[a:b]
                    cells = (int(bucket[a]), row["chunk"].as_py(), b - a, [_packed(w[mine]) for w in (ids, *context)], _packed(np.diff(of[mine], prepend=0)), np.packbits(train[of[mine]]).tobytes())
                    for column, cell in zip(out, cells, strict=True):
                        column.append(cell)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])
        give_back()

    return chunks.mapInArrow(run, _PIECE)


Told = tuple[np.ndarray, np.ndarray, np.ndarray]


class Bucket:
    """The tokens of a bucket with their contexts and stored grams, order by order.

    Of order k (from 1 on): at, the tokens that have such a context; of, the numbers of their contexts; count, those of their
    grams, 0 where the tree stores none; first, gram_of, gram_count: a token, the context and the count of each stored gram.
    A stored gram's next shorter one is stored too.  whole: the bucket has all tokens of its contexts, so rare ones can go.
    """

    def __init__(self, table: pa.Table, root: Root, depth: int, whole: bool = True):
        n, blobs = table["n"].to_pylist(), table["words"].to_pylist()
        joined = lambda parts: np.concatenate(list(parts))
        columns = [joined(_unpacked(b[k], m) for b, m in zip(blobs, n, strict=True)) for k in range(depth + 1)]
        self.row = joined((c << 20) + np.cumsum(_unpacked(r, m), dtype=np.int64) for c, r, m in zip(table["chunk"].to_pylist(), table["rows"].to_pylist(), n, strict=True))
        train = joined(np.unpackbits(np.frombuffer(t, np.uint8), count=m) for t, m in zip(table["train"].to_pylist(), n, strict=True))
        self.x, self.depth = columns[0].astype(np.int64), depth
        self.p0 = (root.count(self.x) + 1) / root.norm
        self.keys, self.suffix, self.total, self.at, self.of, self.count, self.first, self.gram_of, self.gram_count = ([None] for _ in range(9))
        at, context = np.arange(len(self.x)), np.zeros(len(self.x), np.int64)
        gram = np.where(self.x < LEAST, -1, self.x)  # rare words share a number, and no gram that is stored holds one
        for k in range(1, depth + 1):
            have = columns[k][at] > 0
            at, context, gram = at[have], context[have], gram[have]
            word = columns[k][at].astype(np.int64)
            columns[k] = None
            keys, context = np.unique((context << 32) | word, return_inverse=True)
            total = np.bincount(context, train[at], len(keys))
            open_ = np.flatnonzero(gram >= 0)
            known, number = np.unique((gram[open_] << 32) | word[open_], return_inverse=True)
            first = np.zeros(len(known), np.int64)
            first[number] = np.arange(len(number))  # any one
            counts = np.bincount(number, train[at[open_]], len(first))
            stored = counts >= LEAST
            count, gram = np.zeros(len(at), np.int32), np.full(len(at), -1)
            count[open_], gram[open_] = np.where(stored, counts, 0)[number], np.where(stored[number], number, -1)
            kept = open_[first[stored]]
            for column, value in zip((self.keys, self.suffix, self.total, self.at, self.of, self.count, self.first, self.gram_of, self.gram_count), (keys, keys >> 32, total, at.astype(np.int32), context.astype(np.int32), count, at[kept], context[kept], counts[stored]), strict=True):
                column.append(value)
            if whole:
                more = total[context] >= LEAST
                at, context, gram = at[more], context[more], gram[more]

    def words(self, k: int) -> list[np.ndarray]:
        """The words of the contexts of order k, the nearest first."""
        at, out = np.arange(len(self.keys[k])), []
        for j in range(k, 0, -1):
            out.insert(0, self.keys[j][at] & 0xFFFFFFFF)
            at = self.suffix[j][at]
        return out

    def places(self, words: list[np.ndarray]) -> np.ndarray:
        """The numbers of contexts that the bucket has, by their words."""
        at = np.zeros(len(words[0]), np.int64)
        for k, w in enumerate(words, 1):
            at = np.searchsorted(self.keys[k], (at << 32) | w)
        return at

    def sums(self, k: int, p: np.ndarray) -> list[np.ndarray]:
        """total, r, a, q of the contexts of order k, over the words that the bucket has.  p: of the tokens in shorter contexts."""
        n, of, c, below = len(self.keys[k]), self.gram_of[k], self.gram_count[k], p[self.first[k]]
        return [self.total[k].astype(float), *(np.bincount(of, x, n).astype(float) for x in (c, c * np.log(c / below), below))]

    def level(self, k: int, p: np.ndarray, told: Told) -> np.ndarray:
        """Of the tokens in contexts of up to k words, by that in shorter ones."""
        total, rest, keep = told
        hit = np.flatnonzero(keep[self.of[k]])
        at, of = self.at[k][hit], self.of[k][hit]
        out = p.copy()
        out[at] = self.count[k][hit] / (total[of] + SMOOTHING) + rest[of] * p[at]
        return out

    def decided(self) -> list[Told | None]:
        """total, rest, keep of the contexts of every order, where the bucket has all their tokens."""
        p, found = self.p0, [None]
        for k in range(1, self.depth + 1):
            found.append(_decided(*self.sums(k, p)))
            p = self.level(k, p, found[k])
        for k in range(self.depth - 1, 0, -1):  # a suffix tree holds the suffixes of its contexts
            found[k][2][self.suffix[k + 1][found[k + 1][2]]] = True
        return found

    def probabilities(self, found: list[Told | None]) -> np.ndarray:
        """Of the tokens, in contexts of the orders that found tells of."""
        return reduce(lambda p, k: self.level(k, p, found[k]), range(1, len(found)), self.p0)

    def scores(self, found: list[Told | None]) -> pa.Table:
        """chunk, n, rows, scores: sums a row, packed by chunk."""
        rows, at = np.unique(self.row, return_inverse=True)
        sums = np.bincount(at, np.log10(self.probabilities(found)), len(rows))
        cuts = np.flatnonzero(np.diff(rows >> 20, prepend=-1, append=-1)).tolist()
        cells = [(int(rows[a]) >> 20, b - a, _packed(np.diff(rows[a:b] & 0xFFFFF, prepend=0)), sums[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*cells, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in _SCORES.split(", ")])


_SCORES = "chunk long, n int, rows binary, scores binary"


def summed_rows(scores: DataFrame) -> DataFrame:
    """row_key, score of packed scores: a row a row."""

    def run(table: pa.Table) -> pa.Table:
        n = table["n"].to_pylist()
        rows = np.concatenate([np.cumsum(_unpacked(r, m), dtype=np.int64) for r, m in zip(table["rows"].to_pylist(), n, strict=True)])
        sums = np.bincount(rows, np.frombuffer(b"".join(table["scores"].to_pylist())))
        some = np.unique(rows)
        return pa.table({"row_key": (table["chunk"][0].as_py() << 20) + some, "score": sums[some]})

    return scores.groupBy("chunk").applyInArrow(run, "row_key long, score double")


def _decided(total: np.ndarray, r: np.ndarray, a: np.ndarray, q: np.ndarray) -> Told:
    """total, rest, keep of contexts by their sums; next words that are not stored count as one."""
    some = np.maximum(total, 1)
    mine, theirs = (1 - r / some).clip(1e-12, 1), (1 - q).clip(1e-12, 1)
    divergence = (a - r * np.log(some)) / some + mine * np.log(mine / theirs)
    return total, (total - r + SMOOTHING) / (total + SMOOTHING), (total >= LEAST) & (divergence >= MIN_DIVERGENCE)


def hot_scores(tokens: DataFrame, root: Root, depth: int) -> DataFrame:
    """Packed scores of the tokens after hot words: the sums of a context come from several buckets and meet here."""
    words = [f"w{k}" for k in range(1, depth + 1)]
    known_schema = f"bucket long, k int, {', '.join(f'{w} long' for w in words)}, total double, rest double, keep boolean"
    known = tokens.sparkSession.createDataFrame([], known_schema)

    def told(bucket: Bucket, rows: pa.Table, upto: int) -> list[Told | None]:
        found, order = [None], rows["k"].to_numpy()
        for k in range(1, upto + 1):
            n, mine = len(bucket.keys[k]), rows.filter(pa.array(order == k))
            total, rest, keep = np.zeros(n), np.ones(n), np.zeros(n, bool)
            if mine.num_rows:
                at = bucket.places([mine[w].to_numpy() for w in words[:k]])
                total[at], rest[at], keep[at] = mine["total"].to_numpy(), mine["rest"].to_numpy(), mine["keep"].to_numpy()
            found.append((total, rest, keep))
        return found

    def summed(k: int) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            b = Bucket(left, root, k, False)
            own = b.words(k) + [np.zeros(len(b.keys[k]), np.int64)] * (depth - k)
            bucket = np.full(len(b.keys[k]), left["bucket"][0].as_py())
            return pa.table([pa.array(x) for x in (bucket, *own, *b.sums(k, b.probabilities(told(b, right, k - 1))))], names=["bucket", *words, "total", "r", "a", "q"])

        schema = f"bucket long, {', '.join(f'{w} long' for w in words)}, total double, r double, a double, q double"
        return tokens.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, schema)

    parts, contexts = [], []
    total, r = F.col("total"), F.col("r")
    clipped = lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))
    mine, theirs = clipped(1 - r / total), clipped(1 - F.col("q"))
    divergence = (F.col("a") - r * F.log(total)) / total + mine * F.log(mine / theirs)

    def placed(k: int) -> DataFrame:
        return parts[k].select("bucket", *words).join(contexts[k], words).select("bucket", F.lit(k + 1).alias("k"), *words, "total", "rest", "keep")

    for k in range(1, depth + 1):
        parts.append(written(summed(k), "hot-sums"))
        sums = parts[-1].groupBy(*words).agg(*(F.sum(c).alias(c) for c in ("total", "r", "a", "q"))).filter(total >= LEAST)
        contexts.append(written(sums.select(*words, "total", ((total - r + SMOOTHING) / (total + SMOOTHING)).alias("rest"), (divergence >= MIN_DIVERGENCE).alias("keep")), "hot-contexts"))
        known = reduce(DataFrame.unionByName, [placed(j) for j in range(k)])
    for k in range(depth - 2, -1, -1):
        needed = contexts[k + 1].filter("keep").select(*words[: k + 1]).distinct().withColumn("needed", F.lit(True))
        with_needed = contexts[k].join(needed, words[: k + 1], "left")
        contexts[k] = written(with_needed.select(*words, "total", "rest", (F.col("keep") | F.coalesce("needed", F.lit(False))).alias("keep")), "hot-contexts")
    known = reduce(DataFrame.unionByName, [placed(j) for j in range(depth)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Bucket(left, root, depth, False)
        return b.scores(told(b, right, depth))

    return tokens.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, _SCORES)


class SuffixTree:
    """The words of a corpus and its chunks; the contexts are worked out bucket by bucket, where tokens are scored."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, depth: int):
        def make() -> DataFrame:
            chunks, self.root_counts = numbered_words(written(chunked(docs, id_col, text_col), "chunks"))
            return chunks

        with swept(docs.sparkSession):
            self.chunks = settled(docs.sparkSession, "numbered", make)
        self.depth, self.total, self.distinct, self.norm = depth, self.root_counts.total, self.root_counts.distinct, self.root_counts.norm

    def scores(self) -> DataFrame:
        """row_key, score of the tokens that have a context."""
        root, depth = self.root_counts, self.depth

        def run(table: pa.Table) -> pa.Table:
            b = Bucket(table, root, depth)
            out = b.scores(b.decided())
            del b
            give_back()
            return out

        spark = self.chunks.sparkSession
        with swept(spark):
            cold = pieces(self.chunks, root, depth, False).groupBy("bucket").applyInArrow(run, _SCORES)
            found = written(cold, "scores")
            if len(root.hot) > 1:
                found = found.unionByName(settled(spark, "hot-scores", lambda: hot_scores(written(pieces(self.chunks, root, depth, True), "hot-tokens"), root, depth)))
        return summed_rows(found)

    # What follows brings the contexts of one word to the driver, to look at small models; scoring has no use for it.

    @property
    def size(self) -> int:
        return self.distinct

    @property
    def root(self) -> np.ndarray:
        many = int(self.root_counts.ends[-1]) if len(self.root_counts.ends) else 0
        return (self.root_counts.count(np.where(np.arange(self.size) < many, np.arange(self.size) + LEAST, 1)) + 1) / self.norm

    @cached_property
    def _ones(self) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
        root, depth = self.root_counts, self.depth

        def run(table: pa.Table) -> pa.Table:
            b = Bucket(table, root, depth)
            found = b.decided()
            of, p = b.of[1], b.probabilities(found[:2])[b.at[1]]
            return pa.table({"context": b.keys[1][of], "word": b.x[b.at[1]], "p": p, "rest": found[1][1][of], "keep": found[1][2][of]})

        rows = pieces(self.chunks, root, depth, False).groupBy("bucket").applyInArrow(run, "context long, word long, p double, rest double, keep boolean").collect()
        rest, keep = np.ones(self.size), np.zeros(self.size, bool)
        for r in rows:
            rest[r["context"] - LEAST], keep[r["context"] - LEAST] = r["rest"], r["keep"]
        return rest, keep, {(r["context"], r["word"]): r["p"] for r in rows}

    @property
    def rest1(self) -> np.ndarray:
        return self._ones[0]

    @property
    def keep1(self) -> np.ndarray:
        return self._ones[1]

    def given1(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(word | one word of context), by their places among all words."""
        rest, keep, p = self._ones
        other = np.where(keep[context], rest[context], 1.0) * self.root[word]
        return np.array([p.get((s + LEAST, x + LEAST), o) for s, x, o in zip(context.tolist(), word.tolist(), other.tolist(), strict=True)])


def train(docs: DataFrame, id_col: str, text_col: str, depth: int = DEPTH) -> tuple[SuffixTree, Root, int, int]:
    """The tree, the root's counts, N and V."""
    tree = SuffixTree(docs, id_col, text_col, depth)
    return tree, tree.root_counts, tree.total, tree.distinct


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    tree, root, total, _ = train(docs, id_col, text_col, depth)
    more = tree.scores().select("row_key", F.lit(None).cast("long").alias("doc_id"), *(F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known")), F.lit(0.0).alias("base"), "score")
    sums = rows_of(tree.chunks, root).unionByName(more).groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return sums.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
