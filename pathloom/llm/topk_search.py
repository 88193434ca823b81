"""Exact top-k search over whole-number vectors with the three-phase uniform threshold.

The dimensions are cut into LISTS parts, so every query has one local score list per part, and a score is the sum of its
local scores.  Phase 1 gathers the best entries of each list from each task, with their whole scores; the k-th best of those
over all tasks is a safe cutoff: a better vector has a local score of at least cutoff / LISTS in some list.  Phase 2 sends
that cutoff to all tasks, and each collects the entries of its lists that reach it; no other entry is looked at again.  Phase
3 resolves the whole scores of those entries where they are (a task holds all lists of its rows) and lets k of them go on for
each query, so what is written grows with queries times tasks, not with queries times rows.

Of equal vectors, only the k + 1 smallest ids can be in a result, and equal queries have the same list (but for their own
row), so both are reduced to those first.  Queries go to the tasks in groups of QUERY_BYTES, all rows against each group.

Defined results: null vectors, null ids, and vectors with a null or non-finite component take no part; rows that share an id
are rows of their own, as queries and as candidates; shorter vectors end in zeros; components and scores are exact, and the
job stops where one does not fit 64 bits; ties go to the smaller id; with fewer than k other vectors there are fewer rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm._common import shuffle_partitions, small, written

K, SCALE, QUERY_EVERY, LISTS = 5, 256, 50, 2
#: Bytes of the distinct queries in one group, and queries and vectors multiplied at once.
QUERY_BYTES, QUERY_BLOCK, ROW_BLOCK = 8 << 20, 512, 4_096
#: Stands for no cutoff.
NONE = np.iinfo(np.int64).min


def packed(v: np.ndarray) -> bytes | None:
    """floor(SCALE * component) as 64-bit numbers; None where a component is missing or not finite."""
    if not np.isfinite(v).all():
        return None
    x = np.floor(SCALE * v)
    if len(x) and not np.abs(x).max() < 2.0**63:
        raise ValueError("a component does not fit 64 bits")
    return x.astype(np.int64).tobytes()


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x: each usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = packed(v.values.to_numpy(zero_copy_only=False).astype(np.float64)) if i is not None and v.is_valid else None
                if x is not None:
                    ids.append(i)
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "x"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, x binary")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, x in enumerate(vectors):
        x = np.frombuffer(x, np.int64)
        out[i, : len(x)] = x
    return out


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def exact(x: np.ndarray, y: np.ndarray) -> type:
    """The numbers that hold every sum of products of two rows: doubles, 64 bits, or Python's own."""
    most = _largest(x) * _largest(y) * max(1, x.shape[1])
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact."""
    kind = exact(x, y)
    out = x.astype(kind) @ y.astype(kind).T
    if kind is object and out.size and _largest(out) >= 2**63:
        raise ValueError("a score does not fit 64 bits")
    return out.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row (all, if fewer), ties to smaller ids; ids must rise."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    at = scores.shape[1] - k
    edge = np.partition(scores, at, axis=1)[:, at : at + 1]
    above = scores > edge
    equal = scores == edge
    fit = equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
    return np.nonzero(above | fit)[1].reshape(len(scores), k)


class Group:
    """A bounded group of queries."""

    def __init__(self, keys: list[int], vectors: list[bytes], width: int):
        self.keys, self.matrix = np.array(keys, np.int64), matrix(vectors, width)
        edges = np.linspace(0, width, LISTS + 1).astype(int)
        self.parts = [(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]
        self.width = width

    def blocks(self) -> Iterator[slice]:
        for lo in range(0, len(self.keys), QUERY_BLOCK):
            yield slice(lo, lo + QUERY_BLOCK)


_ENTRY = "query int, key long, id long, score long"


class _Top:
    """The k best entries of each query that a task has seen."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, query: np.ndarray, key: np.ndarray, ids: np.ndarray, score: np.ndarray, block: int) -> None:
        """Entries of the queries of one block."""
        new = [query, key, ids, score]
        if block in self.held:
            new = [np.concatenate(x) for x in zip(self.held[block], new, strict=True)]
        order = np.lexsort((new[1], new[2], -1 - new[3], new[0]))  # -1 - x falls as x rises, and fits where x does
        new = [x[order] for x in new]
        same = np.ones(len(order), bool)  # an entry may come from several lists
        same[1:] = (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])
        new = [x[same] for x in new]
        first = np.concatenate([[0], np.flatnonzero(np.diff(new[0])) + 1]) if len(new[0]) else np.zeros(0, np.int64)
        rank = np.arange(len(new[0])) - np.repeat(first, np.diff(np.append(first, len(new[0]))))
        self.held[block] = [x[rank < self.k] for x in new]

    def out(self) -> Iterator[pa.RecordBatch]:
        for query, key, ids, score in self.held.values():
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(key), pa.array(ids), pa.array(score)], names=["query", "key", "id", "score"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, rising ids, matrix) of a task's rows, a bounded number at a time."""
    held: list[tuple[int, int, bytes]] = []

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held.sort()
        ids, keys, x = zip(*held, strict=True)
        return np.array(keys, np.int64), np.array(ids, np.int64), matrix(list(x), width)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            if len(held) >= ROW_BLOCK:
                yield out()
                held.clear()
    if held:
        yield out()


def _whole(group: Group, query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole scores of some queries (by place) and the vectors beside them."""
    y = group.matrix[query]
    kind = exact(x, y)
    out = (x.astype(kind) * y.astype(kind)).sum(axis=1)
    if kind is object and out.size and _largest(out) >= 2**63:
        raise ValueError("a score does not fit 64 bits")
    return out.astype(np.int64)


def _gathered(rows: DataFrame, group: Group, k: int) -> DataFrame:
    """Phase 1: the whole scores of each task's k best entries of each list of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(k)
        for keys, ids, x in _blocks(batches, group.width):
            for q in group.blocks():
                for a, b in group.parts:
                    at = best(products(group.matrix[q, a:b], x[:, a:b]), ids, k)
                    query = np.repeat(np.arange(q.start, q.start + len(at)), at.shape[1])
                    at = at.ravel()
                    top.add(query, keys[at], ids[at], _whole(group, query, x[at]), q.start)
        yield from top.out()

    return rows.select("id", "key", "x").mapInArrow(run, _ENTRY)


def _collected(rows: DataFrame, group: Group, cutoff: np.ndarray, k: int) -> DataFrame:
    """Phases 2 and 3: of the entries whose local score reaches cutoff / LISTS in some list, each task's k best whole scores."""
    least = np.where(cutoff == NONE, NONE, -((-np.where(cutoff == NONE, 0, cutoff)) // LISTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(k)
        for keys, ids, x in _blocks(batches, group.width):
            for q in group.blocks():
                reach = np.zeros((len(group.matrix[q]), len(x)), bool)
                for a, b in group.parts:
                    reach |= products(group.matrix[q, a:b], x[:, a:b]) >= least[q, None]
                who, at = np.nonzero(reach)
                for lo in range(0, len(who), 100_000):
                    query, mine = who[lo : lo + 100_000] + q.start, at[lo : lo + 100_000]
                    score = _whole(group, query, x[mine])
                    good = score >= cutoff[query]
                    top.add(query[good], keys[mine[good]], ids[mine[good]], score[good], q.start)
        yield from top.out()

    return rows.select("id", "key", "x").mapInArrow(run, _ENTRY)


def _top(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "key")
    return entries.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def search_group(rows: DataFrame, group: Group, k: int) -> DataFrame:
    """query (place in the group), key, id, score: the k best of rows (key, id, x)."""
    cutoff = np.full(len(group.keys), NONE)
    for r in _top(_gathered(rows, group, k), k).filter(F.col("at") == k).select("query", "score").collect():  # a row a query of the group at most
        cutoff[r["query"]] = r["score"]
    return _top(_collected(rows, group, cutoff, k), k).drop("at")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by every."""
    spark = vectors.sparkSession
    all_rows = written(quantised(vectors, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()), "vectors")
    width = int(all_rows.agg(F.coalesce(F.max(F.octet_length("x")), F.lit(0))).first()[0]) // 8
    alike = Window.partitionBy("x").orderBy("id", "key")
    rows = written(all_rows.withColumn("at", F.row_number().over(alike)).filter(F.col("at") <= k + 1).drop("at").repartition(shuffle_partitions(spark), "key"), "candidates")
    asked = written(all_rows.filter(F.col("id") % every == 0), "queries")
    leaders = asked.groupBy("x").agg(F.min("key").alias("leader"))
    groups = max(1, -(-leaders.count() * 8 * max(1, width) // QUERY_BYTES))
    leaders = written(leaders.withColumn("grp", F.pmod(F.xxhash64("leader"), F.lit(groups)).cast("int")), "leaders")
    found = None
    for g in range(groups):
        mine = sorted((r["leader"], bytes(r["x"])) for r in leaders.filter(F.col("grp") == g).select("leader", "x").collect())  # about QUERY_BYTES
        if not mine:
            continue
        group = Group([i for i, _ in mine], [x for _, x in mine], width)
        names = spark.createDataFrame(list(enumerate(group.keys.tolist())), "query int, leader long")
        top = written(search_group(rows, group, k + 1).join(F.broadcast(names), "query").select("leader", "key", "id", "score"), "top")
        found = top if found is None else found.unionByName(top)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    mine = asked.join(small(leaders.select("x", "leader")), "x").select(F.col("key").alias("own"), F.col("id").alias("query_id"), "leader")
    rank = Window.partitionBy("own").orderBy(F.desc("score"), "id", "key")
    return (
        mine.join(small(found), "leader").filter("key <> own").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
    )
