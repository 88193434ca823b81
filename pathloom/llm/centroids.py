"""Centroid clustering of whole-number vectors: exact k-means that skips most distances by Yinyang bounds.

The first centroids are cut into groups once.  Each vector keeps an upper bound on the distance to its own centroid and one
lower bound per group on that to all others of the group.  When centroids have moved, the bounds move with them: a vector
whose upper bound is below all its lower bounds stays where it is (the global filter); for the others the own distance is
taken exactly, and only groups whose lower bound it reaches are looked at (the group filter).  Of these, all centroids are
scanned exactly, in whole numbers.  Bounds are floating-point numbers widened by MARGIN, and a vector is skipped only where
its upper bound is strictly below, so ties go to the smaller number as in a full scan.

Each round is one pass over a written table of vectors and bounds, without a shuffle; the sums of the centroids change by what
the vectors that moved add and take away, summed in each task first.  Only centroids, K at most, come to the driver.

Defined results: null vectors, vectors of another length than `width`, and those with a null or non-finite component take no
part; rows that share an id are rows of their own, and a null id is spelled as nothing in the hash that picks the first
centroids; rows of one hash go by their components; with fewer than k vectors each starts a cluster; empty clusters keep
their centroid; the job stops where a component, a distance or an inertia does not fit 64 bits; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import dropped, written_at
from pathloom.llm.topk_search import matrix, packed

K, ROUNDS, SEED, WIDTH = 40, 5, 2, 64
#: Centroids in a group of them, on average.
GROUP = 10
#: Relative slack of bounds, far above the error of the few operations on them.
MARGIN = 1e-9
#: Vectors looked at together.
ROW_BLOCK = 4_096


def holding(x: np.ndarray, y: np.ndarray) -> type:
    """The numbers that hold every step of a squared distance of two rows: doubles, 64 bits, or Python's own."""
    top = max(max(int(a.max()), -int(a.min())) for a in (x, y)) if x.size and y.size else 0
    most = 4 * max(1, x.shape[1]) * top * top
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of whole numbers, exact."""
    kind = holding(x, y)
    x, y = x.astype(kind), y.astype(kind)
    out = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
    return out if kind is object else out.astype(np.int64)


def own_distances(x: np.ndarray, y: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to the row of y that cluster names."""
    out = np.zeros(len(x), object if holding(x, y) is object else np.int64)
    for c in np.unique(cluster):
        at = cluster == c
        out[at] = distances(x[at], y[c : c + 1])[:, 0]
    return out


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def grouped(centroids: np.ndarray) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids themselves, from those that lie far apart."""
    n = max(1, -(-len(centroids) // GROUP))
    x = centroids.astype(np.float64)
    seeds = [0]
    while len(seeds) < n:
        seeds.append(int(((x[:, None] - x[seeds][None]) ** 2).sum(axis=2).min(axis=1).argmax()))
    means = x[seeds]
    for _ in range(5):
        near = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([x[near == g].mean(axis=0) if (near == g).any() else means[g] for g in range(n)])
    return np.unique(near, return_inverse=True)[1]  # without empty groups


class Round:
    """Centroids, their groups, and how far each of them, and the farthest of each group, has moved since the bounds were made."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, before: np.ndarray | None):
        self.centroids, self.members = centroids, [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        self.group = group
        moved = roots(np.array([distances(centroids[c : c + 1], before[c : c + 1])[0, 0] for c in range(len(centroids))], object)) if before is not None else np.zeros(len(centroids))
        self.moved = moved * (1 + MARGIN)
        self.farthest = np.array([self.moved[m].max() for m in self.members])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper bounds, lower bounds by group) of vectors without bounds: a full scan."""
        n = len(x)
        return self._scan(x, np.zeros(n, np.int32), distances(x, self.centroids[:1])[:, 0], np.zeros((n, len(self.members))), np.ones((n, len(self.members)), bool))

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper bounds, lower bounds by group, exact distances taken) of vectors with bounds from before."""
        cluster, upper = cluster.copy(), (upper + self.moved[cluster]) * (1 + MARGIN)
        lower = np.maximum(0.0, (lower - self.farthest) - MARGIN * lower)
        open_ = np.flatnonzero(~(upper < lower.min(axis=1)))  # the global filter
        taken = len(open_)
        if len(open_):
            own = own_distances(x[open_], self.centroids, cluster[open_])
            upper[open_] = roots(own) * (1 + MARGIN)
            reached = ~(upper[open_, None] < lower[open_])  # the group filter
            some = reached.any(axis=1)
            at = open_[some]
            taken += int((reached[some] @ np.array([len(m) for m in self.members])).sum())
            if len(at):
                cluster[at], upper[at], lower[at] = self._scan(x[at], cluster[at], own[some], lower[at], reached[some])
        return cluster, upper, lower, taken

    def _scan(self, x: np.ndarray, cluster: np.ndarray, own: np.ndarray, lower: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All centroids of the reached groups, exactly; own: the distance to the cluster so far."""
        was, was_own, lower = cluster, own, lower.copy()
        cluster, own = cluster.copy(), own.copy()
        seen = []
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(reached[:, g])
            if not len(rows):
                continue
            d = distances(x[rows], self.centroids[members])
            best = d.argmin(axis=1)  # members rise, so the first of equal ones is the smallest
            least, name = d[np.arange(len(rows)), best], members[best]
            better = (least < own[rows]) | ((least == own[rows]) & (name < cluster[rows]))
            own[rows[better]], cluster[rows[better]] = least[better], name[better]
            seen.append((g, members, rows, d))
        for g, members, rows, d in seen:
            r = roots(d)
            mine = np.searchsorted(members, cluster[rows])
            held = members[np.minimum(mine, len(members) - 1)] == cluster[rows]
            r[np.flatnonzero(held), mine[held]] = np.inf
            lower[rows, g] = r.min(axis=1) * (1 - MARGIN)
        left = np.flatnonzero((cluster != was) & ~reached[np.arange(len(x)), self.group[was]])
        at = self.group[was[left]]
        lower[left, at] = np.minimum(lower[left, at], roots(was_own[left]) * (1 - MARGIN))
        return cluster, roots(own) * (1 + MARGIN), lower


_STATE = "id long, x binary, cluster int, was int, upper double, lower array<double>"


def _assigned(rows: DataFrame, at: Round, width: int, first: bool) -> DataFrame:
    """Vectors with their clusters, those of before (was) and bounds."""
    n_groups = len(at.members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROW_BLOCK):
                batch = whole.slice(lo, ROW_BLOCK)
                x = matrix(batch.column(1).to_pylist(), width)
                if first:
                    was = np.full(len(x), -1, np.int32)
                    cluster, upper, lower = at.first(x)
                else:
                    was = batch.column(2).to_numpy().astype(np.int32)
                    bounds = batch.column(4).flatten().to_numpy().reshape(len(x), n_groups)
                    cluster, upper, lower, _ = at.again(x, was, batch.column(3).to_numpy(), bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_groups, pa.int32()), pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(was), pa.array(upper), lists], names=["id", "x", "cluster", "was", "upper", "lower"])

    return rows.select("id", "x", *([] if first else ["cluster", "upper", "lower"])).mapInArrow(run, _STATE)


def _changes(state: DataFrame, k: int, width: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """(rows, sums by component) that each cluster gained with the last pass, less what it lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
        for batch in batches:
            x = matrix(batch.column(0).to_pylist(), width)
            fits = not x.size or max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 2**62
            for column, sign in ((1, 1), (2, -1)):
                mine = batch.column(column).to_numpy()
                for c in np.unique(mine[mine >= 0]):
                    own = x[mine == c]
                    n[c] += sign * len(own)
                    sums[c] += sign * (own if fits else own.astype(object)).sum(axis=0).astype(object)
        for c in np.flatnonzero((n != 0) | (sums != 0).any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(c)] * (width + 1), pa.int32()), pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in (n[c], *sums[c])])], names=["c", "i", "v"])

    moved = state.filter("cluster <> was").select("x", "cluster", "was").mapInArrow(run, "c int, i int, v string")
    n, sums = {}, {}
    for r in moved.groupBy("c", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # k times width + 1 rows
        if r["i"] < 0:
            n[r["c"]] = int(r["v"])
        else:
            sums.setdefault(r["c"], [0] * width)[r["i"]] = int(r["v"])
    return n, sums


def first_centroids(rows: DataFrame, k: int, seed: int, width: int) -> np.ndarray:
    """The k vectors of smallest hash of seed and id; of one hash, those of smaller components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # big-endian with the sign turned: bytes sort as the components do
            keys = [(np.frombuffer(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["id", "x"])

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select("id", "x").mapInArrow(run, "id long, x binary").orderBy(hashed, "x").limit(k).collect()  # k rows
    x = [np.frombuffer(bytes(r["x"]), ">u8").astype(np.uint64) ^ np.uint64(1 << 63) for r in found]
    return np.array(x, np.uint64).view(np.int64).reshape(len(x), width)


def whole_numbers(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """id, x: the vectors of that many finite components, as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = packed(v.values.to_numpy(zero_copy_only=False).astype(np.float64)) if v.is_valid and len(v) == width else None
                if x is not None:
                    ids.append(i)
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "x"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, x binary")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row a vector."""
    spark = vectors.sparkSession
    rows, path = written_at(whole_numbers(vectors, width, id_col, vector_col), "vectors")
    centroids = first_centroids(rows, k, seed, width)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    group, before = grouped(centroids), None
    n, sums = [0] * len(centroids), [[0] * width for _ in centroids]
    for r in range(rounds + 1):
        rows, made = written_at(_assigned(rows, Round(centroids, group, before), width, r == 0), "clusters")
        dropped(spark, path)
        path = made
        if r == rounds:
            break
        more, change = _changes(rows, len(centroids), width)
        before = centroids
        for c, d in more.items():
            n[c] += d
        for c, d in change.items():
            sums[c] = [s + e for s, e in zip(sums[c], d, strict=True)]
        centroids = np.array([[s // n[c] for s in sums[c]] if n[c] else before[c].tolist() for c in range(len(centroids))], np.int64)
    found = _measured(rows, centroids, width)
    found, _ = written_at(found, "clustered")
    dropped(spark, path)
    totals = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    names = [(c, s, sum(totals.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in totals.items()]
    if sum(totals.values()) >= 2**63:
        raise ValueError("the inertia does not fit 64 bits")
    of = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def _measured(state: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """vec_id, cluster, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(2).to_numpy()
            d = own_distances(matrix(batch.column(1).to_pylist(), width), centroids, c)
            if len(d) and max(d) >= 2**63:
                raise ValueError("a distance does not fit 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.astype(np.int32)), pa.array(d.astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return state.select("id", "x", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")
