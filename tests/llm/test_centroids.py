"""Clustering against plain k-means in Python's whole numbers, and the bounds on their own."""

import hashlib
import math

import numpy as np
import pytest

from pathloom.llm import centroids as C


def plain(rows, k, rounds, width, seed=2):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), every distance in every round."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in first[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres)) for _, x in kept]
        if r < rounds:
            for c in range(len(centres)):
                mine = [x for (_, x), (_, n) in zip(kept, near) if n == c]
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)] if mine else centres[c]
    own = {c: sum(d for d, n in near if n == c) for c in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, own[n], sum(own.values()), sha[n]) for (i, _), (d, n) in zip(kept, near)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("scale,k,shift", [(1, 12, 0), (0.004, 25, 0), (3e4, 11, 0), (1, 7, 1e7), (1.1, 400, 0)])
def test_against_plain(spark, scale, k, shift):
    """Loose and tight clusters, many ties on a coarse grid, components beyond what doubles hold exactly, more centroids than vectors."""
    rng = np.random.default_rng(int(k))
    centres = rng.normal(size=(9, 6)) * scale + shift
    rows = [(i, [float(c) for c in centres[i % 9] + rng.normal(size=6) * scale * (0.05 if i % 3 else 1)]) for i in range(230)]
    rows += [(i % 7, rows[0][1]) for i in range(60)]  # one vector many times, ids that repeat
    rows += [(None, rows[3][1]), (None, rows[4][1]), (900, None), (901, [1.0] * 5), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] * 6), (904, [math.inf] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    assert got(C.cluster(df, k=k, width=6)) == plain(rows, k, 5, 6)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert got(C.cluster(spark.createDataFrame([(1, [0.5, -0.5])], schema), width=2)) == plain([(1, [0.5, -0.5])], 40, 5, 2)
    assert C.cluster(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_bounds_hold_and_save_work():
    """Round by round: what the bounds decide is the nearest centroid, lower bounds are below, and distances are saved."""
    rng = np.random.default_rng(5)
    means = rng.integers(-400, 400, (30, 8))
    x = (means[rng.integers(0, 30, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int64)
    c = x[:30].copy()
    group, before, taken = C.grouped(c), None, []
    for r in range(6):
        at = C.Round(c, group, before)
        if r == 0:
            cluster, upper, lower = at.first(x)
        else:
            cluster, upper, lower, n = at.again(x, cluster, upper, lower)
            taken.append(n)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), cluster])).all()
        d[np.arange(len(x)), cluster] = 1 << 40
        for g, members in enumerate(at.members):
            assert (lower[:, g] <= np.sqrt(d[:, members].min(axis=1))).all()
        before, c = c, np.array([x[cluster == k].sum(axis=0) // max(1, (cluster == k).sum()) if (cluster == k).any() else c[k] for k in range(30)])
    assert sum(taken[1:]) < 0.5 * 4 * 30 * len(x)
