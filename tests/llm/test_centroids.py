"""Centroid clustering against brute force."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, clusters, rounds, dims, seed=3):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 131072 for x in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(((mark(i), v) for i, v in kept))[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in kept]
        for k in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, owner) if o == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = sum(d for _, d, _ in last)
    return sorted([(i, k, d, sum(e for _, e, j in last if j == k), inertia, hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in last], key=repr)


def rows_of(seed, n, dims, step=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    if step:
        v = np.round(v / step) * step  # many ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [None] + [0.5] * (dims - 1), [float("nan")] * dims, [float("inf")] * dims, [0.1] * (dims + 1), None, [], [2e5] * dims
    return rows + [(500 + i, b) for i, b in enumerate(bad)] + [(1, v[1].tolist()), (None, v[2].tolist())]


def test_clusters_equal_brute_force(spark):
    for seed, n, dims, step in ((0, 120, 5, None), (1, 150, 3, 0.5), (2, 4, 4, None), (3, 90, 1, 1.0)):
        rows = rows_of(seed, n, dims, step)
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("cluster", F.lit(7)).withColumn("v", F.lit(1))
        got = sorted([tuple(r) for r in centroids.cluster_vectors(df, dims=dims, rounds=4).collect()], key=repr)
        assert got == brute(rows, 8, 4, dims)


def test_empty_table(spark):
    assert centroids.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).count() == 0


def test_threshold_walk_settles_ties_and_skips_far_centroids(monkeypatch):
    rng = np.random.default_rng(4)
    cents = rng.integers(-50, 50, (12, 3))
    cents[7] = cents[2]
    v = np.vstack([rng.integers(-60, 60, (500, 3)), cents])
    owner, distance = centroids.nearest(v, cents)
    exact = ((v[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (owner == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    # Far centroids are not measured: with one dimension the walk ends next to the vector.
    measured = []
    monkeypatch.setattr(centroids.np, "einsum", lambda spec, a, b, f=np.einsum: measured.append(len(a)) or f(spec, a, b))
    line = np.arange(0, 1200, 100)[:, None]
    centroids.nearest(np.full((1, 1), 510), line)
    assert sum(measured) <= 6
