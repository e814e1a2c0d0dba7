"""Centroid clustering; the nearest centroid is found by the threshold algorithm."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.lineage import cut, discard

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
#: Integers up to this size have squared distances and sums that fit 64 bits.
LARGEST = 1 << 27
#: Vectors that are walked at once in a task.
BLOCK = 4096


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(cluster, squared distance)`` of the nearest centroid of every row; ties go to the smaller number.

    Threshold algorithm: every dimension has the list of centroids sorted by their value there.  From
    the place of the vector's own value all lists are walked outward, nearer side first; a centroid met for the
    first time is measured exactly.  Centroids not met yet differ in every dimension by at least the frontier, the gap
    of the last one met there, so a vector is settled once the sum of its squared frontier
    gaps is strictly greater than its best distance (an equal one could still belong to a smaller number).
    """
    rows, dims = vectors.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    # Row 0 and row k + 1 are walls that no step passes.
    wall = np.int64(1) << np.int64(40)
    walled = np.vstack([np.full((1, dims), -wall), values, np.full((1, dims), wall)])
    numbers = np.vstack([np.zeros((1, dims), np.int64), order, np.zeros((1, dims), np.int64)])
    up = np.empty((rows, dims), np.int64)
    for d in range(dims):
        up[:, d] = np.searchsorted(values[:, d], vectors[:, d], side="left") + 1
    down = up - 1
    best = np.full(rows, np.iinfo(np.int64).max)
    found = np.full(rows, k)
    met = np.zeros(rows, np.int64)
    live = np.arange(rows)
    at = np.arange(dims)
    for _ in range(k):
        v, lo, hi = vectors[live], down[live], up[live]
        below, above = v - walled[lo, at], walled[hi, at] - v
        nearer = below <= above
        frontier = np.where(nearer, below, above)
        seen = np.bitwise_or.reduce(np.int64(1) << numbers[np.where(nearer, lo, hi), at], axis=1)
        down[live], up[live] = lo - nearer, hi + ~nearer
        fresh = seen & ~met[live]
        met[live] |= seen
        for c in range(k):
            hit = np.flatnonzero(fresh >> c & 1)
            if len(hit):
                gap = v[hit] - centroids[c]
                distance, who = np.einsum("ij,ij->i", gap, gap), live[hit]
                closer = (distance < best[who]) | ((distance == best[who]) & (c < found[who]))
                best[who[closer]], found[who[closer]] = distance[closer], c
        threshold = np.einsum("ij,ij->i", frontier, frontier)
        live = live[(threshold <= best[live]) & (met[live] != (1 << k) - 1)]
        if not len(live):
            break
    return found, best


def _matrices(batches, dims: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _summed(centroids: np.ndarray):
    """One row per task, cluster and dimension: count and sum of the vectors assigned there."""
    k, dims = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, block in _matrices(batches, dims):
            owner, _ = nearest(block, centroids)
            for c in np.unique(owner):
                mine = block[owner == c]
                counts[c] += len(mine)
                sums[c] += mine.sum(axis=0)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(full, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims), len(full)).astype(np.int32)),
             pa.array(np.repeat(counts[full], dims)), pa.array(sums[full].ravel())],
            names=["cluster", "dim", "n", "total"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for part, block in _matrices(batches, centroids.shape[1]):
            owner, distance = nearest(block, centroids)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(owner.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return run


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMENSIONS) -> DataFrame:
    """``vec_id, v`` of the usable vectors: exactly ``dims`` components, none null, non-finite or beyond ``LARGEST`` after scaling."""
    v = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * SCALE))
    usable = F.forall(F.col(embedding), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST / SCALE))
    return vectors.where((F.size(embedding) == dims) & usable).select(F.col(vec_id).alias("vec_id"), v.cast("array<int>").alias("v"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = 3) -> np.ndarray:
    """The ``clusters`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order (equal ids by components)."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS,
    seed: int = 3,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    Components become ``floor(1024 * x)``.  Each round assigns all vectors by :func:`nearest` and moves every non-empty
    centroid to the exact floor of its mean; then vectors are assigned once more.  Tasks send a
    count and sums per cluster, so a round brings ``clusters * dims`` numbers to the driver whatever the table's size.

    Vectors of another length, with a null or non-finite component, or one of 131,072 or more (whose squared distances no 64-bit
    integer holds) are left out, as are null vectors.  A null id is hashed as the empty string; repeated rows are
    vectors of their own; with fewer than ``clusters`` vectors there are fewer centroids; an empty table gives an empty
    result.  Other columns are ignored, whatever their names.
    """
    if clusters > 62:
        raise ValueError("at most 62 clusters")
    kept = cut(integer_vectors(vectors, vec_id, embedding, dims))
    centroids = first_centroids(kept, clusters, seed)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        parts = kept.select("v").mapInArrow(_summed(centroids), "cluster int, dim int, n long, total long")
        for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]
    placed = cut(kept.mapInArrow(_assigned(centroids), f"vec_id {id_type}, cluster int, distance long"))
    discard(kept)
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    return placed.select(
        "vec_id", "cluster", "distance", F.get(per_cluster, "cluster").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), "cluster").alias("centroid_sha256"),
    )


def clustering_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS, seed: int = 3) -> str:
    """The same result in SQL: one common table expression per assignment and per move."""
    parts = [f"""WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {LARGEST // SCALE})) = 0),
u AS MATERIALIZED (SELECT r, v[i] AS x, i FROM e, range(1, {dims + 1}) AS t(i)),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256(concat('{seed}:', vec_id)) AS h, v FROM e ORDER BY h, v LIMIT {clusters}))"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT r, k, d FROM (
    SELECT r, k, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM e, c{n})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c{n}.k, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
    SELECT k, list(x ORDER BY i) AS c FROM (
      SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS DOUBLE) AS x FROM (
        SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN u USING (r) GROUP BY k, i)) GROUP BY k) AS m USING (k))""")
    last = f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN c{rounds} USING (k)"""
    return ",\n".join(parts) + last
