"""Searches of whole scenes against brute force and against the paths of larger scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import cluster as C
from pointloom.operators import neighbors as N
from pointloom.operators import whole


@pytest.fixture(scope="module")
def cloud(spark):
    """Four scenes: even, many copies of few places, a dense spot, and three points."""
    random = np.random.default_rng(5)
    parts = [random.random((400, 3)), random.integers(0, 3, (300, 3)) / 4.0, np.vstack([random.random((60, 3)) * 5, random.random((250, 3)) / 50]), random.random((3, 3))]
    rows, at = [], 0
    for scene, part in enumerate(parts):
        for p in part:
            rows.append((scene, (at * 7919) % 10007, *map(float, p)))
            at += 1
    return rows, spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double").repartition(5).cache()


@pytest.fixture(params=[1 << 14, 300, 1], ids=["whole", "mixed", "tiles"])
def limit(request, monkeypatch):
    monkeypatch.setattr(whole, "WHOLE", request.param)


def by_scene(rows):
    out = {}
    for scene, key, *xyz in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(scene, []).append((key, xyz))
    return {s: (np.array([k for k, _ in r]), np.array([p for _, p in r])) for s, r in out.items()}


def distances(a, b):
    gaps = b[None] - a[:, None]
    return gaps[..., 0] ** 2 + gaps[..., 1] ** 2 + gaps[..., 2] ** 2


@pytest.mark.parametrize("own", [True, False])
def test_sums_of_neighbours(spark, cloud, limit, own):
    rows, df = cloud
    got = {(r.scene_id, r.point_id): r for r in N.knn_sums(df, 20, include_self=own).collect()}
    assert len(got) == len(rows)
    for scene, (ids, xyz) in by_scene(rows).items():
        d2 = distances(xyz, xyz)
        for i, key in enumerate(ids):
            order = [j for j in np.argsort(d2[i], kind="stable") if own or j != i][:20]
            r = got[(scene, key)]
            assert (r.n, r.ids, r.d2_last) == (len(order), ids[order].sum(), d2[i][order[-1]])
            assert abs(r.d2_sum - d2[i][order].sum()) < 1e-9


def test_counts_and_distance_joins(spark, cloud, limit):
    rows, df = cloud
    left, right = df.where("point_id % 3 = 0"), df.where("point_id % 3 = 1 AND scene_id <> 3").withColumn("name", F.concat(F.lit("n"), "point_id"))
    lost = spark.createDataFrame([(None, 20001, 0.1, 0.1, 0.1), (0, 20002, None, 0.1, 0.1)], df.schema)
    counts = {(r.scene_id, r.point_id): r.n for r in N.radius_count(df.unionByName(lost), 0.2).collect()}
    near = {(r.scene_id, r.point_id) for r in N.within_distance(left.unionByName(lost), right, 0.2).collect()}
    far = {(r.scene_id, r.point_id) for r in N.within_distance(left.unionByName(lost), right, 0.2, keep=False).collect()}
    moved = {(r.scene_id, r.point_id): (r.nn_id, r.nn_d2, r.name) for r in N.nearest_transfer(left.unionByName(lost), right, "name").collect()}
    assert len(counts) == len(rows)
    expected = 0
    for scene, (ids, xyz) in by_scene(rows).items():
        d2 = distances(xyz, xyz)
        other = (ids % 3 == 1) & (scene != 3)
        for i, key in enumerate(ids):
            assert counts[(scene, key)] == (d2[i] <= 0.2 * 0.2).sum() - 1
            if key % 3 == 0:
                expected += 1
                assert ((scene, key) in near) == bool((d2[i][other] < 0.2 * 0.2).any()) == ((scene, key) not in far)
                best = np.flatnonzero(other)[np.argmin(d2[i][other])] if other.any() else None
                assert moved[(scene, key)] == ((ids[best], d2[i][best], f"n{ids[best]}") if other.any() else (None, None, None))
    assert {(None, 20001), (0, 20002)} <= far and len(near) + len(far) == expected + 2
    assert moved[(None, 20001)] == moved[(0, 20002)] == (None, None, None) and len(moved) == expected + 2


@pytest.mark.parametrize("dims, eps, least", [("xyz", 0.15, 5), ("xz", 0.06, 4), ("xyz", 0.001, 6)])
def test_density_clusters(spark, cloud, limit, dims, eps, least):
    rows, df = cloud
    got = {(r.scene_id, r.point_id): (r.cluster_id, r.is_core) for r in C.dbscan(df, eps, least, dims=tuple(dims)).collect()}
    assert len(got) == len(rows)
    for scene, (ids, xyz) in by_scene(rows).items():
        if dims == "xz":
            xyz = xyz[:, [0, 2, 2]] * [1, 1, 0]
        linked = distances(xyz, xyz) <= eps * eps
        core = linked.sum(axis=1) >= least
        part, number = np.full(len(ids), -1), 0
        for i in np.flatnonzero(core):
            if part[i] < 0:
                queue = [i]
                part[i] = number
                while queue:
                    for j in np.flatnonzero(linked[queue.pop()] & core & (part < 0)):
                        part[j] = number
                        queue.append(j)
                number += 1
        for i, key in enumerate(ids):
            reach = part[linked[i] & core]
            cluster = int(reach.min()) if len(reach) else None
            assert got[(scene, key)] == (cluster if not core[i] else int(part[i]), bool(core[i]))


def traffic(spark, run):
    """Bytes that ``run`` shuffles, spills and writes."""
    store, jvm = spark._jsc.sc().statusStore(), spark._jvm

    def total():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (stages.apply(i) for i in range(stages.size())))

    before = total()
    run()
    return total() - before


def test_traffic_follows_the_points(spark):
    """Lists, border copies and edges of small scenes leave no task: a point costs a few rows of its own size."""
    points = spark.range(30000).selectExpr(
        "id % 10 AS scene_id", "id AS point_id", *[f"rand({i}) * {w} AS {a}" for i, (a, w) in enumerate((("x", 5), ("y", 0.5), ("z", 4)))]).localCheckpoint()
    halves = points.where("point_id % 3 = 0"), points.where("point_id % 3 > 0")
    for run in (
        lambda: N.knn_sums(points, 50).count(), lambda: N.radius_count(points, 0.15).count(), lambda: N.nearest_transfer(*halves, []).count(),
        lambda: N.within_distance(*halves, 0.3).count(), lambda: C.dbscan(points, 0.15, 10).count(),
    ):
        assert traffic(spark, run) < 200 * 30000


def test_grid_components(spark, limit):
    """Cells of four scenes, a null among them, against a flood; and few jobs, where each round of the graph took several."""
    random = np.random.default_rng(8)
    snake = [(i, j) for i in range(0, 30, 2) for j in range(30)] + [(i, 29 * (i // 2 % 2 == 0)) for i in range(1, 29, 2)]
    scenes = {0: snake, 1: sorted({*map(tuple, random.integers(-9, 9, (150, 2)).tolist())}), 2: [(5, 5)], 3: [(0, 0), (0, 2), (1, 1), (-1, 1)]}
    rows = [(s, i, j, float(i * j)) for s, cells in scenes.items() for i, j in cells]
    rows += [(3, 0, 0, 7.0), (None, 1, 1, 0.0), (3, None, 1, 0.0)]
    expected = []
    for s, cells in scenes.items():
        left, number = set(cells), 0
        while left:
            todo, part = [min(left)], set()
            while todo:
                i, j = todo.pop()
                if (i, j) in left:
                    left.remove((i, j))
                    part.add((i, j))
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
            expected += [(r[0], r[1], r[2], r[3], number) for r in rows if r[0] == s and (r[1], r[2]) in part]
            number += 1
    df = spark.createDataFrame(random.permutation(np.array(rows, object)).tolist(), "scene_id long, i long, j long, h double")
    spark.sparkContext.setJobGroup("grid", "grid")
    got = [tuple(r) for r in C.grid_components(df).collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid"))
    spark.sparkContext.setJobGroup("", "")
    assert sorted(got) == sorted(expected)
    assert whole.WHOLE < 1 << 14 or jobs <= 8
