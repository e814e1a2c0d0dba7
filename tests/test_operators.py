"""Analytic cases and brute-force cross-checks on small frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom import params as P
from pointloom.functions.groups import attach, exact_percentiles, first_n, running_index
from pointloom.operators import cluster as C
from pointloom.operators import grids as G
from pointloom.operators import neighbors as N
from pointloom.operators import sampling as S
from pointloom.operators import transforms as T


def cloud(spark, xyz, scene=0, label=None):
    xyz = np.asarray(xyz, dtype=float)
    pdf = pd.DataFrame(xyz, columns=["x", "y", "z"])
    pdf.insert(0, "point_id", np.arange(len(xyz), dtype=np.int64))
    pdf.insert(0, "scene_id", np.full(len(xyz), scene, dtype=np.int64))
    if label is not None:
        pdf["label"] = np.asarray(label, dtype=np.int32)
    return spark.createDataFrame(pdf)


def brute_knn(xyz, k, self_too=True):
    out = {}
    for i, p in enumerate(xyz):
        d = ((xyz - p) ** 2)
        d = d[:, 0] + d[:, 1] + d[:, 2]
        order = [j for j in np.lexsort((np.arange(len(xyz)), d)) if self_too or j != i]
        out[i] = [int(j) for j in order[:k]]
    return out


@pytest.mark.parametrize("self_too", [True, False])
def test_knn_with_copies_dense_spot_and_outlier(spark, self_too):
    rng = np.random.default_rng(1)
    xyz = np.vstack([
        rng.uniform(-1, 1, (60, 3)), rng.normal(0.3, 0.001, (60, 3)),
        np.repeat([[0.5, 0.5, 0.5]], 40, axis=0),  # one location holds a fifth of the points
        [[40.0, 0.0, -7.0]],
    ])
    got = {}
    for r in N.knn(cloud(spark, xyz), 6, include_self=self_too).orderBy("point_id", "rank").collect():
        got.setdefault(r["point_id"], []).append(r["nbr_id"])
    assert got == brute_knn(xyz, 6, self_too)


def test_knn_and_nearest_in_a_dense_cube_with_a_stray(spark):
    """Cells shrink to the cube's density although one return lies 100 km away."""
    rng = np.random.default_rng(4)
    xyz = np.vstack([rng.uniform(0, 0.04, (1500, 3)), [[100_000.0, 0.0, 0.0]]])
    got = {}
    for r in N.knn(cloud(spark, xyz), 5).orderBy("point_id", "rank").collect():
        got.setdefault(r["point_id"], []).append(r["nbr_id"])
    assert got == brute_knn(xyz, 5)
    asked = rng.uniform(0, 0.04, (50, 3))
    found = {r["point_id"]: r["nn_id"] for r in N.nearest_transfer(cloud(spark, asked), cloud(spark, xyz), []).collect()}
    assert found == {i: int(((xyz - p) ** 2).sum(1).argmin()) for i, p in enumerate(asked)}


def test_fov_filter_keeps_exempt_and_seen(spark):
    camera = {"pos": (0.0, 0.0, 5.0), "fov_deg": 60.0}
    df = cloud(spark, [[0, 0, 0], [50, 0, 0], [50, 0, 0], [0, 0, 5]], label=[1, 1, 2, 1])
    kept = T.fov_filter(df, (camera,), exempt=(2,))
    assert sorted(r["point_id"] for r in kept.collect()) == [0, 2]
    assert T.fov_filter(df, (), exempt=()).count() == 0


def test_knn_small_scene_gives_all(spark):
    assert N.knn(cloud(spark, [[0, 0, 0], [1, 0, 0], [0, 2, 0]]), 20).count() == 9


def test_radius_count_counts_copies(spark):
    xyz = [[0, 0, 0]] * 5 + [[0.1, 0, 0], [0.2, 0, 0]]
    got = {r["point_id"]: r["n"] for r in N.radius_count(cloud(spark, xyz), 0.15).collect()}
    assert [got[i] for i in (0, 5, 6)] == [5, 6, 1]


def test_nearest_transfer_far_target_and_tie(spark):
    left = cloud(spark, [[0, 0, 0], [9, 9, 9]])
    right = cloud(spark, [[1, 0, 0], [-1, 0, 0], [30, 9, 9]], label=[7, 8, 9])
    got = {r["point_id"]: (r["nn_id"], r["label"]) for r in N.nearest_transfer(left, right, "label").collect()}
    assert got == {0: (0, 7), 1: (0, 7)}


def brute_dbscan(xyz, eps, min_pts):
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(-1) <= eps * eps
    core = d.sum(1) >= min_pts
    label = np.full(len(xyz), -1)
    n = 0
    for i in np.where(core)[0]:
        if label[i] >= 0:
            continue
        stack = [i]
        label[i] = n
        while stack:
            for j in np.where(d[stack.pop()] & core)[0]:
                if label[j] < 0:
                    label[j] = n
                    stack.append(j)
        n += 1
    for i in np.where(~core)[0]:
        near = label[d[i] & core]
        if len(near):
            label[i] = near.min()
    return label


def test_dbscan_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    xyz = np.vstack([rng.normal(0, 0.05, (150, 3)), rng.normal(0.5, 0.04, (80, 3)), rng.uniform(-1, 1, (60, 3)),
                     np.repeat([[0.0, 0.9, 0.0]], 20, axis=0), np.c_[np.linspace(0, 0.6, 60), np.full(60, -0.5), np.zeros(60)]])
    got = C.dbscan(cloud(spark, xyz), 0.08, 6).orderBy("point_id").collect()
    want = brute_dbscan(xyz, 0.08, 6)
    assert [(-1 if r["cluster_id"] is None else r["cluster_id"]) for r in got] == want.tolist()


def test_components_of_a_long_chain(spark):
    n = 200
    ids = np.random.default_rng(0).permutation(n)
    nodes = spark.createDataFrame([(0, int(i)) for i in range(n)], "scene_id long, id long")
    edges = spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(ids, ids[1:])], "scene_id long, a long, b long")
    assert {r["root"] for r in C.components(nodes, edges).collect()} == {0}


def test_volume_of_a_unit_cube_top(spark):
    rng = np.random.default_rng(0)
    xz = rng.uniform(-0.5, 0.5, (10_000, 2))
    pts = cloud(spark, np.c_[xz[:, 0], np.ones(10_000), xz[:, 1]])
    field = P.HeightFieldParams(offset=0.0)
    row = G.height_field_volume(G.height_field(pts, None, field), pts, field).first()
    assert abs(row["volume_m3"] - 1.0) < 0.05


def test_volume_of_low_and_empty_clouds(spark):
    low = cloud(spark, [[0, 0.05, 0], [0.1, 0.05, 0.1]])
    row = G.height_field_volume(G.height_field(low), low).first()
    assert (row["volume_m3"], row["n_cells"]) == (0.0, 0)


def test_halo_is_dropped_only_next_to_tall_cells(spark):
    cells = [(0, i, j, 1.0) for i in range(4) for j in range(4)] + [(0, 10, j, 0.09) for j in range(4)]
    cells += [(1, 0, j, 0.09) for j in range(3)]
    df = spark.createDataFrame(cells, "scene_id long, i long, j long, h double")
    out = C.halo_filter(df).groupBy("scene_id").agg(F.count("*").alias("n"), F.max("halo_used").alias("u")).collect()
    assert {r["scene_id"]: (r["n"], r["u"]) for r in out} == {0: (16, True), 1: (3, False)}


def test_floor_is_chosen_over_a_big_cargo_top(spark):
    rng = np.random.default_rng(3)
    floor = np.c_[rng.uniform(-2, 2, 600), rng.normal(0, 0.005, 600), rng.uniform(-2, 2, 600)]
    top = np.c_[rng.uniform(-0.5, 0.5, 2000), np.full(2000, 0.5), rng.uniform(-0.5, 0.5, 2000)]
    params = P.ExtractionParams(floor_hypotheses=200)
    row = C.floor_plane(cloud(spark, np.vstack([floor, top])), params).first()
    assert abs(row["floor_y"]) < 0.02


def test_wall_has_no_floor(spark):
    rng = np.random.default_rng(3)
    wall = np.c_[np.zeros(400), rng.uniform(0, 2, 400), rng.uniform(-1, 1, 400)]
    assert C.floor_plane(cloud(spark, wall), P.ExtractionParams(floor_hypotheses=50)).count() == 0


def test_negative_filter_truth_table(spark):
    rows = [(0, 0, 50, 1, 0.9), (0, 1, 40, 2, 0.9), (0, 2, 30, 3, 0.6), (0, 3, 20, 9, 0.99), (1, 0, 10, 2, 0.8), (1, 1, 99, 3, 0.9)]
    df = spark.createDataFrame(rows, "scene_id long, cluster_id long, n long, y_pred int, max_prob double")
    got = {(r["scene_id"], r["cluster_id"]): (r["keep"], r["source"]) for r in C.negative_filter(df).collect()}
    assert [got[(0, i)][0] for i in range(4)] == [True, False, True, True]
    assert got[(1, 0)] == (False, "fallback_rank0") and got[(1, 1)] == (True, "fallback_rank0")


def test_percentiles_equal_numpy_with_one_hot_group(spark):
    rng = np.random.default_rng(2)
    values = {0: np.r_[rng.normal(0, 1, 3000), np.zeros(2000)], 1: rng.normal(5, 2, 7), 2: np.array([4.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g long, v double")
    wanted = {"a": 0.02, "b": 0.3, "c": 0.5, "d": 0.98}
    for r in exact_percentiles(df, "g", "v", wanted).collect():
        want = np.percentile(values[r["g"]], [100 * p for p in wanted.values()])
        assert np.allclose([r[k] for k in wanted], want, atol=1e-12)


def test_first_n_does_not_depend_on_partitioning(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "id AS point_id", "CAST((id * id * 7 + id * 31) % 997 AS DOUBLE) / 997 AS u")
    pick = lambda d: {r["point_id"] for r in first_n(d, "g", "u", "point_id", F.floor(F.col("_group") * 0.2)).collect()}
    a, b = pick(df), pick(df.repartition(13))
    rows = df.toPandas().sort_values(["u", "point_id"])
    want = {i for _, x in rows.groupby("g") for i in x["point_id"].head(int(len(x) * 0.2))}
    assert a == b == want


def test_running_index_is_dense(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id * 17 AS k")
    got = running_index(df, "g", "k", 500).orderBy("g", "k").collect()
    assert [r["idx"] for r in got] == list(range(500)) * 2


def test_folds_keep_scenes_whole(spark):
    df = spark.range(4000).selectExpr("id % 23 AS scene_id", "id AS point_id", "CAST(id % 4 AS INT) AS label")
    folds = S.assign_folds(df, 5).collect()
    assert len({r["scene_id"] for r in folds}) == len(folds) == 23
    sizes = pd.Series([r["fold"] for r in folds]).value_counts()
    assert set(sizes.index) == set(range(5)) and sizes.max() - sizes.min() <= 1


def test_unknown_class_weight_is_an_error(spark):
    with pytest.raises(ValueError):
        S.class_weights(cloud(spark, [[0, 0, 0]], label=[1]), {"truck": 2.0})


def test_noise_grows_with_depth_squared(spark):
    rng = np.random.default_rng(0)
    cams = ({"name": "top", "pos": (0.0, 0.0, 0.0), "fov_deg": 90.0},)
    params = P.DegradeParams(cameras=cams)
    sigma = []
    for depth in (3.5, 4.6):
        pts = cloud(spark, np.c_[rng.uniform(-0.05, 0.05, (20_000, 2)), np.full(20_000, depth)])
        q = S.axial_noise(pts, params).selectExpr("percentile(noise, array(0.25, 0.75)) AS q").first()["q"]
        sigma.append((q[1] - q[0]) / 1.349)
    assert abs(sigma[1] / sigma[0] / (4.6 / 3.5) ** 2 - 1) < 0.3


def test_rotation_levels_a_tilted_plane(spark):
    rng = np.random.default_rng(0)
    xz = rng.uniform(-1, 1, (500, 2))
    pts = cloud(spark, np.c_[xz[:, 0], 0.1 * xz[:, 0] + 0.3, xz[:, 1]])
    planes = spark.createDataFrame([(0, -0.1, 1.0, 0.0, -0.3)], "scene_id long, a double, b double, c double, d double")
    spread = T.level_to_plane(pts, planes).selectExpr("max(y) - min(y) AS s").first()["s"]
    assert spread < 1e-9


@pytest.mark.parametrize("limit", [0, 1 << 40])
def test_attach_is_the_same_for_any_limit(spark, limit):
    rows = spark.createDataFrame([(i % 3, i) for i in range(50)], "k long, v long")
    small = spark.createDataFrame([(0, {"a": 1}), (1, {"b": 2})], "k long, m map<string,int>")
    got = {(r["v"], str(r["m"])) for r in attach(rows, small, "k", max_bytes=limit).collect()}
    assert got == {(i, str({0: {"a": 1}, 1: {"b": 2}}.get(i % 3))) for i in range(50)}


def test_components_of_long_shapes(spark):
    """A horseshoe of cells and a sorted chain settle; 80-cell legs once needed a round per cell."""
    cells = [(1, 0, j) for j in range(80)] + [(1, 4, j) for j in range(80)] + [(1, i, 0) for i in range(1, 4)] + [(1, 2, 40)]
    got = C.grid_components(spark.createDataFrame(cells, "scene_id long, i long, j long"))
    assert got.groupBy("component").count().orderBy("component").collect()[0]["count"] == 163 and got.select("component").distinct().count() == 2
    n = 3000
    nodes = spark.createDataFrame([(1, i) for i in range(n + 1)], "scene_id long, id long")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(n - 1)], "scene_id long, a long, b long")
    assert {(r["root"], r["count"]) for r in C.components(nodes, edges).groupBy("root").count().collect()} == {(0, n), (n, 1)}


def test_radius_counts_settle_boxes_by_bounds():
    from pointloom.operators import tiles

    rng = np.random.default_rng(6)
    grown = []
    for n in (3000, 30_000):
        xyz = rng.uniform(0, 0.4, (n, 3))
        weight = rng.integers(1, 4, n)
        c = np.floor(xyz / 0.1).astype(int) + 1
        cells = (c[:, 0] * tiles.WIDE + c[:, 1]) * tiles.WIDE + c[:, 2]
        found = tiles.Within(xyz, cells, 0.1, False)
        for part in np.array_split(np.arange(n), 3):
            found.add(xyz[part], weight[part], cells[part])
        for i in range(0, n, n // 40):
            d = xyz[i] - xyz
            assert found.weight[i] == weight[(d * d).sum(axis=1) <= 0.1 * 0.1].sum()
        grown.append(found.pairs / n)
    # Ten times the density: ten times the neighbours of a point, but fewer than that in compared pairs.
    assert grown[1] < 8 * grown[0]


def test_within_distance_forms(spark):
    rng = np.random.default_rng(7)
    a, b = rng.uniform(-1, 1, (300, 3)), rng.uniform(-1, 1, (40, 3))
    b[:3] = a[:3] + [0.25, 0, 0]
    left, right = cloud(spark, np.vstack([a, a[:5]])), cloud(spark, b, scene=1)
    d2 = lambda i: min((b[:, 0] - a[i % 300, 0]) ** 2 + (b[:, 1] - a[i % 300, 1]) ** 2 + (b[:, 2] - a[i % 300, 2]) ** 2)
    near = {i for i in range(305) if d2(i) < 0.25 * 0.25}
    ids = lambda df: sorted(r["point_id"] for r in df.collect())
    assert ids(N.within_distance(left, right, 0.25, scene=None)) == sorted(near)
    assert ids(N.within_distance(left, right, 0.25, scene=None, keep=False)) == sorted(set(range(305)) - near)
    assert N.within_distance(left, right, 0.25).count() == 0
    missing = left.withColumn("x", F.when(F.col("point_id") == 0, F.lit(None)).otherwise(F.col("x")))
    assert 0 in ids(N.within_distance(missing, right, 0.25, scene=None, keep=False)) and missing.columns == N.within_distance(missing, right, 0.25).columns


def test_settled_points_are_not_searched_again(spark, monkeypatch):
    """Most points are settled at the first level, and only the others ask again."""
    rng = np.random.default_rng(8)
    xyz = np.vstack([rng.uniform(0, 2, (1500, 3)), rng.uniform(0, 20, (60, 3))])
    again = []
    monkeypatch.setattr(N, "attach", lambda df, small, keys, *a, f=N.attach, **k: (again.append(small.count()) if "_ask" in small.columns else None) or f(df, small, keys, *a, **k))
    got = {}
    for r in N.knn(cloud(spark, xyz), 8).orderBy("point_id", "rank").collect():
        got.setdefault(r["point_id"], []).append(r["nbr_id"])
    assert got == brute_knn(xyz, 8) and sum(again) < 0.2 * len(xyz)


def test_percentiles_narrow_until_buckets_are_small(spark):
    rng = np.random.default_rng(9)
    v = {0: rng.normal(size=4000), 1: np.round(rng.normal(size=900), 1), 2: rng.normal(size=1)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [(3, None)], "g int, v double")
    wanted = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.987, "e": 1.0}
    got = {r["g"]: r for r in exact_percentiles(df, "g", "v", wanted, buckets=8, bound=20).collect()}
    assert set(got) == {0, 1, 2}
    for k, xs in v.items():
        for name, p in wanted.items():
            assert math.isclose(got[k][name], np.quantile(xs, p), rel_tol=1e-12, abs_tol=1e-12)
    total = exact_percentiles(df, [], "v", {"m": 0.5}, buckets=4, bound=10).first()["m"]
    assert math.isclose(total, np.median(np.concatenate(list(v.values()))), rel_tol=1e-12)


def test_best_plane_leaves_no_winner_out(spark):
    rng = np.random.default_rng(10)
    xyz = np.vstack([np.column_stack([rng.uniform(-2, 2, 900), rng.normal(0, 0.01, 900), rng.uniform(-2, 2, 900)]), rng.uniform(-1, 1, (600, 3))])
    normal = rng.normal([0, 1, 0], 0.1, (80, 3))
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    planes = [(0, h, *map(float, n), float(rng.normal(0, 0.05))) for h, n in enumerate(normal)]
    df = cloud(spark, xyz)
    got = C.best_plane(df, spark.createDataFrame(planes, "scene_id long, h long, a double, b double, c double, d double")).first()
    counts = [int((np.abs(p[2] * xyz[:, 0] + p[3] * xyz[:, 1] + p[4] * xyz[:, 2] + p[5]) <= 0.025).sum()) for p in planes]
    assert (got["h"], got["inliers"]) == (int(np.argmax(counts)), max(counts))


def test_choice_of_cargo_by_predictions(spark):
    rows = [(s, 10 * c + i, 0.0, 0.5, 0.0, c) for s in range(4) for c, n in ((0, 5), (1, 9), (2, 3)) for i in range(n)] + [(0, 99, 0.0, 0.5, 0.0, None)]
    clustered = spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double, cluster_id long")
    preds = spark.createDataFrame(
        [(0, 0, 3, 0.9), (0, 1, 2, 0.8), (0, 2, 1, 0.5), (1, 0, 3, 0.9), (1, 1, 2, 0.8), (1, 2, 3, 1.0), (2, 0, 3, 0.7), (2, 1, 2, 0.99)],
        "scene_id long, cluster_id long, y_pred int, max_prob double")
    points, summary = C.choose_cargo(clustered, None, None, preds=preds)
    kept = {s: {r["cluster_id"] for r in points.where(f"scene_id = {s}").collect()} for s in range(4)}
    assert kept == {0: {2}, 1: {1}, 2: {0, 2}, 3: {0, 1, 2}}  # confident exclusion, fallback, doubtful or missing predictions stay
    got = {r["scene_id"]: (r["n_in_anchor"], r["n_clusters"], r["cluster_id"], r["n_kept"], r["n_excluded"], r["source"]) for r in summary.collect()}
    assert got == {0: (18, 3, -1, 1, 2, "classifier"), 1: (17, 3, 1, 0, 3, "fallback_rank0"), 2: (17, 3, -1, 2, 1, "classifier"), 3: (17, 3, -1, 3, 0, "classifier")}


def test_later_attempts_see_only_the_scenes_without_a_cluster(spark):
    rows = spark.createDataFrame([(s, p) for s in range(4) for p in range(3)], "scene_id long, point_id long")
    asked = []

    def attempt(success):
        def run(df):
            asked.append(sorted(r[0] for r in df.select("scene_id").distinct().collect()))
            return df.withColumn("cluster_id", F.when(F.col("scene_id").isin(success) & (F.col("point_id") > 0), F.col("point_id")))
        return run

    attempts = [attempt([0, 2]), attempt([0, 1]), attempt([2])]
    got = sorted(map(tuple, C.in_turn(rows, attempts).select("scene_id", "point_id", "attempt").collect()))
    assert asked == [[0, 1, 2, 3], [1, 3], [3]]
    want = C.first_success([a(rows) for a in attempts])
    assert got == sorted(map(tuple, want.select("scene_id", "point_id", "attempt").collect())) and len(got) == 6
