"""Spread of normals and counts around a point, in whole scenes and beside larger ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import features as FE
from pointloom.operators import neighbors as N
from pointloom.operators import whole


@pytest.fixture(scope="module")
def cloud(spark):
    """Three scenes: even, many copies of few places, and a single point."""
    random = np.random.default_rng(8)
    parts = [random.random((150, 3)), random.integers(0, 3, (90, 3)) / 4.0, random.random((1, 3))]
    rows = [(scene, (i * 7919) % 1009, *map(float, p), i % 3) for scene, part in enumerate(parts) for i, p in enumerate(part)]
    return spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double, label int").repartition(3).cache()


@pytest.mark.parametrize("limit", [1 << 14, 100, 0], ids=["whole", "mixed", "tiles"])
@pytest.mark.parametrize("include_self", [True, False])
def test_spread_is_that_of_the_neighbours(cloud, monkeypatch, limit, include_self):
    monkeypatch.setattr(whole, "WHOLE", limit)

    def describe(near):
        return near.select("scene_id", "point_id", "label", "ids", "within", (F.col("y") + F.col("s_sy")).alias("v"))

    got = N.neighbourhoods(cloud, 5, 9, describe, "v", include_self, radius=0.3, keep=["label"])
    got = {(r.scene_id, r.point_id): r for r in got.collect()}
    near = N.knn(cloud, 5, include_self).select("scene_id", "point_id", "nbr_id", "y", "ny").collect()
    value, lists = {}, {}
    for r in near:
        value[r.scene_id, r.point_id] = value.get((r.scene_id, r.point_id), r.y) + r.ny - r.y
        lists.setdefault((r.scene_id, r.point_id), []).append(r.nbr_id)
    within = {(r.scene_id, r.point_id): r.n for r in N.radius_count(cloud, 0.3).collect()}
    label = {(r.scene_id, r.point_id): r.label for r in cloud.collect()}
    assert got.keys() == lists.keys()
    for key, ids in lists.items():
        assert got[key].spread == pytest.approx(np.std([value[key[0], i] for i in ids]), abs=1e-9)
        assert (got[key].within, got[key].label) == (within[key], label[key])


@pytest.mark.parametrize("features", [FE.point_features, FE.raw_point_features])
def test_whole_scenes_need_no_row_per_neighbour(cloud, features):
    plan = features(cloud)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and plan.count("MapInArrow") == 2
