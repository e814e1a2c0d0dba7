"""The plane with most points: counted in the scene's task, and by boxes in larger scenes."""

import numpy as np
import pytest

from pointloom.operators import cluster as C
from pointloom.operators import whole


@pytest.fixture(scope="module")
def given(spark):
    """Two scenes with planes, some of them equal, one without planes, and planes of a scene without points."""
    random = np.random.default_rng(4)
    points = [(s, *map(float, random.random(3) * [2, 0.1 + s, 2])) for s, n in ((0, 300), (1, 80), (2, 20)) for _ in range(n)]
    normals = random.normal(size=(12, 3)) * [0.05, 1, 0.05]
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    planes = [(s, h, *map(float, normals[h % 9]), float(-0.1 * (h % 3))) for s in (0, 1, 3) for h in range(12)]
    return points, planes, spark.createDataFrame(points, "scene_id long, x double, y double, z double"), spark.createDataFrame(
        planes, "scene_id long, h long, a double, b double, c double, d double")


@pytest.mark.parametrize("limit", [1 << 14, 100, 0], ids=["whole", "mixed", "boxes"])
def test_best_plane_is_that_of_brute_force(given, monkeypatch, limit):
    monkeypatch.setattr(whole, "WHOLE", limit)
    points, planes, rows, drawn = given
    want = {}
    for s, h, a, b, c, d in sorted(planes):
        xyz = np.array([p[1:] for p in points if p[0] == s]).reshape(-1, 3)
        n = int((np.abs(a * xyz[:, 0] + b * xyz[:, 1] + c * xyz[:, 2] + d) <= 0.05).sum())
        if len(xyz) and n > want.get(s, (0, -1))[1]:
            want[s] = (h, n, a, b, c, d)
    got = C.best_plane(rows, drawn, 0.05)
    assert got.columns == ["scene_id", "h", "inliers", "a", "b", "c", "d"]
    assert {r.scene_id: tuple(r)[1:] for r in got.collect()} == want and len(want) == 2


def test_small_scenes_need_no_packs(given):
    plan = C.best_plane(given[2], given[3])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Aggregate" not in plan and "Join" not in plan
