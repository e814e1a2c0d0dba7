"""Operators with several passes derive their input once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import cluster as C
from pointloom.operators import evaluate as E
from pointloom.operators import grids as G
from pointloom.operators import sampling as S


@pytest.fixture
def counted(spark):
    """A small labelled cloud and the number of its rows that were derived so far."""
    random = np.random.default_rng(2)
    rows = [(s, i, *map(float, random.random(3) * [4, 2, 4]), int(i % 3), float(random.random())) for s in range(3) for i in range(200)]
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "scene_id long, point_id long, x double, y double, z double, label int, height double"
    return spark.createDataFrame(rows, schema).mapInArrow(count, schema), made


def test_dataset_stats(counted):
    cloud, made = counted
    assert E.dataset_stats(cloud, 50).count() == 1
    assert made.value == 600


@pytest.mark.parametrize("run", [
    G.detect_floor_y, lambda cloud: C.tall_column_person(cloud, 0.3, edge=6), lambda cloud: S.context_sample(cloud, 0.5, 0.1, 0.3),
], ids=["detect_floor_y", "tall_column_person", "context_sample"])
def test_grids_and_samples(counted, run):
    cloud, made = counted
    run(cloud).collect()
    assert made.value == 600


def test_excluded_cluster_report(spark, counted):
    """The cloud is derived once, and means that lie between two rounded values do not depend on the order of the rows."""
    cloud, made = counted
    preds = spark.createDataFrame([(s, 0, 2, 0.5) for s in range(3)], "scene_id long, cluster_id long, y_pred int, max_prob double")
    floor = spark.createDataFrame([(s, 0.0) for s in range(3)], "scene_id long, floor_y double")
    run = lambda df: {r.scene_id: r for r in E.excluded_cluster_report(df, preds, floor).collect()}
    found = run(cloud.withColumn("cluster_id", F.lit(0).cast("long")))
    assert made.value == 600 and {r.n for r in found.values()} == {200}
    mm = [1494, 1495, 1494, 1494, 1495, 1494, 1494, 1495, 1495, 1494, 1495, 1494, 1494, 1494, 1494, 1494]
    total = sum(mm) / 1000 / 16
    for order in (mm, mm[::-1], sorted(mm)):
        rows = [(0, i, x / 1000, i % 7 / 10, x / 1000, 0) for i, x in enumerate(order)]
        got = run(spark.createDataFrame(rows, "scene_id long, point_id long, x double, y double, z double, cluster_id long").coalesce(1))[0]
        assert got.ctr_x == got.ctr_z == total
