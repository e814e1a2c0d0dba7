"""Percentiles and first rows of groups that fit in a task and of larger ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import graph
from pointloom.functions.groups import exact_percentiles, first_n

from test_whole import traffic


@pytest.mark.parametrize("bound", [1 << 16, 200, 3])
def test_small_and_large_groups(spark, bound):
    random = np.random.default_rng(3)
    rows = [(g, i, float(v)) for g, n in enumerate((1, 2, 40, 900)) for i, v in enumerate(random.integers(0, 700, n) / 700)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    got = {r.g: r for r in exact_percentiles(df, "g", "v", {"q": 0.3, "m": 0.5}, 4, bound).collect()}
    first = first_n(df, "g", "v", "i", F.greatest(F.lit(2), F.floor(F.col("_group") * 0.3)), 16, bound).collect()
    for g in range(4):
        own = sorted((v, i) for h, i, v in rows if h == g)
        values = [v for v, _ in own]
        assert abs(got[g].q - np.quantile(values, 0.3)) < 1e-12 and abs(got[g].m - np.median(values)) < 1e-12
        assert sorted((r.v, r.i) for r in first if r.g == g) == own[: max(2, int(len(own) * 0.3))]


def test_small_groups_are_shuffled_once(spark):
    df = spark.range(60000).selectExpr("id % 20 AS g", "id AS i", "rand(1) AS v").localCheckpoint()
    assert traffic(spark, lambda: first_n(df, "g", "v", "i", F.lit(5000)).count()) < 60000
    assert traffic(spark, lambda: exact_percentiles(df, "g", "v", {"m": 0.5}).count()) < 40 * 60000


@pytest.mark.parametrize("few", [1 << 20, 40, 0], ids=["one task", "last rounds", "rounds"])
def test_components_of_few_edges(spark, monkeypatch, few):
    """What is left of a graph is settled in one task; a small graph takes no rounds."""
    random = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(300) if i % 60] + [(-5, 2 ** 62), (7, 7), (900, 900)] + random.integers(1000, 1400, (250, 2)).tolist()
    root = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    monkeypatch.setattr(graph, "FEW", few, raising=False)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges] + [(None, 3)], "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("few", "few")
    got = graph.connected_components(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("", "")
    assert {r.node: r.root for r in got.collect()} == root
    assert few < 1 << 20 or jobs <= 12
