"""Queries against their SQL twins on the smallest data set.

``FULL=1`` runs every registered query; by default a few from each family.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "agg18_height_field_volume", "prj6_level_to_plane", "flt7_facing_filter", "flt13_check_scenes", "agg5_floor_axis", "agg7_height_above_local_floor",
    "agg19_oriented_box", "jn1_knn_20", "jn3_radius_count", "jn4_nearest_transfer", "clu3_dbscan_3d", "clu10_halo_filter", "jn8_remove_detected",
    "smp1_stratified_sample", "ev5_scene_metrics", "agg28_ratio_stats",
]
NAMES = list(entry_point.oracle_sql()) if os.environ.get("FULL") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((v is None, "" if isinstance(v, (int, float)) else str(v), v if isinstance(v, (int, float)) else 0) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    cur = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
            else:
                assert x == y


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
