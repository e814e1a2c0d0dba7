"""Registry of queries with their SQL twins, and the derived tables as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.session import configure

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``f(spark, sf_dir)`` and, if there is one, its SQL."""

    def add(f):
        def run(spark, sf_dir):
            return f(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return add


def r(c, digits: int = 6) -> Column:
    """Rounded value without negative zero (the twin of ``rd`` in SQL)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


def rd(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0e0)"


# ---------------------------------------------------------------- derived tables

PM = """
k_ AS (SELECT (l_orderkey * 8 + l_linenumber) * 101 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) - 1 AS point_id,
    l_orderkey AS ok FROM lineitem),
u_ AS (
  SELECT CAST(point_id AS BIGINT) AS point_id, CAST(ok // 750 AS BIGINT) AS scene_id,
    (CAST(point_id AS BIGINT) * point_id * 31 + point_id * 7919) % 10007 AS u0,
    (CAST(point_id AS BIGINT) * point_id * 17 + point_id * 6101) % 10009 AS u1,
    (CAST(point_id AS BIGINT) * point_id * 13 + point_id * 4001) % 10037 AS u2,
    (CAST(point_id AS BIGINT) * point_id * 11 + point_id * 2003) % 10039 AS u3 FROM k_),
l_ AS (
  SELECT *, CASE WHEN u0 < 6000 THEN 0 WHEN u0 < 7500 THEN 1 WHEN u0 < 8400 THEN 2
    WHEN u0 < 8800 THEN 3 WHEN u0 < 9700 THEN 4 ELSE 255 END AS label FROM u_),
pm AS MATERIALIZED (
  SELECT scene_id, point_id, label,
    CAST(CASE label WHEN 0 THEN u1 % 5001 - 2500
      WHEN 1 THEN u1 % (401 + 10 * (scene_id % 30)) - (200 + 5 * (scene_id % 30))
      WHEN 2 THEN u1 % 701 - 350 WHEN 3 THEN u1 % 401 + 1300
      WHEN 4 THEN u1 % 1201 - 600 ELSE u1 % 4001 - 2000 END AS BIGINT) AS x_mm,
    CAST(CASE label WHEN 0 THEN u2 % 31 - 15 WHEN 1 THEN 144 + u2 % (301 + 20 * (scene_id % 40))
      WHEN 2 THEN u2 % 151 WHEN 3 THEN u2 % 1751 WHEN 4 THEN 122 + u2 % 23 ELSE u2 % 2001 END AS BIGINT) AS y_mm,
    CAST(CASE label WHEN 0 THEN u3 % 4001 - 2000 WHEN 1 THEN u3 % 601 - 300 WHEN 2 THEN u3 % 401 - 820
      WHEN 3 THEN u3 % 401 + 900 WHEN 4 THEN u3 % 801 - 400 ELSE u3 % 3001 - 1500 END AS BIGINT) AS z_mm
  FROM l_)"""

PTS = PM + """,
pts AS MATERIALIZED (
  SELECT scene_id, point_id, label, CAST(x_mm AS DOUBLE) / 1000e0 AS x, CAST(y_mm AS DOUBLE) / 1000e0 AS y,
    CAST(z_mm AS DOUBLE) / 1000e0 AS z FROM pm)"""

PREDS = PM + """,
preds AS MATERIALIZED (
  SELECT scene_id, point_id, label AS y_true,
    CASE WHEN (point_id * 37 + 11) % 100 < 85 THEN label ELSE (label + 1) % 5 END AS y_pred
  FROM pm WHERE label <> 255)"""

CAPTURES = """
captures AS MATERIALIZED (
  SELECT CAST(o_custkey % 20 + 1 AS BIGINT) AS scenario, CAST(o_orderkey % 10 + 1 AS BIGINT) AS capture,
    CAST(o_orderkey AS BIGINT) AS run_id,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) / 100000e0 END AS vol_ref,
    CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE
      CAST(o_totalprice AS DOUBLE) / 100000e0 * CAST(3 + o_orderkey % 17 AS DOUBLE) / 10e0 END AS vol_est
  FROM orders)"""

CAM = PM + """,
cam AS MATERIALIZED (
  SELECT scene_id, point_id, CASE point_id % 3 WHEN 0 THEN 'Izq' WHEN 1 THEN 'Der' ELSE 'Cenital' END AS camera,
    CAST(x_mm AS DOUBLE) / 1000e0 AS x, CAST(y_mm AS DOUBLE) / 1000e0 AS y, CAST(z_mm + 3000 AS DOUBLE) / 1000e0 AS z,
    CAST(point_id % 256 AS INTEGER) AS r, CAST((point_id * 7) % 256 AS INTEGER) AS g,
    CAST((point_id * 13) % 256 AS INTEGER) AS b FROM pm),
intr AS (
  SELECT * FROM (VALUES ('Izq', 2048e0, 1536e0, 1680e0, 1680e0, 1045e0, 758e0),
    ('Der', 2048e0, 1536e0, 1664e0, 1664e0, 1013e0, 750e0),
    ('Cenital', 1024e0, 768e0, 833e0, 833e0, 517e0, 382e0)) t(camera, w, h, fx, fy, cx, cy)),
uv_ AS (
  SELECT c.*, i.w, i.h,
    CAST(CASE WHEN z > 0 THEN round_even(fx * x / z + cx, 0) ELSE -1 END AS INTEGER) AS u,
    CAST(CASE WHEN z > 0 THEN round_even(fy * y / z + cy, 0) ELSE -1 END AS INTEGER) AS v
  FROM cam c JOIN intr i USING (camera)),
proj AS MATERIALIZED (
  SELECT *, z > 0 AND u >= 0 AND u < w AND v >= 0 AND v < h AS valid FROM uv_)"""

DETS = """
dets AS MATERIALIZED (
  SELECT scene_id, CASE cam WHEN 0 THEN 'Izq' WHEN 1 THEN 'Der' ELSE 'Cenital' END AS camera,
    CAST(CASE WHEN (scene_id + cam + k) % 7 = 0 THEN 2 ELSE 0 END AS INTEGER) AS cls,
    CAST((scene_id * 13 + cam * 29 + k * 31) % 90 + 10 AS DOUBLE) / 100e0 AS conf,
    CAST((scene_id * 37 + cam * 101 + k * 211) % 500 AS DOUBLE) AS x1,
    CAST((scene_id * 53 + cam * 67 + k * 97) % 400 AS DOUBLE) AS y1,
    CAST((scene_id * 37 + cam * 101 + k * 211) % 500 + 400 AS DOUBLE) AS x2,
    CAST((scene_id * 53 + cam * 67 + k * 97) % 400 + 300 AS DOUBLE) AS y2
  FROM (SELECT DISTINCT scene_id FROM pm) s, (VALUES (0), (1), (2)) c(cam), (VALUES (0), (1)) d(k))"""

_DIM = "CAST(({0}) // 100 AS VARCHAR) || '.' || lpad(CAST(({0}) % 100 AS VARCHAR), 2, '0')"


def _m(e: str) -> str:
    return "(" + _DIM.format(e) + ")"


_ITEM = (
    "CASE WHEN ps % 2 = 0 THEN '{\"type\":\"box\",\"w\":' || " + _m("28 + (pk * 7) % 70") + " || ',\"h\":' || "
    + _m("22 + (pk * 11) % 120") + " || ',\"d\":' || " + _m("28 + ps % 48")
    + " ELSE '{\"type\":\"cylinder\",\"r\":' || " + _m("14 + ps % 26") + " || ',\"h\":' || " + _m("28 + (pk * 5) % 94") + " END"
)
_OY = "CASE WHEN pk % 9 = 0 THEN '' ELSE ',\"oy\":' || " + _m("(pk * 3) % 90") + " END"
META = f"""
meta_ AS (SELECT CAST(p_partkey AS BIGINT) AS pk, CAST(p_size AS BIGINT) AS ps FROM part),
objs AS MATERIALIZED (
  SELECT pk // 4 AS scene_id, pk % 4 AS slot,
    CASE WHEN pk % 4 = 0 THEN 'cargo1' WHEN pk % 4 = 1 AND ps % 5 < 3 THEN 'cargo2' WHEN pk % 4 = 2 THEN 'vehicle'
      WHEN pk % 4 = 3 AND ps % 4 = 0 THEN 'person' ELSE 'floor' END AS name,
    CASE WHEN pk % 4 = 0 OR (pk % 4 = 1 AND ps % 5 < 3) THEN {_ITEM} || {_OY}
        || CASE WHEN pk % 4 = 1 THEN CASE WHEN ps % 3 = 0 THEN ',"placement":"stacked"' ELSE ',"placement":"tandem"' END ELSE '' END || '}}'
      WHEN pk % 4 = 2 THEN '{{"type":"' || CASE WHEN ps % 2 = 0 THEN 'forklift' ELSE 'pallet_jack' END || '"}}'
      WHEN pk % 4 = 3 AND ps % 4 = 0 THEN '{{"zone":"' || CASE ps % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'perimeter' ELSE 'elsewhere' END || '"}}'
      ELSE NULL END AS spec FROM meta_),
items AS MATERIALIZED (
  SELECT scene_id, slot, name, spec ->> '$.type' AS type, CAST(spec ->> '$.w' AS DOUBLE) AS w, CAST(spec ->> '$.h' AS DOUBLE) AS h,
    CAST(spec ->> '$.d' AS DOUBLE) AS d, CAST(spec ->> '$.r' AS DOUBLE) AS r, CAST(spec ->> '$.oy' AS DOUBLE) AS oy,
    spec ->> '$.placement' AS placement, spec ->> '$.zone' AS zone FROM objs)"""

# Clusters for reports: one cluster per object class and point parity.
CPTS = PTS + """,
cpts AS MATERIALIZED (
  SELECT *, CASE WHEN label BETWEEN 1 AND 4 THEN CAST((label - 1) * 2 + point_id % 2 AS BIGINT) END AS cluster_id FROM pts),
cpred AS MATERIALIZED (
  SELECT scene_id, cluster_id, COUNT(*) AS n, CAST((scene_id + cluster_id) % 3 + 1 AS INTEGER) AS y_pred,
    CAST((scene_id * 7 + cluster_id * 13) % 60 + 40 AS DOUBLE) / 100e0 AS max_prob
  FROM cpts WHERE cluster_id IS NOT NULL GROUP BY ALL),
anch AS MATERIALIZED (
  SELECT scene_id, min(x) AS x_min, max(x) AS x_max, min(z) AS z_min, max(z) AS z_max,
    (min(x) + max(x)) / 2e0 AS center_x, (min(z) + max(z)) / 2e0 AS center_z FROM pts WHERE label = 1 GROUP BY scene_id)"""


def cpts(spark, sf):
    from pointloom.sources import fixtures as fx

    return fx.points(spark, sf).withColumn(
        "cluster_id", F.when(F.col("label").between(1, 4), ((F.col("label") - 1) * 2 + F.col("point_id") % 2).cast("long"))
    )


def cpreds(points: DataFrame) -> DataFrame:
    sizes = points.where("cluster_id IS NOT NULL").groupBy("scene_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumns({
        "y_pred": ((F.col("scene_id") + F.col("cluster_id")) % 3 + 1).cast("int"),
        "max_prob": ((F.col("scene_id") * 7 + F.col("cluster_id") * 13) % 60 + 40).cast("double") / 100.0,
    })


def flat_floor(points: DataFrame) -> DataFrame:
    """Floor height 0 for every scene."""
    return points.select("scene_id").distinct().withColumn("floor_y", F.lit(0.0))


def cargo_anchor(points: DataFrame) -> DataFrame:
    from pointloom.operators.cluster import anchor_box

    return anchor_box(points.where("label = 1"))


def tilted_planes(points: DataFrame) -> DataFrame:
    """A slightly tilted plane per scene, upside down in every second one."""
    return points.select("scene_id").distinct().selectExpr(
        "scene_id", "CAST(scene_id % 3 AS DOUBLE) / 100D AS a",
        "CASE WHEN scene_id % 2 = 0 THEN 1D ELSE -1D END AS b",
        "CAST(scene_id % 5 AS DOUBLE) / 50D AS c", "CAST(scene_id % 7 AS DOUBLE) / 100D AS d",
    )


PLANES = """
planes AS MATERIALIZED (
  SELECT DISTINCT scene_id, CAST(scene_id % 3 AS DOUBLE) / 100e0 AS a,
    CASE WHEN scene_id % 2 = 0 THEN 1e0 ELSE -1e0 END AS b,
    CAST(scene_id % 5 AS DOUBLE) / 50e0 AS c, CAST(scene_id % 7 AS DOUBLE) / 100e0 AS d FROM pts)"""
