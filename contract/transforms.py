"""Queries for projections, transforms, filters, set operations and plain joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointloom import params as P
from pointloom.functions.lineage import cut
from pointloom.operators import grids as G
from pointloom.operators import transforms as T
from pointloom.sources import fixtures as fx
from pointloom.sources import tables as TB

from .base import (
    CAM, CPTS, DETS, META, PLANES, PM, PTS, cargo_anchor, cpreds, cpts, flat_floor, query, r, rd, rounded, tilted_planes,
)

AXIS_SQL = """
lim AS (SELECT scene_id, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM pts GROUP BY 1),
ax_ AS (
  SELECT scene_id, 0 AS axis, x AS v, lx AS lo, hx AS hi FROM pts JOIN lim USING (scene_id)
  UNION ALL SELECT scene_id, 1, y, ly, hy FROM pts JOIN lim USING (scene_id)
  UNION ALL SELECT scene_id, 2, z, lz, hz FROM pts JOIN lim USING (scene_id)),
peak_ AS (
  SELECT scene_id, axis, bin, COUNT(*) AS n FROM (
    SELECT scene_id, axis, CAST(least(floor((v - lo) * 100 / (hi - lo)), 99) AS BIGINT) AS bin FROM ax_) GROUP BY ALL),
best_ AS (SELECT scene_id, axis, max(n) AS peak FROM peak_ GROUP BY ALL),
fax AS MATERIALIZED (
  SELECT scene_id, CAST(axis AS INTEGER) AS floor_axis, peak FROM (
    SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY peak DESC, axis) AS rn FROM best_) WHERE rn = 1)"""

FLOOR_Y_SQL = """
p30_ AS (SELECT scene_id, quantile_cont(y, 0.3) AS p FROM pts GROUP BY 1),
low_ AS (SELECT scene_id, y, min(y) OVER (PARTITION BY scene_id) AS lo, max(y) OVER (PARTITION BY scene_id) AS hi
  FROM pts JOIN p30_ USING (scene_id) WHERE y < p),
bin_ AS (SELECT scene_id, lo, hi, CAST(least(floor((y - lo) * 200 / (hi - lo)), 199) AS BIGINT) AS bin, COUNT(*) AS n FROM low_ GROUP BY ALL),
fy AS MATERIALIZED (
  SELECT scene_id, lo + bin * (hi - lo) / 200 AS floor_y FROM (
    SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, bin) AS rn FROM bin_) WHERE rn = 1)"""


@query("prj1_align_axes", f"""WITH {PTS}, {AXIS_SQL}
SELECT p.scene_id, point_id, {rd("CASE WHEN floor_axis = 0 THEN y ELSE x END")} AS x,
  {rd("CASE floor_axis WHEN 0 THEN x WHEN 2 THEN z ELSE y END")} AS y, {rd("CASE WHEN floor_axis = 2 THEN y ELSE z END")} AS z
FROM pts p JOIN fax USING (scene_id)""")
def _(spark, sf):
    return rounded(T.align_axes(fx.points(spark, sf)).select("scene_id", "point_id", "x", "y", "z"), "x", "y", "z")


@query("prj1_z_to_y", f"""WITH {PTS} SELECT scene_id, point_id, {rd("x")} AS x, {rd("z")} AS y, {rd("y")} AS z FROM pts""")
def _(spark, sf):
    return rounded(T.align_axes(fx.points(spark, sf), "z_to_y").select("scene_id", "point_id", "x", "y", "z"), "x", "y", "z")


@query("prj2_translate_floor", f"""WITH {PTS}, {FLOOR_Y_SQL}
SELECT scene_id, point_id, {rd("y - floor_y")} AS y FROM pts JOIN fy USING (scene_id)""")
def _(spark, sf):
    p = cut(fx.points(spark, sf))
    return rounded(T.translate_floor(p, G.detect_floor_y(p)).select("scene_id", "point_id", "y"), "y")


_S, _C = repr(math.sin(math.radians(47.5))) + "e0", repr(math.cos(math.radians(47.5))) + "e0"


@query("prj3_camera_to_world", f"""WITH {CAM} SELECT scene_id, point_id, {rd(f"z * {_C} + y * {_S}")} AS world_x,
  {rd(f"3.8e0 - z * {_S} - y * {_C}")} AS height, {rd("-x")} AS world_y FROM cam""")
def _(spark, sf):
    out = T.camera_to_world(fx.camera_points(spark, sf)).select("scene_id", "point_id", "world_x", "height", "world_y")
    return rounded(out, "world_x", "height", "world_y")


@query("prj4_project_pinhole", f"WITH {CAM} SELECT scene_id, point_id, camera, u, v, valid FROM proj")
def _(spark, sf):
    return T.project_pinhole(fx.camera_points(spark, sf)).select("scene_id", "point_id", "camera", "u", "v", "valid")


PLANE_H = f"""{PTS}, {PLANES},
ph_ AS (SELECT p.*, (x * a + y * b + z * c + d) / sqrt(a * a + b * b + c * c) AS h FROM pts p JOIN planes USING (scene_id)),
ph AS MATERIALIZED (SELECT scene_id, point_id, x, y, z, label,
  CASE WHEN avg(h) OVER (PARTITION BY scene_id) < 0 THEN -h ELSE h END AS height FROM ph_)"""


@query("prj5_height_above_plane", f"WITH {PLANE_H} SELECT scene_id, point_id, {rd('height')} AS height FROM ph")
def _(spark, sf):
    p = fx.points(spark, sf)
    return rounded(T.height_above_plane(p, tilted_planes(p)).select("scene_id", "point_id", "height"), "height")


@query("prj6_level_to_plane", f"""WITH {PTS}, {PLANES},
n_ AS (SELECT scene_id, a / l * s AS na, b / l * s AS nb, c / l * s AS nc FROM (
  SELECT *, sqrt(a * a + b * b + c * c) AS l, CASE WHEN b < 0 THEN -1e0 ELSE 1e0 END AS s FROM planes)),
rot_ AS (SELECT scene_id, point_id, (1 - na * na * f) * x - na * y - na * nc * f * z AS x, na * x + nb * y + nc * z AS y,
  -na * nc * f * x - nc * y + (1 - nc * nc * f) * z AS z FROM (SELECT *, 1 / (1 + nb) AS f FROM n_) JOIN pts USING (scene_id)),
s_ AS (SELECT scene_id, avg(x) AS mx, avg(z) AS mz, quantile_cont(y, 0.02) AS y02 FROM rot_ GROUP BY 1)
SELECT scene_id, point_id, {rd("x - mx")} AS x, {rd("y - y02")} AS y, {rd("z - mz")} AS z FROM rot_ JOIN s_ USING (scene_id)""")
def _(spark, sf):
    p = fx.points(spark, sf)
    return rounded(T.level_to_plane(p, tilted_planes(p)).select("scene_id", "point_id", "x", "y", "z"), "x", "y", "z")


def _colour(i):
    cases = " ".join(f"WHEN {k} THEN {v[i]}" for k, v in P.LABEL_COLOURS.items())
    return f"CASE label {cases} ELSE {P.UNKNOWN_COLOUR[i]} END"


@query("prj7_label_rgb", f"""WITH {PM}, l2 AS (SELECT scene_id, point_id, CASE WHEN point_id % 11 = 0 THEN 77 ELSE label END AS label FROM pm)
SELECT scene_id, point_id, {_colour(0)} AS red, {_colour(1)} AS green, {_colour(2)} AS blue FROM l2""")
def _(spark, sf):
    p = fx.points_mm(spark, sf).withColumn("label", F.expr("CASE WHEN point_id % 11 = 0 THEN 77 ELSE label END"))
    return T.label_rgb(p).select("scene_id", "point_id", "red", "green", "blue")


@query("prj8_map_labels", f"""WITH {PM} SELECT scene_id, point_id,
  CASE label WHEN 1 THEN 1 WHEN 4 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS cluster_class FROM pm""")
def _(spark, sf):
    return T.map_labels(fx.points_mm(spark, sf)).select("scene_id", "point_id", "cluster_class")


@query("prj9_assign_roles", f"""WITH {CPTS}
SELECT p.scene_id, point_id, CASE WHEN label = 0 THEN 'floor' WHEN y_pred IN (2, 3) AND max_prob < 0.75 THEN 'rescued'
  WHEN y_pred = 1 THEN 'cargo' WHEN y_pred = 2 THEN 'vehicle' WHEN y_pred = 3 THEN 'person' ELSE 'non_cluster' END AS role
FROM cpts p LEFT JOIN cpred c ON p.scene_id = c.scene_id AND p.cluster_id = c.cluster_id""")
def _(spark, sf):
    c = cpts(spark, sf)
    pts = c.select("scene_id", "point_id", (F.col("label") == 0).alias("is_floor"))
    return T.assign_roles(pts, c, cpreds(c)).select("scene_id", "point_id", "role")


ROI = "x BETWEEN -2.5 AND 2.5 AND y BETWEEN -0.15 AND 2.5 AND z BETWEEN -2 AND 2"


@query("flt1_roi", f"""WITH {PTS} SELECT scene_id, point_id FROM pts
WHERE x BETWEEN -2 AND 2 AND y BETWEEN -0.01e0 AND 1.5e0 AND z BETWEEN -1.5e0 AND 1.5e0""")
def _(spark, sf):
    return T.roi(fx.points(spark, sf), 2.0, (-0.01, 1.5), 1.5).select("scene_id", "point_id")


@query("flt2_center_crop", f"""WITH {PTS} SELECT scene_id, COUNT(*) AS n_before,
  COUNT(*) FILTER (x BETWEEN 0.5 AND 5 AND z BETWEEN -3 AND 2) AS n_after FROM pts GROUP BY scene_id""")
def _(spark, sf):
    return T.center_crop_counts(fx.points(spark, sf))


IN_ANCHOR = "x BETWEEN x_min - 0.3 AND x_max + 0.3 AND z BETWEEN z_min - 0.3 AND z_max + 0.3"


@query("flt3_height_slice", f"""WITH {CPTS} SELECT scene_id, point_id FROM pts JOIN anch USING (scene_id)
WHERE y BETWEEN 0e0 + 0.05e0 AND 0e0 + 0.2e0 AND {IN_ANCHOR.replace("0.3", "0.3e0")}""")
def _(spark, sf):
    p = fx.points(spark, sf)
    return T.height_slice(p, flat_floor(p), anchors=cargo_anchor(p)).select("scene_id", "point_id")


@query("flt4_above_floor", f"WITH {PTS} SELECT scene_id, point_id FROM pts WHERE y > 0.2e0")
def _(spark, sf):
    p = fx.points(spark, sf)
    return T.above_floor(p, flat_floor(p), 0.20).select("scene_id", "point_id")


@query("flt5_inside_anchor", f"""WITH {CPTS} SELECT scene_id, point_id FROM pts JOIN anch USING (scene_id)
WHERE {IN_ANCHOR.replace("0.3", "0.3e0")}""")
def _(spark, sf):
    p = fx.points(spark, sf)
    return T.inside_anchor(p, cargo_anchor(p), 0.30).select("scene_id", "point_id")


# The fixture's scenes fit into the real cones, so narrower ones are used.
NARROW = tuple({**c, "fov_deg": 30.0} for c in P.SCENE_CAMERAS)


def _cone(c):
    px, py, pz = c["pos"]
    n = math.sqrt(px * px + py * py + pz * pz)
    d = [f"(x - ({px!r}e0))", f"(y - ({py!r}e0))", f"(z - ({pz!r}e0))"]
    dist = "greatest(sqrt(" + " + ".join(f"{e} * {e}" for e in d) + "), 1e-9)"
    along = " + ".join(f"{e} * ({-v / n!r}e0)" for e, v in zip(d, (px, py, pz)))
    return f"({along}) / {dist} > {math.cos(math.radians(c['fov_deg'] / 2.0))!r}e0"


@query("flt6_fov_filter", f"""WITH {PTS} SELECT scene_id, point_id FROM pts
WHERE label IN (2) OR {" OR ".join(_cone(c) for c in NARROW)}""")
def _(spark, sf):
    return T.fov_filter(fx.points(spark, sf), NARROW, exempt=(2,)).select("scene_id", "point_id")


def _facing(c):
    px, py, pz = c["pos"]
    return f"nx * (({px!r}e0) - x) + ny * (({py!r}e0) - y) + nz * (({pz!r}e0) - z) > 0"


@query("flt7_facing_filter", f"""WITH {PTS},
n_ AS (SELECT *, CASE WHEN scene_id % 4 = 1 THEN 0e0 ELSE CAST(point_id % 3 - 1 AS DOUBLE) END AS nx,
  CASE WHEN scene_id % 4 = 1 THEN -1e0 ELSE CAST(point_id % 5 - 2 AS DOUBLE) END AS ny, 0e0 AS nz FROM pts),
f_ AS (SELECT scene_id, point_id, ({" OR ".join(_facing(c) for c in P.SCENE_CAMERAS)}) AS facing FROM n_)
SELECT scene_id, point_id FROM (SELECT *, bool_or(facing) OVER (PARTITION BY scene_id) AS anyf FROM f_) WHERE facing OR NOT anyf""")
def _(spark, sf):
    p = fx.points(spark, sf).selectExpr(
        "*", "CASE WHEN scene_id % 4 = 1 THEN 0D ELSE CAST(point_id % 3 - 1 AS DOUBLE) END AS nx",
        "CASE WHEN scene_id % 4 = 1 THEN -1D ELSE CAST(point_id % 5 - 2 AS DOUBLE) END AS ny", "0D AS nz")
    return T.facing_filter(p).select("scene_id", "point_id")


@query("flt8_route", f"""WITH {PTS} SELECT scene_id, point_id,
  CASE WHEN NOT ({ROI}) THEN 255 WHEN y < 0.05e0 THEN 0 ELSE -1 END AS route FROM (SELECT * REPLACE (x + 1e0 AS x) FROM pts)""")
def _(spark, sf):
    shifted = fx.points(spark, sf).withColumn("x", F.col("x") + 1.0)
    return T.route_for_prediction(shifted).select("scene_id", "point_id", "route")


@query("flt9_drop_classes", f"WITH {PM} SELECT scene_id, point_id, label FROM pm WHERE label NOT IN (255, 0)")
def _(spark, sf):
    return T.drop_classes(fx.points_mm(spark, sf), (255, 0)).select("scene_id", "point_id", "label")


@query("flt11_circle_clears_box", f"""WITH {CPTS},
c_ AS (SELECT scene_id, point_id, x AS px, z AS pz, 0.25e0 AS pr FROM pts WHERE label = 3 OR label = 255)
SELECT scene_id, point_id, (px - greatest(x_min, least(px, x_max))) * (px - greatest(x_min, least(px, x_max)))
  + (pz - greatest(z_min, least(pz, z_max))) * (pz - greatest(z_min, least(pz, z_max))) >= pr * pr AS clear FROM c_ JOIN anch USING (scene_id)""")
def _(spark, sf):
    p = fx.points(spark, sf)
    circles = p.where("label IN (3, 255)").selectExpr("scene_id", "point_id", "x AS px", "z AS pz", "0.25D AS pr")
    return T.circle_clears_box(circles, cargo_anchor(p)).select("scene_id", "point_id", "clear")


@query("flt13_check_scenes", f"""WITH {META},
v_ AS (SELECT scene_id,
  COUNT(*) FILTER (name LIKE 'cargo%' AND ((type = 'box' AND (w < 0.3e0 - 1e-6 OR w > 1e0 + 1e-6 OR d < 0.3e0 - 1e-6 OR d > 0.75e0 + 1e-6
    OR h < 0.25e0 - 1e-6 OR h > 1.4e0 + 1e-6)) OR (type = 'cylinder' AND (r < 0.15e0 - 1e-6 OR r > 0.4e0 + 1e-6 OR h < 0.3e0 - 1e-6 OR h > 1.2e0 + 1e-6)))) AS bad_size,
  max(coalesce(w, r * 2e0)) FILTER (name = 'cargo1') AS w1, max(coalesce(d, r * 2e0)) FILTER (name = 'cargo1') AS d1,
  max(coalesce(w, r * 2e0)) FILTER (name = 'cargo2') AS w2, max(coalesce(d, r * 2e0)) FILTER (name = 'cargo2') AS d2,
  max(placement) FILTER (name = 'cargo2') AS pl, COUNT(*) FILTER (name = 'vehicle') AS nv,
  COUNT(*) FILTER (name = 'person' AND NOT coalesce(zone IN ('operator', 'perimeter'), false)) AS bad_zone
  FROM items GROUP BY scene_id)
SELECT scene_id, bad_size, CAST(coalesce(pl = 'stacked' AND (w2 > w1 + 1e-6 OR d2 > d1 + 1e-6), false) AS INTEGER) AS bad_stack,
  CAST(coalesce(pl = 'tandem' AND d1 + 0.02e0 + d2 > 0.8e0 + 1e-6, false) AS INTEGER) AS bad_tandem,
  CAST(nv <> 1 AS INTEGER) AS bad_vehicle_count, bad_zone FROM v_""")
def _(spark, sf):
    return T.check_scenes(fx.metadata(spark, sf))


@query("src2_metadata_objects", f"""WITH {META} SELECT scene_id, CAST(slot AS INTEGER) AS pos, name, type, {rd("h")} AS h, zone FROM items""")
def _(spark, sf):
    return T.explode_objects(fx.metadata(spark, sf)).select("scene_id", "pos", "name", "type", r("h").alias("h"), "zone")


@query("src3_reference_volumes", f"""SELECT 'Escenario_' || lpad(CAST(o_custkey % 20 + 1 AS VARCHAR), 2, '0') AS scenario,
  'Captura_' || CAST(o_orderkey % 10 + 1 AS VARCHAR) AS capture,
  {rd("coalesce(sum(CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderkey % 900 AS VARCHAR) || '.25' AS DOUBLE) END), 0)")} AS vol_ref, COUNT(*) AS n_files
FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    texts = fx.table(spark, sf, "orders").selectExpr(
        "concat('/ref/Escenario_', lpad(CAST(o_custkey % 20 + 1 AS STRING), 2, '0'), '/Captura_', CAST(o_orderkey % 10 + 1 AS STRING),"
        " '_C', CAST(o_orderkey AS STRING), '_get_bounding_box.txt') AS path",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'no estimate' ELSE concat('start\n[GetVolume] Best estimation with ',"
        " CASE o_orderkey % 3 WHEN 0 THEN 'ConvexHull' WHEN 1 THEN 'MomentOfInertia' ELSE 'MomentOfIntertia' END, ': ',"
        " CAST(o_orderkey % 900 AS STRING), '.25 m3\nend') END AS value")
    return rounded(TB.parse_reference_volumes(texts), "vol_ref")


@query("src4_capture_inventory", """WITH a AS (SELECT DISTINCT CAST(o_custkey % 20 + 1 AS INTEGER) AS scenario, CAST(o_orderkey % 97 AS INTEGER) AS capture FROM orders),
b AS (SELECT DISTINCT CAST(l_suppkey % 20 + 1 AS INTEGER) AS scenario, CAST(l_orderkey % 89 AS INTEGER) AS capture FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2 = 0)
SELECT scenario, capture FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.scenario = a.scenario AND b.capture = a.capture)""")
def _(spark, sf):
    path = "concat('/data/Escenario_', lpad(CAST({} % 20 + 1 AS STRING), 2, '0'), '/Captura_', CAST({} AS STRING), '.ply') AS path"
    a = fx.table(spark, sf, "orders").selectExpr(path.format("o_custkey", "o_orderkey % 97"))
    b = fx.table(spark, sf, "lineitem").where("l_linenumber = 1 AND l_orderkey % 2 = 0").selectExpr(path.format("l_suppkey", "l_orderkey % 89"))
    return TB.capture_inventory(a, b)


@query("src5_coerce_comparison", f"""SELECT CAST(o_orderkey AS BIGINT) AS run_id, {rd("CAST(o_totalprice AS DOUBLE)", 2)} AS vol_ref,
  {rd("CAST(o_custkey AS DOUBLE)")} AS vol_hf FROM orders WHERE o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0""")
def _(spark, sf):
    raw = fx.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS BIGINT) AS run_id", "CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_totalprice AS STRING) END AS vol_ref",
        "CASE WHEN o_orderkey % 31 = 0 THEN 'crash' ELSE CAST(o_custkey AS STRING) END AS vol_hf")
    return TB.coerce_comparison(raw).select("run_id", r("vol_ref", 2).alias("vol_ref"), r("vol_hf").alias("vol_hf"))


@query("set1_concat_points", f"""WITH {PTS} SELECT scene_id, COUNT(*) AS n, CAST(sum(point_id) AS BIGINT) AS ids FROM (
  SELECT * FROM pts WHERE label = 1 UNION ALL SELECT * FROM pts WHERE label IN (1, 2)) GROUP BY scene_id""")
def _(spark, sf):
    p = fx.points(spark, sf)
    both = T.concat_points(p.where("label = 1"), p.where("label IN (1, 2)"))
    return both.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"))


@query("set2_remaining", f"""WITH {PM} SELECT scene_id, point_id FROM pm
EXCEPT SELECT scene_id, point_id FROM pm WHERE label = 0 AND y_mm > 0""")
def _(spark, sf):
    p = fx.points_mm(spark, sf)
    return T.remaining(p, p.where("label = 0 AND y_mm > 0")).select("scene_id", "point_id")


@query("set3_merge_masks", f"""WITH {PM} SELECT scene_id, point_id FROM pm WHERE label = 3
UNION SELECT scene_id, point_id FROM pm WHERE y_mm > 400""")
def _(spark, sf):
    p = fx.points_mm(spark, sf)
    return T.merge_masks(p.where("label = 3"), p.where("y_mm > 400"))


@query("set4_available_in_both", """SELECT CAST(o_custkey AS BIGINT) AS c, CAST(o_orderkey % 10 AS BIGINT) AS k FROM orders WHERE o_orderkey % 2 = 0
INTERSECT SELECT CAST(o_custkey AS BIGINT), CAST(o_orderkey % 10 AS BIGINT) FROM orders WHERE o_totalprice > 100000""")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").selectExpr("CAST(o_custkey AS BIGINT) AS c", "CAST(o_orderkey % 10 AS BIGINT) AS k", "o_orderkey", "o_totalprice")
    return T.available_in_both(o.where("o_orderkey % 2 = 0").select("c", "k"), o.where("o_totalprice > 100000").select("c", "k"))


@query("jn14_paint", f"""WITH {PM} SELECT scene_id, point_id, CASE WHEN label = 1 AND y_mm > 200 THEN 'cargo' ELSE 'rest' END AS role FROM pm""")
def _(spark, sf):
    p = fx.points_mm(spark, sf)
    return T.paint(p, p.where("label = 1 AND y_mm > 200"), "cargo", "role", "rest").select("scene_id", "point_id", "role")


@query("win6_y_norm", f"""WITH {PTS} SELECT scene_id, point_id, {rd("(y - lo) / CASE WHEN hi - lo < 1e-6 THEN 1e0 ELSE hi - lo END")} AS y_norm FROM (
  SELECT *, min(y) OVER (PARTITION BY scene_id) AS lo, max(y) OVER (PARTITION BY scene_id) AS hi FROM pts)""")
def _(spark, sf):
    return rounded(T.y_norm(fx.points(spark, sf)).select("scene_id", "point_id", "y_norm"), "y_norm")


@query("win9_sorted_shares", f"""WITH {PM} SELECT label, COUNT(*) AS n, {rd("COUNT(*) / sum(COUNT(*)) OVER ()")} AS share FROM pm GROUP BY label ORDER BY share DESC, label""")
def _(spark, sf):
    return rounded(G.label_distribution(fx.points_mm(spark, sf)), "share")


@query("win10_limit_scenes", f"""WITH {PM} SELECT scene_id, COUNT(*) AS n FROM pm
WHERE scene_id IN (SELECT DISTINCT scene_id FROM pm ORDER BY scene_id LIMIT 5) GROUP BY scene_id""")
def _(spark, sf):
    return T.limit_scenes(fx.points_mm(spark, sf), 5).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- sources and sinks

def _folder(spark, name: str) -> str:
    import uuid

    from pointloom.functions.lineage import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark, sf, name: str, labels: str = "label <> 255") -> str:
    from pointloom.sources import clouds

    path = _folder(spark, name)
    clouds.write_points(fx.points(spark, sf).where(labels), path, format="ply")
    return path


_RANKED = """rk AS (SELECT scene_id, dense_rank() OVER (ORDER BY lpad(CAST(scene_id AS VARCHAR), 5, '0')) - 1 AS file, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS place,
  label, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, COUNT(*) OVER (PARTITION BY scene_id) AS n FROM pts WHERE label <> 255)"""


@query("src1_read_points", f"""WITH {PTS}, {_RANKED} SELECT file AS scene_id, place AS point_id, label, {rd("x")} AS x, {rd("y")} AS y, {rd("z")} AS z, n AS n_header, n AS n_readable FROM rk""")
def _(spark, sf):
    """Files of all scenes, read by ranges of records."""
    from pointloom.sources import clouds

    out = clouds.read_points(spark, _written(spark, sf, "src1"), "header")
    return rounded(out.select("scene_id", "point_id", "label", "x", "y", "z", "n_header", "n_readable"), "x", "y", "z")


@query("snk1_write_points", f"""WITH {PTS}, {_RANKED} SELECT file AS scene_id, label, COUNT(*) AS n, {rd("sum(CAST(x AS DOUBLE))", 4)} AS x FROM rk GROUP BY ALL""")
def _(spark, sf):
    """What an export leaves, per scene and class."""
    from pointloom.sources import clouds

    out = clouds.read_points(spark, _written(spark, sf, "snk1"), "labelled")
    return out.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 4).alias("x"))


@query("snk2_csv_round_trip", f"WITH {PTS} SELECT scene_id, label, COUNT(*) AS n, {rd('min(x)')} AS x_min FROM pts GROUP BY scene_id, label")
def _(spark, sf):
    from pointloom.sources import tables

    path = _folder(spark, "snk2")
    tables.write_table(fx.points(spark, sf).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min")), path, "csv")
    back = spark.read.option("header", "true").csv(path)
    return back.select(F.col("scene_id").cast("long").alias("scene_id"), F.col("label").cast("int").alias("label"), F.col("n").cast("long").alias("n"),
                       r(F.col("x_min").cast("double")).alias("x_min"))


@query("snk3_json_round_trip", f"""WITH {PTS}, c AS (SELECT scene_id, label, COUNT(*) AS n FROM pts GROUP BY ALL)
SELECT scene_id, max(n) FILTER (label = 0) AS n_floor, max(n) FILTER (label = 1) AS n_cargo, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY scene_id""")
def _(spark, sf):
    """A nested document per scene."""
    from pointloom.sources import tables

    path = _folder(spark, "snk3")
    counts = fx.points(spark, sf).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"), F.struct(F.count_if(F.col("label") == 0).alias("floor"), F.count_if(F.col("label") == 1).alias("cargo")).alias("classes"))
    tables.write_table(counts, path, "json")
    back = spark.read.schema(counts.schema).json(path)
    zero = lambda c: F.when(F.col(c) > 0, F.col(c))
    return back.select("scene_id", zero("classes.floor").alias("n_floor"), zero("classes.cargo").alias("n_cargo"), "n")


@query("snk4_cached_features", f"WITH {PTS} SELECT scene_id, point_id, label, {rd('x * 2')} AS twice, {rd('y + z')} AS total FROM pts")
def _(spark, sf):
    """Features computed once and read from the store the second time."""
    from pointloom.sources import stores

    path = _folder(spark, "snk4")
    compute = lambda: fx.points(spark, sf).selectExpr("scene_id", "point_id", "label", "x * 2 AS twice", "y + z AS total")
    stores.cached_features(spark, path, ["twice", "total"], compute)
    return rounded(stores.cached_features(spark, path, ["twice", "total"], lambda: None), "twice", "total")
