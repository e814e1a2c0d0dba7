"""Queries for camera joins, sampling, evaluation and learning."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointloom import params as P
from pointloom.functions.lineage import cut
from pointloom.operators import detect as D
from pointloom.operators import evaluate as E
from pointloom.operators import grids as G
from pointloom.operators import learn as L
from pointloom.operators import sampling as S
from pointloom.operators import transforms as T
from pointloom.operators import volumes as V
from pointloom.sources import fixtures as fx

from .base import CAM, CAPTURES, CPTS, DETS, PM, PREDS, PTS, cpreds, cpts, query, r, rd, rounded
from .spatial import D3, U, uni
from .transforms import _C, _S

# ------------------------------------------------------------------------ cameras

BEST = f"""{DETS},
bd AS MATERIALIZED (SELECT scene_id, camera, conf, x1, y1, x2, y2, CASE WHEN conf >= CASE camera WHEN 'Cenital' THEN 0.3e0 ELSE 0.5e0 END
  THEN CASE camera WHEN 'Cenital' THEN 0.3e0 ELSE 0.5e0 END WHEN conf >= 0.3e0 THEN 0.3e0 END AS used_threshold
  FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, camera ORDER BY conf DESC, x1, y1) AS rn FROM dets WHERE cls = 0) WHERE rn = 1)"""
HIT = "valid AND u >= x1 - 5 AND u <= x2 + 5 AND v >= y1 - 5 AND v <= y2 + 5"


@query("win5_best_detection", f"WITH {PM}, {BEST} SELECT * FROM bd WHERE used_threshold IS NOT NULL")
def _(spark, sf):
    return D.best_detection(fx.detections(spark, sf))


@query("flt10_in_bbox", f"""WITH {CAM}, {DETS} SELECT scene_id, point_id, EXISTS (SELECT 1 FROM dets d WHERE d.scene_id = p.scene_id AND d.camera = p.camera AND {HIT}) AS in_box FROM proj p""")
def _(spark, sf):
    return D.in_bbox(T.project_pinhole(fx.camera_points(spark, sf)), fx.detections(spark, sf)).select("scene_id", "point_id", "in_box")


@query("flt12_edge_flags", f"""WITH {CAM}, {DETS} SELECT scene_id, camera, x1, y1, x1 <= 10 AS edge_left, y1 <= 10 AS edge_top, x2 >= w - 10 AS edge_right, y2 >= h - 10 AS edge_bottom
FROM dets JOIN intr USING (camera)""")
def _(spark, sf):
    return D.edge_flags(fx.detections(spark, sf)).select("scene_id", "camera", "x1", "y1", "edge_left", "edge_top", "edge_right", "edge_bottom")


MERGED = """
ci AS MATERIALIZED (SELECT *, CASE camera WHEN 'Izq' THEN 0 WHEN 'Der' THEN 1 ELSE 2 END AS seq, row_number() OVER (PARTITION BY scene_id, camera ORDER BY point_id) - 1 AS cam_idx FROM proj),
mg AS MATERIALIZED (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS idx FROM pm),
cn AS (SELECT scene_id, camera, seq, COUNT(*) AS n FROM ci GROUP BY ALL),
rg AS (SELECT scene_id, camera, sum(n) OVER (PARTITION BY scene_id ORDER BY seq) AS hi, n FROM cn),
src_ AS MATERIALIZED (SELECT m.scene_id, m.idx, camera, CAST(idx - (hi - n) AS BIGINT) AS cam_idx FROM mg m LEFT JOIN rg r ON m.scene_id = r.scene_id AND idx >= hi - n AND idx < hi)"""


def merged(spark, sf):
    """Merged index, camera points with their own index, and points per camera."""
    from pointloom.functions.groups import running_index

    p = fx.points_mm(spark, sf).select("scene_id", "point_id")
    m = running_index(p, "scene_id", "point_id", 4096).select("scene_id", "idx")
    cam = running_index(fx.camera_points(spark, sf), ["scene_id", "camera"], "point_id", 4096, "cam_idx")
    seq = F.expr("CASE camera WHEN 'Izq' THEN 0 WHEN 'Der' THEN 1 ELSE 2 END").alias("seq")
    counts = cam.groupBy("scene_id", "camera", seq).agg(F.count(F.lit(1)).alias("n"))
    return m, cam, counts


@query("jn7_source_camera", f"WITH {CAM}, {MERGED} SELECT scene_id, idx, camera, cam_idx FROM src_")
def _(spark, sf):
    m, _, counts = merged(spark, sf)
    return D.assign_source_camera(m, counts)


REMOVED = f"""{CAM}, {BEST}, {MERGED},
hit AS (SELECT DISTINCT c.scene_id, c.camera, c.cam_idx FROM ci c JOIN bd b ON b.scene_id = c.scene_id AND b.camera = c.camera AND used_threshold IS NOT NULL AND {HIT})"""


@query("jn8_remove_detected", f"""WITH {REMOVED},
k AS (SELECT s.scene_id, COUNT(*) AS n_total, COUNT(h.cam_idx) AS n_removed FROM src_ s LEFT JOIN hit h ON s.scene_id = h.scene_id AND s.camera = h.camera AND s.cam_idx = h.cam_idx GROUP BY 1)
SELECT scene_id, n_total, n_removed, {rd("100e0 * n_removed / greatest(n_total, 1)")} AS pct_removed, (SELECT CAST(sum(n) AS BIGINT) FROM cn WHERE cn.scene_id = k.scene_id) AS n_expected,
  n_total <> (SELECT sum(n) FROM cn WHERE cn.scene_id = k.scene_id) AS count_mismatch FROM k""")
def _(spark, sf):
    m, cam, counts = merged(spark, sf)
    return rounded(D.remove_detected(m, cam, D.best_detection(fx.detections(spark, sf)), counts)[1], "pct_removed")


BANDS = """
pw AS (SELECT * FROM pts WHERE label = 3), cw AS (SELECT * FROM pts WHERE label = 1),
ct AS (SELECT DISTINCT scene_id, 0.3e0 AS lo, 1.6e0 AS hi FROM pts),
wc AS (SELECT scene_id, avg(x) AS wx, avg(z) AS wz FROM pts WHERE y > 0.05e0 GROUP BY 1), pc AS (SELECT scene_id, avg(x) AS px, avg(z) AS pz FROM pw GROUP BY 1),
cc AS (SELECT scene_id, avg(x) AS cx, avg(z) AS cz FROM cw GROUP BY 1),
tr AS MATERIALIZED (SELECT scene_id, az, lo, hi, wx + co * (px - cx) - si * (pz - cz) AS cx, wz + si * (px - cx) + co * (pz - cz) AS cz FROM wc JOIN pc USING (scene_id) JOIN cc USING (scene_id)
  JOIN ct USING (scene_id), (VALUES (0, 1e0, 0e0), (90, 0e0, 1e0), (180, -1e0, 0e0), (270, 0e0, -1e0)) t(az, co, si)),
sc AS (SELECT t.scene_id, az, t.cx, t.cz, lo, hi, COUNT(p.point_id) AS score FROM tr t LEFT JOIN pts p ON p.scene_id = t.scene_id AND y BETWEEN lo AND hi
  AND (p.x - t.cx) * (p.x - t.cx) + (p.z - t.cz) * (p.z - t.cz) <= 0.5e0 * 0.5e0 GROUP BY ALL),
ba AS MATERIALIZED (SELECT scene_id, az, cx, cz, lo, hi, score FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, az) AS rn FROM sc) WHERE rn = 1)"""


def azimuth(p):
    bands = p.select("scene_id").distinct().selectExpr("scene_id", "0.3D AS lo", "1.6D AS hi")
    return D.best_azimuth(p, p.where("label = 3"), p.where("label = 1"), bands)


@query("jn10_best_azimuth", f"WITH {PTS}, {BANDS} SELECT scene_id, az, {rd('cx')} AS cx, {rd('cz')} AS cz, score FROM ba")
def _(spark, sf):
    return rounded(azimuth(fx.points(spark, sf)).drop("lo", "hi"), "cx", "cz")


@query("jn9_in_cylinder", f"""WITH {PTS}, {BANDS},
h AS (SELECT p.scene_id, point_id FROM pts p JOIN ba b USING (scene_id) WHERE score >= 5 AND (((p.x - b.cx) * (p.x - b.cx) + (p.z - b.cz) * (p.z - b.cz) <= 0.25e0 * 0.25e0 AND y BETWEEN lo AND hi)
  OR ((p.x - b.cx) * (p.x - b.cx) + (p.z - b.cz) * (p.z - b.cz) <= (0.25e0 * 1.3e0) * (0.25e0 * 1.3e0) AND y BETWEEN greatest(0, lo - 0.1e0) AND least(2.2e0, hi + 0.1e0))))
SELECT scene_id, point_id FROM h WHERE scene_id IN (SELECT scene_id FROM h GROUP BY 1 HAVING COUNT(*) >= 10)""")
def _(spark, sf):
    p = fx.points(spark, sf)
    return D.in_cylinder(p, azimuth(p).drop("az"), min_hits=10).select("scene_id", "point_id")


PIX = """
px AS (SELECT scene_id, camera, u, v, min(CAST((u * 3 + v) % 256 AS INTEGER)) AS r, min(CAST((v * 5) % 256 AS INTEGER)) AS g, min(CAST((u + v) % 256 AS INTEGER)) AS b FROM proj WHERE valid GROUP BY ALL)"""


@query("jn11_color_match", f"""WITH {CAM}, {PIX} SELECT p.scene_id, p.camera, COUNT(*) AS n,
  {rd("avg(CASE WHEN greatest(abs(p.r - x.r), abs(p.g - x.g), abs(p.b - x.b)) <= 90 THEN 1 ELSE 0 END)")} AS match_rate
FROM proj p JOIN px x USING (scene_id, camera, u, v) WHERE valid GROUP BY ALL""")
def _(spark, sf):
    p = T.project_pinhole(fx.camera_points(spark, sf))
    pixels = p.where("valid").select("scene_id", "camera", "u", "v").distinct().selectExpr(
        "*", "CAST((u * 3 + v) % 256 AS INT) AS r", "CAST((v * 5) % 256 AS INT) AS g", "CAST((u + v) % 256 AS INT) AS b")
    return rounded(D.color_match_rate(p, pixels, 90), "match_rate")


@query("agg31_estimate_intrinsics", f"""WITH {CAM}, q AS (SELECT scene_id, camera, quantile_cont(x / z, 0.02) AS xl, quantile_cont(x / z, 0.98) AS xh, quantile_cont(y / z, 0.02) AS yl, quantile_cont(y / z, 0.98) AS yh FROM cam GROUP BY ALL)
SELECT scene_id, camera, {rd("2047e0 / (xh - xl)")} AS fx, {rd("-xl * (2047e0 / (xh - xl))")} AS cx, {rd("1535e0 / (yh - yl)")} AS fy, {rd("-yl * (1535e0 / (yh - yl))")} AS cy FROM q""")
def _(spark, sf):
    return rounded(D.estimate_intrinsics(fx.camera_points(spark, sf), 2048, 1536), "fx", "cx", "fy", "cy")


@query("agg32_projection_report", f"""WITH {CAM}, {DETS},
ib AS MATERIALIZED (SELECT p.*, EXISTS (SELECT 1 FROM dets d WHERE d.scene_id = p.scene_id AND d.camera = p.camera AND {HIT}) AS in_box FROM proj p),
a AS (SELECT scene_id, camera, COUNT(*) FILTER (valid) AS nf, COUNT(*) FILTER (in_box) AS nb, quantile_cont(z, 0.5) FILTER (valid) AS zf, quantile_cont(z, 0.5) FILTER (in_box) AS zb FROM ib GROUP BY ALL),
e AS (SELECT scene_id, camera, bool_or(x1 <= 10) AS l, bool_or(y1 <= 10) AS t, bool_or(x2 >= w - 10) AS r, bool_or(y2 >= h - 10) AS b FROM dets JOIN intr USING (camera) GROUP BY ALL)
SELECT scene_id, camera, CASE WHEN l THEN 'L' ELSE '.' END || CASE WHEN t THEN 'T' ELSE '.' END || CASE WHEN r THEN 'R' ELSE '.' END || CASE WHEN b THEN 'B' ELSE '.' END AS edge,
  nf AS n_in_frame, nb AS n_in_box, {rd("zf")} AS z_frame, {rd("zb")} AS z_box, l OR t OR r OR b AS note_edge, nb < 500 AS note_few, coalesce(nb > 0 AND abs(zb - zf) < 0.1e0, false) AS note_overlap
FROM a JOIN e USING (scene_id, camera)""")
def _(spark, sf):
    return rounded(D.projection_report(fx.camera_points(spark, sf), fx.detections(spark, sf)), "z_frame", "z_box")


@query("ml9_pseudo_label", f"""WITH {CAM}, {BEST}, w_ AS (SELECT c.*, 3.8e0 - z * {_S} - y * {_C} AS height, -x AS wy, 1680e0 * x / z + 1045e0 AS uu, 1680e0 * y / z + 758e0 AS vv FROM cam c)
SELECT w_.scene_id, point_id, CASE WHEN z > 0 AND uu BETWEEN x1 AND x2 AND vv BETWEEN y1 AND y2 AND height > 0.3e0 THEN 1 WHEN height > 0.15e0 AND abs(wy) < 1.5 THEN 2 ELSE 0 END AS pseudo
FROM w_ LEFT JOIN bd ON bd.scene_id = w_.scene_id AND bd.camera = 'Izq' AND used_threshold IS NOT NULL""")
def _(spark, sf):
    dets = D.best_detection(fx.detections(spark, sf)).where("camera = 'Izq'")
    return D.pseudo_label(fx.camera_points(spark, sf), dets).select("scene_id", "point_id", "pseudo")


# ----------------------------------------------------------------------- sampling

_DIST = [f"sqrt((x - ({c['pos'][0]!r}e0)) * (x - ({c['pos'][0]!r}e0)) + (y - ({c['pos'][1]!r}e0)) * (y - ({c['pos'][1]!r}e0)) + (z - ({c['pos'][2]!r}e0)) * (z - ({c['pos'][2]!r}e0)))" for c in P.SCENE_CAMERAS]
DEPTH = f"least({', '.join(_DIST)})"


@query("deg1_nearest_camera", f"""WITH {PTS}, d_ AS (SELECT *, {_DIST[0]} AS d0, {_DIST[1]} AS d1, {_DIST[2]} AS d2 FROM pts),
e_ AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cam, greatest(least(d0, d1, d2), 1e-9) AS m FROM d_)
SELECT scene_id, point_id, cam, {rd("least(d0, d1, d2)")} AS depth, {rd("(x - CASE cam WHEN 0 THEN 0e0 WHEN 1 THEN 3.33e0 ELSE -3.33e0 END) / m")} AS rx,
  {rd("(y - CASE cam WHEN 0 THEN 3.68e0 ELSE 3.8e0 END) / m")} AS ry, {rd("z / m")} AS rz FROM e_""")
def _(spark, sf):
    return rounded(S.nearest_camera(fx.points(spark, sf)).select("scene_id", "point_id", "cam", "depth", "rx", "ry", "rz"), "depth", "rx", "ry", "rz")


@query("deg2_thin_by_distance", f"""WITH {PTS} SELECT scene_id, point_id FROM (SELECT *, 3e0 / greatest({DEPTH}, 3e0) AS s FROM pts) WHERE {U} < least(greatest(s * s, 0.15e0), 1e0)""")
def _(spark, sf):
    return S.thin_by_distance(fx.points(spark, sf), ref=3.0, uniform=uni()).select("scene_id", "point_id")


def hashed(seed: int, salt: str, *keys: str) -> str:
    """The uniform of ``hash_uniform`` in SQL."""
    return f"((CAST(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', {', '.join(keys)})), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0)"


def normal_sql(u1: str, u2: str) -> str:
    return f"(sqrt(-2e0 * ln(greatest({u1}, 1e-300))) * cos({2.0 * math.pi!r}e0 * {u2}))"


def noise_sql(src: str, out: str) -> str:
    """Points of ``src`` moved along the ray of the nearest camera."""
    u = lambda salt: hashed(42, salt, "scene_id", "point_id")
    pos = [c["pos"] for c in P.SCENE_CAMERAS]
    ds = ", ".join("sqrt(" + " + ".join(f"({v} - {p!r}e0) * ({v} - {p!r}e0)" for v, p in zip("xyz", q)) + f") AS d{i}" for i, q in enumerate(pos))
    pick = lambda f: f"CASE WHEN d0 <= d1 AND d0 <= d2 THEN {f(0)} WHEN d1 <= d2 THEN {f(1)} ELSE {f(2)} END"
    rays = ", ".join(f"{pick(lambda i, k=k, v=v: f'({v} - {pos[i][k]!r}e0)')} AS r{v}" for k, v in enumerate("xyz"))
    return f"""
{out}_d AS (SELECT *, {ds} FROM {src}), {out}_r AS (SELECT *, {pick(lambda i: f"d{i}")} AS depth, {rays} FROM {out}_d),
{out}_n AS (SELECT *, pow(depth / 3e0, 2e0) AS sc, {normal_sql(u("n1"), u("n2"))} AS nm, -2e0 * ln(greatest({u("c1")} * {u("c2")}, 1e-300)) AS chi FROM {out}_r),
{out}_s AS (SELECT *, CASE WHEN {u("mix")} < 0.6e0 THEN nm * 0.01e0 * sc ELSE nm * sqrt(4e0 / greatest(chi, 1e-12)) / sqrt(2e0) * 0.025e0 * sc END AS noise FROM {out}_n),
{out} AS MATERIALIZED (SELECT scene_id, point_id, label, {", ".join(f"{v} + noise * (r{v} / greatest(depth, 1e-9)) AS {v}" for v in "xyz")}, noise FROM {out}_s)"""


def outlier_sql(src: str, out: str) -> str:
    """``src`` with outliers beside random members of each scene."""
    u = lambda salt: hashed(42, salt, "scene_id", "k")
    moved = ", ".join(f"{v} + {normal_sql(u(v + '1'), u(v + '2'))} * 0.055e0 AS {v}" for v in "xyz")
    return f"""
{out}_i AS (SELECT scene_id, x, y, z, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS place FROM {src}),
{out}_z AS (SELECT scene_id, COUNT(*) AS n, max(point_id) AS mx, greatest(1, CAST(floor(COUNT(*) * 0.03e0) AS BIGINT)) AS want FROM {src} GROUP BY 1),
{out}_k AS (SELECT scene_id, n, mx, unnest(range(0, want)) AS k FROM {out}_z),
{out}_a AS (SELECT *, CAST(floor({u("anchor")} * n) AS BIGINT) AS place FROM {out}_k),
{out} AS MATERIALIZED (SELECT scene_id, point_id, label, x, y, z FROM {src} UNION ALL SELECT scene_id, mx + 1 + k, 255, {moved} FROM {out}_a JOIN {out}_i USING (scene_id, place))"""


def tail_sql(src: str) -> str:
    """Robust spread and tails of ``v`` per scene."""
    return f"""
q AS (SELECT scene_id, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349e0 AS s FROM {src} GROUP BY 1),
t AS (SELECT scene_id, any_value(s) AS sigma, avg(CASE WHEN abs(v) > 2.5e0 * s THEN 1 ELSE 0 END) AS tail FROM {src} JOIN q USING (scene_id) GROUP BY 1),
m AS (SELECT scene_id, {", ".join(f"mad(v) FILTER (abs(v) <= {x}e0) AS m{i}" for i, x in enumerate((0.015, 0.03, 0.05)))} FROM {src} GROUP BY 1)
SELECT scene_id, {rd("sigma")} AS sigma, {rd("tail")} AS tail_share, {rd("m0")} AS mad_15, {rd("m1")} AS mad_30, {rd("m2")} AS mad_50 FROM t JOIN m USING (scene_id)"""


PLACE = f"scene_id, point_id, CAST(label AS INTEGER) AS label, {rd('x')} AS x, {rd('y')} AS y, {rd('z')} AS z"


@query("deg3_axial_noise", f"WITH {PTS}, {noise_sql('pts', 'nz')}, v AS (SELECT scene_id, noise AS v FROM nz), {tail_sql('v')}")
def _(spark, sf):
    out = S.axial_noise(fx.points(spark, sf))
    return rounded(E.tail_stats(out, "noise"), "sigma", "tail_share", "mad_15", "mad_30", "mad_50")


@query("deg3_noise_positions", f"WITH {PTS}, {noise_sql('pts', 'nz')} SELECT {PLACE} FROM nz")
def _(spark, sf):
    return rounded(S.axial_noise(fx.points(spark, sf)).select("scene_id", "point_id", "label", "x", "y", "z"), "x", "y", "z")


@query("deg5_outlier_positions", f"WITH {PTS}, {outlier_sql('pts', 'ou')} SELECT {PLACE} FROM ou")
def _(spark, sf):
    return rounded(S.inject_outliers(fx.points(spark, sf), 0.03).select("scene_id", "point_id", "label", "x", "y", "z"), "x", "y", "z")


THIN = """th AS MATERIALIZED (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY scene_id, floor(x / 0.019e0), floor(y / 0.019e0), floor(z / 0.019e0) ORDER BY point_id) = 1)"""
DEGRADED = f"""{PTS}, {THIN}, {noise_sql("th", "nz")},
dp AS MATERIALIZED (SELECT * FROM nz WHERE {hashed(42, "drop", "scene_id", "point_id")} > 0.15e0), {outlier_sql("dp", "ou")}"""


@query("deg6_degrade_positions", f"WITH {DEGRADED} SELECT {PLACE} FROM ou")
def _(spark, sf):
    return rounded(S.degrade(fx.points(spark, sf)).select("scene_id", "point_id", "label", "x", "y", "z"), "x", "y", "z")


@query("agg34_tail_stats", f"""WITH {PTS}, v AS (SELECT scene_id, (y - 0.1e0) / 4e0 AS v FROM pts WHERE label IN (0, 1, 2)),
q AS (SELECT scene_id, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349e0 AS s FROM v GROUP BY 1),
t AS (SELECT scene_id, any_value(s) AS sigma, avg(CASE WHEN abs(v) > 2.5e0 * s THEN 1 ELSE 0 END) AS tail FROM v JOIN q USING (scene_id) GROUP BY 1),
m AS (SELECT scene_id, {", ".join(f"mad(v) FILTER (abs(v) <= {x}e0) AS m{i}" for i, x in enumerate((0.015, 0.03, 0.05)))} FROM v GROUP BY 1)
SELECT scene_id, {rd("sigma")} AS sigma, {rd("tail")} AS tail_share, {rd("m0")} AS mad_15, {rd("m1")} AS mad_30, {rd("m2")} AS mad_50 FROM t JOIN m USING (scene_id)""")
def _(spark, sf):
    v = fx.points(spark, sf).where("label IN (0, 1, 2)").withColumn("v", (F.col("y") - 0.1) / 4.0)
    return rounded(E.tail_stats(v, "v"), "sigma", "tail_share", "mad_15", "mad_30", "mad_50")


@query("deg4_dropout", f"WITH {PTS} SELECT scene_id, point_id FROM pts WHERE {U} > 0.15e0")
def _(spark, sf):
    return S.dropout(fx.points(spark, sf), 0.15, uni()).select("scene_id", "point_id")


@query("deg5_outlier_counts", f"""WITH {PTS} SELECT scene_id, CAST(COUNT(*) + greatest(1, floor(COUNT(*) * 0.03e0)) AS BIGINT) AS n,
  CAST(COUNT(*) FILTER (label = 255) + greatest(1, floor(COUNT(*) * 0.03e0)) AS BIGINT) AS n_outliers FROM pts GROUP BY scene_id""")
def _(spark, sf):
    out = S.inject_outliers(fx.points(spark, sf), 0.03)
    return out.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 255).alias("n_outliers"))


@query("deg6_degrade", f"WITH {DEGRADED} SELECT scene_id, label, COUNT(*) AS n, {rd('avg(y)')} AS y FROM ou GROUP BY scene_id, label")
def _(spark, sf):
    out = S.degrade(fx.points(spark, sf))
    return rounded(out.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")), "y")


@query("smp1_stratified_sample", f"""WITH {PTS} SELECT scene_id, point_id, label FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, label ORDER BY {U}, point_id) AS rn,
  COUNT(*) OVER (PARTITION BY scene_id, label) AS n FROM pts) WHERE rn <= greatest(1, floor(n * 0.3e0))""")
def _(spark, sf):
    return S.stratified_sample(fx.points(spark, sf), 0.3, uni()).select("scene_id", "point_id", "label")


@query("smp2_context_sample", f"""WITH {PTS}, f AS MATERIALIZED (SELECT *, EXISTS (SELECT 1 FROM pts b WHERE b.label <> 0 AND a.scene_id = b.scene_id AND {D3} < 0.3e0 * 0.3e0) AS near FROM pts a WHERE label = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY near ORDER BY {U}, scene_id, point_id) AS rn, COUNT(*) OVER (PARTITION BY near) AS n FROM f)
SELECT scene_id, point_id FROM pts WHERE label <> 0 UNION ALL
SELECT scene_id, point_id FROM k WHERE rn <= greatest(1, floor(n * CASE WHEN near THEN 0.5e0 ELSE 0.1e0 END))""")
def _(spark, sf):
    out = S.context_sample(fx.points(spark, sf), contextual=0.5, bulk=0.1, radius=0.3, uniform=uni())
    return out.select("scene_id", "point_id")


@query("smp3_cap_per_class", f"""WITH {PTS}, s AS (SELECT scene_id FROM pts GROUP BY 1 HAVING COUNT(*) >= 1000 AND COUNT(*) FILTER (label = 1) >= 310 AND COUNT(*) FILTER (label = 2) >= 100)
SELECT scene_id, point_id, label FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, label ORDER BY {U}, point_id) AS rn FROM pts WHERE label IN (1, 2) AND scene_id IN (SELECT scene_id FROM s)) WHERE rn <= 150""")
def _(spark, sf):
    p = fx.points(spark, sf)
    # A higher minimum for one class makes some scenes drop out.
    enough = p.where("label = 1").groupBy("scene_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 310").select("scene_id")
    return S.cap_per_class(p.join(enough, "scene_id"), 150, uniform=uni()).select("scene_id", "point_id", "label")


@query("smp4_class_weights", f"""WITH {PM}, c AS (SELECT label, COUNT(*) AS nc FROM pm GROUP BY 1)
SELECT label, nc AS n, {rd("sum(nc) OVER () / (COUNT(*) OVER () * nc) * CASE label WHEN 3 THEN 2e0 WHEN 4 THEN 1.5e0 ELSE 1e0 END")} AS weight FROM c""")
def _(spark, sf):
    w = S.class_weights(fx.points_mm(spark, sf), {"person": 2.0, "pallet": 1.5})
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.max("weight")).alias("weight"))


@query("smp5_sample_n", f"""WITH {PTS} SELECT scene_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {U}, point_id) AS rn FROM pts) WHERE rn <= 700""")
def _(spark, sf):
    return S.sample_n(fx.points(spark, sf), 700, uni()).select("scene_id", "point_id")


@query("smp6_assign_folds", f"""WITH {PM}, s AS (SELECT scene_id, CAST(-round(stddev_pop(n) * 1000) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT scene_id, label, COUNT(*) AS n FROM pm GROUP BY ALL) GROUP BY 1),
p AS (SELECT *, (row_number() OVER (ORDER BY k, scene_id) - 1) % 10 AS t FROM s)
SELECT scene_id, CAST(CASE WHEN t < 5 THEN t ELSE 9 - t END AS INTEGER) AS fold, n FROM p""")
def _(spark, sf):
    return S.assign_folds(fx.points_mm(spark, sf))


@query("smp6_leave_one_out", f"WITH {PM} SELECT scene_id, CAST(row_number() OVER (ORDER BY scene_id) - 1 AS INTEGER) AS fold, COUNT(*) AS n FROM pm GROUP BY scene_id")
def _(spark, sf):
    return S.leave_one_out(fx.points_mm(spark, sf))


# --------------------------------------------------------------------- evaluation

REPORT = """
cl AS (SELECT DISTINCT {by} c FROM (SELECT {by} y_true AS c FROM preds UNION ALL SELECT {by} y_pred FROM preds)),
rp AS MATERIALIZED (
  SELECT {kby} c AS cls, COUNT(*) FILTER (y_true = c AND y_pred = c) AS tp, COUNT(*) FILTER (y_pred = c) AS np, COUNT(*) FILTER (y_true = c) AS support
  FROM cl k JOIN preds p ON {on} (p.y_true = c OR p.y_pred = c) GROUP BY ALL),
rep AS MATERIALIZED (
  SELECT {rby} cls, CASE WHEN np > 0 THEN tp / np ELSE 0e0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0e0 END AS recall,
    CASE WHEN np + support > 0 THEN 2 * tp / (np + support) ELSE 0e0 END AS f1, support FROM rp)"""


def report_sql(by: str = "") -> str:
    return REPORT.format(by=f"{by}," if by else "", kby=f"k.{by}," if by else "", rby=f"{by}," if by else "", on=f"p.{by} = k.{by} AND" if by else "")


@query("ev1_confusion", f"""WITH {PREDS}, c AS (SELECT DISTINCT y_true AS c FROM preds UNION SELECT y_pred FROM preds),
g AS (SELECT a.c AS y_true, b.c AS y_pred FROM c a, c b), n AS (SELECT y_true, y_pred, COUNT(*) AS n FROM preds GROUP BY ALL)
SELECT y_true, y_pred, coalesce(n, 0) AS n, {rd("coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY y_true), 0), 0)")} AS share FROM g LEFT JOIN n USING (y_true, y_pred)""")
def _(spark, sf):
    return rounded(E.confusion(fx.predictions(spark, sf)), "share")


@query("ev2_class_report", f"WITH {PREDS}, {report_sql()} SELECT cls, {rd('precision')} AS precision, {rd('recall')} AS recall, {rd('f1')} AS f1, support FROM rep")
def _(spark, sf):
    return rounded(E.class_report(fx.predictions(spark, sf)), "precision", "recall", "f1")


@query("ev3_macro_f1", f"WITH {PREDS}, {report_sql('scene_id')} SELECT scene_id, {rd('avg(f1)')} AS macro_f1, COUNT(*) AS n_classes FROM rep GROUP BY scene_id")
def _(spark, sf):
    return rounded(E.macro_f1(fx.predictions(spark, sf), "scene_id"), "macro_f1")


BIN = """b AS (SELECT COUNT(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, COUNT(*) FILTER (y_true <> 1 AND y_pred = 1) AS fp,
  COUNT(*) FILTER (y_true = 1 AND y_pred <> 1) AS fn, COUNT(*) FILTER (y_true <> 1 AND y_pred <> 1) AS tn FROM preds)"""


@query("ev4_binary_report", f"""WITH {PREDS}, {BIN} SELECT {rd("tp / (tp + fp + fn)")} AS iou_cls, {rd("tn / (tn + fp + fn)")} AS iou_rest, {rd("tp / (tp + fp)")} AS precision,
  {rd("tp / (tp + fn)")} AS recall, {rd("2 * tp / (2 * tp + fp + fn)")} AS f1, tp + fn AS support, tp + fp + fn + tn AS n FROM b""")
def _(spark, sf):
    return rounded(E.binary_report(fx.predictions(spark, sf)), "iou_cls", "iou_rest", "precision", "recall", "f1")


@query("ev5_scene_metrics", f"""WITH {PREDS}, {report_sql('scene_id')},
a AS (SELECT scene_id, avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS acc, COUNT(*) AS n FROM preds GROUP BY 1)
SELECT scene_id, {rd("any_value(acc)")} AS accuracy, any_value(n) AS n, {rd("avg(f1)")} AS macro_f1,
  {", ".join(f"{rd(f'coalesce(max(f1) FILTER (cls = {c}), 0)')} AS f1_{n}" for c, n in enumerate(("floor", "cargo", "vehicle", "person", "pallet")))} FROM rep JOIN a USING (scene_id) GROUP BY scene_id""")
def _(spark, sf):
    out = E.scene_metrics(fx.predictions(spark, sf))
    return rounded(out, "accuracy", "macro_f1", "f1_floor", "f1_cargo", "f1_vehicle", "f1_person", "f1_pallet")


FOLDS = PREDS.replace("preds AS", "preds0 AS") + ", preds AS MATERIALIZED (SELECT *, CAST(scene_id % 5 AS INTEGER) AS fold FROM preds0)"


@query("ev6_fold_mean", f"""WITH {FOLDS}, {report_sql('fold')}, m AS (SELECT avg(f) AS m FROM (SELECT avg(f1) AS f FROM rep GROUP BY fold))
SELECT cls, {rd("avg(f1)")} AS f1_mean, {rd("stddev_pop(f1)")} AS f1_std, CAST(sum(support) AS BIGINT) AS support, {rd("any_value(m)")} AS macro_f1 FROM rep, m GROUP BY cls""")
def _(spark, sf):
    p = fx.predictions(spark, sf).withColumn("fold", (F.col("scene_id") % 5).cast("int"))
    return rounded(E.fold_mean(p), "f1_mean", "f1_std", "macro_f1")


@query("ev6_pooled_report", f"WITH {PREDS}, {report_sql()} SELECT cls, {rd('precision')} AS precision, {rd('recall')} AS recall, {rd('f1')} AS f1, support FROM rep")
def _(spark, sf):
    return rounded(E.pooled_report(fx.predictions(spark, sf)), "precision", "recall", "f1")


@query("ev7_diff", f"""WITH {PREDS} SELECT scene_id, point_id, CASE WHEN y_true = y_pred THEN 'correct' ELSE 'wrong_' || CASE y_true WHEN 0 THEN 'floor' WHEN 1 THEN 'cargo' WHEN 2 THEN 'vehicle' WHEN 3 THEN 'person' ELSE 'pallet' END END AS outcome FROM preds""")
def _(spark, sf):
    return E.diff(fx.predictions(spark, sf)).select("scene_id", "point_id", "outcome")


@query("ev7_diff_summary", f"WITH {PREDS} SELECT scene_id, COUNT(*) FILTER (y_true <> y_pred) AS n_errors, {rd('avg((y_true = y_pred)::INT)')} AS accuracy FROM preds GROUP BY scene_id")
def _(spark, sf):
    return rounded(E.diff_summary(fx.predictions(spark, sf)), "accuracy")


@query("ml12_gate", f"""WITH {PREDS}, {report_sql('scene_id')},
i AS (SELECT scene_id, COUNT(*) FILTER (y_true = 1 AND y_pred = 1) / nullif(COUNT(*) FILTER (y_true = 1 OR y_pred = 1), 0) AS iou FROM preds GROUP BY 1),
m AS (SELECT scene_id, avg(f1) AS mf, max(f1) FILTER (cls = 1) AS fc, max(recall) FILTER (cls = 1) AS rc FROM rep GROUP BY 1)
SELECT scene_id, mf >= 0.85e0 AND fc >= 0.85e0 AND rc >= 0.85e0 AS passed, CASE WHEN iou >= 0.9 THEN 'collapse' WHEN iou >= 0.85 THEN 'four_class' ELSE 'retrain' END AS iou_band FROM m JOIN i USING (scene_id)""")
def _(spark, sf):
    p = fx.predictions(spark, sf)
    rep = E.class_report(p, "scene_id").groupBy("scene_id").agg(
        F.avg("f1").alias("macro_f1"), F.max(F.when(F.col("cls") == 1, F.col("f1"))).alias("f1_cargo"), F.max(F.when(F.col("cls") == 1, F.col("recall"))).alias("recall_cargo"))
    both, either = (F.col("y_true") == 1) & (F.col("y_pred") == 1), (F.col("y_true") == 1) | (F.col("y_pred") == 1)
    iou = p.groupBy("scene_id").agg(F.try_divide(F.count_if(both), F.count_if(either)).alias("iou_cargo"))
    return E.gate(rep.join(iou, "scene_id")).select("scene_id", "passed", "iou_band")


@query("ml11_config_deltas", f"""WITH {FOLDS}, {report_sql('fold')}, c AS (SELECT CASE WHEN fold < 2 THEN 'A' ELSE 'B' END AS config, f1, cls, fold FROM rep WHERE fold < 4),
v AS (SELECT config, 'f1_macro' AS metric, avg(f1) AS value, 0.002e0 AS tol FROM c GROUP BY 1 UNION ALL SELECT config, 'f1_person', avg(f1) FILTER (cls = 3), 0.005e0 FROM c GROUP BY 1)
SELECT metric, {rd("a.value")} AS base_value, {rd("b.value")} AS other_value, {rd("b.value - a.value")} AS delta,
  CASE WHEN b.value - a.value > a.tol THEN 'gains' WHEN b.value - a.value < -a.tol THEN 'loses' ELSE 'tie' END AS verdict FROM v a JOIN v b USING (metric) WHERE a.config = 'A' AND b.config = 'B'""")
def _(spark, sf):
    p = fx.predictions(spark, sf).withColumn("fold", (F.col("scene_id") % 5).cast("int"))
    rep = E.class_report(p, "fold").where("fold < 4").withColumn("config", F.expr("CASE WHEN fold < 2 THEN 'A' ELSE 'B' END"))
    res = rep.groupBy("config").agg(F.avg("f1").alias("f1_macro"), F.avg(F.when(F.col("cls") == 3, F.col("f1"))).alias("f1_person"))
    return rounded(E.config_deltas(res, "A", "B", ["f1_macro", "f1_person"]), "base_value", "other_value", "delta")


# ------------------------------------------------------------------ volume reports

COMPARE = CAPTURES + f""",
cmp AS MATERIALIZED (SELECT scenario, run_id, vol_ref, vol_est AS vol_hf, CASE WHEN vol_ref > 0 THEN {rd("vol_est / vol_ref", 4)} END AS ratio_hf,
  CASE WHEN vol_est IS NULL THEN 'crash' WHEN vol_ref IS NULL THEN 'no_reference' ELSE 'ok' END AS status FROM captures)"""


def compared(spark, sf):
    c = fx.captures(spark, sf)
    results = c.select("scenario", "run_id", F.col("vol_est").alias("vol_hf"))
    ref = c.where("vol_ref IS NOT NULL").select("run_id", "vol_ref")
    return V.compare_volumes(results, ref, keys=("run_id",))


@query("jn12_compare_volumes", f"WITH {COMPARE} SELECT scenario, run_id, vol_ref, vol_hf, ratio_hf, status FROM cmp")
def _(spark, sf):
    return compared(spark, sf).select("scenario", "run_id", "vol_ref", "vol_hf", "ratio_hf", "status")


@query("agg28_ratio_stats", f"""WITH {COMPARE}, l AS (SELECT CAST(scenario AS VARCHAR) AS grp, 'ratio_hf' AS metric, ratio_hf AS v FROM cmp UNION ALL SELECT CAST(scenario AS VARCHAR), 'vol_hf', vol_hf FROM cmp),
b AS (SELECT * FROM l UNION ALL SELECT 'ALL', metric, v FROM l)
SELECT grp, metric, COUNT(v) AS n, {rd("avg(v)")} AS mean, {rd("median(v)")} AS median, {rd("CASE WHEN COUNT(v) > 1 THEN stddev_samp(v) WHEN grp = 'ALL' THEN 0 END")} AS std, {rd("min(v)")} AS min, {rd("max(v)")} AS max
FROM b WHERE v IS NOT NULL GROUP BY grp, metric""")
def _(spark, sf):
    return rounded(E.ratio_stats(compared(spark, sf), ["ratio_hf", "vol_hf"]), "mean", "median", "std", "min", "max")


@query("agg29_ratio_outliers", f"WITH {COMPARE} SELECT run_id, ratio_hf FROM cmp WHERE ratio_hf < 0.4e0 OR ratio_hf > 1.5e0")
def _(spark, sf):
    return E.ratio_outliers(compared(spark, sf)).select("run_id", "ratio_hf")


@query("agg29_ratio_counts", f"""WITH {COMPARE} SELECT COUNT(*) AS n, COUNT(*) FILTER (status = 'crash') AS n_failed, COUNT(*) FILTER (vol_ref IS NULL) AS n_missing,
  COUNT(ratio_hf) AS n_valid, COUNT(*) FILTER (ratio_hf < 0.4e0 OR ratio_hf > 1.5e0) AS n_outliers FROM cmp""")
def _(spark, sf):
    return E.ratio_counts(compared(spark, sf))


@query("agg30_scenario_summary", f"""WITH {COMPARE}, v AS (SELECT * FROM cmp WHERE ratio_hf IS NOT NULL),
q AS (SELECT scenario, COUNT(*) AS n, COUNT(*) FILTER (ratio_hf > 1.8e0) AS n_excluded, quantile_cont(ratio_hf, 0.25) AS q1, median(ratio_hf) AS median, quantile_cont(ratio_hf, 0.75) AS q3 FROM v GROUP BY 1),
f AS (SELECT scenario, COUNT(*) AS n_fair, avg(vol_ref) AS mr, stddev_samp(vol_ref) AS sr, avg(vol_hf) AS me, stddev_samp(vol_hf) AS se FROM v WHERE ratio_hf <= 1.8e0 GROUP BY 1)
SELECT scenario, n, n_excluded, {rd("q1")} AS q1, {rd("median")} AS median, {rd("q3")} AS q3, n_fair, {rd("mr")} AS mean_ref, {rd("sr")} AS std_ref, {rd("me")} AS mean_est, {rd("se")} AS std_est,
  median BETWEEN 0.5e0 AND 1.2e0 AS calibrated FROM q LEFT JOIN f USING (scenario)""")
def _(spark, sf):
    out = E.scenario_summary(compared(spark, sf), cap=1.8)
    return rounded(out, "q1", "median", "q3", "mean_ref", "std_ref", "mean_est", "std_est")


CP = CPTS + """, pp AS (SELECT scene_id, cluster_id, CAST((scene_id * 17 + cluster_id * 37) % 100 AS DOUBLE) / 99e0 AS p_cargo, CAST(cluster_id % 3 + 1 AS INTEGER) AS y_true FROM cpred)"""


def cluster_probs(spark, sf):
    c = cpts(spark, sf).where("cluster_id IS NOT NULL").select("scene_id", "cluster_id").distinct()
    return c.selectExpr("scene_id", "cluster_id", "CAST((scene_id * 17 + cluster_id * 37) % 100 AS DOUBLE) / 99D AS p_cargo", "CAST(cluster_id % 3 + 1 AS INT) AS y_true")


@query("agg23_proba_histogram", f"""WITH {CP} SELECT CASE WHEN p_cargo < 0.1e0 THEN 0 WHEN p_cargo < 0.3e0 THEN 1 WHEN p_cargo < 0.5e0 THEN 2 WHEN p_cargo < 0.7e0 THEN 3 WHEN p_cargo < 0.9e0 THEN 4
  WHEN p_cargo < 0.99e0 THEN 5 ELSE 6 END AS bin, COUNT(*) AS n FROM pp GROUP BY 1""")
def _(spark, sf):
    return E.proba_histogram(cluster_probs(spark, sf))


@query("agg23_proba_by_class", f"WITH {CP} SELECT y_true, COUNT(*) AS n, {rd('avg(p_cargo)')} AS mean, {rd('quantile_cont(p_cargo, 0.1)')} AS p10, {rd('quantile_cont(p_cargo, 0.9)')} AS p90 FROM pp GROUP BY 1")
def _(spark, sf):
    return rounded(E.proba_by_class(cluster_probs(spark, sf)), "mean", "p10", "p90")


@query("agg24_feature_shift", f"""WITH {PTS}, a AS (SELECT 'x' AS feature, x AS v, scene_id FROM pts UNION ALL SELECT 'y', y, scene_id FROM pts UNION ALL SELECT 'z', z, scene_id FROM pts),
s AS (SELECT feature, median(v) FILTER (scene_id % 2 = 0) AS ma, median(v) FILTER (scene_id % 2 = 1) AS mb, avg(v) FILTER (scene_id % 2 = 0) AS m, stddev_pop(v) FILTER (scene_id % 2 = 0) AS sd FROM a GROUP BY 1)
SELECT feature, {rd("ma")} AS median_a, {rd("mb")} AS median_b, CASE WHEN abs(ma) > 1e-9 THEN {rd("mb / ma")} END AS ratio, {rd("(mb - m) / (sd + 1e-9)")} AS z, abs((mb - m) / (sd + 1e-9)) > 2 AS shifted FROM s""")
def _(spark, sf):
    p = fx.points(spark, sf)
    out = E.feature_shift(p.where("scene_id % 2 = 0"), p.where("scene_id % 2 = 1"), ["x", "y", "z"])
    return rounded(out, "median_a", "median_b", "ratio", "z")


# ----------------------------------------------------------------------- learning

CHEAP = ["x", "y", "z", "y_norm"]


def training(spark, sf):
    return cut(T.y_norm(cut(T.drop_classes(fx.points(spark, sf)))))


@query("ml1_standardise", f"""WITH {PTS}, s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM pts)
SELECT scene_id, point_id, {rd("(x - mx) / sx")} AS x, {rd("(y - my) / sy")} AS y FROM pts, s""")
def _(spark, sf):
    return rounded(L.standardise(fx.points(spark, sf).select("scene_id", "point_id", "x", "y"), ["x", "y"]), "x", "y")


ML1 = ["x", "y", "z", "y_norm"]


@query("ml1_pipeline_scaler", f"""WITH {PTS}, lim AS (SELECT scene_id, min(y) AS lo, max(y) AS hi FROM pts WHERE label <> 255 GROUP BY 1),
t AS MATERIALIZED (SELECT scene_id, point_id, x, y, z, (y - lo) / CASE WHEN hi - lo < 1e-6 THEN 1e0 ELSE hi - lo END AS y_norm FROM pts JOIN lim USING (scene_id) WHERE label <> 255),
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ML1)} FROM t)
SELECT scene_id, point_id, {", ".join(f"{rd(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in ML1)} FROM t, s""")
def _(spark, sf):
    """The scaling stage of the training pipelines."""
    df = training(spark, sf)
    out = L.PopulationScaler(ML1).fit(df).transform(df)
    return out.select("scene_id", "point_id", *[r(f"{c}_scaled").alias(c) for c in ML1])


@query("ml2_random_forest")
def _(spark, sf):
    df = training(spark, sf)
    return L.predict_rows(df, L.fit(df, L.random_forest(CHEAP, trees=10, depth=6))).groupBy("label", "y_pred").agg(F.count(F.lit(1)).alias("n"))


@query("ml3_gradient_boosting")
def _(spark, sf):
    df = training(spark, sf)
    return L.predict_rows(df, L.fit(df, L.gradient_boosting(CHEAP, rounds=3, depth=4))).groupBy("label", "y_pred").agg(F.count(F.lit(1)).alias("n"))


@query("ml4_cross_validate")
def _(spark, sf):
    df = training(spark, sf)
    _, metrics = L.cross_validate(df, L.random_forest(CHEAP, trees=5, depth=5), S.assign_folds(df, 3))
    return metrics.select("fold", "n_classes", r("macro_f1", 2).alias("macro_f1"))


@query("ml5_loo_select")
def _(spark, sf):
    df = training(spark, sf).withColumn("group", F.col("scene_id") % 3)
    folds = df.select("scene_id", F.col("group").cast("int").alias("fold")).distinct()
    models = {"small": L.random_forest(CHEAP, trees=3, depth=3), "large": L.random_forest(CHEAP, trees=5, depth=5)}
    winner, _, table = L.loo_select(df.drop("group"), models, folds)
    return table.select("model", r("mean_f1", 2).alias("mean_f1"), r("std_f1", 2).alias("std_f1"), (F.col("model") == winner).alias("winner"))


@query("ml6_predict")
def _(spark, sf):
    df = training(spark, sf)
    model = L.fit(df, L.random_forest(CHEAP, trees=5, depth=5))
    cloud = T.y_norm(fx.points(spark, sf)).withColumn("x", F.col("x") + 0.5)
    return L.predict(cloud, cloud, model).groupBy("label", "y_pred").agg(F.count(F.lit(1)).alias("n"))


@query("ml7_predict_clusters")
def _(spark, sf):
    from pointloom.operators.features import CLUSTER_FEATURES, cluster_features

    feats = cut(cluster_features(cpts(spark, sf)).withColumn("label", (F.col("cluster_id") % 3 + 1).cast("int")))
    model = L.fit(feats, L.random_forest(CLUSTER_FEATURES, trees=5, depth=4))
    out = L.predict_clusters(feats, model)
    return out.groupBy("y_pred").agg(F.count(F.lit(1)).alias("n"), r(F.avg("max_prob"), 2).alias("mean_prob"))


@query("ml10_feature_importance")
def _(spark, sf):
    df = training(spark, sf)
    return rounded(L.feature_importance(L.fit(df, L.random_forest(CHEAP, trees=5, depth=5)), CHEAP, spark), "importance", digits=3)


@query("ml11_compare_configs")
def _(spark, sf):
    df = training(spark, sf)
    configs = {"A": {}, "B": {"floor": {"contextual": 0.5, "bulk": 0.1, "radius": 0.3}, "multipliers": {"person": 2.0}}}
    folds = S.assign_folds(df, 2)
    res = L.compare_configs(df, configs, lambda: L.random_forest(CHEAP, trees=3, depth=4), folds, CHEAP, subsample=0.5)
    return rounded(res.drop("cv_time_s"), "f1_macro", "f1_floor", "f1_cargo", "f1_vehicle", "f1_person", "f1_pallet", digits=2)
