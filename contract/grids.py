"""Queries for voxels, histograms, grid statistics, volumes and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import cluster as C
from pointloom.operators import evaluate as E
from pointloom.operators import grids as G
from pointloom.operators import transforms as T
from pointloom.operators import volumes as V
from pointloom.sources import fixtures as fx

from .base import CPTS, META, PM, PTS, cargo_anchor, cpreds, cpts, flat_floor, query, r, rd, rounded, tilted_planes
from .transforms import AXIS_SQL, FLOOR_Y_SQL, PLANE_H


@query("agg1_voxel_first", f"""WITH {PTS} SELECT scene_id, min(point_id) AS point_id, CAST(arg_min(label, point_id) AS INTEGER) AS label
FROM pts GROUP BY scene_id, floor(x / 0.05e0), floor(y / 0.05e0), floor(z / 0.05e0)""")
def _(spark, sf):
    return G.voxel_first(fx.points(spark, sf), 0.05).select("scene_id", "point_id", "label")


@query("agg2_voxel_centroid", f"""WITH {PTS} SELECT scene_id, min(point_id) AS point_id, {rd("avg(x)")} AS x, {rd("avg(y)")} AS y, {rd("avg(z)")} AS z, COUNT(*) AS n
FROM pts GROUP BY scene_id, floor(x / 0.035e0), floor(y / 0.035e0), floor(z / 0.035e0)""")
def _(spark, sf):
    out = G.voxel_centroid(fx.points(spark, sf)).select("scene_id", "point_id", "x", "y", "z", "n")
    return rounded(out, "x", "y", "z")


@query("agg3_label_distribution", f"""WITH {PM} SELECT scene_id, label, COUNT(*) AS n,
  {rd("COUNT(*) / sum(COUNT(*)) OVER (PARTITION BY scene_id)")} AS share FROM pm GROUP BY scene_id, label""")
def _(spark, sf):
    return rounded(G.label_distribution(fx.points_mm(spark, sf), "scene_id"), "share")


@query("agg3_label_counts_map", f"""WITH {PM}, c AS (SELECT scene_id, label, COUNT(*) AS n FROM pm GROUP BY ALL)
SELECT scene_id, max(n) FILTER (label = 0) AS n_floor, max(n) FILTER (label = 1) AS n_cargo, COUNT(*) AS n_classes FROM c GROUP BY scene_id""")
def _(spark, sf):
    m = G.label_counts_map(fx.points_mm(spark, sf))
    return m.select("scene_id", F.col("label_counts")["0"].alias("n_floor"), F.col("label_counts")["1"].alias("n_cargo"),
                    F.size("label_counts").cast("long").alias("n_classes"))


@query("agg4_label_by_height", f"""WITH {PTS}, c AS (SELECT label, COUNT(*) FILTER (y < 0.1e0) AS n_low, COUNT(*) FILTER (y >= 0.1e0) AS n_high, COUNT(*) AS n FROM pts GROUP BY label)
SELECT label, n_low, n_high, n, {rd("n_low / sum(n_low) OVER ()")} AS share_low, {rd("n_high / sum(n_high) OVER ()")} AS share_high, {rd("n / sum(n) OVER ()")} AS share FROM c""")
def _(spark, sf):
    return rounded(G.label_by_height(fx.points(spark, sf)), "share_low", "share_high", "share")


@query("agg5_floor_axis", f"WITH {PTS}, {AXIS_SQL} SELECT scene_id, floor_axis, peak FROM fax")
def _(spark, sf):
    return G.detect_floor_axis(fx.points(spark, sf))


@query("agg6_floor_y", f"WITH {PTS}, {FLOOR_Y_SQL} SELECT scene_id, {rd('floor_y')} AS floor_y FROM fy")
def _(spark, sf):
    return rounded(G.detect_floor_y(fx.points(spark, sf)), "floor_y")


@query("agg7_height_above_local_floor", f"""WITH {PTS},
m AS (SELECT scene_id, floor(x / 0.5e0) AS cx, floor(z / 0.5e0) AS cz, median(y) AS med FROM pts GROUP BY ALL)
SELECT scene_id, point_id, {rd("y - med")} AS height_above_local_floor FROM (SELECT *, floor(x / 0.5e0) AS cx, floor(z / 0.5e0) AS cz FROM pts) JOIN m USING (scene_id, cx, cz)""")
def _(spark, sf):
    out = G.height_above_local_floor(fx.points(spark, sf)).select("scene_id", "point_id", "height_above_local_floor")
    return rounded(out, "height_above_local_floor")


def _rough(where, cell, least):
    return f"""c AS (SELECT scene_id, CAST(floor(x / {cell}e0) AS BIGINT) AS cx, CAST(floor(z / {cell}e0) AS BIGINT) AS cz, stddev_pop(height) AS sigma, COUNT(*) AS n
  FROM ph WHERE {where} GROUP BY ALL)
SELECT scene_id, cx, cz, {rd("sigma")} AS sigma, n FROM (SELECT *, sum(n) OVER (PARTITION BY scene_id) AS t FROM c) WHERE n >= {least} AND t >= 50"""


@query("agg8_roughness_floor", f"WITH {PLANE_H}, {_rough('abs(height) < 0.06e0', '0.2', 8)}")
def _(spark, sf):
    p = fx.points(spark, sf)
    return rounded(G.roughness(T.height_above_plane(p, tilted_planes(p)), cell_size=0.2), "sigma")


@query("agg9_roughness_band", f"WITH {PLANE_H}, {_rough('height >= 0.2e0 AND height < 1.6e0', '0.1', 3)}")
def _(spark, sf):
    p = fx.points(spark, sf)
    h = T.height_above_plane(p, tilted_planes(p))
    return rounded(G.roughness(h, lo=0.20, hi=1.60, cell_size=0.1, min_cell=3), "sigma")


@query("agg10_density_map", f"""WITH {PTS}, c AS (
  SELECT CAST(least(floor((x - (-2e0)) * 60 / 4e0), 59) AS BIGINT) AS i, CAST(least(floor((z - (-2e0)) * 60 / 4e0), 59) AS BIGINT) AS j, COUNT(*) AS n
  FROM pts WHERE x BETWEEN -2 AND 2 AND z BETWEEN -2 AND 2 GROUP BY ALL)
SELECT i, j, n, {rd("n / (sum(n) OVER () * (4e0 / 60) * (4e0 / 60))")} AS density FROM c""")
def _(spark, sf):
    return rounded(G.density_map(fx.points(spark, sf), half=2.0), "density")


@query("agg11_histogram", f"""WITH {PM} SELECT label, CAST(least((y_mm - (-10)) // 25, 78) AS BIGINT) AS bin, COUNT(*) AS n FROM pm
WHERE y_mm >= -10 AND y_mm <= -10 + 79 * 25 GROUP BY ALL""")
def _(spark, sf):
    return G.histogram(fx.points_mm(spark, sf), "y_mm", -10, 25, 79, by="label")


@query("agg12_extents", f"""WITH {PTS} SELECT scene_id, {rd("max(x) - min(x)")} AS span_x, {rd("max(y) - min(y)")} AS span_y, {rd("max(z) - min(z)")} AS span_z FROM pts GROUP BY scene_id""")
def _(spark, sf):
    return rounded(G.extents(fx.points(spark, sf)), "span_x", "span_y", "span_z")


@query("agg12_footprint", f"WITH {PTS} SELECT {rd('min(x)')} AS x_min, {rd('max(x)')} AS x_max, {rd('min(z)')} AS z_min, {rd('max(z)')} AS z_max FROM pts")
def _(spark, sf):
    return rounded(G.footprint(fx.points(spark, sf)), "x_min", "x_max", "z_min", "z_max")


@query("agg13_scene_count_stats", f"""WITH {PM}, c AS (SELECT scene_id, COUNT(*) AS n FROM pm GROUP BY 1)
SELECT COUNT(*) AS n_scenes, {rd("avg(n)")} AS mean_points, {rd("stddev_pop(n)")} AS std_points FROM c""")
def _(spark, sf):
    return rounded(G.scene_count_stats(fx.points_mm(spark, sf)), "mean_points", "std_points")


@query("agg13_count_ratio", f"""WITH {PM}, c AS (SELECT scene_id, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS m FROM pm GROUP BY 1)
SELECT {rd("avg(n)")} AS mean_a, {rd("avg(m)")} AS mean_b, {rd("avg(m) / avg(n)")} AS ratio FROM c""")
def _(spark, sf):
    p = fx.points_mm(spark, sf)
    return rounded(G.count_ratio(p, p.where("label = 1")), "mean_a", "mean_b", "ratio")


COLUMN_SQL = """
cs AS MATERIALIZED (
  SELECT scene_id, CAST(floor((x - x0) / 0.15e0) AS BIGINT) AS i, CAST(floor((z - z0) / 0.15e0) AS BIGINT) AS j,
    max(y) AS y_max, min(y) AS y_min, max(y) - min(y) AS y_range, COUNT(*) AS n
  FROM (SELECT *, min(x) OVER (PARTITION BY scene_id) AS x0, min(z) OVER (PARTITION BY scene_id) AS z0 FROM src) GROUP BY ALL)"""


@query("agg16_column_stats", f"""WITH {PTS}, src AS (SELECT * FROM pts), {COLUMN_SQL}
SELECT scene_id, i, j, {rd("y_max")} AS y_max, {rd("y_min")} AS y_min, {rd("y_range")} AS y_range, n FROM cs""")
def _(spark, sf):
    return rounded(G.column_stats(fx.points(spark, sf)), "y_max", "y_min", "y_range")


FIELD = PTS + """,
hb AS (SELECT scene_id, min(x) AS lx, max(x) AS hx, min(z) AS lz, max(z) AS hz FROM pts WHERE label = 1 GROUP BY 1),
cells AS MATERIALIZED (
  SELECT scene_id, CAST(least(floor((x - lx) / 0.04e0), greatest(ceil((hx - lx) / 0.04e0), 1) - 1) AS BIGINT) AS i,
    CAST(least(floor((z - lz) / 0.04e0), greatest(ceil((hz - lz) / 0.04e0), 1) - 1) AS BIGINT) AS j, max(y) - (0e0 + 0.144e0) AS h
  FROM pts JOIN hb USING (scene_id) WHERE label = 1 GROUP BY ALL)"""


def cargo_cells(spark, sf):
    p = fx.points(spark, sf)
    return G.height_field(p.where("label = 1"), flat_floor(p))


@query("agg17_height_field", f"WITH {FIELD} SELECT scene_id, i, j, {rd('h')} AS h FROM cells")
def _(spark, sf):
    return rounded(cargo_cells(spark, sf), "h")


@query("agg18_height_field_volume", f"""WITH {FIELD}, v AS (SELECT scene_id, sum(h * (0.04e0 * 0.04e0)) AS v, COUNT(*) AS n, avg(h) AS m, max(h) AS x FROM cells WHERE h >= 0.05e0 GROUP BY 1)
SELECT scene_id, {rd("coalesce(v, 0)")} AS volume_m3, {rd("coalesce(n, 0) * (0.04e0 * 0.04e0)")} AS footprint_m2, {rd("coalesce(m, 0)")} AS mean_height,
  {rd("coalesce(x, 0)")} AS max_height, coalesce(n, 0) AS n_cells FROM (SELECT DISTINCT scene_id FROM pts) LEFT JOIN v USING (scene_id)""")
def _(spark, sf):
    p = fx.points(spark, sf)
    out = G.height_field_volume(G.height_field(p.where("label = 1"), flat_floor(p)), p)
    return rounded(out, "volume_m3", "footprint_m2", "mean_height", "max_height")


# Closed-form principal axes in SQL: the twin of the column expressions.
def pca_sql(src: str, by: str, ddof: int = 0) -> str:
    """CTEs ending in ``ev`` (covariance, l1..l3) for the relation ``src`` (columns x, y, z)."""
    div = f"greatest(n - {ddof}, 1)" if ddof else "n"
    cov = lambda a, b: f"(sum({a}{b}_) - sum({a}_) * sum({b}_) / COUNT(*))"
    return f"""
rel_ AS (SELECT {by}, x - min(x) OVER w AS x_, y - min(y) OVER w AS y_, z - min(z) OVER w AS z_ FROM {src} WINDOW w AS (PARTITION BY {by})),
prod_ AS (SELECT *, x_ * x_ AS xx_, y_ * y_ AS yy_, z_ * z_ AS zz_, x_ * y_ AS xy_, x_ * z_ AS xz_, y_ * z_ AS yz_ FROM rel_),
sum_ AS (SELECT {by}, COUNT(*) AS n, {", ".join(f"{cov(p[0], p[1])} AS c{p}" for p in ("xx", "yy", "zz", "xy", "xz", "yz"))} FROM prod_ GROUP BY {by}),
cov_ AS (SELECT {by}, n, {", ".join(f"c{p} / {div} AS {p}" for p in ("xx", "yy", "zz", "xy", "xz", "yz"))} FROM sum_),
{eig_sql("cov_", f"{by}, n")}"""


def eig_sql(src: str, keep: str, out: str = "ev") -> str:
    return f"""
{out}_q AS (SELECT *, (xx + yy + zz) / 3e0 AS q FROM {src}),
{out}_p AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2e0 * (xy * xy + xz * xz + yz * yz)) / 6e0) AS p FROM {out}_q),
{out}_r AS (SELECT *, CASE WHEN p > 0 THEN ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (p * p * p) / 2e0 ELSE 0e0 END AS r FROM {out}_p),
{out}_a AS (SELECT *, acos(greatest(-1e0, least(1e0, r))) / 3e0 AS t FROM {out}_r),
{out}_l AS (SELECT *, q + 2e0 * p * cos(t) AS l1, q + 2e0 * p * cos(t + 2e0 * pi() / 3e0) AS l3 FROM {out}_a),
{out} AS MATERIALIZED (SELECT {keep}, xx, yy, zz, xy, xz, yz, l1, 3e0 * q - l1 - l3 AS l2, l3 FROM {out}_l)"""


AXES_SQL = """
cr_ AS (
  SELECT *, {'n': p1x * p1x + p1y * p1y + p1z * p1z, 'x': p1x, 'y': p1y, 'z': p1z} AS s1, {'n': p2x * p2x + p2y * p2y + p2z * p2z, 'x': p2x, 'y': p2y, 'z': p2z} AS s2,
    {'n': p3x * p3x + p3y * p3y + p3z * p3z, 'x': p3x, 'y': p3y, 'z': p3z} AS s3 FROM (
    SELECT *, xy * yz - xz * (yy - lam) AS p1x, xz * xy - (xx - lam) * yz AS p1y, (xx - lam) * (yy - lam) - xy * xy AS p1z,
      xy * (zz - lam) - xz * yz AS p2x, xz * xz - (xx - lam) * (zz - lam) AS p2y, (xx - lam) * yz - xy * xz AS p2z,
      (yy - lam) * (zz - lam) - yz * yz AS p3x, yz * xz - xy * (zz - lam) AS p3y, xy * yz - (yy - lam) * xz AS p3z
    FROM (SELECT *, 1 AS k, l1 AS lam FROM ev UNION ALL SELECT *, 3 AS k, l3 AS lam FROM ev))),
vec_ AS (SELECT *, greatest(s1, s2, s3) AS s FROM cr_),
frame AS MATERIALIZED (
  SELECT a.* EXCLUDE (k, lam, s1, s2, s3, s, p1x, p1y, p1z, p2x, p2y, p2z, p3x, p3y, p3z), a.s.x / sqrt(a.s.n) AS a1x, a.s.y / sqrt(a.s.n) AS a1y, a.s.z / sqrt(a.s.n) AS a1z,
    b.s.x / sqrt(b.s.n) AS a3x, b.s.y / sqrt(b.s.n) AS a3y, b.s.z / sqrt(b.s.n) AS a3z
  FROM vec_ a JOIN vec_ b ON a.scene_id = b.scene_id AND a.cluster_id = b.cluster_id AND a.k = 1 AND b.k = 3),
spin_ AS (
  SELECT scene_id, cluster_id, max(x * a1x + y * a1y + z * a1z) - min(x * a1x + y * a1y + z * a1z) AS e1,
    max(x * a2x + y * a2y + z * a2z) - min(x * a2x + y * a2y + z * a2z) AS e2, max(x * a3x + y * a3y + z * a3z) - min(x * a3x + y * a3y + z * a3z) AS e3,
    max(x) - min(x) AS ext_x, max(y) - min(y) AS ext_y, max(z) - min(z) AS ext_z, any_value(abs(a1y)) AS u1, any_value(abs(a2y)) AS u2, any_value(abs(a3y)) AS u3
  FROM (SELECT *, a3y * a1z - a3z * a1y AS a2x, a3z * a1x - a3x * a1z AS a2y, a3x * a1y - a3y * a1x AS a2z FROM frame) JOIN box_src USING (scene_id, cluster_id) GROUP BY ALL),
ob_ AS (SELECT *, CASE WHEN u1 >= u2 AND u1 >= u3 THEN 1 WHEN u2 >= u3 THEN 2 ELSE 3 END AS v FROM spin_),
obox AS MATERIALIZED (
  SELECT *, CASE v WHEN 1 THEN greatest(e2, e3) WHEN 2 THEN greatest(e1, e3) ELSE greatest(e1, e2) END AS box_long,
    CASE v WHEN 1 THEN least(e2, e3) WHEN 2 THEN least(e1, e3) ELSE least(e1, e2) END AS box_short,
    CASE v WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END AS box_height FROM ob_)"""


def box_sql(src: str, ddof: int = 0) -> str:
    return f"""box_src AS MATERIALIZED (SELECT scene_id, cluster_id, x, y, z FROM {src} WHERE cluster_id IS NOT NULL),
{pca_sql("box_src", "scene_id, cluster_id", ddof)}, {AXES_SQL}"""


@query("agg19_oriented_box", f"""WITH {CPTS}, {box_sql("cpts")}
SELECT scene_id, cluster_id, n, {rd("ext_x")} AS ext_x, {rd("list_sort([e1, e2, e3])[3]", 4)} AS dim_1, {rd("list_sort([e1, e2, e3])[1]", 4)} AS dim_3,
  {rd("e1 * e2 * e3", 4)} AS box_volume, {rd("ext_x * ext_y * ext_z")} AS aabb_volume, {rd("box_long", 4)} AS box_long, {rd("box_short", 4)} AS box_short, {rd("box_height", 4)} AS box_height
FROM obox JOIN ev USING (scene_id, cluster_id)""")
def _(spark, sf):
    c = cpts(spark, sf).where("cluster_id IS NOT NULL")
    box = V.oriented_box(c, ["scene_id", "cluster_id"])
    four = {k: r(k, 4) for k in ("dim_1", "dim_3", "box_volume", "box_long", "box_short", "box_height")}
    return box.withColumns({**four, "ext_x": r("ext_x"), "aabb_volume": r("aabb_volume")}).select(
        "scene_id", "cluster_id", "n", "ext_x", "dim_1", "dim_3", "box_volume", "aabb_volume", "box_long", "box_short", "box_height")


@query("agg20_hull_prism", f"""WITH {PTS},
dir_ AS (SELECT k, cos(k * 2e0 * pi() / 64) AS co, sin(k * 2e0 * pi() / 64) AS si FROM range(64) t(k)),
sup_ AS (SELECT scene_id, k, max(x * co + z * si) AS h FROM pts CROSS JOIN dir_ WHERE label = 1 GROUP BY ALL),
ht_ AS (SELECT scene_id, max(y) - min(y) AS height FROM pts WHERE label = 1 GROUP BY 1),
ar_ AS (SELECT a.scene_id, sum(a.h * ((b.h + c.h) / sin(2e0 * pi() / 64) - 2e0 * a.h * cos(2e0 * pi() / 64) / sin(2e0 * pi() / 64)) / 2e0) AS area
  FROM sup_ a JOIN sup_ b ON a.scene_id = b.scene_id AND b.k = (a.k + 63) % 64 JOIN sup_ c ON a.scene_id = c.scene_id AND c.k = (a.k + 1) % 64 GROUP BY 1)
SELECT scene_id, {rd("area")} AS hull_area, {rd("height")} AS height, {rd("area * height")} AS prism_volume FROM ar_ JOIN ht_ USING (scene_id)""")
def _(spark, sf):
    out = V.hull_prism_volume(fx.points(spark, sf).where("label = 1")).drop("n_directions")
    return rounded(out, "hull_area", "height", "prism_volume")


@query("win7_fill_columns", f"""WITH {FIELD},
sp_ AS (SELECT scene_id, i, min(j) AS j0, max(j) AS j1, max(h) AS f FROM cells WHERE h >= 0.2e0 GROUP BY ALL),
fl_ AS (SELECT scene_id, i, f, unnest(range(j0, j1 + 1)) AS j FROM sp_)
SELECT coalesce(c.scene_id, f.scene_id) AS scene_id, coalesce(c.i, f.i) AS i, coalesce(c.j, f.j) AS j, {rd("greatest(coalesce(h, f), coalesce(f, h))")} AS h
FROM cells c FULL JOIN fl_ f ON c.scene_id = f.scene_id AND c.i = f.i AND c.j = f.j""")
def _(spark, sf):
    return rounded(G.fill_columns(cargo_cells(spark, sf)), "h")


SHAPE = CPTS + """,
shp_ AS (SELECT scene_id, cluster_id, COUNT(*) AS n, max(y) AS top, avg(x) AS cx, avg(z) AS cz,
  sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(z) - min(z)) * (max(z) - min(z))) AS xz FROM cpts WHERE cluster_id IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 30),
shape AS MATERIALIZED (
  SELECT scene_id, cluster_id, n, top AS h, xz, CASE WHEN xz > 1e-6 THEN top / xz END AS h_xz, dist, n * top / (0.3e0 + dist) AS score FROM (
    SELECT *, sqrt((cx - center_x) * (cx - center_x) + (cz - center_z) * (cz - center_z)) AS dist FROM shp_ JOIN anch USING (scene_id)))"""


@query("win1_largest_cluster", f"""WITH {CPTS} SELECT scene_id, n, cluster_id FROM (
  SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, cluster_id) AS rn FROM cpred) WHERE rn = 1""")
def _(spark, sf):
    return C.largest_cluster(C.cluster_sizes(cpts(spark, sf))).select("scene_id", "n", "cluster_id")


@query("win2_score_clusters", f"""WITH {SHAPE} SELECT scene_id, cluster_id, n, {rd("h")} AS h, {rd("dist")} AS dist, {rd("score", 4)} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, cluster_id) AS rn FROM shape) WHERE rn = 1""")
def _(spark, sf):
    c = cpts(spark, sf)
    out = C.score_clusters(c, flat_floor(c), cargo_anchor(c))
    return rounded(out, "h", "dist").withColumn("score", r("score", 4))


@query("win3_top_clusters", f"""WITH {SHAPE} SELECT scene_id, cluster_id, n, {rd("h")} AS h, {rd("xz")} AS xz, {rd("h_xz")} AS h_xz, {rd("dist")} AS dist, CAST(rn - 1 AS INTEGER) AS size_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, cluster_id) AS rn FROM shape) WHERE rn <= 6""")
def _(spark, sf):
    c = cpts(spark, sf)
    return rounded(C.top_clusters(c, flat_floor(c), cargo_anchor(c), k=6).drop("score"), "h", "xz", "h_xz", "dist")


@query("win4_rank_candidates", f"""WITH {CPTS} SELECT scene_id, cluster_id, n, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, cluster_id) - 1 AS INTEGER) AS cand_rank FROM cpred""")
def _(spark, sf):
    return C.rank_candidates(C.cluster_sizes(cpts(spark, sf)))


@query("agg21_cluster_labels", f"""WITH {CPTS},
v AS (SELECT *, (cluster_id + CASE WHEN point_id % 5 < 2 THEN 1 ELSE 0 END + CASE WHEN point_id % 7 = 0 THEN scene_id % 2 ELSE 0 END) % 3 + 1 AS cls FROM cpts WHERE cluster_id IS NOT NULL),
c AS (SELECT scene_id, cluster_id, cls, COUNT(*) AS c FROM v GROUP BY ALL),
b AS (SELECT *, sum(c) OVER (PARTITION BY scene_id, cluster_id) AS n, row_number() OVER (PARTITION BY scene_id, cluster_id ORDER BY c DESC, cls) AS rn FROM c)
SELECT scene_id, cluster_id, CAST(n AS BIGINT) AS n, CAST(cls AS INTEGER) AS majority, {rd("c / n")} AS purity, CAST(CASE WHEN c / n >= 0.6e0 THEN cls ELSE 2 END AS INTEGER) AS y_cluster FROM b WHERE rn = 1 AND n >= 60""")
def _(spark, sf):
    v = cpts(spark, sf).withColumn("cluster_class", F.expr(
        "CAST((cluster_id + CASE WHEN point_id % 5 < 2 THEN 1 ELSE 0 END + CASE WHEN point_id % 7 = 0 THEN scene_id % 2 ELSE 0 END) % 3 + 1 AS INT)"))
    return rounded(C.cluster_labels(v, min_points=60), "purity")


@query("clu7_negative_filter", f"""WITH {CPTS},
k AS (SELECT *, NOT (y_pred IN (2, 3) AND max_prob >= 0.5e0) AS keep0, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, cluster_id) = 1 AS top FROM cpred),
t AS (SELECT *, COUNT(*) FILTER (keep0) OVER (PARTITION BY scene_id) AS kept FROM (SELECT * FROM k WHERE scene_id % 3 <> 0 OR y_pred <> 1))
SELECT scene_id, cluster_id, CASE WHEN kept = 0 THEN rn = 1 ELSE keep0 END AS keep, CASE WHEN kept = 0 THEN 'fallback_rank0' ELSE 'classifier' END AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, cluster_id) AS rn FROM t)""")
def _(spark, sf):
    p = cpreds(cpts(spark, sf)).where("scene_id % 3 <> 0 OR y_pred <> 1")
    return C.negative_filter(p, 0.5).select("scene_id", "cluster_id", "keep", "source")


# ------------------------------------------------------------- volumes and reports

GT = META + f""",
gt AS MATERIALIZED (
  SELECT scene_id, coalesce(sum(CASE WHEN name LIKE 'cargo%' THEN CASE type WHEN 'box' THEN w * h * d WHEN 'cylinder' THEN pi() * r * r * h END END), 0e0) AS gt_cargo,
    CASE WHEN coalesce(bool_or(oy IS NULL) FILTER (name LIKE 'cargo%'), false) THEN 0e0 ELSE
      coalesce(sum(CASE WHEN name LIKE 'cargo%' THEN CASE type WHEN 'box' THEN w * d * (oy + h) WHEN 'cylinder' THEN pi() * r * r * (oy + h) END END), 0e0) END AS gt_column
  FROM items GROUP BY scene_id)"""


@query("agg25_gt_cargo_volume", f"WITH {GT} SELECT scene_id, {rd('gt_cargo')} AS gt_cargo_m3 FROM gt")
def _(spark, sf):
    return rounded(V.gt_cargo_volume(fx.metadata(spark, sf)), "gt_cargo_m3")


@query("agg26_gt_column_volume", f"WITH {GT} SELECT scene_id, {rd('gt_column')} AS gt_column_m3 FROM gt")
def _(spark, sf):
    return rounded(V.gt_column_volume(fx.metadata(spark, sf)), "gt_column_m3")


ERRS = GT + f""",
pr AS (SELECT scene_id, 0.1e0 + CAST(scene_id % 50 AS DOUBLE) / 40e0 AS pred FROM gt WHERE scene_id % 13 <> 0),
errs AS MATERIALIZED (SELECT scene_id, gt_cargo, gt_column, pred, {rd("(pred - gt_cargo) / gt_cargo", 4)} AS rel_cargo,
  CASE WHEN gt_column > 0 THEN {rd("(pred - gt_column) / gt_column", 4)} END AS rel_col FROM gt JOIN pr USING (scene_id) WHERE gt_cargo > 0)"""


def _errors(spark, sf):
    m = fx.metadata(spark, sf)
    truth = V.gt_cargo_volume(m).join(V.gt_column_volume(m), "scene_id")
    pred = m.where("scene_id % 13 <> 0").selectExpr("scene_id", "0.1D + CAST(scene_id % 50 AS DOUBLE) / 40D AS pred_m3")
    return V.volume_errors(truth, pred)


@query("jn13_volume_errors", f"""WITH {ERRS} SELECT scene_id, {rd("gt_cargo", 4)} AS gt_cargo_m3, {rd("gt_column", 4)} AS gt_column_m3, {rd("pred", 4)} AS pred_m3,
  rel_cargo AS rel_vs_cargo, rel_col AS rel_vs_column FROM errs""")
def _(spark, sf):
    return rounded(_errors(spark, sf), "gt_cargo_m3", "gt_column_m3", "pred_m3", "rel_vs_cargo", "rel_vs_column", digits=4)


@query("agg27_volume_error_report", f"""WITH {ERRS}, e AS (SELECT rel_col AS v, abs(rel_col) AS a FROM errs WHERE rel_col IS NOT NULL)
SELECT COUNT(*) AS n, {rd("avg(v)")} AS bias, {rd("avg(a)")} AS mean_abs, {rd("median(a)")} AS median_abs, {rd("quantile_cont(a, 0.9)")} AS p90_abs,
  COUNT(*) FILTER (a < 0.05e0) AS b0_5, COUNT(*) FILTER (a >= 0.05e0 AND a < 0.1e0) AS b5_10, COUNT(*) FILTER (a >= 0.1e0 AND a < 0.2e0) AS b10_20,
  COUNT(*) FILTER (a >= 0.2e0 AND a < 0.5e0) AS b20_50, COUNT(*) FILTER (a >= 0.5e0) AS b50_up FROM e""")
def _(spark, sf):
    out = E.volume_error_report(_errors(spark, sf), "rel_vs_column")
    return rounded(out, "bias", "mean_abs", "median_abs", "p90_abs")


@query("agg35_metadata_summary", f"""WITH {META} SELECT regexp_replace(name, '[0-9]+$', '') AS kind, type, placement, zone, COUNT(*) AS n_objects, COUNT(DISTINCT scene_id) AS n_scenes FROM items GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return V.metadata_summary(fx.metadata(spark, sf))
