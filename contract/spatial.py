"""Queries for neighbour joins, clustering, floor planes and features, with brute-force SQL twins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pointloom import params as P
from pointloom.functions.lineage import cut
from pointloom.operators import cluster as C
from pointloom.operators import evaluate as E
from pointloom.operators import features as FE
from pointloom.operators import grids as G
from pointloom.operators import neighbors as N
from pointloom.operators import transforms as T
from pointloom.plans import extraction as X
from pointloom.sources import fixtures as fx

from .base import CPTS, PLANES, PM, PTS, cargo_anchor, cpreds, cpts, flat_floor, query, r, rd, rounded, tilted_planes
from .grids import FIELD, box_sql, cargo_cells, eig_sql

D3 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)"


def knn_sql(k: int, src: str = "pts", self_too: bool = True, name: str = "nn") -> str:
    other = "" if self_too else " AND a.point_id <> b.point_id"
    return f"""
{name}_l AS MATERIALIZED (
  SELECT a.scene_id, a.point_id, min({{'d2': {D3}, 'id': b.point_id}}, {k}) AS l
  FROM {src} a JOIN {src} b ON a.scene_id = b.scene_id{other} GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT scene_id, point_id, l[rank].d2 AS d2, l[rank].id AS nbr_id, rank
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS rank FROM {name}_l))"""


def _knn_summary(near):
    return near.select("scene_id", "point_id", "n", r("d2_last", 9).alias("d2_last"), r("d2_sum", 6).alias("d2_sum"), "ids")


KNN_OUT = f"""SELECT scene_id, point_id, COUNT(*) AS n, {rd("max(d2)", 9)} AS d2_last, {rd("sum(d2)")} AS d2_sum, CAST(sum(nbr_id) AS BIGINT) AS ids
FROM nn GROUP BY scene_id, point_id"""


@query("jn1_knn_20", f"WITH {PTS}, {knn_sql(20)} {KNN_OUT}")
def _(spark, sf):
    return _knn_summary(N.knn_sums(fx.points(spark, sf), 20))


@query("jn1_knn_50", f"WITH {PTS}, {knn_sql(50)} {KNN_OUT}")
def _(spark, sf):
    return _knn_summary(N.knn_sums(fx.points(spark, sf), 50))


@query("jn2_knn_without_self", f"WITH {PTS}, {knn_sql(20, self_too=False)} {KNN_OUT}")
def _(spark, sf):
    return _knn_summary(N.knn_sums(fx.points(spark, sf), 20, include_self=False))


EMB = """pts AS MATERIALIZED (SELECT CAST(j AS BIGINT) AS scene_id, r AS point_id, coalesce(CAST(v[3 * j + 1] AS DOUBLE), 0e0) AS x, coalesce(CAST(v[3 * j + 2] AS DOUBLE), 0e0) AS y,
  coalesce(CAST(v[3 * j + 3] AS DOUBLE), 0e0) AS z FROM (SELECT CAST(vec_id AS BIGINT) AS r, embedding AS v FROM embeddings), range(22) t(j))"""


@query("jn1_knn_embeddings", f"WITH {EMB}, {knn_sql(10)} {KNN_OUT}")
def _(spark, sf):
    """Neighbours in every three-dimensional subspace of the whole vectors: a scene per subspace, coordinates without any grid."""
    v = fx.table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("point_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("j"))
    part = lambda k: F.coalesce(F.get("embedding", F.col("j") * 3 + k).cast("double"), F.lit(0.0))
    e = v.select(F.col("j").cast("long").alias("scene_id"), "point_id", *[part(i).alias(a) for i, a in enumerate("xyz")])
    return _knn_summary(N.knn_sums(e, 10))


@query("jn3_radius_count", f"""WITH {PTS} SELECT a.scene_id, a.point_id, COUNT(*) - 1 AS n FROM pts a JOIN pts b ON a.scene_id = b.scene_id
AND {D3} <= 0.15e0 * 0.15e0 GROUP BY ALL""")
def _(spark, sf):
    return N.radius_count(fx.points(spark, sf), 0.15)


def nearest_sql(left: str, right: str, cols: str) -> str:
    return f"""nr AS MATERIALIZED (SELECT a.scene_id, a.point_id, min({{'d2': {D3}, 'id': b.point_id, {cols}}}) AS m
  FROM {left} a JOIN {right} b ON a.scene_id = b.scene_id GROUP BY ALL)"""


@query("jn4_nearest_transfer", f"""WITH {PTS}, a_ AS (SELECT * FROM pts WHERE label IN (1, 3, 255)), b_ AS (SELECT * FROM pts WHERE label IN (2, 4) AND scene_id % 6 <> 5),
{nearest_sql("a_", "b_", "'label': b.label")}
SELECT a.scene_id, a.point_id, m.id AS nn_id, {rd("m.d2", 9)} AS nn_d2, m.label AS label FROM a_ a LEFT JOIN nr USING (scene_id, point_id)""")
def _(spark, sf):
    p = fx.points(spark, sf)
    out = N.nearest_transfer(p.where("label IN (1, 3, 255)"), p.where("label IN (2, 4) AND scene_id % 6 <> 5"), "label")
    return out.select("scene_id", "point_id", "nn_id", r("nn_d2", 9).alias("nn_d2"), "label")


def _near_floor(keep):
    word = "" if keep else "NOT "
    return f"""WITH {PTS} SELECT scene_id, point_id FROM pts a WHERE label = 0 AND {word}EXISTS (
  SELECT 1 FROM pts b WHERE b.label <> 0 AND a.scene_id = b.scene_id AND {D3} < 0.3e0 * 0.3e0)"""


@query("jn5_within_distance", _near_floor(True))
def _(spark, sf):
    p = fx.points(spark, sf)
    return N.within_distance(p.where("label = 0"), p.where("label <> 0"), 0.3).select("scene_id", "point_id")


@query("jn5_beyond_distance", _near_floor(False))
def _(spark, sf):
    p = fx.points(spark, sf)
    return N.within_distance(p.where("label = 0"), p.where("label <> 0"), 0.3, keep=False).select("scene_id", "point_id")


@query("jn6_eps_edges", f"""WITH {PTS}, s AS (SELECT * FROM pts WHERE y > 0.16e0)
SELECT a.scene_id, a.point_id AS a, b.point_id AS b, {rd(D3, 9)} AS d2 FROM s a JOIN s b ON a.scene_id = b.scene_id AND a.point_id < b.point_id AND {D3} <= 0.12e0 * 0.12e0""")
def _(spark, sf):
    return rounded(N.eps_edges(fx.points(spark, sf).where("y > 0.16"), 0.12), "d2", digits=9)


@query("jn15_temporal_diff", f"""WITH {PTS}, a_ AS (SELECT * FROM pts WHERE point_id % 2 = 0), b_ AS (SELECT * FROM pts WHERE point_id % 2 = 1),
{nearest_sql("a_", "b_", "'x': 0")}
SELECT scene_id, COUNT(*) AS n, {rd("avg(CASE WHEN sqrt(m.d2) > 0.1e0 THEN 1 ELSE 0 END)")} AS share_moved, {rd("median(sqrt(m.d2))")} AS median_distance FROM nr GROUP BY scene_id""")
def _(spark, sf):
    p = fx.points(spark, sf)
    return rounded(N.temporal_diff(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1")), "share_moved", "median_distance")


U = "CAST((point_id * point_id * 7 + point_id * 3001) % 10061 AS DOUBLE) / 10061e0"


def uni():
    """The uniform of ``U`` as a column (made on use: columns need a session)."""
    return fx.uniform(7, 3001, 10061)



def sample_sql(n: int, src: str = "pts", name: str = "smp") -> str:
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {U}, point_id) AS rn FROM {src}) WHERE rn <= {n})"""


@query("agg14_nn_spacing", f"""WITH {PTS}, {sample_sql(5000)}, {nearest_sql("smp", "smp", "'x': 0").replace("a.scene_id = b.scene_id", "a.scene_id = b.scene_id AND a.point_id <> b.point_id")}
SELECT scene_id, COUNT(*) AS n, {rd("avg(sqrt(m.d2))")} AS mean_nn, {rd("median(sqrt(m.d2))")} AS median_nn FROM nr GROUP BY scene_id""")
def _(spark, sf):
    return rounded(E.nn_spacing(fx.points(spark, sf), 5000, uni()), "mean_nn", "median_nn")


def _side(i: int, where: str) -> str:
    cells = lambda w: f"""(SELECT median(sigma) FROM (SELECT stddev_pop(height) AS sigma, COUNT(*) AS n, scene_id, sum(COUNT(*)) OVER (PARTITION BY scene_id) AS t
      FROM hp{i} WHERE {w} GROUP BY scene_id, floor(x / 0.2e0), floor(z / 0.2e0)) WHERE n >= 4 AND t >= 50)"""  # noqa: E731
    return f"""hp{i} AS MATERIALIZED (SELECT *, y AS height FROM pts WHERE {where}), {sample_sql(5000, f"hp{i}", f"sm{i}")},
nr{i} AS (SELECT a.scene_id, a.point_id, min({D3}) AS d2 FROM sm{i} a JOIN sm{i} b ON a.scene_id = b.scene_id AND a.point_id <> b.point_id GROUP BY ALL),
st{i} AS MATERIALIZED (SELECT (SELECT median(sqrt(d2)) FROM nr{i}) AS nn, {cells("abs(height) < 0.06e0")} AS rf, {cells("height >= 0.2e0 AND height < 1.6e0")} AS rc,
  (SELECT avg(n) FROM (SELECT COUNT(*) AS n FROM hp{i} GROUP BY scene_id)) AS mp)"""


def _status(g):
    return f"CASE WHEN abs({g}) < 5 THEN 'ok' WHEN {g} > 0 THEN 'increase_noise' ELSE 'decrease_noise' END"


_FG, _CG = "(b.rf - a.rf) * 1000e0", "(b.rc - a.rc) * 1000e0"


@query("agg15_calibration_report", f"""WITH {PTS}, {_side(1, "scene_id % 2 = 0")}, {_side(2, "scene_id % 2 = 1")}
SELECT {rd("b.nn / a.nn")} AS spacing_ratio, {rd("CASE WHEN b.nn / a.nn > 1 THEN b.nn / a.nn * 0.019e0 ELSE 0.019e0 END")} AS suggested_voxel,
  CASE WHEN b.nn / a.nn > 1.5 THEN 'increase_voxel' ELSE 'ok' END AS spacing_status, {rd(_FG)} AS floor_gap_mm, {_status(_FG)} AS floor_status,
  {rd(_CG)} AS cargo_gap_mm, {_status(_CG)} AS cargo_status, {rd("b.mp / a.mp")} AS count_ratio FROM st1 a, st2 b""")
def _(spark, sf):
    p = fx.points(spark, sf).withColumn("height", F.col("y"))
    a, b = [E.dataset_stats(p.where(f"scene_id % 2 = {i}"), 5000, uni(), floor_cell=0.2, min_cell=4) for i in (0, 1)]
    return rounded(E.calibration_report(a, b), "spacing_ratio", "suggested_voxel", "floor_gap_mm", "cargo_gap_mm", "count_ratio")


# --------------------------------------------------------------------- features

def moments_sql(k: int, src: str, name: str, ddof: int = 0) -> str:
    """Covariance of the first k neighbours relative to the query point."""
    div = f"greatest(n - {ddof}, 1)" if ddof else "n"
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    sums = ", ".join(f"sum(d{p[0]} * d{p[1]}) AS s{p}" for p in pairs)
    covs = ", ".join(f"(s{p} - s{p[0]} * s{p[1]} / n) / {div} AS {p}" for p in pairs)
    return f"""
{name}_d AS MATERIALIZED (SELECT n.scene_id, n.point_id, n.nbr_id, n.rank, b.y AS yb, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM {src} n
  JOIN pts a ON a.scene_id = n.scene_id AND a.point_id = n.point_id JOIN pts b ON b.scene_id = n.scene_id AND b.point_id = n.nbr_id WHERE rank <= {k}),
{name}_s AS (SELECT scene_id, point_id, COUNT(*) AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dz) AS sz, {sums} FROM {name}_d GROUP BY ALL),
{name}_c AS (SELECT scene_id, point_id, n, {covs} FROM {name}_s),
{eig_sql(f"{name}_c", "scene_id, point_id, n", f"{name}_ev")},
{name} AS MATERIALIZED (SELECT *, CASE WHEN l2 - l3 < 1e-12 THEN 0e0 ELSE sqrt(greatest(0e0, least(1e0, ((xx - l3) * (zz - l3) - xz * xz) / ((l3 - l1) * (l3 - l2))))) END AS ny FROM {name}_ev)"""


@query("fea2_local_pca", f"""WITH {PTS}, {knn_sql(20)}, {moments_sql(20, "nn", "s")}
SELECT scene_id, point_id, n AS k, {rd("l1", 5)} AS l1, {rd("l2", 5)} AS l2, {rd("l3", 5)} AS l3, {rd("ny", 4)} AS normal_y FROM s""")
def _(spark, sf):
    out = FE.local_pca(fx.points(spark, sf), 20)
    return rounded(out, "l1", "l2", "l3", digits=5).withColumn("normal_y", r("normal_y", 4))


def _den(e):
    return f"CASE WHEN {e} < 1e-10 THEN 1e-10 ELSE {e} END"


F1 = {
    "y": "p.y", "y_norm": "(p.y - lo) / CASE WHEN hi - lo < 1e-6 THEN 1e0 ELSE hi - lo END", "nbr_y_mean": "st.m", "nbr_y_std": "st.sd",
    "height_range_local": "st.rg", "normal_y": "s.ny", "curvature": f"s.l3 / ({_den('(s.l1 + s.l2 + s.l3)')})",
    "planarity": f"(s.l2 - s.l3) / ({_den('s.l1')})", "linearity": f"(s.l1 - s.l2) / ({_den('s.l1')})", "sphericity": f"s.l3 / ({_den('s.l1')})",
    "verticality": "s.ny", "normal_y_std": "sp.v", "planarity_large": f"(b.l2 - b.l3) / ({_den('b.l1')})",
    "height_above_local_floor": "p.y - med", "linearity_large": f"(b.l1 - b.l2) / ({_den('b.l1')})", "sphericity_large": f"b.l3 / ({_den('b.l1')})",
    "verticality_large": "b.ny",
}


@query("fea1_point_features", f"""WITH {PTS}, {knn_sql(50)}, {moments_sql(20, "nn", "s")}, {moments_sql(50, "nn", "b")},
st AS (SELECT scene_id, point_id, avg(yb) AS m, stddev_pop(yb) AS sd, max(yb) - min(yb) AS rg FROM s_d GROUP BY ALL),
sp AS (SELECT d.scene_id, d.point_id, stddev_pop(s.ny) AS v FROM s_d d JOIN s ON s.scene_id = d.scene_id AND s.point_id = d.nbr_id GROUP BY ALL),
med_ AS (SELECT scene_id, floor(x / 0.5e0) AS cx, floor(z / 0.5e0) AS cz, median(y) AS med FROM pts GROUP BY ALL),
rc AS (SELECT a.scene_id, a.point_id, COUNT(*) - 1 AS c FROM pts a JOIN pts b ON a.scene_id = b.scene_id AND {D3} <= 0.15e0 * 0.15e0 GROUP BY ALL),
pp AS (SELECT *, min(y) OVER (PARTITION BY scene_id) AS lo, max(y) OVER (PARTITION BY scene_id) AS hi, floor(x / 0.5e0) AS cx, floor(z / 0.5e0) AS cz FROM pts)
SELECT p.scene_id, p.point_id, p.label, rc.c AS local_density, {", ".join(f"{rd(v, 6 if k == 'nbr_y_mean' else 4)} AS {k}" for k, v in F1.items())},
  {rd(f"ln(1 + s.l1 / ({_den('s.l2')}))", 4)} AS lam_ratio_12
FROM pp p JOIN med_ USING (scene_id, cx, cz) JOIN s USING (scene_id, point_id) JOIN b USING (scene_id, point_id) JOIN st USING (scene_id, point_id)
JOIN sp USING (scene_id, point_id) JOIN rc USING (scene_id, point_id)""")
def _(spark, sf):
    out = FE.point_features(fx.points(spark, sf))
    out = out.withColumn("lam_ratio_12", r(F.log(F.col("lam_ratio_12") + 1.0), 4))
    # Means of 20 millimetre values end in 0.00005, so four digits would be a coin toss.
    return rounded(rounded(out, *[f for f in F1 if f != "nbr_y_mean"], digits=4), "nbr_y_mean")


F3 = {
    "curvature": "s.l3 / (s.l1 + s.l2 + s.l3 + 1e-10)", "planarity": "(s.l2 - s.l3) / (s.l1 + 1e-10)", "linearity": "(s.l1 - s.l2) / (s.l1 + 1e-10)",
    "sphericity": "s.l3 / (s.l1 + 1e-10)", "planarity_large": "(b.l2 - b.l3) / (b.l1 + 1e-10)", "linearity_large": "(b.l1 - b.l2) / (b.l1 + 1e-10)",
    "sphericity_large": "b.l3 / (b.l1 + 1e-10)", "normal_y_std": "sp.v", "height": "p.y", "lam_ratio_12": "ln(1 + s.l1 / (s.l2 + 1e-10))",
}


@query("fea3_raw_point_features", f"""WITH {PTS}, {knn_sql(50, self_too=False)}, {moments_sql(20, "nn", "s", 1)}, {moments_sql(50, "nn", "b", 1)},
sp AS (SELECT d.scene_id, d.point_id, stddev_pop(s.ny) AS v FROM s_d d JOIN s ON s.scene_id = d.scene_id AND s.point_id = d.nbr_id GROUP BY ALL)
SELECT p.scene_id, p.point_id, {", ".join(f"{rd(v, 4)} AS {k}" for k, v in F3.items())}
FROM pts p JOIN s USING (scene_id, point_id) JOIN b USING (scene_id, point_id) JOIN sp USING (scene_id, point_id)""")
def _(spark, sf):
    out = FE.raw_point_features(fx.points(spark, sf)).withColumn("lam_ratio_12", F.log(F.col("lam_ratio_12") + 1.0))
    return rounded(out, *F3, digits=4)


@query("fea4_cluster_features", f"""WITH {CPTS}, {box_sql("cpts", 1)},
sl_ AS (SELECT *, max(y) OVER w AS y1, min(y) OVER w AS y0, min(x) OVER w AS x0, min(z) OVER w AS z0 FROM box_src WINDOW w AS (PARTITION BY scene_id, cluster_id)),
sl AS (SELECT scene_id, cluster_id, COUNT(*) FILTER (y >= y1 - (y1 - y0) * 0.15e0) AS nt, COUNT(*) FILTER (y <= y0 + (y1 - y0) * 0.15e0) AS nb,
  stddev_pop(y) FILTER (y >= y1 - (y1 - y0) * 0.15e0) AS sd, any_value(y1 - y0) AS span,
  COUNT(DISTINCT [floor((x - x0) / 0.05e0), floor((z - z0) / 0.05e0)]) AS nc FROM sl_ GROUP BY ALL),
en AS (SELECT scene_id, cluster_id, -sum(c / t * ln(c / t)) AS e FROM (SELECT *, sum(c) OVER (PARTITION BY scene_id, cluster_id) AS t FROM (
  SELECT scene_id, cluster_id, COUNT(*) AS c FROM sl_ GROUP BY scene_id, cluster_id, least(floor((y - y0) * 10 / (y1 - y0)), 9))) GROUP BY ALL)
SELECT scene_id, cluster_id, {rd("n", 4)} AS n_points, {rd("log10(n)", 4)} AS log10_n_points, {rd("box_long", 4)} AS obb_long, {rd("box_short", 4)} AS obb_short,
  {rd("box_height", 4)} AS obb_height, {rd("box_long / greatest(box_short, 1e-6)", 4)} AS aspect_long_short, {rd("box_height / greatest(box_long, 1e-6)", 4)} AS aspect_height_long,
  {rd("box_long * box_short", 4)} AS base_area, {rd("box_long * box_short * box_height", 4)} AS volume_obb, {rd("n / greatest(box_long * box_short, 1e-6)", 3)} AS density_xz,
  {rd("n / greatest(box_long * box_short * box_height, 1e-6)", 3)} AS density_volume, {rd("nt / n", 4)} AS top_slab_frac, {rd("nb / n", 4)} AS bottom_slab_frac,
  {rd("CASE WHEN nt < 3 THEN 0 ELSE sd END", 4)} AS top_slab_planarity, {rd("e", 4)} AS vertical_profile_entropy,
  {rd("nc / greatest((box_long / 0.05e0) * (box_short / 0.05e0), 1e0)", 4)} AS fill_ratio, {rd("(l1 - l2) / greatest(l1, 1e-12)", 4)} AS pca_linearity,
  {rd("(l2 - l3) / greatest(l1, 1e-12)", 4)} AS pca_planarity, {rd("l3 / greatest(l1, 1e-12)", 4)} AS pca_sphericity
FROM obox JOIN ev USING (scene_id, cluster_id) JOIN sl USING (scene_id, cluster_id) JOIN en USING (scene_id, cluster_id)""")
def _(spark, sf):
    out = FE.cluster_features(cpts(spark, sf))
    three = ("density_xz", "density_volume")
    return rounded(rounded(out, *[f for f in FE.CLUSTER_FEATURES if f not in three], digits=4), *three, digits=3)


# -------------------------------------------------------------------- clustering

def flood_sql(n: str, nodes: str, edges: str) -> str:
    """Smallest id of each connected part: ``{n}_root(scene_id, id, root)``."""
    return f"""
{n}_cc(scene_id, id, root) AS (
  SELECT scene_id, id, id FROM {nodes} UNION
  SELECT e.scene_id, e.b, c.root FROM {n}_cc c JOIN {edges} e ON e.scene_id = c.scene_id AND e.a = c.id AND e.b > c.root),
{n}_root AS MATERIALIZED (SELECT scene_id, id, min(root) AS root FROM {n}_cc GROUP BY ALL)"""


def dbscan_sql(n: str, src: str, eps: float, min_pts: int, dist: str = D3) -> str:
    e = f"{eps!r}e0"
    return f"""
{n}_e AS MATERIALIZED (SELECT a.scene_id, a.point_id AS a, b.point_id AS b FROM {src} a JOIN {src} b ON a.scene_id = b.scene_id AND {dist} <= {e} * {e}),
{n}_core AS MATERIALIZED (SELECT scene_id, a AS id FROM {n}_e GROUP BY ALL HAVING COUNT(*) >= {min_pts}),
{n}_ce AS MATERIALIZED (SELECT e.* FROM {n}_e e JOIN {n}_core p ON p.scene_id = e.scene_id AND p.id = e.a JOIN {n}_core q ON q.scene_id = e.scene_id AND q.id = e.b),
{flood_sql(n, f"{n}_core", f"{n}_ce")},
{n}_num AS (SELECT scene_id, id, dense_rank() OVER (PARTITION BY scene_id ORDER BY root) - 1 AS cluster_id FROM {n}_root),
{n}_bd AS (SELECT e.scene_id, e.a AS id, min(k.cluster_id) AS cluster_id FROM {n}_e e JOIN {n}_num k ON k.scene_id = e.scene_id AND k.id = e.b GROUP BY ALL),
{n} AS MATERIALIZED (SELECT s.*, coalesce(k.cluster_id, b.cluster_id) AS cluster_id, k.cluster_id IS NOT NULL AS is_core FROM {src} s
  LEFT JOIN {n}_num k ON k.scene_id = s.scene_id AND k.id = s.point_id LEFT JOIN {n}_bd b ON b.scene_id = s.scene_id AND b.id = s.point_id)"""


@query("clu3_dbscan_3d", f"""WITH RECURSIVE {PTS}, s AS MATERIALIZED (SELECT * FROM pts WHERE y > 0.16e0), {dbscan_sql("db", "s", 0.12, 10)}
SELECT scene_id, point_id, cluster_id, is_core FROM db""")
def _(spark, sf):
    return C.dbscan(fx.points(spark, sf).where("y > 0.16"), 0.12, 10).select("scene_id", "point_id", "cluster_id", "is_core")


@query("clu3_dbscan_2d", f"""WITH RECURSIVE {PTS}, s AS MATERIALIZED (SELECT * FROM pts WHERE y > 0.2e0), {dbscan_sql("db", "s", 0.1, 12, D2)}
SELECT scene_id, point_id, cluster_id, is_core FROM db""")
def _(spark, sf):
    return C.dbscan(fx.points(spark, sf).where("y > 0.2"), 0.10, 12, dims=("x", "z")).select("scene_id", "point_id", "cluster_id", "is_core")


# The fixture is much sparser than real clouds, so wider radii are used.
SPARSE = replace(P.ExtractionParams(), anchor_eps=0.15, anchor_min_pts=10, cargo_eps=0.2, cargo_min_pts=12, pallet_eps=0.25, pallet_min_pts=12,
                 pallet_min_density=50.0)

ANCHOR = f"""{PTS}, hi_ AS MATERIALIZED (SELECT * FROM pts WHERE y > 0.2e0), {dbscan_sql("an", "hi_", 0.15, 10, D2)},
anc_ AS (SELECT scene_id, cluster_id FROM (SELECT scene_id, cluster_id, row_number() OVER (PARTITION BY scene_id ORDER BY COUNT(*) DESC, cluster_id) AS rn
  FROM an WHERE cluster_id IS NOT NULL GROUP BY scene_id, cluster_id) WHERE rn = 1),
anchor AS MATERIALIZED (SELECT scene_id, COUNT(*) AS n_points, min(x) AS x_min, max(x) AS x_max, min(z) AS z_min, max(z) AS z_max, max(y) - min(y) AS height,
  (min(x) + max(x)) / 2e0 AS center_x, (min(z) + max(z)) / 2e0 AS center_z FROM an JOIN anc_ USING (scene_id, cluster_id) GROUP BY scene_id)"""


@query("clu4_find_anchor", f"""WITH RECURSIVE {ANCHOR} SELECT scene_id, n_points, {", ".join(f"{rd(c)} AS {c}" for c in ("x_min", "x_max", "z_min", "z_max", "height", "center_x", "center_z"))} FROM anchor""")
def _(spark, sf):
    p = cut(fx.points(spark, sf))
    return rounded(C.find_anchor(p, flat_floor(p), SPARSE), "x_min", "x_max", "z_min", "z_max", "height", "center_x", "center_z")


@query("clu5_pallet_candidates", f"""WITH RECURSIVE {PTS}, sl0 AS MATERIALIZED (SELECT * FROM pts WHERE y BETWEEN 0e0 + 0.05e0 AND 0e0 + 0.2e0), {dbscan_sql("pl", "sl0", 0.25, 12)}, {box_sql("pl")},
g_ AS (SELECT scene_id, cluster_id, n, box_long, box_short, box_long / box_short AS aspect, n / (box_long * box_short + 1e-9) AS density FROM obox JOIN ev USING (scene_id, cluster_id))
SELECT scene_id, cluster_id, n, {rd("box_long", 4)} AS box_long, {rd("box_short", 4)} AS box_short, {rd("aspect", 4)} AS aspect, {rd("density", 3)} AS density,
  CAST(row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, cluster_id) - 1 AS INTEGER) AS cand_rank
FROM g_ WHERE box_short >= 0.3e0 AND box_long >= 0.5e0 AND box_long <= 1.8e0 AND aspect <= 2.5e0 AND density >= 50e0 AND n >= 12""")
def _(spark, sf):
    p = fx.points(spark, sf)
    out = C.pallet_candidates(p, flat_floor(p), None, SPARSE)
    return rounded(out, "box_long", "box_short", "aspect", digits=4).withColumn("density", r("density", 3))


@query("clu6_extract_cargo", f"""WITH RECURSIVE {ANCHOR}, ins0 AS (SELECT p.* FROM pts p JOIN anchor USING (scene_id) WHERE p.y > 0.05e0 AND x BETWEEN x_min - 0.3e0 AND x_max + 0.3e0 AND z BETWEEN z_min - 0.3e0 AND z_max + 0.3e0),
ins AS MATERIALIZED (SELECT * FROM ins0 WHERE scene_id IN (SELECT scene_id FROM ins0 GROUP BY 1 HAVING COUNT(*) >= 12)), {dbscan_sql("cg", "ins", 0.2, 12)},
sz AS (SELECT scene_id, cluster_id, COUNT(*) AS n, COUNT(*) OVER (PARTITION BY scene_id) AS n_clusters, row_number() OVER (PARTITION BY scene_id ORDER BY COUNT(*) DESC, cluster_id) AS rn
  FROM cg WHERE cluster_id IS NOT NULL GROUP BY scene_id, cluster_id)
SELECT scene_id, (SELECT COUNT(*) FROM ins i WHERE i.scene_id = sz.scene_id) AS n_in_anchor, n_clusters, cluster_id, n, 'rank0' AS source, 'rank0' AS policy FROM sz WHERE rn = 1""")
def _(spark, sf):
    p = cut(fx.points(spark, sf))
    anchors = C.find_anchor(p, flat_floor(p), SPARSE)
    return C.extract_cargo(C.cluster_in_anchor(p.where("y > 0.05"), anchors, SPARSE))[1]


LADDER = ((0.10, 20), (0.15, 15), (0.20, 10))


def _ladder_sql(src):
    runs = ",\n".join(dbscan_sql(f"r{i}", src, e, m) for i, (e, m) in enumerate(LADDER))
    alls = " UNION ALL ".join(f"SELECT scene_id, point_id, cluster_id, {i} AS attempt FROM r{i} WHERE cluster_id IS NOT NULL" for i in range(3))
    return f"""{runs}, al_ AS ({alls}), fs AS MATERIALIZED (SELECT * FROM (SELECT *, min(attempt) OVER (PARTITION BY scene_id) AS m FROM al_) WHERE attempt = m)"""


@query("win8_first_success", f"""WITH RECURSIVE {PTS}, s AS MATERIALIZED (SELECT * FROM pts WHERE label = 1 AND scene_id % 2 = 0 OR label = 3), {_ladder_sql("s")}
SELECT scene_id, CAST(attempt AS INTEGER) AS attempt, COUNT(*) AS n, COUNT(DISTINCT cluster_id) AS n_clusters FROM fs GROUP BY ALL""")
def _(spark, sf):
    p = fx.points(spark, sf).where("label = 1 AND scene_id % 2 = 0 OR label = 3")
    runs = [lambda df, e=e, m=m: C.dbscan(df, e, m).select("scene_id", "point_id", "cluster_id") for e, m in LADDER]
    return C.in_turn(p, runs).groupBy("scene_id", "attempt").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster_id").alias("n_clusters"))


@query("clu8_refine_cargo", f"""WITH RECURSIVE {CPTS},
shp_ AS (SELECT scene_id, cluster_id, COUNT(*) AS n, max(y) AS top, avg(x) AS cx, avg(z) AS cz FROM cpts WHERE cluster_id IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 30),
bst AS (SELECT scene_id, arg_max(cluster_id, n * top / (0.3e0 + sqrt((cx - center_x) * (cx - center_x) + (cz - center_z) * (cz - center_z)))) AS cluster_id FROM shp_ JOIN anch USING (scene_id) GROUP BY 1),
hg AS MATERIALIZED (SELECT scene_id, point_id, x, y, z FROM cpts JOIN bst USING (scene_id, cluster_id) WHERE y > 0.15e0),
s AS MATERIALIZED (SELECT * FROM hg WHERE scene_id IN (SELECT scene_id FROM hg GROUP BY 1 HAVING COUNT(*) >= 30)), {_ladder_sql("s")},
pk AS (SELECT scene_id, cluster_id FROM (SELECT scene_id, cluster_id, row_number() OVER (PARTITION BY scene_id ORDER BY COUNT(*) DESC, cluster_id) AS rn FROM fs GROUP BY scene_id, cluster_id) WHERE rn = 1)
SELECT scene_id, point_id, CAST(attempt AS INTEGER) AS attempt FROM fs JOIN pk USING (scene_id, cluster_id)
UNION ALL SELECT scene_id, point_id, NULL FROM hg WHERE scene_id NOT IN (SELECT scene_id FROM fs)""")
def _(spark, sf):
    c = cut(cpts(spark, sf))
    return C.refine_cargo(c, flat_floor(c), cargo_anchor(c)).select("scene_id", "point_id", "attempt")


GRID_EDGES = """{n}_id AS MATERIALIZED (SELECT *, i * 2147483648 + j AS id FROM {src}),
{n}_ge AS MATERIALIZED (SELECT a.scene_id, a.id AS a, b.id AS b FROM {n}_id a JOIN {n}_id b ON a.scene_id = b.scene_id
  AND ((abs(a.i - b.i) = 1 AND a.j = b.j) OR (a.i = b.i AND abs(a.j - b.j) = 1)))"""


def grid_sql(n: str, src: str) -> str:
    return f"""{GRID_EDGES.format(n=n, src=src)}, {flood_sql(n, f"{n}_id", f"{n}_ge")},
{n} AS MATERIALIZED (SELECT c.*, dense_rank() OVER (PARTITION BY c.scene_id ORDER BY root) - 1 AS component FROM {n}_id c JOIN {n}_root USING (scene_id, id))"""


@query("clu9_grid_components", f"""WITH RECURSIVE {FIELD}, ok_ AS MATERIALIZED (SELECT * FROM cells WHERE h >= 0.05e0), {grid_sql("gc", "ok_")}
SELECT scene_id, i, j, component FROM gc""")
def _(spark, sf):
    return C.grid_components(cargo_cells(spark, sf).where("h >= 0.05")).select("scene_id", "i", "j", F.col("component").cast("long").alias("component"))


@query("clu10_halo_filter", f"""WITH RECURSIVE {FIELD}, ok_ AS MATERIALIZED (SELECT * FROM cells WHERE h >= 0.05e0), {grid_sql("gc", "ok_")},
pt_ AS (SELECT scene_id, component, bool_or(h >= 0.2e0) AS tall FROM gc GROUP BY ALL),
sc_ AS (SELECT scene_id, bool_or(tall) AS any_, bool_and(tall) AS all_ FROM pt_ GROUP BY 1)
SELECT scene_id, i, j, {rd("h")} AS h, any_ AND NOT all_ AS halo_used FROM gc JOIN pt_ USING (scene_id, component) JOIN sc_ USING (scene_id) WHERE tall OR NOT any_""")
def _(spark, sf):
    return rounded(C.halo_filter(cargo_cells(spark, sf)).drop("component"), "h")


@query("clu11_tall_column_person", f"""WITH RECURSIVE {PTS}, src AS MATERIALIZED (SELECT *, min(x) OVER (PARTITION BY scene_id) AS x0, min(z) OVER (PARTITION BY scene_id) AS z0 FROM pts WHERE y >= 0.05e0),
gp AS MATERIALIZED (SELECT *, CAST(floor((x - x0) / 0.3e0) AS BIGINT) AS i, CAST(floor((z - z0) / 0.3e0) AS BIGINT) AS j FROM src),
cs AS MATERIALIZED (SELECT scene_id, i, j, max(y) AS y_max, max(y) - min(y) AS y_range FROM gp GROUP BY ALL),
sz AS (SELECT scene_id, max(i) + 1 AS ni, max(j) + 1 AS nj FROM cs GROUP BY 1), tl AS MATERIALIZED (SELECT * FROM cs WHERE y_max >= 1.0e0 AND y_range >= 0.8e0), {grid_sql("gc", "tl")},
pc AS (SELECT scene_id, component FROM gc JOIN sz USING (scene_id) GROUP BY scene_id, component, ni, nj HAVING COUNT(*) * 0.3e0 * 0.3e0 < 0.5e0 AND (min(i) <= 5 OR max(i) >= ni - 6 OR min(j) <= 5 OR max(j) >= nj - 6))
SELECT scene_id, point_id, component FROM gp JOIN gc USING (scene_id, i, j) JOIN pc USING (scene_id, component)""")
def _(spark, sf):
    out = C.tall_column_person(fx.points(spark, sf), cell_size=0.3, edge=6)
    return out.select("scene_id", "point_id", F.col("component").cast("long").alias("component"))


@query("clu12_compact_cluster_person", f"""WITH RECURSIVE {PTS}, s AS MATERIALIZED (SELECT * FROM pts WHERE y BETWEEN 0.8e0 AND 2.0e0), {dbscan_sql("db", "s", 0.3, 2, D2)},
sd AS (SELECT DISTINCT scene_id, cluster_id FROM db JOIN (SELECT scene_id, a FROM db_e GROUP BY ALL HAVING COUNT(*) >= 5) d USING (scene_id) WHERE d.a = point_id),
fp AS (SELECT scene_id, cluster_id, (max(x) - min(x)) * (max(z) - min(z)) AS f FROM db JOIN sd USING (scene_id, cluster_id) GROUP BY ALL HAVING COUNT(*) >= 20),
bs AS (SELECT scene_id, min({{'f': f, 'c': cluster_id}}) AS m FROM fp GROUP BY 1)
SELECT scene_id, point_id FROM db JOIN bs USING (scene_id) WHERE cluster_id = m.c AND m.f < 1""")
def _(spark, sf):
    return C.compact_cluster_person(fx.points(spark, sf), min_pts=20).select("scene_id", "point_id")


# ------------------------------------------------------------------- floor planes

HYP = """hyp AS MATERIALIZED (SELECT scene_id, h, CAST((h * 7 + scene_id) % 5 - 2 AS DOUBLE) / 200e0 AS a, 1e0 AS b, CAST((h * 3 + scene_id) % 5 - 2 AS DOUBLE) / 200e0 AS c,
  CAST(h % 9 - 4 AS DOUBLE) / -100e0 AS d FROM (SELECT DISTINCT scene_id FROM pts) s, range(32) t(h)),
hits AS (SELECT p.scene_id, h, COUNT(*) FILTER (abs(a * x + b * y + c * z + d) <= 0.025e0) AS inliers FROM pts p JOIN hyp USING (scene_id) GROUP BY ALL),
bp AS MATERIALIZED (SELECT scene_id, h, inliers, a, b, c, d FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY inliers DESC, h) AS rn FROM hits) JOIN hyp USING (scene_id, h) WHERE rn = 1)"""


def given_planes(p):
    return p.select("scene_id").distinct().selectExpr("scene_id", "explode(sequence(0L, 31L)) AS h").selectExpr(
        "scene_id", "h", "CAST((h * 7 + scene_id) % 5 - 2 AS DOUBLE) / 200D AS a", "1D AS b", "CAST((h * 3 + scene_id) % 5 - 2 AS DOUBLE) / 200D AS c",
        "CAST(h % 9 - 4 AS DOUBLE) / -100D AS d")


@query("clu1_best_plane", f"WITH {PTS}, {HYP} SELECT scene_id, h, inliers, {rd('a')} AS a, {rd('b')} AS b, {rd('c')} AS c, {rd('d')} AS d FROM bp")
def _(spark, sf):
    p = fx.points(spark, sf)
    return rounded(C.best_plane(p, given_planes(p)), "a", "b", "c", "d")


def floor_sql() -> str:
    """Three rounds of the best given plane on what the rounds before left over, and the choice among them."""
    near = "abs(a * x + b * y + c * z + d) <= 0.025e0"
    parts = [f"WITH {PTS}, hyp0 AS MATERIALIZED (SELECT scene_id, h, a, b, c, d FROM (WITH {HYP.split(',\nhits')[0]} SELECT * FROM hyp)), w0 AS (SELECT scene_id, point_id, x, y, z FROM pts)"]
    for i in range(3):
        parts.append(f"""bp{i} AS MATERIALIZED (SELECT scene_id, h, inliers, a, b, c, d FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY inliers DESC, h) AS rn FROM (
    SELECT p.scene_id, h, COUNT(*) FILTER ({near}) AS inliers FROM w{i} p JOIN hyp0 USING (scene_id) GROUP BY ALL)) JOIN hyp0 USING (scene_id, h) WHERE rn = 1),
m{i} AS MATERIALIZED (SELECT w.*, coalesce({near}, false) AS inn FROM w{i} w LEFT JOIN bp{i} USING (scene_id)),
cd{i} AS (SELECT scene_id, a, b, c, d, floor_y, inliers, {i + 1} AS attempt FROM bp{i} JOIN (SELECT scene_id, avg(y) AS floor_y FROM m{i} WHERE inn GROUP BY 1) USING (scene_id)
  WHERE abs(b) >= 0.9e0 AND abs(floor_y) <= 0.1e0),
w{i + 1} AS MATERIALIZED (SELECT scene_id, point_id, x, y, z FROM m{i} WHERE NOT inn)""")
    return ",\n".join(parts) + f""",
cd AS (SELECT * FROM cd0 UNION ALL SELECT * FROM cd1 UNION ALL SELECT * FROM cd2),
jd AS (SELECT cd.*, (SELECT COUNT(*) FILTER (y < floor_y - 0.1e0) / COUNT(*) FROM pts p WHERE p.scene_id = cd.scene_id) AS below_frac FROM cd)
SELECT scene_id, {rd("a")} AS a, {rd("b")} AS b, {rd("c")} AS c, {rd("d")} AS d, {rd("floor_y")} AS floor_y, inliers, {rd("below_frac")} AS below_frac, attempt FROM jd
QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY below_frac <= 0.02e0 DESC, CASE WHEN below_frac <= 0.02e0 THEN CAST(inliers AS DOUBLE) ELSE -below_frac END DESC, attempt) = 1"""


@query("clu1_floor_plane", floor_sql())
def _(spark, sf):
    """All rounds over given hypotheses."""
    p = fx.points(spark, sf)
    out = C.floor_plane(p, SPARSE, planes=given_planes(p))
    return rounded(out, "a", "b", "c", "d", "floor_y", "below_frac")


@query("clu1_drawn_floor_plane")
def _(spark, sf):
    """All rounds over drawn hypotheses."""
    out = C.floor_plane(fx.points(spark, sf), SPARSE)
    return rounded(out, "a", "b", "c", "d", "floor_y", "below_frac")


@query("clu2_mark_floor", f"""WITH {PTS}, {HYP}, fl AS (SELECT bp.scene_id, a, b, c, d, (SELECT avg(y) FROM pts p WHERE p.scene_id = bp.scene_id AND abs(a * x + b * y + c * z + d) <= 0.025e0) AS floor_y FROM bp)
SELECT scene_id, point_id, abs(a * x + b * y + c * z + d) <= 0.025e0 OR (y >= floor_y - 0.05e0 AND y <= floor_y + 0.05e0) AS is_floor FROM pts JOIN fl USING (scene_id)""")
def _(spark, sf):
    p = fx.points(spark, sf)
    best = C.best_plane(p, given_planes(p))
    level = p.join(best, "scene_id").where("abs(a * x + b * y + c * z + d) <= 0.025").groupBy("scene_id").agg(F.avg("y").alias("floor_y"))
    return C.mark_floor(p, best.join(level, "scene_id")).select("scene_id", "point_id", "is_floor")


@query("clu2_virtual_floor", f"WITH {PTS} SELECT scene_id, {rd('min(y) - 0.05e0')} AS floor_y, {rd('-(min(y) - 0.05e0)')} AS d FROM pts GROUP BY scene_id")
def _(spark, sf):
    return rounded(C.virtual_floor(fx.points(spark, sf)).select("scene_id", "floor_y", "d"), "floor_y", "d")


@query("clu13_run_extraction")
def _(spark, sf):
    out = X.run_extraction(fx.points(spark, sf), SPARSE)
    return out.select("scene_id", "status", "n_anchor", "n_pallets", "n_clusters", "n_cargo", r("volume_m3").alias("volume_m3"), r("obb_volume", 4).alias("obb_volume"))


def extraction_sql(eps: float, min_pts: int, virtual: bool, given: bool, fill: bool) -> str:
    """The end-to-end extraction: voxels, floor, anchor, clusters, choice of cargo, refinement, height field."""
    floor = "SELECT scene_id, min(y) - 0.05e0 AS floor_y FROM vx GROUP BY 1" if virtual else "SELECT DISTINCT scene_id, 0e0 AS floor_y FROM vx"
    above = "SELECT * FROM vx" if virtual else "SELECT * FROM vx WHERE NOT (abs(y) <= 0.025e0 OR (y >= -0.05e0 AND y <= 0.05e0))"
    if given:
        chosen = """jd AS MATERIALIZED (SELECT *, NOT (((scene_id + cluster_id) % 3 + 1) IN (2, 3)
    AND CAST((scene_id * 7 + cluster_id * 13) % 60 + 40 AS DOUBLE) / 100e0 >= 0.75e0) AS keep0 FROM sz),
kp AS MATERIALIZED (SELECT *, CASE WHEN kept = 0 THEN rk = 1 ELSE keep0 END AS keep FROM (SELECT *, COUNT(*) FILTER (keep0) OVER (PARTITION BY scene_id) AS kept FROM jd)),
sm AS (SELECT scene_id, CAST(any_value(kept) AS BIGINT) AS n_kept, COUNT(*) - any_value(kept) AS n_excluded, CASE WHEN any_value(kept) = 0 THEN 'fallback_rank0' ELSE 'classifier' END AS source,
  'negative_filter' AS policy FROM kp GROUP BY 1)"""
    else:
        chosen = f"""sc_ AS (SELECT c.scene_id, cluster_id, COUNT(*) * (max(y) - any_value(floor_y)) / (0.3e0 + sqrt((avg(x) - any_value(center_x)) * (avg(x) - any_value(center_x))
    + (avg(z) - any_value(center_z)) * (avg(z) - any_value(center_z)))) AS score FROM cg c JOIN anchor USING (scene_id) JOIN fl USING (scene_id)
  WHERE cluster_id IS NOT NULL GROUP BY c.scene_id, cluster_id HAVING COUNT(*) >= {min_pts}),
kp AS MATERIALIZED (SELECT scene_id, cluster_id, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC NULLS LAST, rk) = 1 AS keep FROM sz LEFT JOIN sc_ USING (scene_id, cluster_id)),
sm AS (SELECT scene_id, CAST(1 AS BIGINT) AS n_kept, CAST(0 AS BIGINT) AS n_excluded, 'score' AS source, 'rank0' AS policy FROM kp GROUP BY 1)"""
    filled = """sp2 AS (SELECT scene_id, i, min(j) AS j0, max(j) AS j1, max(h) AS f FROM cl0 WHERE h >= 0.2e0 GROUP BY ALL),
fl2 AS (SELECT scene_id, i, f, unnest(range(j0, j1 + 1)) AS j FROM sp2),
cl AS MATERIALIZED (SELECT coalesce(c.scene_id, f.scene_id) AS scene_id, coalesce(c.i, f.i) AS i, coalesce(c.j, f.j) AS j, greatest(coalesce(h, f), coalesce(f, h)) AS h
  FROM cl0 c FULL JOIN fl2 f ON c.scene_id = f.scene_id AND c.i = f.i AND c.j = f.j)""" if fill else "cl AS MATERIALIZED (SELECT * FROM cl0)"
    return f"""WITH RECURSIVE {PTS},
vx AS MATERIALIZED (SELECT scene_id, min(point_id) AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY scene_id, floor(x / 0.035e0), floor(y / 0.035e0), floor(z / 0.035e0)),
fl AS MATERIALIZED ({floor}), ab AS MATERIALIZED ({above}),
hi_ AS MATERIALIZED (SELECT ab.* FROM ab JOIN fl USING (scene_id) WHERE y > floor_y + 0.2e0), {dbscan_sql("an", "hi_", 0.15, 10, D2)},
anc_ AS (SELECT scene_id, cluster_id FROM (SELECT scene_id, cluster_id, row_number() OVER (PARTITION BY scene_id ORDER BY COUNT(*) DESC, cluster_id) AS rn
  FROM an WHERE cluster_id IS NOT NULL GROUP BY scene_id, cluster_id) WHERE rn = 1),
anchor AS MATERIALIZED (SELECT scene_id, COUNT(*) AS n_points, min(x) AS x_min, max(x) AS x_max, min(z) AS z_min, max(z) AS z_max,
  (min(x) + max(x)) / 2e0 AS center_x, (min(z) + max(z)) / 2e0 AS center_z FROM an JOIN anc_ USING (scene_id, cluster_id) GROUP BY scene_id),
ins0 AS (SELECT p.* FROM ab p JOIN anchor USING (scene_id) WHERE x BETWEEN x_min - 0.3e0 AND x_max + 0.3e0 AND z BETWEEN z_min - 0.3e0 AND z_max + 0.3e0),
ins AS MATERIALIZED (SELECT * FROM ins0 WHERE scene_id IN (SELECT scene_id FROM ins0 GROUP BY 1 HAVING COUNT(*) >= {min_pts})), {dbscan_sql("cg", "ins", eps, min_pts)},
sz AS MATERIALIZED (SELECT scene_id, cluster_id, COUNT(*) AS n, COUNT(*) OVER (PARTITION BY scene_id) AS n_clusters, row_number() OVER (PARTITION BY scene_id ORDER BY COUNT(*) DESC, cluster_id) AS rk
  FROM cg WHERE cluster_id IS NOT NULL GROUP BY scene_id, cluster_id), {chosen},
hg AS MATERIALIZED (SELECT cg.scene_id, point_id, x, y, z FROM cg JOIN kp USING (scene_id, cluster_id) JOIN fl USING (scene_id) WHERE keep AND y > floor_y + 0.15e0),
s AS MATERIALIZED (SELECT * FROM hg WHERE scene_id IN (SELECT scene_id FROM hg GROUP BY 1 HAVING COUNT(*) >= 30)), {_ladder_sql("s")},
pk AS (SELECT scene_id, cluster_id FROM (SELECT scene_id, cluster_id, row_number() OVER (PARTITION BY scene_id ORDER BY COUNT(*) DESC, cluster_id) AS rn FROM fs GROUP BY scene_id, cluster_id) WHERE rn = 1),
cgo AS MATERIALIZED (SELECT hg.* FROM hg JOIN fs USING (scene_id, point_id) JOIN pk ON pk.scene_id = fs.scene_id AND pk.cluster_id = fs.cluster_id
  UNION ALL SELECT * FROM hg WHERE scene_id NOT IN (SELECT scene_id FROM fs)),
hb AS (SELECT scene_id, min(x) AS lx, max(x) AS hx, min(z) AS lz, max(z) AS hz, COUNT(*) AS n_cargo FROM cgo GROUP BY 1),
cl0 AS MATERIALIZED (SELECT scene_id, CAST(least(floor((x - lx) / 0.04e0), greatest(ceil((hx - lx) / 0.04e0), 1) - 1) AS BIGINT) AS i,
    CAST(least(floor((z - lz) / 0.04e0), greatest(ceil((hz - lz) / 0.04e0), 1) - 1) AS BIGINT) AS j, max(y) - (any_value(floor_y) + 0.144e0) AS h
  FROM cgo JOIN hb USING (scene_id) JOIN fl USING (scene_id) GROUP BY ALL), {filled},
ok_ AS MATERIALIZED (SELECT * FROM cl WHERE h >= 0.05e0), {grid_sql("gc", "ok_")},
pt_ AS (SELECT scene_id, component, bool_or(h >= 0.2e0) AS tall FROM gc GROUP BY ALL), any_ AS (SELECT scene_id, bool_or(tall) AS has_tall FROM pt_ GROUP BY 1),
vo AS (SELECT scene_id, sum(h * (0.04e0 * 0.04e0)) AS v FROM gc JOIN pt_ USING (scene_id, component) JOIN any_ USING (scene_id) WHERE tall OR NOT has_tall GROUP BY 1),
ia AS (SELECT scene_id, COUNT(*) AS n_in_anchor FROM cg GROUP BY 1), nc AS (SELECT scene_id, any_value(n_clusters) AS n_clusters FROM sz GROUP BY 1)
SELECT d.scene_id, CASE WHEN a.n_points IS NULL THEN 'no_anchor' WHEN nc.n_clusters IS NULL THEN 'no_cluster' WHEN hb.n_cargo IS NULL THEN 'no_cargo' ELSE 'ok' END AS status,
  a.n_points AS n_anchor, CASE WHEN nc.n_clusters IS NOT NULL THEN ia.n_in_anchor END AS n_in_anchor, nc.n_clusters AS n_clusters, sm.n_kept AS n_kept, sm.n_excluded AS n_excluded,
  sm.source AS source, sm.policy AS policy, hb.n_cargo AS n_cargo, CASE WHEN hb.n_cargo IS NOT NULL THEN {rd("coalesce(vo.v, 0e0)")} END AS volume_m3
FROM (SELECT DISTINCT scene_id FROM pts) d LEFT JOIN anchor a USING (scene_id) LEFT JOIN ia USING (scene_id) LEFT JOIN nc USING (scene_id) LEFT JOIN sm USING (scene_id)
LEFT JOIN hb USING (scene_id) LEFT JOIN vo USING (scene_id)"""


def _extraction_row(out):
    return out.select("scene_id", "status", "n_anchor", "n_in_anchor", "n_clusters", "n_kept", "n_excluded", "source", "policy", "n_cargo", r("volume_m3").alias("volume_m3"))


def _given_predictions(features):
    """Class and probability of every cluster by arithmetic on its keys."""
    return features.select("scene_id", "cluster_id", F.expr("CAST((scene_id + cluster_id) % 3 + 1 AS INT)").alias("y_pred"),
                           F.expr("CAST((scene_id * 7 + cluster_id * 13) % 60 + 40 AS DOUBLE) / 100D").alias("max_prob"))


@query("clu13_run_extraction_classifier", extraction_sql(0.2, 12, virtual=False, given=True, fill=False))
def _(spark, sf):
    """Known level floor, clusters chosen by given predictions."""
    p = fx.points(spark, sf)
    level = flat_floor(p).selectExpr("scene_id", "0D AS a", "1D AS b", "0D AS c", "0D AS d", "floor_y")
    return _extraction_row(X.run_extraction(p, SPARSE, floor=level, classifier=_given_predictions))


@query("clu13_run_extraction_preprocessed", extraction_sql(0.15, 10, virtual=True, given=False, fill=True))
def _(spark, sf):
    """Clouds with z up and without a floor plane."""
    return _extraction_row(X.run_extraction(fx.points(spark, sf).selectExpr("scene_id", "point_id", "x", "z AS y", "y AS z"), SPARSE, preprocessed=True))


@query("ml8_build_cluster_dataset")
def _(spark, sf):
    rows, _ = X.build_cluster_dataset(fx.points(spark, sf), SPARSE, min_points=12)
    return rows.select("scene_id", "cluster_id", "n_points", "majority", "y_cluster", r("purity").alias("purity"))


@query("agg22_purity_report", f"""WITH {CPTS}, v AS (SELECT *, (cluster_id + CASE WHEN point_id % 5 < 2 THEN 1 ELSE 0 END) % 3 + 1 AS cls FROM cpts WHERE cluster_id IS NOT NULL),
c AS (SELECT scene_id, cluster_id, cls, COUNT(*) AS c FROM v GROUP BY ALL),
k AS MATERIALIZED (SELECT scene_id, cluster_id, arg_min(cls, [-c, cls]) AS majority, max(c) / sum(c) AS purity FROM c GROUP BY ALL HAVING sum(c) >= 30),
s AS (SELECT 'all' AS scope, purity FROM k UNION ALL SELECT 'cargo_majority', purity FROM k WHERE majority = 1)
SELECT scope, COUNT(*) AS n, {rd("avg(purity)")} AS mean, {rd("avg((purity < 0.6e0)::INT)")} AS below_06, {rd("avg((purity < 0.8e0)::INT)")} AS below_08,
  {rd("median(purity)")} AS median, {rd("quantile_cont(purity, 0.25)")} AS p25, {rd("quantile_cont(purity, 0.1)")} AS p10 FROM s GROUP BY scope""")
def _(spark, sf):
    v = cpts(spark, sf).withColumn("cluster_class", F.expr("CAST((cluster_id + CASE WHEN point_id % 5 < 2 THEN 1 ELSE 0 END) % 3 + 1 AS INT)"))
    return rounded(E.purity_report(C.cluster_labels(v)), "mean", "below_06", "below_08", "median", "p25", "p10")


@query("agg33_excluded_cluster_report", f"""WITH {CPTS}, x_ AS (SELECT p.*, max_prob FROM cpts p JOIN cpred c USING (scene_id, cluster_id) WHERE y_pred = 2), {box_sql("x_")},
w_ AS (SELECT scene_id, cluster_id, any_value(max_prob) AS max_prob, avg(x) AS cx, avg(z) AS cz, min(y) AS y0 FROM x_ GROUP BY ALL)
SELECT scene_id, cluster_id, n, {rd("max_prob")} AS max_prob, max_prob < 0.75e0 AS doubtful, {rd("box_long", 4)} AS box_long, {rd("box_short", 4)} AS box_short, {rd("box_height", 4)} AS box_height,
  {rd("box_long / greatest(box_short, 1e-6)", 4)} AS aspect_ls, {rd("box_height / greatest(box_long, 1e-6)", 4)} AS aspect_hl, {rd("cx")} AS ctr_x, {rd("cz")} AS ctr_z, {rd("y0")} AS above_floor
FROM obox JOIN ev USING (scene_id, cluster_id) JOIN w_ USING (scene_id, cluster_id)""")
def _(spark, sf):
    c = cut(cpts(spark, sf))
    out = E.excluded_cluster_report(c, cpreds(c), flat_floor(c))
    four = ("box_long", "box_short", "box_height", "aspect_ls", "aspect_hl")
    return rounded(rounded(out, *four, digits=4), "max_prob", "ctr_x", "ctr_z", "above_floor")


@query("agg33_excluded_cluster_counts", f"""WITH {CPTS} SELECT scene_id, COUNT(*) FILTER (y_pred = 2) AS n_excluded, COUNT(*) FILTER (y_pred = 2 AND max_prob < 0.75e0) AS n_doubtful FROM cpred GROUP BY scene_id""")
def _(spark, sf):
    return E.excluded_cluster_counts(cpreds(cpts(spark, sf)))
