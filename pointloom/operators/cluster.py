"""Connected components, density clustering, floor planes and cargo extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import cell, hash_uniform, squared_distance
from ..functions.groups import attach, first_n, with_stats
from ..functions.graph import connected_components
from ..functions.lineage import cut
from . import whole
from .grids import column_stats
from .neighbors import _offsets, _types, _weighted_counts, in_scenes, large_scenes, parted
from .transforms import above_floor, height_slice, inside_anchor

XYZ = ("x", "y", "z")


# ------------------------------------------------------------------- components

def components(nodes: DataFrame, edges: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Smallest node id reachable from each node: ``scene_id, id, root``.

    Nodes without edges are their own component and take no part in the search,
    whose rounds grow with the logarithm of the number of nodes (no cap).
    """
    end = lambda c: F.struct(F.col(scene).alias("s"), F.col(c).alias("id"))
    found = connected_components(edges.select(end("a").alias("a"), end("b").alias("b")))
    linked = found.select(F.col("node.s").alias(scene), F.col("node.id").alias("id"), F.col("root.id").alias("_root"))
    return nodes.select(scene, "id").join(linked, [scene, "id"], "left").select(scene, "id", F.coalesce("_root", "id").alias("root"))


def grid_components(cells: DataFrame, by="scene_id") -> DataFrame:
    """4-connected components of occupied cells: adds ``component`` (0.. per scene, by the smallest cell ``i, j``).

    A scene whose cells a task may hold is settled there, larger ones as a graph (:func:`_grid_components_of_runs`).
    """
    known = cut(cells.where(F.col(by).isNotNull() & F.col("i").isNotNull() & F.col("j").isNotNull()))
    rows = known.select(by, "i", "j", *[c for c in known.columns if c not in (by, "i", "j")])
    large, total = large_scenes(by, rows)
    small, rest = parted(rows, large, by)
    found = in_scenes(small, by, total).mapInArrow(whole.components_in_scenes(by), f"{_types(rows, rows.columns)}, component int")
    return found if rest is None else found.unionByName(_grid_components_of_runs(cut(rest), by))


def _grid_components_of_runs(cells: DataFrame, by: str) -> DataFrame:
    """:func:`grid_components` of large scenes.

    Runs of adjacent cells in a column are joined first, so the graph has one node
    per run instead of one per cell.
    """
    keyed = cells.select(by, "i", "j").distinct()
    line = Window.partitionBy(by, "i").orderBy("j")
    runs = keyed.withColumn("_run", F.col("j") - F.row_number().over(line))
    pack = F.col("i") * F.lit(1 << 31) + F.min("j")
    nodes = runs.groupBy(by, "i", "_run").agg(pack.alias("id"))
    tagged = runs.join(nodes, [by, "i", "_run"]).select(by, "i", "j", "id")
    right = tagged.select(by, (F.col("i") - 1).alias("i"), "j", F.col("id").alias("b"))
    edges = tagged.select(by, "i", "j", F.col("id").alias("a")).join(right, [by, "i", "j"]).select(by, "a", "b").distinct()
    tagged = cut(tagged)
    roots = components(nodes, edges, by)
    order = Window.partitionBy(by).orderBy("root")
    numbers = roots.select(by, "root").distinct().withColumn("component", F.row_number().over(order) - 1)
    named = roots.join(numbers, [by, "root"]).select(by, "id", "component")
    return cells.join(tagged.join(named, [by, "id"]).drop("id"), [by, "i", "j"])


# --------------------------------------------------------------------- clustering

def dbscan(
    df: DataFrame, eps: float, min_pts: int, dims=XYZ, scene: str = "scene_id", key: str = "point_id",
) -> DataFrame:
    """Density clustering per scene: adds ``cluster_id`` (NULL = noise) and ``is_core``.

    A point with at least ``min_pts`` points (itself included) within ``eps`` is a
    core point; border points join the cluster with the smallest core id among
    the core points in reach.  Clusters are numbered 0.. by their smallest core id.

    A scene that a task may hold is clustered there (:func:`~pointloom.operators.whole.dense_parts`), larger ones on cells.
    """
    dims = list(dims)
    rows = cut(df.where(F.col(scene).isNotNull()))
    rows = rows.select(scene, key, *[c for c in rows.columns if c not in (scene, key)])
    large, total = large_scenes(scene, rows)
    small, rest = parted(rows, large, scene)
    found = in_scenes(small, scene, total).mapInArrow(
        whole.dense_in_scenes(scene, key, dims, eps, min_pts), f"{_types(rows, rows.columns)}, cluster_id long, is_core boolean")
    return found if rest is None else found.unionByName(_dbscan_on_cells(cut(rest), eps, min_pts, dims, scene, key))


def _dbscan_on_cells(df, eps, min_pts, dims, scene, key):
    """:func:`dbscan` of large scenes.

    The graph is built on cells of diagonal ``eps``: the points of one cell are
    mutual neighbours, so full cells need no pairs at all and the graph has one node
    per cell.  Point pairs are formed only for thinly filled cells and between
    neighbouring cells whose outermost points do not settle the question.
    """
    n_dims = len(dims)
    width = eps / n_dims ** 0.5 * (1.0 - 1e-9)
    cells = [f"_c{i}" for i in range(n_dims)]
    pts = cut(
        df.select(scene, key, *dims).withColumns({c: cell(d, width) for c, d in zip(cells, dims)})
    )
    places = pts.groupBy(scene, *cells, *dims).agg(F.count(F.lit(1)).alias("_w"), F.min(key).alias("_id"))
    fill = places.groupBy(scene, *cells).agg(F.sum("_w").alias("_fill"))
    placed = places.join(fill, [scene, *cells])
    thin = placed.where(F.col("_fill") < min_pts).select(scene, *dims)
    counted = _weighted_counts(thin, places.select(scene, *dims, "_w"), eps, dims, scene)
    cores = placed.where(F.col("_fill") >= min_pts).select(scene, *dims, *cells, "_id").unionByName(
        placed.where(F.col("_fill") < min_pts).join(counted.where(F.col("_found") >= min_pts), [scene, *dims], "left_semi")
        .select(scene, *dims, *cells, "_id")
    )
    cores = cut(cores)

    spot = F.struct(*dims)
    boxes = cut(cores.groupBy(scene, *cells).agg(
        F.min("_id").alias("node"),
        *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))],
        F.array(*[g(spot, d) for d in dims for g in (F.min_by, F.max_by)]).alias("reps"),
    ))
    linked = _linked_cells(boxes, cores, eps, dims, cells, scene)
    roots = components(boxes.select(scene, F.col("node").alias("id")), linked, scene)
    named = boxes.select(scene, *cells, "node").join(
        roots.select(scene, F.col("id").alias("node"), "root"), [scene, "node"]
    ).drop("node")
    order = Window.partitionBy(scene).orderBy("root")
    numbered = named.select(scene, "root").distinct().withColumn("cluster_id", F.row_number().over(order) - 1)
    named = cut(named.join(numbered, [scene, "root"]).drop("root"))

    core_named = cores.join(named, [scene, *cells]).select(scene, *dims, *cells, "cluster_id")
    lonely = placed.where(F.col("_fill") < min_pts).join(cores.select(scene, *dims), [scene, *dims], "left_anti")
    border = _border_labels(lonely.select(scene, *dims, *cells), core_named, eps, dims, cells, scene)
    labels = core_named.select(scene, *dims, "cluster_id").withColumn("is_core", F.lit(True)).unionByName(
        border.withColumn("is_core", F.lit(False))
    )
    out = pts.join(labels, [scene, *dims], "left").select(
        scene, key, F.col("cluster_id").cast("long").alias("cluster_id"), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )
    return df.join(out, [scene, key])


def _ring(rows: DataFrame, cells, scene: str, half: bool) -> DataFrame:
    """Adjacent cell pairs up to two cells apart; ``half`` keeps each pair once."""
    shifted = rows.withColumn("_o", F.explode(_offsets(len(cells), 2)))
    if half:
        zero = F.struct(*[F.lit(0).cast("long").alias(f"o{i}") for i in range(len(cells))])
        shifted = shifted.where(F.col("_o") > zero)
    return shifted.withColumns({f"_n{c}": F.col(c) + F.col(f"_o.o{i}") for i, c in enumerate(cells)}).drop("_o")


def _linked_cells(boxes, cores, eps, dims, cells, scene):
    """Pairs of core cells that hold two core points within ``eps``."""
    limit = F.lit(eps * eps)
    a = _ring(boxes, cells, scene, half=True)
    b = boxes.select(
        scene, *[F.col(c).alias(f"_n{c}") for c in cells], F.col("node").alias("_node"), F.col("reps").alias("_reps"),
        *[F.col(f"{n}_{d}").alias(f"_{n}_{d}") for d in dims for n in ("lo", "hi")],
    )
    gap = None
    for d in dims:
        g = F.greatest(F.col(f"lo_{d}") - F.col(f"_hi_{d}"), F.col(f"_lo_{d}") - F.col(f"hi_{d}"), F.lit(0.0))
        gap = g * g if gap is None else gap + g * g
    close = a.join(b, [scene, *[f"_n{c}" for c in cells]]).where(gap <= limit * (1.0 + 1e-9))

    def near(p, q):
        return squared_distance([p[d] for d in dims], [q[d] for d in dims]) <= limit

    settled = F.exists("reps", lambda p: F.exists("_reps", lambda q: near(p, q)))
    close = cut(close.withColumn("_settled", settled).drop("reps", "_reps"))
    sure = close.where("_settled").select(scene, F.col("node").alias("a"), F.col("_node").alias("b"))
    open_pairs = close.where("NOT _settled")

    def box_gap(prefix):
        total = None
        for d in dims:
            g = F.greatest(F.col(f"{prefix}lo_{d}") - F.col(d), F.col(d) - F.col(f"{prefix}hi_{d}"), F.lit(0.0))
            total = g * g if total is None else total + g * g
        return total <= limit * (1.0 + 1e-9)

    spots = cores.select(scene, *cells, *dims)
    left = spots.join(open_pairs, [scene, *cells]).where(box_gap("_")).select(
        scene, "node", "_node", *[f"_n{c}" for c in cells], *[f"lo_{d}" for d in dims], *[f"hi_{d}" for d in dims],
        *[F.col(d).alias(f"p_{d}") for d in dims],
    )
    other = spots.select(scene, *[F.col(c).alias(f"_n{c}") for c in cells], *dims)
    joined = left.join(other, [scene, *[f"_n{c}" for c in cells]]).where(box_gap(""))
    hits = joined.where(squared_distance([f"p_{d}" for d in dims], dims) <= limit)
    found = hits.groupBy(scene, "node", "_node").agg(F.lit(1)).select(
        scene, F.col("node").alias("a"), F.col("_node").alias("b")
    )
    return sure.unionByName(found)


def _border_labels(lonely, core_named, eps, dims, cells, scene):
    """Smallest cluster among the core points within ``eps`` of each non-core location."""
    around = _ring(lonely.select(scene, *cells).distinct(), cells, scene, half=False).select(
        scene, *cells, *[f"_n{c}" for c in cells]
    )
    targets = core_named.select(
        scene, *[F.col(c).alias(f"_n{c}") for c in cells], *[F.col(d).alias(f"n_{d}") for d in dims], "cluster_id"
    ).join(around, [scene, *[f"_n{c}" for c in cells]])
    d2 = squared_distance(dims, [f"n_{d}" for d in dims])
    return lonely.join(targets, [scene, *cells]).where(d2 <= F.lit(eps * eps)).groupBy(scene, *dims).agg(
        F.min("cluster_id").alias("cluster_id")
    )


def first_success(results: list[DataFrame], by: str = "scene_id") -> DataFrame:
    """Rows of the first attempt that produced a cluster in each scene (adds ``attempt``).

    ``results`` are clusterings (with ``cluster_id``) in order of preference.
    """
    tagged = None
    for i, r in enumerate(results):
        t = r.where(F.col("cluster_id").isNotNull()).withColumn("attempt", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    chosen = tagged.groupBy(by).agg(F.min("attempt").alias("attempt"))
    return attach(tagged, chosen.withColumnRenamed("attempt", "_best"), by, "inner").where(
        F.col("attempt") == F.col("_best")
    ).drop("_best")


def in_turn(df: DataFrame, attempts: list, by: str = "scene_id") -> DataFrame:
    """:func:`first_success` of clusterings that are functions of ``df``: each attempt sees only the scenes that are still without a cluster."""
    left, found = df, []
    for i, attempt in enumerate(attempts):
        got = cut(attempt(left).where(F.col("cluster_id").isNotNull()).withColumn("attempt", F.lit(i)))
        found.append(got)
        left = cut(left.join(got.select(by).distinct(), by, "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


# ---------------------------------------------------------------- cluster ranking

def cluster_sizes(points: DataFrame) -> DataFrame:
    """``scene_id, cluster_id, n`` without noise."""
    return points.where(F.col("cluster_id").isNotNull()).groupBy("scene_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("n")
    )


def largest_cluster(clusters: DataFrame) -> DataFrame:
    """The biggest cluster per scene; ties go to the lowest id."""
    return clusters.groupBy("scene_id").agg(
        F.max_by(F.struct(*[c for c in clusters.columns if c != "scene_id"]), F.struct("n", (-F.col("cluster_id")).alias("k"))).alias("m")
    ).select("scene_id", "m.*")


def cluster_shape(points: DataFrame, floor: DataFrame, anchors: DataFrame, min_pts: int = 30) -> DataFrame:
    """Size, height above floor, XZ diagonal, distance to the anchor and hybrid score."""
    stats = points.where(F.col("cluster_id").isNotNull()).groupBy("scene_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("y").alias("_top"), F.avg("x").alias("_cx"), F.avg("z").alias("_cz"),
        F.hypot(F.max("x") - F.min("x"), F.max("z") - F.min("z")).alias("xz"),
    ).where(F.col("n") >= min_pts)
    placed = stats.join(floor.select("scene_id", "floor_y"), "scene_id").join(
        anchors.select("scene_id", "center_x", "center_z"), "scene_id"
    )
    h = F.col("_top") - F.col("floor_y")
    dist = F.hypot(F.col("_cx") - F.col("center_x"), F.col("_cz") - F.col("center_z"))
    return placed.select(
        "scene_id", "cluster_id", "n", h.alias("h"), "xz",
        F.when(F.col("xz") > 1e-6, h / F.col("xz")).alias("h_xz"), dist.alias("dist"),
        (F.col("n") * h / (F.lit(0.3) + dist)).alias("score"),
    )


def score_clusters(points: DataFrame, floor: DataFrame, anchors: DataFrame, min_pts: int = 30) -> DataFrame:
    """Best cluster per scene by ``n * h / (0.3 + dist)``; ties go to the lowest id."""
    shape = cluster_shape(points, floor, anchors, min_pts)
    best = F.max_by(F.struct("cluster_id", "n", "h", "dist", "score"), F.struct("score", (-F.col("cluster_id")).alias("k")))
    return shape.groupBy("scene_id").agg(best.alias("m")).select("scene_id", "m.*")


def top_clusters(points: DataFrame, floor: DataFrame, anchors: DataFrame, k: int = 6, min_pts: int = 30) -> DataFrame:
    """The ``k`` biggest clusters per scene with their shape, 0-based ``size_rank``."""
    order = Window.partitionBy("scene_id").orderBy(F.desc("n"), "cluster_id")
    shape = cluster_shape(points, floor, anchors, min_pts)
    return shape.withColumn("size_rank", F.row_number().over(order) - 1).where(F.col("size_rank") < k)


def rank_candidates(df: DataFrame, size: str = "n") -> DataFrame:
    """0-based rank by point count within the scene."""
    order = Window.partitionBy("scene_id").orderBy(F.desc(size), "cluster_id")
    return df.withColumn("cand_rank", F.row_number().over(order) - 1)


# ----------------------------------------------------------------------- floor

def hypotheses(df: DataFrame, n: int, seed: int = 0, scene: str = "scene_id", key: str = "point_id") -> DataFrame:
    """``n`` point triples per scene in hash order: planes ``scene_id, h, a, b, c, d``.

    The 3n points with the smallest hash are taken, so the draw does not depend on
    partitioning; degenerate triples are dropped.
    """
    drawn = first_n(
        df.select(scene, key, *XYZ).withColumn("_u", hash_uniform(seed, "plane", scene, key)), scene, "_u", key, F.lit(3 * n)
    )
    order = Window.partitionBy(scene).orderBy("_u", key)
    numbered = drawn.withColumn("_k", F.row_number().over(order) - 1)
    triples = numbered.groupBy(scene, F.floor(F.col("_k") / 3).alias("h")).agg(
        *[F.max(F.when(F.col("_k") % 3 == i, F.struct(*XYZ))).alias(f"p{i + 1}") for i in range(3)]
    )
    return planes_from_triples(triples, scene)


def planes_from_triples(triples: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Unit-normal planes through point triples ``p1, p2, p3`` (structs x, y, z)."""
    def diff(p, q):
        return [F.col(f"{q}.{a}") - F.col(f"{p}.{a}") for a in XYZ]

    (ux, uy, uz), (vx, vy, vz) = diff("p1", "p2"), diff("p1", "p3")
    raw = triples.select(scene, "h", "p1", (uy * vz - uz * vy).alias("_a"), (uz * vx - ux * vz).alias("_b"), (ux * vy - uy * vx).alias("_c"))
    norm = F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b") + F.col("_c") * F.col("_c"))
    unit = raw.withColumn("_n", norm).where(F.col("_n") > 1e-12).select(
        scene, "h", "p1", *[(F.col(f"_{k}") / F.col("_n")).alias(k) for k in "abc"]
    )
    d = -(F.col("a") * F.col("p1.x") + F.col("b") * F.col("p1.y") + F.col("c") * F.col("p1.z"))
    return unit.select(scene, "h", "a", "b", "c", d.alias("d"))


def _plane_distance():
    return F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))


#: Rows of a scene that are held against its planes at once, and cell width of the boxes that bound their counts.
_PACK, _BOX = 4096, 0.05


def _packed(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt into packs of about ``_PACK``: ``scene_id`` and one array per column."""
    sizes = df.groupBy("scene_id").agg(F.ceil(F.count(F.lit(1)) / _PACK).alias("_packs"))
    dealt = attach(df, sizes, "scene_id").withColumn("_pack", F.pmod(F.xxhash64(*columns), F.col("_packs")))
    return dealt.groupBy("scene_id", "_pack").agg(F.collect_list(F.struct(*columns)).alias("_rows")).select(
        "scene_id", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def _count_near(tolerance: float):
    """Weight of the boxes that may hold inliers, per pack and plane: those whose centre is no farther than the tolerance and their radius."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                scene = batch.column("scene_id").slice(i, 1)
                x, y, z, weight, radius = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "w", "r"))
                planes = batch.column("planes")[i].values
                h, a, b, c, d = (planes.field(f).to_numpy(zero_copy_only=False) for f in ("h", "a", "b", "c", "d"))
                totals = np.empty(len(h), np.int64)
                for at in range(0, len(h), 64):
                    k = slice(at, at + 64)
                    off = np.abs(a[k, None] * x + b[k, None] * y + c[k, None] * z + d[k, None])
                    totals[k] = np.where(off - radius <= tolerance, weight, 0).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([scene] * len(h)), pa.array(h), pa.array(totals)], names=["scene_id", "h", "inliers"])

    return run


def _inliers(packs: DataFrame, planes: DataFrame, tolerance: float) -> DataFrame:
    """``scene_id, h, inliers`` of every plane; the planes of a scene travel as one array per pack."""
    per_scene = planes.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("h", "a", "b", "c", "d"))).alias("planes"))
    types = {f.name: f.dataType.simpleString() for f in planes.schema.fields}
    schema = f"scene_id {types['scene_id']}, h {types['h']}, inliers long"
    counted = attach(packs, per_scene, "scene_id", "inner").mapInArrow(_count_near(tolerance), schema)
    return counted.groupBy("scene_id", "h").agg(F.sum("inliers").alias("inliers"))


def best_plane(df: DataFrame, planes: DataFrame, tolerance: float = 0.025, box: float = _BOX) -> DataFrame:
    """The hypothesis with most inliers per scene (ties: the smallest ``h``): ``h, a, b, c, d, inliers``.

    Points and planes of a scene that a task may hold are dealt to it together and all counted there; larger ones are bounded by boxes.
    """
    rows = df.select("scene_id", *XYZ)
    planes = cut(planes.select("scene_id", "h", "a", "b", "c", "d"))
    large, total = large_scenes("scene_id", rows, planes)
    (small, rest), (drawn, far) = parted(rows, large, "scene_id"), parted(planes, large, "scene_id")
    tagged = small.withColumn("_plane", F.lit(False)).unionByName(drawn.withColumn("_plane", F.lit(True)), allowMissingColumns=True)
    found = in_scenes(tagged, "scene_id", total).mapInArrow(
        whole.planes_in_scenes("scene_id", tolerance), f"{_types(planes, ['scene_id', 'h'])}, inliers long, {_types(planes, 'abcd')}")
    return found if rest is None else found.unionByName(_best_plane_by_boxes(cut(rest), cut(far), tolerance, box))


def _best_plane_by_boxes(rows: DataFrame, planes: DataFrame, tolerance: float, box: float) -> DataFrame:
    """:func:`best_plane` of large scenes.

    Branch and bound: points are counted in small boxes, and for every plane the boxes that it may touch bound its inliers from
    above.  The plane with the highest bound is counted exactly; of the others only those whose bound reaches that count are
    counted on the points.  No plane that could win is left out, and only the few that could meet all points.
    """
    points = cut(_packed(rows.withColumns({"w": F.lit(1).cast("long"), "r": F.lit(0.0)}), "x", "y", "z", "w", "r"))
    centre = [((F.floor(F.col(a) / box) + 0.5) * box).alias(a) for a in XYZ]
    boxes = rows.groupBy("scene_id", *centre).agg(F.count(F.lit(1)).alias("w")).withColumn("r", F.lit(box * 3 ** 0.5 / 2 * (1 + 1e-9) + 1e-9))
    bounds = cut(_inliers(_packed(boxes, "x", "y", "z", "w", "r"), planes, tolerance).withColumnRenamed("inliers", "_most"))
    keys = ["scene_id", "h"]
    first = bounds.groupBy("scene_id").agg(F.max_by("h", F.struct("_most", (-F.col("h")).alias("k"))).alias("h"))
    lead = _inliers(points, planes.join(first, keys, "left_semi"), tolerance).select("scene_id", F.col("inliers").alias("_least"))
    open_ = cut(attach(bounds, lead, "scene_id", "inner").where(F.col("_most") >= F.col("_least")).select(*keys))
    counts = _inliers(points, planes.join(open_, keys, "left_semi"), tolerance)
    top = counts.groupBy("scene_id").agg(
        F.max_by(F.struct("h", "inliers"), F.struct("inliers", (-F.col("h")).alias("k"))).alias("m")
    ).select("scene_id", "m.*")
    return top.join(planes, keys)


def floor_plane(
    df: DataFrame, params: P.ExtractionParams = P.ExtractionParams(), seed: int = 0, planes: DataFrame | None = None,
) -> DataFrame:
    """Robust floor plane per scene: ``a, b, c, d, floor_y, inliers, below_frac, attempts``.

    Up to three planes are fitted one after the other, each on the points the
    earlier ones left over.  Near-horizontal planes near y = 0 are candidates; the
    one with most inliers among those with almost nothing below wins, otherwise the
    one with fewest points below.  Scenes without a candidate give no row.
    """
    work = cut(df.select("scene_id", "point_id", *XYZ))
    totals = work.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_total"))
    everything, candidates = work, None
    for attempt in range(params.floor_rounds):
        drawn = planes if planes is not None else hypotheses(work, params.floor_hypotheses, seed + attempt)
        best = cut(best_plane(work, drawn, params.floor_tolerance))
        on_plane = attach(work, best.select("scene_id", "a", "b", "c", "d"), "scene_id").withColumn(
            "_in", F.coalesce(_plane_distance() <= params.floor_tolerance, F.lit(False))
        )
        level = on_plane.where("_in").groupBy("scene_id").agg(F.avg("y").alias("floor_y"))
        fitted = best.join(level, "scene_id").where(
            (F.abs("b") >= params.floor_min_normal_y) & (F.abs("floor_y") <= params.floor_max_abs_y)
        ).withColumn("attempt", F.lit(attempt + 1))
        candidates = fitted if candidates is None else candidates.unionByName(fitted)
        if attempt + 1 < params.floor_rounds:
            work = cut(on_plane.where("NOT _in").select("scene_id", "point_id", *XYZ))
            if work.isEmpty():
                break
    candidates = cut(candidates)
    limits = candidates.groupBy("scene_id").agg(F.collect_list(F.struct("attempt", "floor_y")).alias("_levels"))
    below = (
        attach(everything.select("scene_id", "y"), limits, "scene_id", "inner")
        .withColumn("_c", F.explode("_levels"))
        .groupBy("scene_id", F.col("_c.attempt").alias("attempt"))
        .agg(F.count_if(F.col("y") < F.col("_c.floor_y") - params.floor_below_margin).alias("_below"))
    )
    judged = candidates.join(below, ["scene_id", "attempt"]).join(totals, "scene_id").withColumn(
        "below_frac", F.col("_below") / F.col("_total")
    )
    strict = F.col("below_frac") <= params.floor_below_max_frac
    preference = F.struct(
        strict.alias("s"), F.when(strict, F.col("inliers").cast("double")).otherwise(-F.col("below_frac")).alias("v"),
        (-F.col("attempt")).alias("k"),
    )
    keep = F.struct("a", "b", "c", "d", "floor_y", "inliers", "below_frac", "attempt")
    return judged.groupBy("scene_id").agg(F.max_by(keep, preference).alias("m")).select("scene_id", "m.*")


def mark_floor(df: DataFrame, floor: DataFrame, params: P.ExtractionParams = P.ExtractionParams()) -> DataFrame:
    """Flag ``is_floor``: plane inliers or within the band around the floor height."""
    rows = attach(df, floor.select("scene_id", "a", "b", "c", "d", "floor_y"), "scene_id")
    band = (F.col("y") >= F.col("floor_y") - params.floor_band) & (F.col("y") <= F.col("floor_y") + params.floor_band)
    flag = F.coalesce((_plane_distance() <= params.floor_tolerance) | band, F.lit(False))
    return rows.withColumn("is_floor", flag).drop("a", "b", "c", "d", "floor_y")


def remove_floor(df: DataFrame, floor: DataFrame, params: P.ExtractionParams = P.ExtractionParams()) -> DataFrame:
    return mark_floor(df, floor, params).where("NOT is_floor").drop("is_floor")


def virtual_floor(df: DataFrame, margin: float = 0.05) -> DataFrame:
    """Horizontal plane just below the cloud, for clouds that carry no floor."""
    level = F.min("y") - margin
    return df.groupBy("scene_id").agg(level.alias("floor_y")).select(
        "scene_id", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("c"),
        (-F.col("floor_y")).alias("d"), "floor_y",
    )


# ------------------------------------------------------------------- extraction

def anchor_box(points: DataFrame) -> DataFrame:
    """XZ box, height and centre of the points of each scene."""
    return points.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.min("z").alias("z_min"), F.max("z").alias("z_max"), (F.max("y") - F.min("y")).alias("height"),
        ((F.min("x") + F.max("x")) / 2.0).alias("center_x"), ((F.min("z") + F.max("z")) / 2.0).alias("center_z"),
    )


def keep_cluster(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """Points of the chosen cluster of each scene."""
    pick = chosen.select("scene_id", F.col("cluster_id").alias("_chosen"))
    return attach(points, pick, "scene_id", "inner").where(F.col("cluster_id") == F.col("_chosen")).drop("_chosen")


def find_anchor(df: DataFrame, floor: DataFrame, params: P.ExtractionParams = P.ExtractionParams()) -> DataFrame:
    """XZ box of the dominant blob above ``floor_y + anchor_y_min``; no row when there is none."""
    high = above_floor(df, floor, params.anchor_y_min)
    clustered = cut(dbscan(high, params.anchor_eps, params.anchor_min_pts, dims=("x", "z")))
    return anchor_box(keep_cluster(clustered, largest_cluster(cluster_sizes(clustered))))


def pallet_candidates(
    df: DataFrame, floor: DataFrame, anchors: DataFrame | None = None,
    params: P.ExtractionParams = P.ExtractionParams(), clustered: DataFrame | None = None,
) -> DataFrame:
    """Clusters in the pallet slice whose footprint passes the size, aspect and density gates."""
    from .volumes import oriented_box

    if clustered is None:
        part = height_slice(df, floor, params.slice_lo, params.slice_hi, anchors, params.anchor_margin)
        clustered = cut(dbscan(part, params.pallet_eps, params.pallet_min_pts))
    boxes = oriented_box(clustered.where(F.col("cluster_id").isNotNull()), ["scene_id", "cluster_id"])
    aspect = F.col("box_long") / F.col("box_short")
    density = F.col("n") / (F.col("box_long") * F.col("box_short") + 1e-9)
    gated = boxes.where(F.col("box_short") >= params.pallet_min_short).withColumns({"aspect": aspect, "density": density}).where(
        (F.col("n") >= params.pallet_min_pts) & (F.col("box_long") >= params.pallet_min_long)
        & (F.col("box_long") <= params.pallet_max_long) & (F.col("aspect") <= params.pallet_max_aspect)
        & (F.col("density") >= params.pallet_min_density)
    )
    return rank_candidates(gated).select(
        "scene_id", "cluster_id", "n", "box_long", "box_short", "aspect", "density", "cand_rank"
    )


def cluster_in_anchor(df: DataFrame, anchors: DataFrame, params: P.ExtractionParams = P.ExtractionParams()) -> DataFrame:
    """Clustering of the points in the expanded anchor footprint."""
    inside = cut(inside_anchor(df, anchors, params.anchor_margin))
    enough = inside.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= params.cargo_min_pts)
    usable = attach(inside, enough, "scene_id", "inner").drop("_n")
    return cut(dbscan(usable, params.cargo_eps, params.cargo_min_pts))


def extract_cargo(clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rank-0 policy: points of the largest cluster and one summary row per scene."""
    sizes = cluster_sizes(clustered)
    best = largest_cluster(sizes)
    counts = clustered.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_in_anchor"))
    clusters = sizes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_clusters"))
    summary = counts.join(clusters, "scene_id").join(best, "scene_id").select(
        "scene_id", "n_in_anchor", "n_clusters", "cluster_id", "n",
        F.lit("rank0").alias("source"), F.lit("rank0").alias("policy"),
    )
    return keep_cluster(clustered, best), summary


def negative_filter(preds: DataFrame, confidence: float | None = 0.75, excluded=(2, 3)) -> DataFrame:
    """Keep every cluster except confident person or vehicle predictions.

    ``preds``: ``scene_id, cluster_id, n, y_pred, max_prob``.  Without a confidence the
    hard label decides.  A scene that would lose everything falls back to its
    largest cluster.  Adds ``keep`` and ``source``.
    """
    bad = F.coalesce(F.col("y_pred").isin(*excluded), F.lit(False))
    if confidence is not None:
        bad = bad & (F.col("max_prob") >= confidence)
    rows = preds.withColumn("_keep", ~bad)
    best = F.max_by("cluster_id", F.struct("n", (-F.col("cluster_id")).alias("k")))
    summary = rows.groupBy("scene_id").agg(F.count_if("_keep").alias("_kept"), best.alias("_rank0"))
    joined = rows.join(summary, "scene_id")
    fallback = F.col("_kept") == 0
    return joined.select(
        *preds.columns,
        F.when(fallback, F.col("cluster_id") == F.col("_rank0")).otherwise(F.col("_keep")).alias("keep"),
        F.when(fallback, "fallback_rank0").otherwise("classifier").alias("source"),
    )


def choose_cargo(
    clustered: DataFrame, floor: DataFrame, anchors: DataFrame, params: P.ExtractionParams = P.ExtractionParams(), preds: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cargo points and one summary row per scene with clusters: by predictions where there are some, else by score.

    With ``preds`` (``scene_id, cluster_id, y_pred, max_prob``) the clusters that :func:`negative_filter` keeps are cargo together, and a scene
    that would lose all falls back to its largest one; a cluster without a prediction is kept.  Without them the
    best score decides (the largest cluster where none has ``cargo_min_pts`` points).  The summary has ``n_in_anchor, n_clusters,
    cluster_id`` (-1 for several), ``n_kept, n_excluded, source, policy``.
    """
    sizes = cut(cluster_sizes(clustered))
    counts = clustered.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_in_anchor"))
    clusters = sizes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_clusters"))
    base = counts.join(clusters, "scene_id")
    if preds is None:
        scored = score_clusters(clustered, floor, anchors, params.cargo_min_pts).select("scene_id", F.col("cluster_id").alias("_best"))
        chosen = cut(largest_cluster(sizes).join(scored, "scene_id", "left").select("scene_id", F.coalesce("_best", "cluster_id").alias("cluster_id")))
        summary = base.join(chosen, "scene_id").select(
            "scene_id", "n_in_anchor", "n_clusters", "cluster_id", F.lit(1).cast("long").alias("n_kept"), F.lit(0).cast("long").alias("n_excluded"),
            F.lit("score").alias("source"), F.lit("rank0").alias("policy"))
        return keep_cluster(clustered, chosen), summary
    known = sizes.join(preds.select("scene_id", "cluster_id", "y_pred", "max_prob"), ["scene_id", "cluster_id"], "left")
    judged = cut(negative_filter(known, params.negative_confidence))
    kept = judged.where("keep").select("scene_id", "cluster_id", F.lit(True).alias("_keep"))
    per_scene = judged.groupBy("scene_id").agg(
        F.count_if("keep").alias("_kept"), F.max(F.when(F.col("keep"), F.col("cluster_id"))).alias("_one"), F.max("source").alias("source"))
    fallback = F.col("source") == "fallback_rank0"
    summary = base.join(per_scene, "scene_id").select(
        "scene_id", "n_in_anchor", "n_clusters", F.when(fallback, F.col("_one")).otherwise(F.lit(-1)).cast("long").alias("cluster_id"),
        F.when(fallback, F.lit(0)).otherwise(F.col("_kept")).cast("long").alias("n_kept"),
        F.when(fallback, F.col("n_clusters")).otherwise(F.col("n_clusters") - F.col("_kept")).cast("long").alias("n_excluded"),
        "source", F.lit("negative_filter").alias("policy"))
    return attach(clustered, kept, ["scene_id", "cluster_id"], "inner").drop("_keep"), summary


def refine_cargo(
    clustered: DataFrame, floor: DataFrame, anchors: DataFrame, params: P.ExtractionParams = P.ExtractionParams(),
) -> DataFrame:
    """Cargo points after the score override, the height filter and re-clustering.

    Scenes where no setting of the ladder finds a cluster, or with fewer than 30
    points left, keep the height-filtered points.  Adds ``attempt`` (NULL = kept).
    """
    best = score_clusters(clustered, floor, anchors, params.cargo_min_pts)
    return refine_points(keep_cluster(clustered, best), floor, params)


def refine_points(chosen: DataFrame, floor: DataFrame, params: P.ExtractionParams = P.ExtractionParams()) -> DataFrame:
    """The height filter and the re-clustering of :func:`refine_cargo` on chosen cargo points."""
    high = cut(above_floor(chosen.select("scene_id", "point_id", *XYZ), floor, params.refine_height))
    enough = high.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 30)
    todo = cut(attach(high, enough, "scene_id", "inner").drop("_n"))
    found = None
    rest = todo
    # A setting is run only for the scenes the settings before it left without a cluster.
    for i, (eps, min_pts) in enumerate(params.refine_ladder):
        got = dbscan(rest, eps, min_pts).where(F.col("cluster_id").isNotNull()).withColumn("attempt", F.lit(i))
        got = cut(got)
        found = got if found is None else found.unionByName(got)
        rest = cut(attach(rest, got.select("scene_id").distinct().withColumn("_f", F.lit(True)), "scene_id").where(F.col("_f").isNull()).drop("_f"))
        if rest.isEmpty():
            break
    tight = keep_cluster(found, largest_cluster(cluster_sizes(found))).select("scene_id", "point_id", *XYZ, "attempt")
    settled = found.select("scene_id").distinct().withColumn("_f", F.lit(True))
    kept = attach(high, settled, "scene_id").where(F.col("_f").isNull()).select(
        "scene_id", "point_id", *XYZ, F.lit(None).cast("int").alias("attempt")
    )
    return tight.unionByName(kept)


# -------------------------------------------------------------------- grid filters

def halo_filter(cells: DataFrame, params: P.HeightFieldParams = P.HeightFieldParams(), by: str = "scene_id") -> DataFrame:
    """Drop components without a tall cell, in scenes that have any tall cell.

    Works on the cells at or above ``min_height``.  ``halo_used`` is true only where a
    component was dropped.
    """
    valid = cells.where(F.col("h") >= params.min_height)
    parts = cut(grid_components(valid, by))
    per_part = parts.groupBy(by, "component").agg(F.bool_or(F.col("h") >= params.tall).alias("_tall"))
    scene = per_part.groupBy(by).agg(F.bool_or("_tall").alias("_any"), F.bool_and("_tall").alias("_all"))
    judged = per_part.join(scene, by)
    rows = attach(parts, judged, [by, "component"]).where(F.col("_tall") | ~F.col("_any"))
    return rows.select(by, "i", "j", "h", "component", (F.col("_any") & ~F.col("_all")).alias("halo_used"))


def tall_column_person(
    df: DataFrame, cell_size: float = 0.15, floor_y: float = 0.05, min_top: float = 1.0, min_range: float = 0.8,
    max_footprint: float = 0.5, edge: int = 2,
) -> DataFrame:
    """Points of narrow, tall columns at the rim of the grid (standing persons)."""
    high = cut(df.where(F.col("y") >= floor_y))
    stats = cut(column_stats(high, cell_size))
    size = stats.groupBy("scene_id").agg((F.max("i") + 1).alias("_ni"), (F.max("j") + 1).alias("_nj"))
    tall = cut(stats.where((F.col("y_max") >= min_top) & (F.col("y_range") >= min_range)))
    parts = cut(grid_components(tall))
    shape = parts.groupBy("scene_id", "component").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("i").alias("_i0"), F.max("i").alias("_i1"),
        F.min("j").alias("_j0"), F.max("j").alias("_j1"),
    ).join(size, "scene_id")
    rim = (
        (F.col("_i0") <= edge - 1) | (F.col("_i1") >= F.col("_ni") - edge)
        | (F.col("_j0") <= edge - 1) | (F.col("_j1") >= F.col("_nj") - edge)
    )
    person = shape.where((F.col("n_cells") * cell_size * cell_size < max_footprint) & rim).select("scene_id", "component")
    cells = parts.join(person, ["scene_id", "component"], "left_semi").select("scene_id", "i", "j", "component")
    rows = with_stats(high, "scene_id", F.min("x").alias("_x0"), F.min("z").alias("_z0")).withColumns({
        "i": F.floor((F.col("x") - F.col("_x0")) / cell_size).cast("long"),
        "j": F.floor((F.col("z") - F.col("_z0")) / cell_size).cast("long"),
    })
    return attach(rows, cells, ["scene_id", "i", "j"], "inner").drop("_x0", "_z0", "i", "j")


def compact_cluster_person(
    df: DataFrame, lo: float = 0.8, hi: float = 2.0, radius: float = 0.3, seed_pts: int = 5, min_pts: int = 30,
    max_footprint: float = 1.0, up: str = "y", plane=("x", "z"),
) -> DataFrame:
    """Points of the smallest compact group in a height band.

    Groups are floods over the horizontal radius graph that contain a point with at
    least ``seed_pts`` neighbours (itself included); the smallest horizontal box
    wins if it is below ``max_footprint``.
    """
    band = cut(df.where(F.col(up).between(lo, hi)))
    # With two points as density limit every linked point is a core point, so the
    # clusters are exactly the connected parts of the radius graph.
    parts = cut(dbscan(band, radius, 2, dims=plane).where(F.col("cluster_id").isNotNull()))
    dense = _weighted_counts(
        parts.select("scene_id", *plane).distinct(),
        band.groupBy("scene_id", *plane).agg(F.count(F.lit(1)).alias("_w")), radius, list(plane), "scene_id",
    ).where(F.col("_found") >= seed_pts)
    seeded = parts.join(dense, ["scene_id", *plane], "left_semi").select("scene_id", "cluster_id").distinct()
    boxes = parts.groupBy("scene_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max(plane[0]) - F.min(plane[0])) * (F.max(plane[1]) - F.min(plane[1]))).alias("footprint"),
    ).where(F.col("n") >= min_pts).join(seeded, ["scene_id", "cluster_id"], "left_semi")
    best = boxes.groupBy("scene_id").agg(F.min(F.struct("footprint", "cluster_id")).alias("m")).select(
        "scene_id", "m.cluster_id", "m.footprint"
    ).where(F.col("footprint") < max_footprint)
    return keep_cluster(parts, best)


def cluster_labels(
    points: DataFrame, min_points: int = 30, purity: float = 0.6, label: str = "cluster_class",
    fallback: int = P.CLUSTER_CLASS_DEFAULT,
) -> DataFrame:
    """Majority class and purity per cluster; ties go to the smallest class.

    Impure clusters get the fallback class; clusters below ``min_points`` are dropped.
    """
    counts = points.where(F.col("cluster_id").isNotNull()).groupBy("scene_id", "cluster_id", label).agg(
        F.count(F.lit(1)).alias("c")
    )
    best = counts.groupBy("scene_id", "cluster_id").agg(
        F.sum("c").alias("n"), F.max("c").alias("_top"),
        F.max_by(label, F.struct("c", (-F.col(label)).alias("k"))).alias("majority"),
    ).where(F.col("n") >= min_points).withColumn("purity", F.col("_top") / F.col("n"))
    return best.select(
        "scene_id", "cluster_id", "n", "majority", "purity",
        F.when(F.col("purity") >= purity, F.col("majority")).otherwise(F.lit(fallback)).alias("y_cluster"),
    )
