"""Sampling, weighting, folds and sensor degradation as column expressions.

Random numbers are hashes of (seed, salt, scene, point), so results do not change
with the partitioning.  Every operator also accepts a given uniform column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import at_least, col, hash_uniform, standard_normal
from ..functions.groups import attach, first_n, running_index, with_stats
from ..functions.lineage import cut
from .grids import voxel_first
from .neighbors import within_distance

XYZ = ("x", "y", "z")


def _uniform(uniform, seed: int, salt: str) -> Column:
    return hash_uniform(seed, salt, "scene_id", "point_id") if uniform is None else col(uniform)


# ------------------------------------------------------------------- degradation

def nearest_camera(df: DataFrame, cameras=P.SCENE_CAMERAS) -> DataFrame:
    """Add ``cam`` (index), ``depth`` and the unit ray ``rx, ry, rz`` of the nearest camera."""
    options = []
    for i, camera in enumerate(cameras):
        px, py, pz = camera["pos"]
        dx, dy, dz = F.col("x") - px, F.col("y") - py, F.col("z") - pz
        options.append(F.struct(
            F.sqrt(dx * dx + dy * dy + dz * dz).alias("d"), F.lit(i).alias("i"),
            dx.alias("dx"), dy.alias("dy"), dz.alias("dz"),
        ))
    near = df.withColumn("_n", F.array_min(F.array(*options)))
    length = at_least(F.col("_n.d"), 1e-9)
    return near.withColumns({
        "cam": F.col("_n.i"), "depth": F.col("_n.d"),
        **{f"r{a}": F.col(f"_n.d{a}") / length for a in XYZ},
    }).drop("_n")


def keep_probability(depth: Column, ref: float) -> Column:
    share = F.lit(ref) / F.greatest(depth, F.lit(ref))
    return F.least(F.greatest(share * share, F.lit(0.15)), F.lit(1.0))


def thin_by_distance(df: DataFrame, cameras=P.SCENE_CAMERAS, ref: float = 1.5, uniform=None, seed: int = 42) -> DataFrame:
    """Keep a point with probability ``(ref / depth)^2`` clipped to [0.15, 1]."""
    rows = nearest_camera(df, cameras)
    kept = rows.where(_uniform(uniform, seed, "thin") < keep_probability(F.col("depth"), ref))
    return kept.select(*df.columns)


def axial_noise(df: DataFrame, params: P.DegradeParams = P.DegradeParams()) -> DataFrame:
    """Move points along the camera ray by heavy-tailed noise that grows with depth squared.

    A normal core with probability ``gaussian_share``, otherwise Student t with four
    degrees of freedom scaled to unit variance (t4 = N * sqrt(4 / chi2), where the
    chi-square of four degrees is -2 ln(u1 u2)).
    """
    rows = nearest_camera(df, params.cameras)
    u = lambda salt: hash_uniform(params.seed, salt, "scene_id", "point_id")
    scale = F.pow(F.col("depth") / params.depth_ref, F.lit(2.0))
    normal = standard_normal(u("n1"), u("n2"))
    chi2 = -2.0 * F.log(F.greatest(u("c1") * u("c2"), F.lit(1e-300)))
    t4 = normal * F.sqrt(4.0 / F.greatest(chi2, F.lit(1e-12))) / F.sqrt(F.lit(2.0))
    core = u("mix") < params.gaussian_share
    shift = F.when(core, normal * params.core_sigma * scale).otherwise(t4 * params.tail_sigma * scale)
    rows = rows.withColumn("noise", shift)
    return rows.withColumns({a: F.col(a) + F.col("noise") * F.col(f"r{a}") for a in XYZ}).select(*df.columns, "noise")


def dropout(df: DataFrame, ratio: float, uniform=None, seed: int = 42) -> DataFrame:
    return df.where(_uniform(uniform, seed, "drop") > ratio)


def inject_outliers(df: DataFrame, ratio: float, sigma: float = 0.055, seed: int = 42, id_width: int = 4096) -> DataFrame:
    """Append ``max(1, floor(n * ratio))`` points per scene near random members, label 255.

    Members are drawn with replacement; new ids follow the scene's largest id.
    """
    indexed = running_index(df.select("scene_id", "point_id", *XYZ), "scene_id", "point_id", id_width, "_at")
    sizes = df.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"), F.max("point_id").alias("_max"))
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(ratio)))
    # Draws are made in blocks, so that a huge scene is not expanded by one task.
    block = 4096
    blocks = sizes.withColumn("_want", wanted).withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_want") - 1) / block)))
    ).repartition("scene_id", "_b")
    draws = blocks.withColumn(
        "_k", F.explode(F.sequence(F.col("_b") * block, F.least((F.col("_b") + 1) * block, F.col("_want")) - 1))
    )
    u = lambda salt: hash_uniform(seed, salt, "scene_id", "_k")
    draws = draws.withColumn("_at", F.floor(u("anchor") * F.col("_n")))
    placed = draws.join(indexed.select("scene_id", "_at", *XYZ), ["scene_id", "_at"])
    new = placed.select(
        "scene_id", (F.col("_max") + 1 + F.col("_k")).alias("point_id"), F.lit(255).alias("label"),
        *[(F.col(a) + standard_normal(u(a + "1"), u(a + "2")) * sigma).alias(a) for a in XYZ],
    )
    return df.unionByName(new, allowMissingColumns=True)


def degrade(df: DataFrame, params: P.DegradeParams = P.DegradeParams()) -> DataFrame:
    """Voxel thinning, axial noise, dropout and local outliers, in this order."""
    thin = voxel_first(df.select("scene_id", "point_id", "label", *XYZ), params.voxel_size)
    noisy = axial_noise(thin, params).drop("noise")
    return inject_outliers(dropout(noisy, params.dropout, seed=params.seed), params.outlier_ratio, params.outlier_sigma, params.seed)


# ---------------------------------------------------------------------- sampling

def stratified_sample(df: DataFrame, fraction: float, uniform=None, seed: int = 42, by=("scene_id", "label")) -> DataFrame:
    """``max(1, floor(n * fraction))`` rows per scene and class."""
    rows = df.withColumn("_u", _uniform(uniform, seed, "strata"))
    quota = F.greatest(F.lit(1), F.floor(F.col("_group") * F.lit(fraction)))
    return first_n(rows, list(by), "_u", "point_id", quota).drop("_u")


def context_sample(
    df: DataFrame, contextual: float = 1.0, bulk: float = 0.1, radius: float = 0.8, label: int = 0,
    cross_scene: bool = False, uniform=None, seed: int = 42,
) -> DataFrame:
    """Thin one class by context: share ``contextual`` near other classes, ``bulk`` elsewhere.

    Counts are taken over the whole input.  Without any other class every row of
    the class counts as bulk.  ``cross_scene`` measures distances over all scenes at once.
    """
    rows = cut(df.withColumn("_u", _uniform(uniform, seed, "context")))
    target, others = rows.where(F.col("label") == label), rows.where(F.col("label") != label)
    scene = None if cross_scene else "scene_id"
    parts = [others]
    for share, keep in ((contextual, True), (bulk, False)):
        part = within_distance(target, others, radius, strict=True, scene=scene, keep=keep)
        if share < 1.0:
            quota = F.greatest(F.lit(1), F.floor(F.col("_group") * F.lit(share)))
            part = first_n(cut(part).withColumn("_all", F.lit(0)), "_all", "_u", ["scene_id", "point_id"], quota).drop("_all")
        parts.append(part)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("_u")


def cap_per_class(
    df: DataFrame, n: int = 10_000, min_class: int = 100, min_total: int = 1000, classes=(1, 2),
    uniform=None, seed: int = 42,
) -> DataFrame:
    """At most ``n`` rows per scene and class, from scenes that have enough of each class."""
    rows = df.withColumn("_u", _uniform(uniform, seed, "cap"))
    stats = rows.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("label") == c).alias(f"_n{c}") for c in classes]
    )
    fit = F.col("_n") >= min_total
    for c in classes:
        fit = fit & (F.col(f"_n{c}") >= min_class)
    usable = attach(rows.where(F.col("label").isin(*classes)), stats.where(fit).select("scene_id"), "scene_id", "inner")
    return first_n(usable, ["scene_id", "label"], "_u", "point_id", F.lit(n)).drop("_u")


def sample_n(df: DataFrame, n: int, uniform=None, seed: int = 0) -> DataFrame:
    """A fixed number of rows per scene."""
    rows = df.withColumn("_u", _uniform(uniform, seed, "pick"))
    return first_n(rows, "scene_id", "_u", "point_id", F.lit(n)).drop("_u")


def class_weights(df: DataFrame, multipliers: dict[str, float] | None = None, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (k * n_c)`` per row, times a factor per named class."""
    factors = {}
    for name, factor in (multipliers or {}).items():
        if name not in P.LABELS:
            raise ValueError(f"unknown class name: {name!r}")
        factors[P.LABELS[name]] = float(factor)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.select(F.lit(0).alias("_j"), "_nc").groupBy("_j").agg(
        F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k")
    )
    weights = counts.withColumn("_j", F.lit(0)).join(total, "_j").withColumn(
        "weight", F.col("_n") / (F.col("_k") * F.col("_nc"))
    )
    for value, factor in factors.items():
        weights = weights.withColumn("weight", F.when(F.col(label) == value, F.col("weight") * factor).otherwise(F.col("weight")))
    return attach(df, weights.select(label, "weight"), label)


# -------------------------------------------------------------------------- folds

def assign_folds(df: DataFrame, k: int = 5, label: str = "label", scene: str = "scene_id") -> DataFrame:
    """Scene -> fold, balanced in points and classes; a scene lies in exactly one fold.

    Scenes sorted by how uneven their class counts are (largest spread first) are
    dealt out in serpentine order (0..k-1, k-1..0, ...), which needs only their position.
    """
    counts = df.groupBy(scene, label).agg(F.count(F.lit(1)).alias("n"))
    per_scene = counts.groupBy(scene).agg(F.stddev_pop("n").alias("spread"), F.sum("n").alias("n"))
    keyed = per_scene.withColumn("_key", (-F.round(F.coalesce("spread", F.lit(0.0)) * 1000)).cast("long"))
    placed = _positions(keyed, scene)
    turn = F.pmod(F.col("_pos"), F.lit(2 * k))
    fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn)
    return placed.select(scene, fold.cast("int").alias("fold"), "n")


def _positions(keyed: DataFrame, scene: str) -> DataFrame:
    """0-based position in order (``_key``, scene): rank inside key ranges plus the counts before."""
    ranged = keyed.withColumn("_range", F.floor(F.col("_key") / 1000))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size")).withColumn(
        "_start", F.coalesce(F.sum("_size").over(before), F.lit(0))
    )
    inside = Window.partitionBy("_range").orderBy("_key", scene)
    return ranged.withColumn("_i", F.row_number().over(inside) - 1).join(starts, "_range").withColumn(
        "_pos", F.col("_start") + F.col("_i")
    )


def leave_one_out(df: DataFrame, group: str = "scene_id") -> DataFrame:
    """One fold per group: ``group, fold`` where the fold's test set is that group alone.

    Rows of a fold's training set are all rows with another fold number, so nothing
    is replicated.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    keyed = counts.withColumn("_key", F.col(group).cast("long"))
    return _positions(keyed, group).select(group, F.col("_pos").cast("int").alias("fold"), "n")
