"""Per-point and per-cluster geometric features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    at_least, cell, covariance, normal_y, safe_denominator, with_eigenvalues,
)
from ..functions.groups import attach
from ..functions.lineage import cut
from .grids import height_above_local_floor
from .neighbors import knn_moments, neighbourhoods
from .transforms import y_norm
from .volumes import oriented_box

XYZ = ("x", "y", "z")

POINT_FEATURES = [
    "y", "y_norm", "local_density", "nbr_y_mean", "nbr_y_std", "height_range_local", "normal_y", "curvature",
    "planarity", "linearity", "sphericity", "verticality", "normal_y_std", "lam_ratio_12", "planarity_large",
    "height_above_local_floor", "linearity_large", "sphericity_large", "verticality_large",
]
RAW_FEATURES = [
    "curvature", "planarity", "linearity", "sphericity", "lam_ratio_12", "planarity_large", "linearity_large",
    "sphericity_large", "normal_y_std", "height",
]
CLUSTER_FEATURES = [
    "n_points", "log10_n_points", "obb_long", "obb_short", "obb_height", "aspect_long_short", "aspect_height_long",
    "base_area", "volume_obb", "density_xz", "density_volume", "top_slab_frac", "bottom_slab_frac",
    "top_slab_planarity", "vertical_profile_entropy", "fill_ratio", "pca_linearity", "pca_planarity", "pca_sphericity",
]


def local_pca(df: DataFrame, k: int = 20, ddof: int = 0, base_cell: float = 0.05) -> DataFrame:
    """Eigenvalues of the covariance of each point's ``k`` nearest points and |n_y| of their normal."""
    m = with_eigenvalues(knn_moments(df, k, k, base_cell=base_cell).withColumns(covariance("s_", ddof)), "s_")
    return m.select(
        "scene_id", "point_id", F.col("s_n").alias("k"), *[F.col(f"s_{c}").alias(c) for c in ("l1", "l2", "l3")],
        normal_y(*[F.col(f"s_{c}") for c in ("xx", "zz", "xz", "l1", "l2", "l3")]).alias("normal_y"),
    )


def _two_scale_pca(near: DataFrame, ddof: int) -> DataFrame:
    """PCA of both neighbourhoods of :func:`~pointloom.operators.neighbors.knn_moments`."""
    m = near.withColumns({**covariance("s_", ddof), **covariance("b_", ddof)})
    for p in ("s_", "b_"):
        m = with_eigenvalues(m, p)
        m = m.withColumn(f"{p}ny", normal_y(*[F.col(p + c) for c in ("xx", "zz", "xz", "l1", "l2", "l3")]))
    return m


def point_features(
    df: DataFrame, k: int = 20, k_large: int = 50, radius: float = 0.15, base_cell: float = 0.05, keep=("label",),
) -> DataFrame:
    """The 19 per-point features (``POINT_FEATURES``) plus ids and the ``keep`` columns.

    What needs other groupings (heights above the local floor and within the scene) is joined to the narrow rows first.  One
    k_large search then serves both scales, the count within the radius and the spread of the normals, and leaves one row a point.
    """
    keep = [c for c in keep if c in df.columns]
    base = y_norm(height_above_local_floor(df.select("scene_id", "point_id", *XYZ, *keep)))
    own = [*keep, "y_norm", "height_above_local_floor"]

    def describe(near: DataFrame) -> DataFrame:
        return _two_scale_pca(near, 0).select(
            "scene_id", "point_id", "y", *own, "ids", "s_n", "s_sy", "s_syy", "hi", "lo", "within",
            *[p + c for p in ("s_", "b_") for c in ("l1", "l2", "l3", "ny")])

    pca = neighbourhoods(base, k, k_large, describe, "s_ny", radius=radius, keep=own, base_cell=base_cell)
    n = F.col("s_n").cast("double")
    mean_dy = F.col("s_sy") / n
    s1, s2 = safe_denominator(F.col("s_l1")), safe_denominator(F.col("s_l2"))
    b1 = safe_denominator(F.col("b_l1"))
    total = safe_denominator(F.col("s_l1") + F.col("s_l2") + F.col("s_l3"))
    return pca.select(
        "*", F.col("within").alias("local_density"), (F.col("y") + mean_dy).alias("nbr_y_mean"),
        F.sqrt(F.greatest(F.col("s_syy") / n - mean_dy * mean_dy, F.lit(0.0))).alias("nbr_y_std"),
        (F.col("hi") - F.col("lo")).alias("height_range_local"), F.col("s_ny").alias("normal_y"),
        (F.col("s_l3") / total).alias("curvature"), ((F.col("s_l2") - F.col("s_l3")) / s1).alias("planarity"),
        ((F.col("s_l1") - F.col("s_l2")) / s1).alias("linearity"), (F.col("s_l3") / s1).alias("sphericity"),
        F.col("s_ny").alias("verticality"), (F.col("s_l1") / s2).alias("lam_ratio_12"), F.col("spread").alias("normal_y_std"),
        ((F.col("b_l2") - F.col("b_l3")) / b1).alias("planarity_large"),
        ((F.col("b_l1") - F.col("b_l2")) / b1).alias("linearity_large"), (F.col("b_l3") / b1).alias("sphericity_large"),
        F.col("b_ny").alias("verticality_large"),
    ).select("scene_id", "point_id", *keep, *POINT_FEATURES)


def raw_point_features(df: DataFrame, k: int = 20, k_large: int = 50, eps: float = 1e-10, base_cell: float = 0.05) -> DataFrame:
    """Ten features of unlabelled clouds: the point itself is left out of its neighbourhood
    and the covariance is the sample covariance.  ``y`` is the height."""

    def describe(near: DataFrame) -> DataFrame:
        return _two_scale_pca(near, 1).select(
            "scene_id", "point_id", F.col("y").alias("height"), "ids", "s_ny", *[p + c for p in ("s_", "b_") for c in ("l1", "l2", "l3")])

    out = neighbourhoods(df, k, k_large, describe, "s_ny", include_self=False, base_cell=base_cell)
    s1, s2, s3, b1, b2, b3 = [F.col(c) for c in ("s_l1", "s_l2", "s_l3", "b_l1", "b_l2", "b_l3")]
    return out.select(
        "scene_id", "point_id",
        (s3 / (s1 + s2 + s3 + eps)).alias("curvature"), ((s2 - s3) / (s1 + eps)).alias("planarity"),
        ((s1 - s2) / (s1 + eps)).alias("linearity"), (s3 / (s1 + eps)).alias("sphericity"),
        (s1 / (s2 + eps)).alias("lam_ratio_12"), ((b2 - b3) / (b1 + eps)).alias("planarity_large"),
        ((b1 - b2) / (b1 + eps)).alias("linearity_large"), (b3 / (b1 + eps)).alias("sphericity_large"),
        F.col("spread").alias("normal_y_std"), "height",
    )


def cluster_features(points: DataFrame, slab: float = 0.15, bins: int = 10, fill_cell: float = 0.05) -> DataFrame:
    """The 19 features per (scene, cluster); clusters below four points give zeros."""
    by = ["scene_id", "cluster_id"]
    pts = cut(points.where(F.col("cluster_id").isNotNull()).select(*by, *XYZ))
    box = cut(oriented_box(pts, by, ddof=1))
    limits = pts.groupBy(*by).agg(
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.min("z").alias("_z0")
    )
    rows = attach(pts, limits, by)
    span = F.col("_y1") - F.col("_y0")
    flat = span <= 1e-6
    bin_of = F.least(F.floor((F.col("y") - F.col("_y0")) * bins / F.when(flat, F.lit(1.0)).otherwise(span)), F.lit(bins - 1))
    top = F.col("y") >= F.col("_y1") - span * slab
    bottom = F.col("y") <= F.col("_y0") + span * slab
    rel = F.col("y") - F.col("_y1")
    slabs = rows.groupBy(*by).agg(
        F.first(span).alias("_span"), F.count_if(top).alias("_top"), F.count_if(bottom).alias("_bottom"),
        F.stddev_pop(F.when(top, rel)).alias("_top_std"),
    )
    profile = rows.groupBy(*by, bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    totals = profile.groupBy(*by).agg(
        (F.log(F.sum("_c")) - F.sum(F.col("_c") * F.log(F.col("_c"))) / F.sum("_c")).alias("_entropy")
    )
    cells = rows.select(
        *by, cell(F.col("x") - F.col("_x0"), fill_cell).alias("_i"), cell(F.col("z") - F.col("_z0"), fill_cell).alias("_j")
    ).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_cells"))
    all_ = box.join(slabs, by).join(totals, by).join(cells, by)
    n, long_, short = F.col("n").cast("double"), F.col("box_long"), F.col("box_short")
    height = F.col("box_height")
    is_flat = F.col("_span") <= 1e-6
    base, volume = long_ * short, long_ * short * height
    e1 = at_least(F.col("l1"), 1e-12)
    values = {
        "n_points": n, "log10_n_points": F.log10(n), "obb_long": long_, "obb_short": short, "obb_height": height,
        "aspect_long_short": long_ / at_least(short, 1e-6), "aspect_height_long": height / at_least(long_, 1e-6),
        "base_area": base, "volume_obb": volume, "density_xz": n / at_least(base, 1e-6), "density_volume": n / at_least(volume, 1e-6),
        "top_slab_frac": F.when(is_flat, 1.0).otherwise(F.col("_top") / n),
        "bottom_slab_frac": F.when(is_flat, 1.0).otherwise(F.col("_bottom") / n),
        "top_slab_planarity": F.when(is_flat | (F.col("_top") < 3), 0.0).otherwise(F.col("_top_std")),
        "vertical_profile_entropy": F.when(is_flat, 0.0).otherwise(F.col("_entropy")),
        "fill_ratio": F.col("_cells") / at_least((long_ / fill_cell) * (short / fill_cell), 1.0),
        "pca_linearity": (F.col("l1") - F.col("l2")) / e1, "pca_planarity": (F.col("l2") - F.col("l3")) / e1,
        "pca_sphericity": F.col("l3") / e1,
    }
    return all_.select(*by, *[F.when(F.col("n") < 4, 0.0).otherwise(values[f]).alias(f) for f in CLUSTER_FEATURES])
