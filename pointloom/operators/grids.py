"""Voxels, histograms, grid statistics, floor detection and height fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import cell, col
from ..functions.groups import attach, exact_percentiles, with_stats
from ..functions.lineage import cut

XYZ = ("x", "y", "z")


def _voxel(size: float):
    return [cell(a, size).alias(f"v{a}") for a in XYZ]


def voxel_first(df: DataFrame, size: float) -> DataFrame:
    """Keep the row with the smallest ``point_id`` per voxel (labels stay exact)."""
    rest = [c for c in df.columns if c != "scene_id"]
    return (
        df.groupBy("scene_id", *_voxel(size)).agg(F.min_by(F.struct(*rest), "point_id").alias("p"))
        .select("scene_id", "p.*")
    )


def voxel_centroid(df: DataFrame, size: float = 0.035) -> DataFrame:
    """Mean position and count per voxel; ``point_id`` is the smallest member."""
    return df.groupBy("scene_id", *_voxel(size)).agg(
        F.min("point_id").alias("point_id"), *[F.avg(a).alias(a) for a in XYZ], F.count(F.lit(1)).alias("n")
    )


def label_distribution(df: DataFrame, by=(), label: str = "label") -> DataFrame:
    """Counts and shares per class, within ``by`` or overall, largest share first."""
    by = [by] if isinstance(by, str) else list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n") / total).orderBy(*by, F.desc("share"), label)


def label_counts_map(df: DataFrame, label: str = "label") -> DataFrame:
    """MAP of class -> count per scene."""
    counts = df.groupBy("scene_id", label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("scene_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label).cast("string"), "n")))).alias("label_counts")
    )


def label_by_height(df: DataFrame, cut: float = 0.1) -> DataFrame:
    """Per class: counts below, at or above ``cut`` and overall, with shares."""
    low = F.col("y") < cut
    counts = df.groupBy("label").agg(
        F.count_if(low).alias("n_low"), F.count_if(~low).alias("n_high"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy(F.lit(0))
    for c in ("n_low", "n_high", "n"):
        counts = counts.withColumn("share" + c[1:], F.try_divide(F.col(c), F.sum(c).over(w)))
    return counts


def _closed_bin(value, lo, hi, bins: int):
    """Equal-width bin in [lo, hi]; the upper edge belongs to the last bin."""
    width = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    start = F.when(hi > lo, lo).otherwise(lo - 0.5)
    return F.least(F.floor((value - start) * bins / width), F.lit(bins - 1)).cast("long")


def detect_floor_axis(df: DataFrame, bins: int = 100) -> DataFrame:
    """Axis (0, 1, 2) whose histogram over its own range has the highest peak."""
    limits = df.groupBy("scene_id").agg(
        *[F.min(a).alias(f"_lo{a}") for a in XYZ], *[F.max(a).alias(f"_hi{a}") for a in XYZ]
    )
    binned = attach(df.select("scene_id", *XYZ), limits, "scene_id").select(
        "scene_id",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("axis"), _closed_bin(F.col(a), F.col(f"_lo{a}"), F.col(f"_hi{a}"), bins).alias("bin"))
            for i, a in enumerate(XYZ)
        ])).alias("b"),
    )
    peaks = binned.groupBy("scene_id", "b.axis", "b.bin").agg(F.count(F.lit(1)).alias("n"))
    best = peaks.groupBy("scene_id", "axis").agg(F.max("n").alias("peak"))
    return best.groupBy("scene_id").agg(
        F.max_by("axis", F.struct("peak", (-F.col("axis")).alias("first"))).alias("floor_axis"),
        F.max("peak").alias("peak"),
    )


def detect_floor_y(df: DataFrame, bins: int = 200) -> DataFrame:
    """Left edge of the fullest of ``bins`` bins over the heights below the 30th percentile."""
    heights = cut(df.select("scene_id", "y"))
    low = exact_percentiles(heights, "scene_id", "y", {"_p30": 0.3})
    below = attach(heights, low, "scene_id").where(F.col("y") < F.col("_p30"))
    rows = with_stats(below, "scene_id", F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    counts = rows.groupBy(
        "scene_id", "_lo", "_hi", _closed_bin(F.col("y"), F.col("_lo"), F.col("_hi"), bins).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("scene_id").agg(
        F.max_by(F.struct("bin", "_lo", "_hi"), F.struct("n", (-F.col("bin")).alias("first"))).alias("m")
    )
    start = F.when(F.col("m._hi") > F.col("m._lo"), F.col("m._lo")).otherwise(F.col("m._lo") - 0.5)
    width = F.when(F.col("m._hi") > F.col("m._lo"), F.col("m._hi") - F.col("m._lo")).otherwise(F.lit(1.0))
    return top.select("scene_id", (start + F.col("m.bin") * width / bins).alias("floor_y"))


def height_above_local_floor(df: DataFrame, cell_size: float = 0.5) -> DataFrame:
    """Height above the median y of the point's XZ cell."""
    rows = df.withColumns({"_cx": cell("x", cell_size), "_cz": cell("z", cell_size)})
    medians = exact_percentiles(rows, ["scene_id", "_cx", "_cz"], "y", {"_median": 0.5})
    joined = attach(rows, medians, ["scene_id", "_cx", "_cz"])
    return joined.withColumn("height_above_local_floor", F.col("y") - F.col("_median")).drop("_cx", "_cz", "_median")


def roughness(
    df: DataFrame, lo: float | None = None, hi: float | None = None, band: float | None = 0.06,
    cell_size: float = 0.05, min_cell: int = 8, min_scene: int = 50, height: str = "height",
) -> DataFrame:
    """Population std of height per XZ cell, for ``|h| < band`` or ``lo <= h < hi``.

    Scenes with fewer than ``min_scene`` points in the band give no rows.
    """
    h = F.col(height)
    inside = (h >= lo) & (h < hi) if lo is not None else F.abs(h) < band
    kept = df.where(inside)
    cells = kept.groupBy("scene_id", cell("x", cell_size).alias("cx"), cell("z", cell_size).alias("cz")).agg(
        F.stddev_pop(height).alias("sigma"), F.count(F.lit(1)).alias("n")
    )
    totals = cells.groupBy("scene_id").agg(F.sum("n").alias("_total"))
    return attach(cells, totals, "scene_id").where((F.col("n") >= min_cell) & (F.col("_total") >= min_scene)).drop("_total")


def density_map(df: DataFrame, bins: int = 60, half: float = 3.5) -> DataFrame:
    """Normalised XZ density on ``bins x bins`` cells over ``[-half, half]``; outer edge closed."""
    inside = df.where(F.col("x").between(-half, half) & F.col("z").between(-half, half))
    lo, hi = F.lit(-half), F.lit(half)
    counts = inside.groupBy(
        _closed_bin(F.col("x"), lo, hi, bins).alias("i"), _closed_bin(F.col("z"), lo, hi, bins).alias("j")
    ).agg(F.count(F.lit(1)).alias("n"))
    area = (2.0 * half / bins) ** 2
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("n") / (total * F.lit(area)))


def histogram(df: DataFrame, value, lo: int, width: int, bins: int, by=()) -> DataFrame:
    """Counts on equal integer bins ``[lo, lo + bins * width]``; the last bin is closed."""
    by = [by] if isinstance(by, str) else list(by)
    v = col(value)
    inside = df.where((v >= lo) & (v <= lo + bins * width))
    binned = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("long")
    return inside.groupBy(*by, binned.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def extents(df: DataFrame) -> DataFrame:
    """Span per axis and scene."""
    return df.groupBy("scene_id").agg(*[(F.max(a) - F.min(a)).alias(f"span_{a}") for a in XYZ])


def footprint(df: DataFrame) -> DataFrame:
    """Global XZ extent over all scenes."""
    return df.agg(*[f(a).alias(f"{a}_{n}") for a in ("x", "z") for n, f in (("min", F.min), ("max", F.max))])


def scene_count_stats(df: DataFrame) -> DataFrame:
    """Mean and population std of points per scene."""
    counts = df.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_scenes"), F.avg("n").alias("mean_points"), F.stddev_pop("n").alias("std_points")
    )


def count_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean points per scene of ``b`` over that of ``a``."""
    sa = scene_count_stats(a).select(F.lit(0).alias("_k"), F.col("mean_points").alias("mean_a"))
    sb = scene_count_stats(b).select(F.lit(0).alias("_k"), F.col("mean_points").alias("mean_b"))
    return sa.join(sb, "_k").select("mean_a", "mean_b", (F.col("mean_b") / F.col("mean_a")).alias("ratio"))


def column_stats(df: DataFrame, cell_size: float = 0.15) -> DataFrame:
    """Max, min, range and count of y per XZ cell, counted from the scene's minimum corner."""
    rows = with_stats(df, "scene_id", F.min("x").alias("_x0"), F.min("z").alias("_z0"))
    i = F.floor((F.col("x") - F.col("_x0")) / cell_size).cast("long")
    j = F.floor((F.col("z") - F.col("_z0")) / cell_size).cast("long")
    return rows.groupBy("scene_id", i.alias("i"), j.alias("j")).agg(
        F.max("y").alias("y_max"), F.min("y").alias("y_min"),
        (F.max("y") - F.min("y")).alias("y_range"), F.count(F.lit(1)).alias("n"),
    )


# ------------------------------------------------------------------ height field

def height_field(
    df: DataFrame, floor: DataFrame | None = None, params: P.HeightFieldParams = P.HeightFieldParams(), by="scene_id",
) -> DataFrame:
    """Net top height ``h`` per XZ cell ``i, j``; only occupied cells have rows.

    The grid starts at the cluster's minimum and its last row and column are
    closed; ``h`` is max y above ``floor_y + offset`` (``floor_y`` 0 without ``floor``).
    """
    by = [by] if isinstance(by, str) else list(by)
    corners = df.groupBy(*by).agg(*[g(a).alias(f"_{n}{a}") for a in ("x", "z") for n, g in (("lo", F.min), ("hi", F.max))])
    rows = attach(df.select(*by, *XYZ), corners, by)

    def index(a):
        c = F.lit(params.cell)
        last = F.greatest(F.ceil((F.col(f"_hi{a}") - F.col(f"_lo{a}")) / c), F.lit(1)) - 1
        return F.least(F.floor((F.col(a) - F.col(f"_lo{a}")) / c), last).cast("long")

    cells = rows.groupBy(*by, index("x").alias("i"), index("z").alias("j")).agg(F.max("y").alias("_top"))
    if floor is None:
        base = F.lit(0.0)
    else:
        cells = attach(cells, floor.select("scene_id", "floor_y"), "scene_id")
        base = F.col("floor_y")
    return cells.select(*by, "i", "j", (F.col("_top") - (base + params.offset)).alias("h"))


def fill_columns(cells: DataFrame, tall: float = 0.20, by="scene_id") -> DataFrame:
    """Raise everything between the first and last tall cell of a column to the column maximum.

    Unseen cells in between are added; cells outside the span stay as they are.
    """
    by = [by] if isinstance(by, str) else list(by)
    is_tall = F.col("h") >= tall
    spans = cells.where(is_tall).groupBy(*by, "i").agg(
        F.min("j").alias("_j0"), F.max("j").alias("_j1"), F.max("h").alias("_fill")
    )
    filled = spans.select(*by, "i", "_fill", F.explode(F.sequence("_j0", "_j1")).alias("j"))
    both = cells.join(filled, [*by, "i", "j"], "full")
    return both.select(*by, "i", "j", F.greatest("h", "_fill").alias("h"))


def height_field_volume(
    cells: DataFrame, scenes: DataFrame | None = None, params: P.HeightFieldParams = P.HeightFieldParams(), by="scene_id",
) -> DataFrame:
    """Volume, footprint, mean and max height and cell count over valid cells.

    ``scenes`` lists groups that must appear even when nothing is valid (zeros).
    """
    by = [by] if isinstance(by, str) else list(by)
    area = params.cell * params.cell
    valid = cells.where(F.col("h") >= params.min_height)
    out = valid.groupBy(*by).agg(
        F.sum(F.col("h") * F.lit(area)).alias("volume_m3"), (F.count(F.lit(1)) * F.lit(area)).alias("footprint_m2"),
        F.avg("h").alias("mean_height"), F.max("h").alias("max_height"), F.count(F.lit(1)).alias("n_cells"),
    )
    if scenes is None:
        return out
    return scenes.select(*by).distinct().join(out, by, "left").na.fill(
        0, ["volume_m3", "footprint_m2", "mean_height", "max_height", "n_cells"]
    )
