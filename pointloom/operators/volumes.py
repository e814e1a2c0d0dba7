"""Oriented boxes, hull prisms and volume comparisons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import covariance, covariance_sums, principal_axes
from ..functions.groups import attach
from .transforms import explode_objects

XYZ = ("x", "y", "z")


def oriented_box(df: DataFrame, by, ddof: int = 0) -> DataFrame:
    """Box along the principal axes of each group.

    ``n``, axis-aligned ``ext_x/y/z``, ``dim_1 >= dim_2 >= dim_3`` (oriented), the
    volumes ``box_volume`` and ``aabb_volume``, and ``box_long``, ``box_short`` (the two more
    horizontal extents) and ``box_height`` (along the axis closest to y).
    """
    by = [by] if isinstance(by, str) else list(by)
    corner = df.groupBy(*by).agg(*[F.min(a).alias(f"_o{a}") for a in XYZ])
    shifted = attach(df.select(*by, *XYZ), corner, by)
    # Sums are taken relative to the group's corner to avoid cancellation.
    rel = [F.col(a) - F.col(f"_o{a}") for a in XYZ]
    sums = shifted.groupBy(*by).agg(*covariance_sums(*rel), *[f(a).alias(f"_{n}{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max))])
    frames = principal_axes(sums.withColumns(covariance(ddof=ddof)))
    axes = [f"a{k}{a}" for k in (1, 2, 3) for a in XYZ]
    turned = attach(df.select(*by, *XYZ), frames.select(*by, *axes), by)
    spans = []
    for k in (1, 2, 3):
        along = F.col("x") * F.col(f"a{k}x") + F.col("y") * F.col(f"a{k}y") + F.col("z") * F.col(f"a{k}z")
        spans.append((F.max(along) - F.min(along)).alias(f"e{k}"))
    boxes = turned.groupBy(*by).agg(*spans).join(
        frames.select(*by, "n", "l1", "l2", "l3", "a1y", "a2y", "a3y", *[(F.col(f"_hi{a}") - F.col(f"_lo{a}")).alias(f"ext_{a}") for a in XYZ]), by
    )
    up = [F.abs(F.col(f"a{k}y")) for k in (1, 2, 3)]
    vertical = F.when((up[0] >= up[1]) & (up[0] >= up[2]), 1).when(up[1] >= up[2], 2).otherwise(3)
    boxes = boxes.withColumn("_v", vertical)
    pick = lambda v, a, b, c: F.when(F.col("_v") == 1, F.col(a)).when(F.col("_v") == 2, F.col(b)).otherwise(F.col(c))
    h1 = pick("_v", "e2", "e1", "e1")
    h2 = pick("_v", "e3", "e3", "e2")
    dims = F.sort_array(F.array("e1", "e2", "e3"), asc=False)
    return boxes.select(
        *by, "n", "ext_x", "ext_y", "ext_z", "l1", "l2", "l3",
        *[dims[i].alias(f"dim_{i + 1}") for i in range(3)],
        (F.col("e1") * F.col("e2") * F.col("e3")).alias("box_volume"),
        (F.col("ext_x") * F.col("ext_y") * F.col("ext_z")).alias("aabb_volume"),
        F.greatest(h1, h2).alias("box_long"), F.least(h1, h2).alias("box_short"), pick("_v", "e1", "e2", "e3").alias("box_height"),
    )


def hull_prism_volume(df: DataFrame, by="scene_id", directions: int = 64) -> DataFrame:
    """Footprint hull area times height, an upper bound of the occupied volume.

    The hull is the polygon of support lines in ``directions`` evenly spaced
    directions: one maximum per direction is all that is shuffled.
    """
    by = [by] if isinstance(by, str) else list(by)
    step = 2.0 * math.pi / directions
    supports = [
        F.max(F.col("x") * F.lit(math.cos(k * step)) + F.col("z") * F.lit(math.sin(k * step))).alias(f"s{k}")
        for k in range(directions)
    ]
    agg = df.groupBy(*by).agg(*supports, (F.max("y") - F.min("y")).alias("height"))
    values = F.array(*[f"s{k}" for k in range(directions)])
    # Area of a polygon with support h(k): sum over edges of h * edge length / 2.
    cot, csc = math.cos(step) / math.sin(step), 1.0 / math.sin(step)
    area = None
    for k in range(directions):
        h, before, after = F.col(f"s{k}"), F.col(f"s{(k - 1) % directions}"), F.col(f"s{(k + 1) % directions}")
        part = h * ((before + after) * csc - 2.0 * cot * h) / 2.0
        area = part if area is None else area + part
    return agg.select(*by, F.size(values).alias("n_directions"), area.alias("hull_area"), "height", (area * F.col("height")).alias("prism_volume"))


# -------------------------------------------------------------- reference volumes

def compare_volumes(results: DataFrame, reference: DataFrame, keys=("scenario", "capture"), cols=("vol_hf",)) -> DataFrame:
    """Left join of measured and reference volumes with ratios rounded to 4 places.

    ``ratio_*`` is NULL unless the reference is positive; ``status`` tells why.
    """
    rows = results.join(reference, list(keys), "left")
    ok = F.col("vol_ref") > 0
    for c in cols:
        rows = rows.withColumn("ratio" + c[3:], F.when(ok, F.round(F.col(c) / F.col("vol_ref"), 4)))
    failed = F.lit(True)
    for c in cols:
        failed = failed & F.col(c).isNull()
    return rows.withColumn(
        "status", F.when(failed, "crash").when(F.col("vol_ref").isNull(), "no_reference").otherwise("ok")
    )


def gt_cargo_volume(metadata: DataFrame) -> DataFrame:
    """True cargo volume per scene: boxes w*h*d, cylinders pi*r^2*h."""
    items = explode_objects(metadata).withColumn("_cargo", F.col("name").startswith("cargo"))
    v = F.when(F.col("type") == "box", F.col("w") * F.col("h") * F.col("d")).when(
        F.col("type") == "cylinder", F.lit(math.pi) * F.col("r") * F.col("r") * F.col("h")
    )
    return items.groupBy("scene_id").agg(F.coalesce(F.sum(F.when(F.col("_cargo"), v)), F.lit(0.0)).alias("gt_cargo_m3"))


def gt_column_volume(metadata: DataFrame) -> DataFrame:
    """Footprint times top height per scene; 0 when any cargo item lacks ``oy``."""
    items = explode_objects(metadata).withColumn("_cargo", F.col("name").startswith("cargo"))
    top = F.col("oy") + F.col("h")
    v = F.when(F.col("type") == "box", F.col("w") * F.col("d") * top).when(
        F.col("type") == "cylinder", F.lit(math.pi) * F.col("r") * F.col("r") * top
    )
    return items.groupBy("scene_id").agg(
        F.sum(F.when(F.col("_cargo"), v)).alias("_v"),
        F.coalesce(F.bool_or(F.when(F.col("_cargo"), F.col("oy").isNull())), F.lit(False)).alias("_missing"),
    ).select("scene_id", F.when(F.col("_missing"), 0.0).otherwise(F.coalesce("_v", F.lit(0.0))).alias("gt_column_m3"))


def volume_errors(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Relative errors against cargo and column volume; scenes without cargo are skipped."""
    rows = truth.join(predicted, "scene_id").where(F.col("gt_cargo_m3") > 0)
    rel = lambda g: (F.col("pred_m3") - F.col(g)) / F.col(g)
    return rows.select(
        "scene_id", F.round("gt_cargo_m3", 4).alias("gt_cargo_m3"), F.round("gt_column_m3", 4).alias("gt_column_m3"),
        F.round("pred_m3", 4).alias("pred_m3"), F.round(rel("gt_cargo_m3"), 4).alias("rel_vs_cargo"),
        F.when(F.col("gt_column_m3") > 0, F.round(rel("gt_column_m3"), 4)).alias("rel_vs_column"),
    )


def metadata_summary(metadata: DataFrame) -> DataFrame:
    """Counts per object kind, type, placement and zone, and the scenes they occur in."""
    items = explode_objects(metadata)
    kind = F.regexp_replace("name", "[0-9]+$", "")
    return items.groupBy(kind.alias("kind"), "type", "placement", "zone").agg(
        F.count(F.lit(1)).alias("n_objects"), F.count_distinct("scene_id").alias("n_scenes")
    )
