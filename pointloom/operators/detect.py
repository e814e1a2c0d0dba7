"""Camera projections joined with 2-D detections, and person removal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import literal_map, squared_distance
from ..functions.groups import attach, exact_percentiles
from .transforms import _camera_value, camera_to_world, project_pinhole

# Confidence thresholds per camera, tried in order.
THRESHOLDS = {"Izq": (0.5, 0.3), "Der": (0.5, 0.3), "Cenital": (0.3, 0.3)}


def best_detection(dets: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    """Best person box per scene and camera; ``used_threshold`` is the first one it reaches."""
    first = literal_map({k: v[0] for k, v in thresholds.items()}, 0.5)(F.col("camera"))
    second = literal_map({k: v[1] for k, v in thresholds.items()}, 0.3)(F.col("camera"))
    persons = dets.where(F.col("cls") == 0)
    order = F.struct("conf", (-F.col("x1")).alias("a"), (-F.col("y1")).alias("b"))
    best = persons.groupBy("scene_id", "camera").agg(F.max_by(F.struct("conf", "x1", "y1", "x2", "y2"), order).alias("m"))
    rows = best.select("scene_id", "camera", "m.*").withColumn(
        "used_threshold", F.when(F.col("conf") >= first, first).when(F.col("conf") >= second, second)
    )
    return rows.where(F.col("used_threshold").isNotNull())


def edge_flags(dets: DataFrame, cameras=P.PINHOLE_CAMERAS, margin: float = 10) -> DataFrame:
    """Does the box touch the image border within ``margin`` pixels?"""
    w, h = _camera_value(cameras, "w"), _camera_value(cameras, "h")
    return dets.withColumns({
        "edge_left": F.col("x1") <= margin, "edge_top": F.col("y1") <= margin,
        "edge_right": F.col("x2") >= w - margin, "edge_bottom": F.col("y2") >= h - margin,
    })


def in_bbox(projected: DataFrame, dets: DataFrame, pad: float = 5) -> DataFrame:
    """Add ``in_box``: valid pixel inside any box of its scene and camera, padded (inclusive)."""
    boxes = dets.groupBy("scene_id", "camera").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_boxes"))
    rows = attach(projected, boxes, ["scene_id", "camera"])

    def inside(b):
        return (
            (F.col("u") >= b["x1"] - pad) & (F.col("u") <= b["x2"] + pad)
            & (F.col("v") >= b["y1"] - pad) & (F.col("v") <= b["y2"] + pad)
        )

    hit = F.col("valid") & F.coalesce(F.exists("_boxes", inside), F.lit(False))
    return rows.withColumn("in_box", hit).drop("_boxes")


def assign_source_camera(merged: DataFrame, counts: DataFrame) -> DataFrame:
    """Camera and in-camera index of each row of a merged cloud.

    ``counts``: ``scene_id, camera, seq, n``; the merged cloud is the cameras in ``seq``
    order.  Rows beyond the last camera get NULL.
    """
    order = Window.partitionBy("scene_id").orderBy("seq")
    ranges = counts.withColumn("_hi", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    packed = ranges.groupBy("scene_id").agg(
        F.sort_array(F.collect_list(F.struct("_hi", "camera", "n"))).alias("_ranges")
    )
    rows = attach(merged, packed, "scene_id")
    hit = F.element_at(F.filter("_ranges", lambda r: F.col("idx") < r["_hi"]), 1)
    rows = rows.withColumn("_r", F.when(F.size(F.filter("_ranges", lambda r: F.col("idx") < r["_hi"])) > 0, hit))
    return rows.withColumns({
        "camera": F.col("_r.camera"), "cam_idx": F.col("idx") - (F.col("_r._hi") - F.col("_r.n")),
    }).drop("_ranges", "_r")


def remove_detected(
    merged: DataFrame, cam_points: DataFrame, dets: DataFrame, counts: DataFrame, cameras=P.PINHOLE_CAMERAS, pad: float = 5,
) -> tuple[DataFrame, DataFrame]:
    """Drop merged-cloud points whose camera point falls into a detection box.

    ``merged``: ``scene_id, idx``; ``cam_points``: ``scene_id, camera, cam_idx, x, y, z``.
    Returns the remaining rows and a report with totals and the count expected
    from the cameras.
    """
    hits = in_bbox(project_pinhole(cam_points, cameras), dets, pad).where("in_box").select("scene_id", "camera", "cam_idx")
    located = assign_source_camera(merged, counts)
    keys = ["scene_id", "camera", "cam_idx"]
    kept = located.join(hits, keys, "left_anti")
    total = merged.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_total"))
    left = kept.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_left"))
    expected = counts.groupBy("scene_id").agg(F.sum("n").alias("n_expected"))
    report = total.join(left, "scene_id", "left").join(expected, "scene_id", "left").withColumn(
        "n_removed", F.col("n_total") - F.coalesce("_left", F.lit(0))
    )
    return kept, report.select(
        "scene_id", "n_total", "n_removed", (100.0 * F.col("n_removed") / F.greatest("n_total", F.lit(1))).alias("pct_removed"),
        "n_expected", (F.col("n_total") != F.col("n_expected")).alias("count_mismatch"),
    )


def projection_report(cam_points: DataFrame, dets: DataFrame, cameras=P.PINHOLE_CAMERAS, pad: float = 5) -> DataFrame:
    """Per scene and camera: points in frame and in box, median depths and notes."""
    keys = ["scene_id", "camera"]
    rows = in_bbox(project_pinhole(cam_points, cameras), dets, pad)
    counts = rows.groupBy(*keys).agg(
        F.count_if("valid").alias("n_in_frame"), F.count_if("in_box").alias("n_in_box")
    )
    all_z = exact_percentiles(rows.where("valid"), keys, "z", {"z_frame": 0.5})
    box_z = exact_percentiles(rows.where("in_box"), keys, "z", {"z_box": 0.5})
    flags = edge_flags(dets, cameras).groupBy(*keys).agg(
        *[F.bool_or(f"edge_{s}").alias(f"edge_{s}") for s in ("left", "top", "right", "bottom")]
    )
    edge = F.lit("")
    for side in ("left", "top", "right", "bottom"):
        edge = F.concat(edge, F.when(F.col(f"edge_{side}"), side[0].upper()).otherwise("."))
    out = dets.select(*keys).distinct().join(counts, keys).join(flags, keys).join(all_z, keys, "left").join(box_z, keys, "left")
    return out.select(
        *keys, edge.alias("edge"), "n_in_frame", "n_in_box", "z_frame", "z_box",
        (F.col("edge_left") | F.col("edge_top") | F.col("edge_right") | F.col("edge_bottom")).alias("note_edge"),
        (F.col("n_in_box") < 500).alias("note_few"),
        F.coalesce((F.col("n_in_box") > 0) & (F.abs(F.col("z_box") - F.col("z_frame")) < 0.1), F.lit(False)).alias("note_overlap"),
    )


def estimate_intrinsics(df: DataFrame, w: int, h: int, by=("scene_id", "camera")) -> DataFrame:
    """Pinhole parameters from the 2nd and 98th percentile of x/z and y/z."""
    by = list(by)
    rows = df.where(F.col("z") != 0).withColumns({"_xz": F.col("x") / F.col("z"), "_yz": F.col("y") / F.col("z")})
    px = exact_percentiles(rows, by, "_xz", {"x_lo": 0.02, "x_hi": 0.98})
    py = exact_percentiles(rows, by, "_yz", {"y_lo": 0.02, "y_hi": 0.98})
    fx = F.lit(float(w - 1)) / (F.col("x_hi") - F.col("x_lo"))
    fy = F.lit(float(h - 1)) / (F.col("y_hi") - F.col("y_lo"))
    return px.join(py, by).select(
        *by, fx.alias("fx"), (-F.col("x_lo") * fx).alias("cx"), fy.alias("fy"), (-F.col("y_lo") * fy).alias("cy")
    )


def color_match_rate(points: DataFrame, pixels: DataFrame, tol: int = 15) -> DataFrame:
    """Share of projected points whose pixel has the same colour (largest channel gap <= tol)."""
    keys = ["scene_id", "camera", "u", "v"]
    image = pixels.select(*keys, *[F.col(c).alias(f"_{c}") for c in "rgb"])
    diff = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in "rgb"])
    return points.where("valid").join(image, keys).groupBy("scene_id", "camera").agg(
        F.count(F.lit(1)).alias("n"), F.avg((diff <= tol).cast("int")).alias("match_rate")
    )


def in_cylinder(
    points: DataFrame, centres: DataFrame, radius: float = 0.25, up: str = "y", plane=("x", "z"),
    min_score: int = 5, min_hits: int = 50, z_max: float = 2.2,
) -> DataFrame:
    """Points in the upright cylinder around each scene's centre.

    ``centres``: ``scene_id, cx, cz, lo, hi, score``.  Points within the radius and height
    band, plus those within 1.3 radii and a band widened by 0.1.  A scene counts
    only with ``score >= min_score`` and at least ``min_hits`` points.
    """
    rows = attach(points, centres.where(F.col("score") >= min_score), "scene_id", "inner")
    dx, dz = F.col(plane[0]) - F.col("cx"), F.col(plane[1]) - F.col("cz")
    d2 = dx * dx + dz * dz
    tight = (d2 <= radius * radius) & F.col(up).between(F.col("lo"), F.col("hi"))
    wide = (d2 <= (radius * 1.3) * (radius * 1.3)) & F.col(up).between(
        F.greatest(F.lit(0.0), F.col("lo") - 0.1), F.least(F.lit(z_max), F.col("hi") + 0.1)
    )
    hits = rows.where(tight | wide).drop("cx", "cz", "lo", "hi", "score")
    enough = hits.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_hits)
    return attach(hits, enough.select("scene_id"), "scene_id", "inner")


def best_azimuth(
    points: DataFrame, person: DataFrame, cargo: DataFrame, bands: DataFrame, radius: float = 0.25, floor: float = 0.05,
) -> DataFrame:
    """Rotation (0, 90, 180, 270 degrees) that puts most points around the person.

    ``points`` are world points (y up), ``person`` and ``cargo`` camera points; the cargo centroid
    is aligned with the centroid of the non-floor points, then points within twice the
    radius and inside the height band are counted.  The first best angle wins.
    """
    centre = lambda d, p: d.groupBy("scene_id").agg(F.avg("x").alias(f"{p}x"), F.avg("z").alias(f"{p}z"))
    world = centre(points.where(F.col("y") > floor), "w")
    frames = world.join(centre(person, "p"), "scene_id").join(centre(cargo, "c"), "scene_id", "left").join(bands, "scene_id")
    frames = frames.withColumns({"cx0": F.coalesce("cx", "px"), "cz0": F.coalesce("cz", "pz")})
    # Cosine and sine of the four angles.
    turns = F.array(*[F.struct(F.lit(a).alias("az"), F.lit(float(c)).alias("co"), F.lit(float(s)).alias("si"))
                      for a, c, s in ((0, 1, 0), (90, 0, 1), (180, -1, 0), (270, 0, -1))])
    tried = frames.withColumn("_t", F.explode(turns)).select(
        "scene_id", "lo", "hi", F.col("_t.az").alias("az"),
        (F.col("wx") + F.col("_t.co") * (F.col("px") - F.col("cx0")) - F.col("_t.si") * (F.col("pz") - F.col("cz0"))).alias("cx"),
        (F.col("wz") + F.col("_t.si") * (F.col("px") - F.col("cx0")) + F.col("_t.co") * (F.col("pz") - F.col("cz0"))).alias("cz"),
    )
    packed = tried.groupBy("scene_id", "lo", "hi").agg(F.collect_list(F.struct("az", "cx", "cz")).alias("_tries"))
    rows = attach(points.select("scene_id", "x", "y", "z"), packed, "scene_id", "inner")
    rows = rows.where(F.col("y").between(F.col("lo"), F.col("hi"))).withColumn("_t", F.explode("_tries"))
    hit = squared_distance(["x", "z"], ["_t.cx", "_t.cz"]) <= (2 * radius) * (2 * radius)
    scores = rows.where(hit).groupBy("scene_id", F.col("_t.az").alias("az")).agg(F.count(F.lit(1)).alias("score"))
    scored = tried.join(scores, ["scene_id", "az"], "left").na.fill(0, ["score"])
    return scored.groupBy("scene_id").agg(
        F.max_by(F.struct("az", "cx", "cz", "lo", "hi", "score"), F.struct("score", (-F.col("az")).alias("k"))).alias("m")
    ).select("scene_id", "m.*")


def pseudo_label(cam_points: DataFrame, dets: DataFrame, camera: dict = P.PINHOLE_CAMERAS[0]) -> DataFrame:
    """Point labels from a detection box: 1 person, 2 cargo, 0 unlabelled.

    Person: projected into the box (no padding, unrounded pixels) and higher than
    0.3 m; cargo: higher than 0.15 m and less than 1.5 m off the centre line.
    """
    box = dets.select("scene_id", "x1", "y1", "x2", "y2")
    rows = attach(camera_to_world(cam_points), box, "scene_id")
    front = F.col("z") > 0
    depth = F.when(front, F.col("z")).otherwise(F.lit(1.0))
    u = F.lit(camera["fx"]) * F.col("x") / depth + F.lit(camera["cx"])
    v = F.lit(camera["fy"]) * F.col("y") / depth + F.lit(camera["cy"])
    in_box = F.coalesce(front & u.between(F.col("x1"), F.col("x2")) & v.between(F.col("y1"), F.col("y2")), F.lit(False))
    label = F.when(in_box & (F.col("height") > 0.3), 1).when(
        (F.col("height") > 0.15) & (F.abs("world_y") < 1.5), 2).otherwise(0)
    return rows.withColumn("pseudo", label).drop("x1", "y1", "x2", "y2")
