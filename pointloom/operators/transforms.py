"""Coordinate transforms, label maps, filters and predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import at_least, col, literal_map, squared_distance
from ..functions.groups import attach, exact_percentiles, with_stats

XYZ = ("x", "y", "z")


# ------------------------------------------------------------------- transforms

def align_axes(df: DataFrame, mode: str = "auto", floor_axis: DataFrame | None = None) -> DataFrame:
    """Put the floor axis on y as ``[other0, floor, other1]``.

    ``auto`` uses the detected axis per scene, ``z_to_y`` always takes z, ``none``
    returns the input.
    """
    if mode == "none":
        return df
    if mode == "z_to_y":
        axis = F.lit(2)
        rows = df
    else:
        from .grids import detect_floor_axis

        axis = F.col("floor_axis")
        rows = attach(df, (floor_axis or detect_floor_axis(df)).select("scene_id", "floor_axis"), "scene_id")
    new = {
        "x": F.when(axis == 0, F.col("y")).otherwise(F.col("x")),
        "y": F.when(axis == 0, F.col("x")).when(axis == 2, F.col("z")).otherwise(F.col("y")),
        "z": F.when(axis == 2, F.col("y")).otherwise(F.col("z")),
    }
    return rows.withColumns(new).drop("floor_axis")


def translate_floor(df: DataFrame, floor: DataFrame) -> DataFrame:
    """``y -= floor_y`` with one floor height per scene."""
    moved = attach(df, floor.select("scene_id", "floor_y"), "scene_id")
    return moved.withColumn("y", F.col("y") - F.col("floor_y")).drop("floor_y")


def camera_to_world(df: DataFrame, theta_deg: float = 47.5, height: float = 3.80) -> DataFrame:
    """Camera frame -> ``world_x, height, world_y`` for a fixed pitch and mounting height."""
    s, c = math.sin(math.radians(theta_deg)), math.cos(math.radians(theta_deg))
    return df.withColumns({
        "world_x": F.col("z") * F.lit(c) + F.col("y") * F.lit(s),
        "height": F.lit(height) - F.col("z") * F.lit(s) - F.col("y") * F.lit(c),
        "world_y": -F.col("x"),
    })


def _camera_value(cameras, name: str) -> Column:
    table = F.create_map(*[F.lit(v) for c in cameras for v in (c["camera"], float(c[name]))])
    return F.element_at(table, F.col("camera"))


def project_pinhole(df: DataFrame, cameras=P.PINHOLE_CAMERAS) -> DataFrame:
    """Pixel ``u, v`` (half-even rounding) and ``valid`` (in front and inside the image).

    Points behind the camera get -1, like points that miss the image.
    """
    get = lambda n: _camera_value(cameras, n)
    front = F.col("z") > 0
    depth = F.when(front, F.col("z")).otherwise(F.lit(1.0))

    def pixel(axis, f, c):
        return F.when(front, F.rint(get(f) * F.col(axis) / depth + get(c))).otherwise(F.lit(-1.0)).cast("int")

    out = df.withColumns({"u": pixel("x", "fx", "cx"), "v": pixel("y", "fy", "cy")})
    inside = (F.col("u") >= 0) & (F.col("u") < get("w")) & (F.col("v") >= 0) & (F.col("v") < get("h"))
    return out.withColumn("valid", front & inside)


def height_above_plane(df: DataFrame, planes: DataFrame) -> DataFrame:
    """Signed distance to the scene plane ``a, b, c, d``, flipped if its mean is negative."""
    rows = attach(df, planes.select("scene_id", "a", "b", "c", "d"), "scene_id", "inner")
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    raw = (F.col("x") * F.col("a") + F.col("y") * F.col("b") + F.col("z") * F.col("c") + F.col("d")) / norm
    rows = rows.withColumn("height", raw).drop("a", "b", "c", "d")
    rows = with_stats(rows, "scene_id", F.avg("height").alias("_mean"))
    return rows.withColumn(
        "height", F.when(F.col("_mean") < 0, -F.col("height")).otherwise(F.col("height"))
    ).drop("_mean")


def level_to_plane(df: DataFrame, planes: DataFrame) -> DataFrame:
    """Rotate the plane normal onto +y, drop the 2nd percentile of y to 0, centre x and z."""
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    sign = F.when(F.col("b") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    unit = planes.select("scene_id", *[(F.col(k) / n * sign).alias(f"_n{k}") for k in "abc"])
    rows = attach(df, unit, "scene_id", "inner")
    na, nb, nc = F.col("_na"), F.col("_nb"), F.col("_nc")
    # Rodrigues rotation with axis (-nc, 0, na) and cosine nb, written out per row.
    f = F.when(1.0 + nb > 1e-12, 1.0 / (1.0 + nb)).otherwise(F.lit(0.0))
    rows = rows.withColumns({
        "x": (1.0 - na * na * f) * F.col("x") - na * F.col("y") - na * nc * f * F.col("z"),
        "y": na * F.col("x") + nb * F.col("y") + nc * F.col("z"),
        "z": -na * nc * f * F.col("x") - nc * F.col("y") + (1.0 - nc * nc * f) * F.col("z"),
    }).drop("_na", "_nb", "_nc")
    low = exact_percentiles(rows, "scene_id", "y", {"_y02": 0.02})
    means = rows.groupBy("scene_id").agg(F.avg("x").alias("_mx"), F.avg("z").alias("_mz"))
    rows = attach(rows, low.join(means, "scene_id"), "scene_id")
    return rows.withColumns({
        "x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_y02"), "z": F.col("z") - F.col("_mz"),
    }).drop("_y02", "_mx", "_mz")


# ----------------------------------------------------------------------- labels

def label_rgb(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``red, green, blue`` of the class (magenta when unknown)."""
    channels = {}
    for i, name in enumerate(("red", "green", "blue")):
        lookup = literal_map({k: v[i] for k, v in P.LABEL_COLOURS.items()}, P.UNKNOWN_COLOUR[i])
        channels[name] = lookup(F.col(label).cast("int"))
    return df.withColumns(channels)


def map_labels(
    df: DataFrame, mapping: dict = P.CLUSTER_CLASS_OF_LABEL, default: int = P.CLUSTER_CLASS_DEFAULT,
    label: str = "label", out: str = "cluster_class",
) -> DataFrame:
    """Map raw labels through a fixed dictionary with a default."""
    return df.withColumn(out, literal_map(mapping, default)(F.col(label).cast("int")))


def assign_roles(points: DataFrame, clusters: DataFrame, preds: DataFrame, confidence: float = 0.75) -> DataFrame:
    """Role of every point of a classified scene.

    ``floor`` (flag ``is_floor``), ``cargo / vehicle / person`` by cluster class,
    ``rescued`` for person or vehicle clusters below the confidence, and
    ``non_cluster`` otherwise.
    """
    named = attach(
        clusters.select("scene_id", "point_id", "cluster_id").where(F.col("cluster_id").isNotNull()),
        preds.select("scene_id", "cluster_id", "y_pred", "max_prob"), ["scene_id", "cluster_id"],
    ).drop("cluster_id")
    rows = points.join(named, ["scene_id", "point_id"], "left")
    excluded = F.col("y_pred").isin(2, 3)
    role = (
        F.when(F.col("is_floor"), "floor")
        .when(excluded & (F.col("max_prob") < confidence), "rescued")
        .when(F.col("y_pred") == 1, "cargo").when(F.col("y_pred") == 2, "vehicle")
        .when(F.col("y_pred") == 3, "person").otherwise("non_cluster")
    )
    return rows.withColumn("role", role).drop("y_pred", "max_prob")


# ---------------------------------------------------------------------- filters

def roi_mask(x=2.5, y=(-0.15, 2.5), z=2.0) -> Column:
    return (
        F.col("x").between(-x, x) & F.col("y").between(y[0], y[1]) & F.col("z").between(-z, z)
    )


def roi(df: DataFrame, x: float = 2.5, y=(-0.15, 2.5), z: float = 2.0, mask: str | None = None) -> DataFrame:
    """Region of interest, all bounds inclusive; as a filter or as a boolean column."""
    inside = roi_mask(x, y, z)
    return df.withColumn(mask, inside) if mask else df.where(inside)


def center_crop(df: DataFrame, params: P.ExtractionParams = P.ExtractionParams()) -> DataFrame:
    return df.where(F.col("x").between(*params.crop_x) & F.col("z").between(*params.crop_z))


def center_crop_counts(df: DataFrame, params: P.ExtractionParams = P.ExtractionParams()) -> DataFrame:
    """Rows per scene before and after the crop."""
    inside = F.col("x").between(*params.crop_x) & F.col("z").between(*params.crop_z)
    return df.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(inside).alias("n_after")
    )


def height_slice(
    df: DataFrame, floor: DataFrame, lo: float = 0.05, hi: float = 0.20,
    anchors: DataFrame | None = None, margin: float = 0.30,
) -> DataFrame:
    """Band ``floor_y + lo <= y <= floor_y + hi``, optionally inside the anchor footprint."""
    rows = attach(df, floor.select("scene_id", "floor_y"), "scene_id", "inner")
    rows = rows.where(F.col("y").between(F.col("floor_y") + lo, F.col("floor_y") + hi)).drop("floor_y")
    return inside_anchor(rows, anchors, margin) if anchors is not None else rows


def above_floor(df: DataFrame, floor: DataFrame, h: float) -> DataFrame:
    """Points strictly higher than ``floor_y + h``."""
    rows = attach(df, floor.select("scene_id", "floor_y"), "scene_id", "inner")
    return rows.where(F.col("y") > F.col("floor_y") + h).drop("floor_y")


def inside_anchor(df: DataFrame, anchors: DataFrame, margin: float = 0.30) -> DataFrame:
    """Points in the anchor footprint expanded by ``margin`` (inclusive)."""
    box = anchors.select("scene_id", "x_min", "x_max", "z_min", "z_max")
    rows = attach(df, box, "scene_id", "inner")
    inside = F.col("x").between(F.col("x_min") - margin, F.col("x_max") + margin) & F.col("z").between(
        F.col("z_min") - margin, F.col("z_max") + margin
    )
    return rows.where(inside).drop("x_min", "x_max", "z_min", "z_max")


def fov_filter(df: DataFrame, cameras=P.SCENE_CAMERAS, exempt=(0, 2)) -> DataFrame:
    """Keep points in the viewing cone of any camera that looks at the origin; exempt classes always stay.

    The cameras are one array of constants, so the code of the test does not grow with their
    number, and each coordinate is computed once a row.
    """
    fields = []
    for camera in cameras:
        px, py, pz = camera["pos"]
        length = math.sqrt(px * px + py * py + pz * pz)
        cone = {"px": px, "py": py, "pz": pz, "vx": -px / length, "vy": -py / length, "vz": -pz / length,
                "cos": math.cos(math.radians(camera["fov_deg"] / 2.0))}
        fields.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in cone.items()]))

    def sees(at: Column):
        def test(c: Column) -> Column:
            d = F.transform(F.array(F.struct(*[(at[a] - c[f"p{a}"]).alias(a) for a in XYZ])), lambda v: F.struct(
                at_least(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]), 1e-9).alias("distance"),
                (v["x"] * c["vx"] + v["y"] * c["vy"] + v["z"] * c["vz"]).alias("along"),
            ))
            return F.exists(d, lambda v: v["along"] / v["distance"] > c["cos"])
        return test

    place = F.array(F.struct(*[F.col(a).alias(a) for a in XYZ]))
    seen = F.exists(place, lambda at: F.exists(F.array(*fields), sees(at))) if fields else F.lit(False)
    if exempt:
        seen = F.col("label").isin(*exempt) | seen
    return df.where(seen)


def facing_filter(df: DataFrame, cameras=P.SCENE_CAMERAS) -> DataFrame:
    """Keep points whose normal ``nx, ny, nz`` faces any camera.

    A scene in which none does keeps all its points.
    """
    facing = F.lit(False)
    for camera in cameras:
        px, py, pz = camera["pos"]
        dot = F.col("nx") * (F.lit(px) - F.col("x")) + F.col("ny") * (F.lit(py) - F.col("y")) + F.col("nz") * (
            F.lit(pz) - F.col("z"))
        facing = facing | (dot > 0)
    rows = with_stats(df.withColumn("_facing", facing), "scene_id", F.bool_or("_facing").alias("_any"))
    return rows.where(F.col("_facing") | ~F.col("_any")).drop("_facing", "_any")


def route_for_prediction(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """``route``: 0 floor (low inside the ROI), -1 to be classified, 255 outside the ROI."""
    inside = roi_mask()
    return df.withColumn(
        "route", F.when(~inside, 255).when(F.col("y") < threshold, 0).otherwise(-1)
    )


def drop_classes(df: DataFrame, labels=(255,)) -> DataFrame:
    return df.where(~F.col("label").isin(*labels))


def circle_clears_box(circles: DataFrame, boxes: DataFrame) -> DataFrame:
    """Circles ``px, pz, pr`` against boxes of the same scene: ``clear`` if they do not overlap."""
    rows = circles.join(boxes, "scene_id")
    nx = F.greatest(F.col("x_min"), F.least(F.col("px"), F.col("x_max")))
    nz = F.greatest(F.col("z_min"), F.least(F.col("pz"), F.col("z_max")))
    gap = squared_distance(["px", "pz"], [nx, nz])
    return rows.withColumn("clear", gap >= F.col("pr") * F.col("pr"))


def remaining(df: DataFrame, used: DataFrame, key: str = "point_id") -> DataFrame:
    """Rows whose key is not in ``used`` (set difference)."""
    return df.join(used.select("scene_id", key), ["scene_id", key], "left_anti")


def concat_points(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; columns missing somewhere become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_masks(*masks: DataFrame) -> DataFrame:
    """Distinct keys that occur in any mask."""
    keys = [m.select("scene_id", "point_id") for m in masks]
    return concat_points(*keys).distinct()


def available_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def paint(points: DataFrame, subset: DataFrame, value, column: str = "mask", default=None) -> DataFrame:
    """Write ``value`` on the rows that occur in ``subset``, ``default`` on the others."""
    hit = subset.select("scene_id", "point_id").distinct().withColumn("_hit", F.lit(True))
    rows = points.join(hit, ["scene_id", "point_id"], "left")
    return rows.withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.lit(default))).drop("_hit")


def limit_scenes(df: DataFrame, n: int) -> DataFrame:
    """The rows of the first ``n`` scenes in id order (a report on a few scenes)."""
    first = df.select("scene_id").distinct().orderBy("scene_id").limit(n)
    return df.join(F.broadcast(first), "scene_id", "left_semi")


def y_norm(df: DataFrame) -> DataFrame:
    """Height relative to the scene's range; a range below 1e-6 counts as 1."""
    rows = with_stats(df, "scene_id", F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    span = F.when(F.col("_hi") - F.col("_lo") < 1e-6, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    return rows.withColumn("y_norm", (F.col("y") - F.col("_lo")) / span).drop("_lo", "_hi")


# --------------------------------------------------------------- scene metadata

ITEM_SCHEMA = (
    "map<string, struct<type: string, w: double, h: double, d: double, r: double,"
    " ox: double, oy: double, oz: double, placement: string, zone: string>>"
)


def explode_objects(metadata: DataFrame) -> DataFrame:
    """One row per object: ``scene_id, pos, name`` and its fields; bare strings give a name only."""
    each = metadata.select("scene_id", F.posexplode("objects").alias("pos", "text"))
    parsed = each.withColumn("_m", F.from_json("text", ITEM_SCHEMA))
    keyed = parsed.select("scene_id", "pos", "text", F.explode_outer("_m").alias("name", "spec"))
    bare = F.regexp_replace("text", '^"|"$', "")
    return keyed.select(
        "scene_id", "pos", F.coalesce("name", F.when(~F.col("text").startswith("{"), bare)).alias("name"), "spec.*"
    )


def check_scenes(metadata: DataFrame, rules: P.SceneRules = P.SceneRules()) -> DataFrame:
    """Violations per scene: cargo sizes, stacking, tandem depth, vehicles, person zone."""
    tol = rules.tolerance
    objects = explode_objects(metadata)

    def outside(c, bounds):
        return (F.col(c) < bounds[0] - tol) | (F.col(c) > bounds[1] + tol)

    is_box, is_cyl = F.col("type") == "box", F.col("type") == "cylinder"
    cargo = F.col("name").startswith("cargo")
    size = cargo & (
        (is_box & (outside("w", rules.box_w) | outside("d", rules.box_d) | outside("h", rules.box_h)))
        | (is_cyl & (outside("r", rules.cyl_r) | outside("h", rules.cyl_h)))
    )
    width = F.coalesce("w", F.col("r") * 2.0)
    depth = F.coalesce("d", F.col("r") * 2.0)
    first, second = F.col("name") == "cargo1", F.col("name") == "cargo2"
    per_scene = objects.groupBy("scene_id").agg(
        F.count_if(size).alias("bad_size"),
        F.max(F.when(first, width)).alias("w1"), F.max(F.when(first, depth)).alias("d1"),
        F.max(F.when(second, width)).alias("w2"), F.max(F.when(second, depth)).alias("d2"),
        F.max(F.when(second, F.col("placement"))).alias("placement"),
        F.count_if(F.col("name") == "vehicle").alias("n_vehicles"),
        F.count_if((F.col("name") == "person") & ~F.coalesce(F.col("zone").isin("operator", "perimeter"), F.lit(False))).alias("bad_zone"),
    )
    stacked = (F.col("placement") == "stacked") & ((F.col("w2") > F.col("w1") + tol) | (F.col("d2") > F.col("d1") + tol))
    tandem = (F.col("placement") == "tandem") & (
        F.col("d1") + rules.tandem_gap + F.col("d2") > rules.pallet_depth + tol
    )
    return per_scene.select(
        "scene_id", "bad_size",
        F.coalesce(stacked, F.lit(False)).cast("int").alias("bad_stack"),
        F.coalesce(tandem, F.lit(False)).cast("int").alias("bad_tandem"),
        (F.col("n_vehicles") != 1).cast("int").alias("bad_vehicle_count"), "bad_zone",
    )
