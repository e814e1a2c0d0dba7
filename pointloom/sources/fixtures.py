"""Point, capture, detection and metadata tables derived from the given star schema.

All arithmetic is on integers (millimetres, modular uniforms), so another engine
reproduces the same rows; coordinates are ``mm / 1000``.  Every table grows with
its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mixed(key: str, a: int, b: int, p: int) -> str:
    """``(key * key * a + key * b) % p`` without large intermediate values."""
    m = f"({key} % {p})"
    return f"({m} * {m} * {a} + {m} * {b}) % {p}"


def points_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, point_id, label, x_mm, y_mm, z_mm``: a point for every row of ``lineitem``.

    Rows of one line are numbered by part and supplier.
    """
    line = Window.partitionBy("ok", "ln").orderBy("l_partkey", "l_suppkey")
    # The shuffle that numbers the rows also spreads small files over all cores.
    keyed = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), "l_partkey", "l_suppkey",
    ).select("ok", ((F.col("ok") * 8 + F.col("ln")) * 101 + F.row_number().over(line) - 1).alias("point_id"))
    mixed = keyed.selectExpr(
        "point_id", "ok div 750 AS scene_id", f"{_mixed('point_id', 31, 7919, 10007)} AS u0", f"{_mixed('point_id', 17, 6101, 10009)} AS u1",
        f"{_mixed('point_id', 13, 4001, 10037)} AS u2", f"{_mixed('point_id', 11, 2003, 10039)} AS u3",
    ).selectExpr(
        "*",
        "CASE WHEN u0 < 6000 THEN 0 WHEN u0 < 7500 THEN 1 WHEN u0 < 8400 THEN 2"
        " WHEN u0 < 8800 THEN 3 WHEN u0 < 9700 THEN 4 ELSE 255 END AS label",
    )
    return mixed.selectExpr(
        "scene_id", "point_id", "label",
        "CASE label WHEN 0 THEN u1 % 5001 - 2500"
        " WHEN 1 THEN u1 % (401 + 10 * (scene_id % 30)) - (200 + 5 * (scene_id % 30))"
        " WHEN 2 THEN u1 % 701 - 350 WHEN 3 THEN u1 % 401 + 1300"
        " WHEN 4 THEN u1 % 1201 - 600 ELSE u1 % 4001 - 2000 END AS x_mm",
        "CASE label WHEN 0 THEN u2 % 31 - 15"
        " WHEN 1 THEN 144 + u2 % (301 + 20 * (scene_id % 40))"
        " WHEN 2 THEN u2 % 151 WHEN 3 THEN u2 % 1751"
        " WHEN 4 THEN 122 + u2 % 23 ELSE u2 % 2001 END AS y_mm",
        "CASE label WHEN 0 THEN u3 % 4001 - 2000 WHEN 1 THEN u3 % 601 - 300"
        " WHEN 2 THEN u3 % 401 - 820 WHEN 3 THEN u3 % 401 + 900"
        " WHEN 4 THEN u3 % 801 - 400 ELSE u3 % 3001 - 1500 END AS z_mm",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, point_id, label, x, y, z`` in metres."""
    mm = points_mm(spark, sf_dir)
    return mm.select(
        "scene_id", "point_id", "label",
        *[(F.col(f"{a}_mm").cast("double") / F.lit(1000.0)).alias(a) for a in "xyz"],
    )


def uniform(a: int, b: int, p: int, key: str = "point_id"):
    """Arithmetic uniform in [0, 1) that any engine can reproduce."""
    return F.expr(_mixed(key, a, b, p)).cast("double") / F.lit(float(p))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, point_id, y_true, y_pred``: 85 of 100 points keep their class."""
    return points_mm(spark, sf_dir).where("label <> 255").selectExpr(
        "scene_id", "point_id", "label AS y_true",
        "CASE WHEN (point_id * 37 + 11) % 100 < 85 THEN label ELSE (label + 1) % 5 END AS y_pred",
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scenario, capture, run_id, vol_ref, vol_est`` from ``orders`` (with gaps)."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey % 20 + 1 AS BIGINT) AS scenario",
        "CAST(o_orderkey % 10 + 1 AS BIGINT) AS capture",
        "CAST(o_orderkey AS BIGINT) AS run_id",
        "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) / 100000D END AS vol_ref",
        "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE"
        " CAST(o_totalprice AS DOUBLE) / 100000D * CAST(3 + o_orderkey % 17 AS DOUBLE) / 10D END AS vol_est",
    )


def camera_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, camera, point_id, x, y, z, r, g, b`` in the camera frame."""
    return points_mm(spark, sf_dir).selectExpr(
        "scene_id", "point_id",
        "CASE point_id % 3 WHEN 0 THEN 'Izq' WHEN 1 THEN 'Der' ELSE 'Cenital' END AS camera",
        "CAST(x_mm AS DOUBLE) / 1000D AS x", "CAST(y_mm AS DOUBLE) / 1000D AS y",
        "CAST(z_mm + 3000 AS DOUBLE) / 1000D AS z",
        "CAST(point_id % 256 AS INT) AS r", "CAST((point_id * 7) % 256 AS INT) AS g",
        "CAST((point_id * 13) % 256 AS INT) AS b",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, camera, cls, conf, x1, y1, x2, y2``: two boxes per camera and scene."""
    boxes = (
        points_mm(spark, sf_dir).select("scene_id").distinct()
        .selectExpr("scene_id", "explode(array(0L, 1L, 2L)) AS cam")
        .selectExpr("*", "explode(array(0L, 1L)) AS k")
    )
    return boxes.selectExpr(
        "scene_id", "CASE cam WHEN 0 THEN 'Izq' WHEN 1 THEN 'Der' ELSE 'Cenital' END AS camera",
        "CAST(CASE WHEN (scene_id + cam + k) % 7 = 0 THEN 2 ELSE 0 END AS INT) AS cls",
        "CAST((scene_id * 13 + cam * 29 + k * 31) % 90 + 10 AS DOUBLE) / 100D AS conf",
        "CAST((scene_id * 37 + cam * 101 + k * 211) % 500 AS DOUBLE) AS x1",
        "CAST((scene_id * 53 + cam * 67 + k * 97) % 400 AS DOUBLE) AS y1",
        "CAST((scene_id * 37 + cam * 101 + k * 211) % 500 + 400 AS DOUBLE) AS x2",
        "CAST((scene_id * 53 + cam * 67 + k * 97) % 400 + 300 AS DOUBLE) AS y2",
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, objects ARRAY<STRING>``: JSON text per object, from ``part``.

    Four parts make one scene: one or two cargo items, a vehicle and, now and
    then, a person.
    """
    part = table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS BIGINT) AS pk", "CAST(p_size AS BIGINT) AS ps")
    scenes = part.selectExpr("pk div 4 AS scene_id", "pk % 4 AS slot", "pk", "ps")
    # Lengths are whole centimetres written as 0.NN / 1.NN metres.
    def metres(expr: str) -> str:
        return f"concat(CAST(({expr}) div 100 AS STRING), '.', lpad(CAST(({expr}) % 100 AS STRING), 2, '0'))"

    dims = (
        "CASE WHEN ps % 2 = 0 THEN concat('{\"type\":\"box\",\"w\":', " + metres("28 + (pk * 7) % 70")
        + ", ',\"h\":', " + metres("22 + (pk * 11) % 120") + ", ',\"d\":', " + metres("28 + ps % 48")
        + ") ELSE concat('{\"type\":\"cylinder\",\"r\":', " + metres("14 + ps % 26")
        + ", ',\"h\":', " + metres("28 + (pk * 5) % 94") + ") END"
    )
    place = (
        "CASE WHEN slot = 1 THEN CASE WHEN ps % 3 = 0 THEN ',\"placement\":\"stacked\"'"
        " ELSE ',\"placement\":\"tandem\"' END ELSE '' END"
    )
    oy = "CASE WHEN pk % 9 = 0 THEN '' ELSE concat(',\"oy\":', " + metres("(pk * 3) % 90") + ") END"
    return (
        scenes.selectExpr(
            "scene_id", "slot",
            "CASE WHEN slot = 0 THEN concat('{\"cargo1\":', " + dims + ", " + oy + ", '}}')"
            " WHEN slot = 1 AND ps % 5 < 3 THEN concat('{\"cargo2\":', " + dims + ", " + oy + ", " + place + ", '}}')"
            " WHEN slot = 2 THEN concat('{\"vehicle\":{\"type\":\"', CASE WHEN ps % 2 = 0 THEN 'forklift' ELSE 'pallet_jack' END, '\"}}')"
            " WHEN slot = 3 AND ps % 4 = 0 THEN concat('{\"person\":{\"zone\":\"', CASE ps % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'perimeter' ELSE 'elsewhere' END, '\"}}')"
            " ELSE '\"floor\"' END AS object",
        )
        .groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("slot", "object"))).alias("o"))
        .select("scene_id", F.expr("transform(o, s -> s.object)").alias("objects"))
    )
