"""Metadata, reference volumes, comparison tables, inventories and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA_SCHEMA = "id BIGINT, objects ARRAY<STRING>, n_points BIGINT, label_counts MAP<STRING, BIGINT>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Scene metadata: ``scene_id, objects ARRAY<STRING>, n_points, label_counts``.

    The file is one JSON array whose ``objects`` mix strings and dictionaries; each
    element is kept as JSON text.
    """
    rows = spark.read.schema(METADATA_SCHEMA).option("multiLine", "true").json(path)
    return rows.withColumnRenamed("id", "scene_id")


# Fixed value: the line that carries a volume (both spellings occur).
VOLUME_PATTERN = r"\[GetVolume\] Best estimation with (?:ConvexHull|MomentOfInertia|MomentOfIntertia): ([\d.]+) m3"
REFERENCE_PATH = r"([^/]+)/([^/]+)_C[^/]*_get_bounding_box\.txt$"


def parse_reference_volumes(texts: DataFrame) -> DataFrame:
    """``path, value`` rows -> ``scenario, capture, vol_ref, n_files`` (sum over the cluster files)."""
    rows = texts.select(
        F.regexp_extract("path", REFERENCE_PATH, 1).alias("scenario"),
        F.regexp_extract("path", REFERENCE_PATH, 2).alias("capture"),
        F.expr("try_cast(nullif(regexp_extract(value, r'" + VOLUME_PATTERN + "', 1), '') AS DOUBLE)").alias("v"),
    ).where(F.col("capture") != "")
    return rows.groupBy("scenario", "capture").agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("vol_ref"), F.count(F.lit(1)).alias("n_files")
    )


def read_reference_volumes(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*_get_bounding_box.txt").text(path, wholetext=True)
    return parse_reference_volumes(texts.select(F.col("_metadata.file_path").alias("path"), "value"))


SCENARIO_PATH = r"Escenario_(\d+)/Captura_(\d+)"


def capture_inventory(paths_a: DataFrame, paths_b: DataFrame) -> DataFrame:
    """Scenario and capture numbers of ``paths_a`` whose partner exists in ``paths_b`` (column ``path``)."""
    def keyed(d):
        part = lambda i: F.expr(f"try_cast(nullif(regexp_extract(path, r'{SCENARIO_PATH}', {i}), '') AS INT)")
        return d.select(part(1).alias("scenario"), part(2).alias("capture")).dropna()

    return keyed(paths_a).distinct().join(keyed(paths_b), ["scenario", "capture"], "left_semi")


NUMERIC = (
    "n_clusters_ref", "vol_ref", "n_clusters", "vol_hf", "vol_obb", "vol_hull", "vol_anchor",
    "ratio_hf", "ratio_obb", "ratio_hull", "ratio_anchor",
)


def coerce_comparison(raw: DataFrame, required=("vol_ref", "vol_hf")) -> DataFrame:
    """Numbers from text columns; sentinels such as ``""`` and ``"crash"`` become NULL.

    Rows without the required numbers are dropped.
    """
    casts = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in NUMERIC if c in raw.columns}
    return raw.withColumns(casts).dropna(subset=[c for c in required if c in raw.columns])


def read_comparison(spark: SparkSession, path: str, required=("vol_ref", "vol_hf")) -> DataFrame:
    head = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    return coerce_comparison(head, required)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """CSV (flat tables, with header), JSON (nested documents) or Parquet."""
    if format == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        if nested:
            raise ValueError(f"csv cannot hold nested columns: {nested}")
        df.write.mode(mode).option("header", "true").csv(path)
    elif format == "json":
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    else:
        df.write.mode(mode).parquet(path)
