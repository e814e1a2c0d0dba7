"""Feature and model stores with compatibility checks."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

VERSION = 1
REQUIRED = ("version", "feature_names", "label_map")


def cached_features(spark: SparkSession, path: str, names: list[str], compute) -> DataFrame:
    """Stored features when their column list still equals ``names``; otherwise recompute and store.

    ``compute`` is called without arguments and returns the DataFrame.
    """
    keys = ["scene_id", "point_id", "label"]
    try:
        stored = spark.read.parquet(path)
        if [c for c in stored.columns if c not in keys] == list(names):
            return stored
    except AnalysisException:
        pass
    fresh = compute()
    fresh.select(*[k for k in keys if k in fresh.columns], *names).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str, feature_names: list[str], label_map: dict, spark: SparkSession) -> None:
    """Model folder plus a JSON side-car with version, feature names and label map."""
    model.write().overwrite().save(f"{path}/model")
    card = json.dumps({"version": VERSION, "feature_names": feature_names, "label_map": label_map})
    spark.createDataFrame([(card,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def load_model(path: str, spark: SparkSession, feature_names: list[str] | None = None):
    """(model, card); missing files, missing keys, other versions or features are errors."""
    try:
        text = spark.read.text(f"{path}/card", wholetext=True).first()["value"]
    except AnalysisException as e:
        raise FileNotFoundError(f"no model card under {path}") from e
    card = json.loads(text)
    missing = [k for k in REQUIRED if k not in card]
    if missing:
        raise ValueError(f"model card lacks {missing}")
    if card["version"] != VERSION:
        raise ValueError(f"model version {card['version']} is not {VERSION}")
    if feature_names is not None and list(card["feature_names"]) != list(feature_names):
        raise ValueError("model was trained on other features")
    return PipelineModel.load(f"{path}/model"), card
