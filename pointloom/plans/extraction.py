"""End-to-end jobs over all scenes at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.groups import attach
from ..functions.lineage import cut
from ..operators import cluster as C
from ..operators import grids as G
from ..operators.features import cluster_features
from ..operators.neighbors import nearest_transfer
from ..operators.transforms import align_axes, center_crop, inside_anchor, map_labels
from ..operators.volumes import hull_prism_volume, oriented_box

XYZ = ("x", "y", "z")


def prepare(points: DataFrame, params: P.ExtractionParams, align: str = "none") -> DataFrame:
    """Axis alignment and voxel centroids."""
    return cut(G.voxel_centroid(align_axes(points, align), params.voxel_size).select("scene_id", "point_id", *XYZ))


def preprocessed_params(params: P.ExtractionParams = P.ExtractionParams()) -> P.ExtractionParams:
    """Settings for thinned clouds that carry no floor: clusters are sought with the sparse radius and count."""
    return replace(params, cargo_eps=params.sparse_eps, cargo_min_pts=params.sparse_min_pts)


def run_extraction(
    points: DataFrame, params: P.ExtractionParams = P.ExtractionParams(), field: P.HeightFieldParams = P.HeightFieldParams(),
    align: str = "none", crop: bool = False, floorless: bool = False, fill: bool = False, floor: DataFrame | None = None,
    classifier: DataFrame | Callable[[DataFrame], DataFrame] | None = None, preprocessed: bool = False,
) -> DataFrame:
    """One result row per scene: floor, anchor, pallets, cargo, the way it was chosen, and volumes.

    ``classifier`` is a function from cluster features to ``scene_id, cluster_id, y_pred, max_prob``, or such a table: cargo is then what the
    negative filter keeps (:func:`~pointloom.operators.cluster.choose_cargo`); without one the best score decides.
    ``preprocessed`` takes clouds with z up and no floor: axes are swapped, the floor is virtual, clusters are sparse and columns are
    filled.  ``floor`` gives known planes (``scene_id, a, b, c, d, floor_y``) instead of searched ones.  Scenes that fail at a stage keep a
    row with NULLs from there on and the stage in ``status``: no_floor, no_anchor, no_cluster (too few points in the anchor or
    none of them dense), no_cargo (nothing above the pallet) or ok.
    """
    if preprocessed:
        params, align, floorless, fill = preprocessed_params(params), "z_to_y", True, True
    scenes = points.select("scene_id").distinct()
    cloud = prepare(points, params, align)
    if floorless:
        floor = cut(C.virtual_floor(cloud))
        above = cloud
    else:
        floor = cut(C.floor_plane(cloud, params) if floor is None else floor)
        above = cut(C.remove_floor(attach(cloud, floor.select("scene_id"), "scene_id", "left_semi"), floor, params))
    if crop:
        above = cut(center_crop(above, params))
    anchors = cut(C.find_anchor(above, floor, params))
    pallets = C.pallet_candidates(above, floor, anchors, params).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_pallets"))
    clustered = C.cluster_in_anchor(above, anchors, params)
    preds = classifier
    if callable(classifier):
        preds = cut(classifier(cluster_features(clustered.where(F.col("cluster_id").isNotNull()))).select("scene_id", "cluster_id", "y_pred", "max_prob"))
    chosen, summary = C.choose_cargo(clustered, floor, anchors, params, preds)
    cargo = cut(C.refine_points(chosen, floor, params))
    cells = G.height_field(cargo, floor, field)
    if fill:
        cells = G.fill_columns(cells, field.tall)
    volume = G.height_field_volume(C.halo_filter(cells, field), cargo.select("scene_id"), field)
    box = oriented_box(cargo, "scene_id").select("scene_id", F.col("n").alias("n_cargo"), "dim_1", "dim_2", "dim_3", F.col("box_volume").alias("obb_volume"))
    hull = hull_prism_volume(cargo).select("scene_id", F.col("prism_volume").alias("hull_volume"))
    anchor_hull = hull_prism_volume(inside_anchor(above, anchors, params.anchor_margin)).select(
        "scene_id", F.col("prism_volume").alias("anchor_hull_volume"))
    out = scenes
    for part in (
        floor.select("scene_id", "floor_y"), anchors.select("scene_id", F.col("n_points").alias("n_anchor")), pallets,
        summary.drop("cluster_id"), volume, box, hull, anchor_hull,
    ):
        out = out.join(part, "scene_id", "left")
    status = (
        F.when(F.col("floor_y").isNull(), "no_floor").when(F.col("n_anchor").isNull(), "no_anchor")
        .when(F.col("n_clusters").isNull(), "no_cluster").when(F.col("n_cargo").isNull(), "no_cargo").otherwise("ok")
    )
    return out.withColumn("status", status)


def result_documents(results: DataFrame) -> DataFrame:
    """Nested document per capture, ready for the JSON sink."""
    return results.select(
        "scene_id", "status", F.struct("floor_y").alias("floor"), F.struct("n_anchor", "anchor_hull_volume").alias("anchor"),
        F.struct("n_in_anchor", "n_clusters", "n_kept", "n_excluded", "source", "policy").alias("cargo"),
        F.struct("volume_m3", "footprint_m2", "mean_height", "max_height").alias("height_field"),
        F.struct("obb_volume", F.array("dim_1", "dim_2", "dim_3").alias("dims"), "hull_volume").alias("boxes"),
    )


def build_cluster_dataset(
    points: DataFrame, params: P.ExtractionParams = P.ExtractionParams(), min_points: int = 30, purity: float = 0.6,
) -> tuple[DataFrame, DataFrame]:
    """Training rows per cluster (features, majority class) and the reason per skipped scene."""
    cloud = prepare(points, params)
    floor = cut(C.floor_plane(cloud, params))
    above = cut(C.remove_floor(attach(cloud, floor.select("scene_id"), "scene_id", "left_semi"), floor, params))
    anchors = cut(C.find_anchor(above, floor, params))
    clustered = C.cluster_in_anchor(above, anchors, params)
    members = clustered.where(F.col("cluster_id").isNotNull())
    raw = map_labels(points).select("scene_id", "point_id", *XYZ, "cluster_class")
    named = cut(nearest_transfer(members, raw, "cluster_class"))
    labels = C.cluster_labels(named, min_points, purity)
    rows = cluster_features(members).join(labels.select("scene_id", "cluster_id", "majority", "purity", "y_cluster"), ["scene_id", "cluster_id"])
    rows = cut(rows)
    seen = lambda d, n: d.select("scene_id").distinct().withColumn(n, F.lit(True))
    status = points.select("scene_id").distinct()
    for part, name in ((floor, "f"), (anchors, "a"), (rows, "r")):
        status = status.join(seen(part, name), "scene_id", "left")
    status = status.select("scene_id", F.when(F.col("f").isNull(), "no_floor").when(F.col("a").isNull(), "no_anchor").when(
        F.col("r").isNull(), "no_cluster").otherwise("used").alias("outcome"))
    return rows, status
