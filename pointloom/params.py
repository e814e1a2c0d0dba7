"""Parameter bundles and fixed values shared by the operators.

Lengths are metres, angles degrees.  The numbers are fixed values: results only
match the published behaviour with exactly these settings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Class map of labelled clouds.
LABELS = {"floor": 0, "cargo": 1, "vehicle": 2, "person": 3, "pallet": 4, "outlier": 255}

# Display colour per class, and the colour of unknown classes.
LABEL_COLOURS = {
    0: (60, 60, 60),
    1: (220, 50, 50),
    2: (0, 120, 255),
    3: (39, 174, 96),
    4: (255, 210, 0),
    255: (60, 60, 60),
}
UNKNOWN_COLOUR = (255, 0, 255)

# Raw class -> cluster class (cargo 1, vehicle 2, person 3).
CLUSTER_CLASSES = {"cargo": 1, "vehicle": 2, "person": 3}
CLUSTER_CLASS_OF_LABEL = {0: 2, 1: 1, 2: 2, 3: 3, 4: 1, 255: 2}
CLUSTER_CLASS_DEFAULT = 2

# Scene cameras (all look at the origin).
SCENE_CAMERAS = (
    {"name": "cenital", "pos": (0.0, 3.68, 0.0), "fov_deg": 90.0},
    {"name": "der", "pos": (3.33, 3.80, 0.0), "fov_deg": 70.0},
    {"name": "izq", "pos": (-3.33, 3.80, 0.0), "fov_deg": 70.0},
)

# Pinhole intrinsics per camera.
PINHOLE_CAMERAS = (
    {"camera": "Izq", "w": 2048, "h": 1536, "fx": 1680.0, "fy": 1680.0, "cx": 1045.0, "cy": 758.0},
    {"camera": "Der", "w": 2048, "h": 1536, "fx": 1664.0, "fy": 1664.0, "cx": 1013.0, "cy": 750.0},
    {"camera": "Cenital", "w": 1024, "h": 768, "fx": 833.0, "fy": 833.0, "cx": 517.0, "cy": 382.0},
)


@dataclass(frozen=True)
class ExtractionParams:
    """Settings of floor removal, anchoring, pallet search and cargo extraction."""

    voxel_size: float = 0.035
    floor_tolerance: float = 0.025
    floor_hypotheses: int = 500
    floor_rounds: int = 3
    floor_max_abs_y: float = 0.10
    floor_min_normal_y: float = 0.9
    floor_band: float = 0.05
    floor_below_margin: float = 0.10
    floor_below_max_frac: float = 0.02
    anchor_y_min: float = 0.20
    anchor_eps: float = 0.10
    anchor_min_pts: int = 30
    anchor_margin: float = 0.30
    slice_lo: float = 0.05
    slice_hi: float = 0.20
    pallet_eps: float = 0.10
    pallet_min_pts: int = 30
    pallet_min_short: float = 0.30
    pallet_min_long: float = 0.50
    pallet_max_long: float = 1.80
    pallet_max_aspect: float = 2.5
    pallet_min_density: float = 200.0
    cargo_eps: float = 0.08
    cargo_min_pts: int = 30
    sparse_eps: float = 0.15
    sparse_min_pts: int = 10
    refine_height: float = 0.15
    refine_ladder: tuple = ((0.10, 20), (0.15, 15), (0.20, 10))
    crop_x: tuple = (0.5, 5.0)
    crop_z: tuple = (-3.0, 2.0)
    negative_confidence: float = 0.75


@dataclass(frozen=True)
class HeightFieldParams:
    cell: float = 0.04
    offset: float = 0.144
    min_height: float = 0.05
    tall: float = 0.20


@dataclass(frozen=True)
class DegradeParams:
    voxel_size: float = 0.019
    gaussian_share: float = 0.60
    core_sigma: float = 0.010
    tail_sigma: float = 0.025
    depth_ref: float = 3.0
    dropout: float = 0.15
    outlier_ratio: float = 0.03
    outlier_sigma: float = 0.055
    seed: int = 42
    cameras: tuple = field(default=SCENE_CAMERAS)


@dataclass(frozen=True)
class SceneRules:
    """Admissible ranges of scene metadata (cargo sizes, pallet depth)."""

    box_w: tuple = (0.30, 1.00)
    box_d: tuple = (0.30, 0.75)
    box_h: tuple = (0.25, 1.40)
    cyl_r: tuple = (0.15, 0.40)
    cyl_h: tuple = (0.30, 1.20)
    pallet_depth: float = 0.80
    tandem_gap: float = 0.02
    tolerance: float = 1e-6
