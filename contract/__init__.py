"""Queries over the given tables and their SQL twins."""

from . import transforms, grids, spatial, reports  # noqa: F401, E401
from .base import ORACLES, QUERIES  # noqa: F401
