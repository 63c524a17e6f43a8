"""All queries of the raster engine; importing their modules registers them."""

from __future__ import annotations

from fieldloom.plans import clusters, fieldrun, missions, rasters, reports, surfaces  # noqa: F401
from fieldloom.plans.registry import ORACLE, QUERIES  # noqa: F401
