"""Degrees to metres on the WGS 84 ellipsoid, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.raster import bilinear_at

#: Semi-major axis and flattening of WGS 84; scale and false easting of UTM. Fixed values.
AXIS_M, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, FALSE_EASTING_M, SOUTH_M = 0.9996, 500000.0, 10000000.0
#: Zone of the metric grid that outlines are brought to (EPSG:32629).
ZONE = 29


def pixel_size(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two near centres in degrees, by the radii of curvature halfway (relative error below 1e-6 up to 10 km)."""
    e2 = FLATTENING * (2 - FLATTENING)
    middle = F.radians((lat + lat2) / 2)
    bend = 1 - e2 * F.sin(middle) * F.sin(middle)
    north = F.radians(lat2 - lat) * AXIS_M * (1 - e2) / (bend * F.sqrt(bend))
    east = F.radians(lon2 - lon) * AXIS_M * F.cos(middle) / F.sqrt(bend)
    return F.hypot(north, east)


def step_size(scale: Column, geographic: bool, lat: Column, lon: Column, step: int = 1) -> Column:
    """Metres of a pixel after decimation by step: for a geographic grid from a centre to the next one, `scale` degrees east; else |scale|."""
    return step * (pixel_size(lat, lon, lat, lon + scale) if geographic else F.abs(scale))


def utm(lat: Column, lon: Column, zone: int = ZONE, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres of a UTM zone, by Krueger's series to the third order (below a millimetre in the zone)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = UTM_SCALE * AXIS_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * n**0.5 / (1 + n)
    s, off = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(terms, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING_M + radius * east, (SOUTH_M if south else 0.0) + radius * north


def degrees_of(east: Column, north: Column, zone: int = ZONE, south: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of a place in a UTM zone: the inverse series, to the third order too."""
    n = FLATTENING / (2 - FLATTENING)
    radius = UTM_SCALE * AXIS_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    bend = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (north - (SOUTH_M if south else 0.0)) / radius, (east - FALSE_EASTING_M) / radius
    up, side = xi, eta
    for j, b in enumerate(back, 1):
        up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        side = side - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(side))
    lat = chi
    for j, d in enumerate(bend, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(side), F.cos(up))) + (6 * zone - 183)


def warp_to_metric(source: DataFrame | None, target: DataFrame, source_at: tuple[float, float, float, float], target_at: tuple[float, float, float], zone: int = ZONE, south: bool = False, value: str = "elev") -> DataFrame | None:
    """row, col, `value` of a raster in degrees at the pixels of a raster in metres of a UTM zone; None without a source.

    source_at: longitude and latitude of the upper left corner, then degrees of a pixel east and south; target_at: easting
    and northing of the corner, metres of a pixel. Neighbours outside the source or without a value don't count; a pixel without any is null.
    """
    if source is None:
        return None
    left, top, dx, dy = source_at
    east, north, cell = target_at
    lat, lon = degrees_of(east + (F.col("col") + 0.5) * cell, north - (F.col("row") + 0.5) * cell, zone, south)
    return bilinear_at(source, target.select("row", "col", ((top - lat) / dy - 0.5).alias("y"), ((lon - left) / dx - 0.5).alias("x")), value)


def to_metric(rings: DataFrame, zone: int = ZONE) -> DataFrame:
    """Rings whose points are longitude and latitude in degrees, with points in metres of a UTM zone."""
    def moved(p: Column) -> Column:
        east, north = utm(p["y"], p["x"], zone)
        return F.struct(east.alias("x"), north.alias("y"))

    return rings.withColumn("points", F.transform("points", moved))
