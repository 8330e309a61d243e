"""Distances, bearings, the coastal raster and wind expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.registry import (
    COASTLINE,
    DEFAULT_VISIBILITY_M,
    EARTH_RADIUS_NM,
    LAND_BOX,
    RASTER,
    RASTER_OUTSIDE_NM,
)


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _square(x: Column) -> Column:
    return x * x


def _arc_nm(a: Column) -> Column:
    """Haversine term to nautical miles; the clip leaves a floor of about 0.2176 nm."""
    clipped = F.least(F.greatest(a, F.lit(1e-9)), F.lit(1.0 - 1e-9))
    return F.lit(2.0) * F.asin(F.sqrt(clipped)) * F.lit(EARTH_RADIUS_NM)


def great_circle_nm(lat, lon, to_lat, to_lon) -> Column:
    lat, lon, to_lat, to_lon = map(_as_column, (lat, lon, to_lat, to_lon))
    return arc_from_deltas(lat, to_lat, to_lat - lat, to_lon - lon)


def arc_from_deltas(lat: Column, to_lat: Column, dlat: Column, dlon: Column) -> Column:
    """Great circle from already differenced degrees (fixed-point deltas keep noise out)."""
    half = lambda d: _square(F.sin(F.radians(d) / 2))
    return _arc_nm(half(dlat) + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * half(dlon))


def bearing_deg(lat, lon, to_lat, to_lon) -> Column:
    """Initial bearing in [0, 360)."""
    lat, lon, to_lat, to_lon = map(_as_column, (lat, lon, to_lat, to_lon))
    a, b, dl = F.radians(lat), F.radians(to_lat), F.radians(to_lon) - F.radians(lon)
    y = F.sin(dl) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def proximity(distance_nm: Column, half_distance: float = 0.25) -> Column:
    """1 at the anchor, halved every ``half_distance`` nautical miles."""
    return F.exp(-(distance_nm / F.lit(half_distance)) * F.lit(math.log(2.0)))


def raster_distance(lat: Column, lon: Column, nearest_edge: bool = False) -> Column:
    """Coastal distance of the raster cell holding the point.

    The raster is a rule, not a table: the value of a cell is the distance of its
    corner to the nearest coastline vertex, 0 inside the land box.  So the cell
    index is computed and the rule applied, with no lookup join.  The index
    truncates toward zero.  Outside the raster the value is a constant, or with
    ``nearest_edge`` the value of the closest cell.
    """
    r, c = raster_cell(lat, lon)
    rows, cols = RASTER["rows"], RASTER["cols"]
    inside = r.between(0, rows - 1) & c.between(0, cols - 1)
    r = F.least(F.greatest(r, F.lit(0)), F.lit(rows - 1))
    c = F.least(F.greatest(c, F.lit(0)), F.lit(cols - 1))
    value = raster_cell_value(r, c)
    return value if nearest_edge else F.when(inside, value).otherwise(F.lit(RASTER_OUTSIDE_NM))


def raster_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    res = F.lit(RASTER["res"])
    return (
        ((F.lit(RASTER["lat_max"]) - lat) / res).cast("int"),
        ((lon - F.lit(RASTER["lon_min"])) / res).cast("int"),
    )


def raster_cell_value(row: Column, col: Column) -> Column:
    lat = F.lit(RASTER["lat_max"]) - row * F.lit(RASTER["res"])
    lon = F.lit(RASTER["lon_min"]) + col * F.lit(RASTER["res"])
    squares = [_square(lat - a) + _square(lon - b) for a, b in COASTLINE]
    on_land = (lat > LAND_BOX[0]) & (lon > LAND_BOX[1])
    return F.when(on_land, F.lit(0.0)).otherwise(F.sqrt(F.least(*squares)) * 60.0)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Where the wind comes from, degrees; NaN when there is no wind."""
    angle = F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))
    return F.when(wind_speed(u, v) > 1e-6, angle).otherwise(F.lit(float("nan")))


def wind_direction_valid(u: Column, v: Column) -> Column:
    return (wind_speed(u, v) > 1e-6).cast("int")


def headwind(u: Column, v: Column, course: Column) -> Column:
    rad = F.radians(F.pmod(course, F.lit(360.0)))
    return -(u * F.sin(rad) + v * F.cos(rad))


def crosswind(u: Column, v: Column, course: Column) -> Column:
    rad = F.radians(F.pmod(course, F.lit(360.0)))
    return u * F.cos(rad) - v * F.sin(rad)


def visibility(value: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(DEFAULT_VISIBILITY_M))
