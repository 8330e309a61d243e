"""Motion features from the current row and the two rows before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import fields, geo
from wakeline.functions.scoring import clip
from wakeline.operators.slices import BY_SEQUENCE, Stitch, Track, stitch
from wakeline.registry import PORT, TERMINAL

GAP_LIMIT_SEC = 900
POSITION_SCALE, MOTION_SCALE = 1e7, 1e4
CARRY = ["timestamp_sec", "lat_raw", "lon_raw", "speed_raw", "course_raw"]


def elapsed(cur, prev) -> Column:
    """Seconds since the previous row, 1 on the first row."""
    return F.coalesce(cur["timestamp_sec"] - prev["timestamp_sec"], F.lit(1))


def elapsed_floor(cur, prev) -> Column:
    return F.greatest(elapsed(cur, prev), F.lit(1))


def log_elapsed(cur, prev) -> Column:
    dt = elapsed(cur, prev)
    return F.log1p(F.when(dt < 0, F.lit(0)).otherwise(dt).cast("double"))


def fixed_point_delta(cur, prev, name: str, scale: float) -> Column:
    """Difference of values truncated to whole units of 1/scale; 0 on the first row."""
    units = lambda row: (row[name] * F.lit(scale)).cast("bigint")
    return F.coalesce(units(cur) - units(prev), F.lit(0)) / F.lit(scale)


def course_change(cur, prev) -> Column:
    delta = fixed_point_delta(cur, prev, "course_raw", MOTION_SCALE)
    return F.pmod(delta + 180.0, F.lit(360.0)) - 180.0


def gated(cur, prev, value: Column) -> Column:
    """0 after a silence of more than fifteen minutes."""
    return F.when(elapsed(cur, prev) > GAP_LIMIT_SEC, F.lit(0.0)).otherwise(value)


def acceleration(cur, prev) -> Column:
    delta = fixed_point_delta(cur, prev, "speed_raw", MOTION_SCALE)
    return gated(cur, prev, delta / elapsed_floor(cur, prev))


def turn_rate(cur, prev) -> Column:
    return gated(cur, prev, course_change(cur, prev) / elapsed_floor(cur, prev))


def jerk(cur, prev, before_prev) -> Column:
    change = acceleration(cur, prev) - acceleration(prev, before_prev)
    return F.when(prev["timestamp_sec"].isNull(), F.lit(0.0)).otherwise(
        gated(cur, prev, change / elapsed_floor(cur, prev)))


def turn_speed_ratio(cur, prev) -> Column:
    ratio = turn_rate(cur, prev) / (cur["speed_raw"] + 1e-4)
    return clip(F.when(cur["speed_raw"] < 0.5, F.lit(0.0)).otherwise(ratio), -50.0, 50.0)


def displacement(cur, prev) -> tuple[Column, Column]:
    """East and north displacement in nautical miles on a plane."""
    north = (cur["lat_raw"] - prev["lat_raw"]) * 60.0
    east = (cur["lon_raw"] - prev["lon_raw"]) * F.cos(F.radians(cur["lat_raw"])) * 60.0
    zero = F.lit(0.0)
    return (
        F.coalesce(gated(cur, prev, east), zero),
        F.coalesce(gated(cur, prev, north), zero),
    )


def geodetic_displacement(cur, prev) -> Column:
    dlat = fixed_point_delta(cur, prev, "lat_raw", POSITION_SCALE)
    dlon = fixed_point_delta(cur, prev, "lon_raw", POSITION_SCALE)
    arc = geo.arc_from_deltas(prev["lat_raw"], cur["lat_raw"], dlat, dlon)
    return F.when(prev["lat_raw"].isNull(), F.lit(0.0)).otherwise(gated(cur, prev, arc))


def motion_columns(cur, prev, before_prev) -> dict[str, Column]:
    east, north = displacement(cur, prev)
    arc = geodetic_displacement(cur, prev)
    return {
        "delta_y_nm": north,
        "delta_x_nm": east,
        "geodetic_displacement_nm": arc,
        "geodetic_distance_nm": arc,
        "acceleration": acceleration(cur, prev),
        "course_change": course_change(cur, prev),
        "log_time_diff": log_elapsed(cur, prev),
        "jerk": jerk(cur, prev, before_prev),
        "turn_rate": turn_rate(cur, prev),
        "turn_rate_speed_ratio": turn_speed_ratio(cur, prev),
        "actual_speed_knots": cur["speed_raw"],
    }


def place_columns() -> dict[str, Column]:
    """Features that need nothing but the row itself."""
    lat, lon, speed = F.col("lat_raw"), F.col("lon_raw"), F.col("speed_raw")
    terminal = geo.great_circle_nm(lat, lon, *TERMINAL)
    raster = geo.raster_distance(lat, lon)
    hour_sin, hour_cos = fields.hour_cycle(F.col("datetime"))
    day_sin, day_cos = fields.weekday_cycle(F.col("datetime"))
    return {
        "hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos,
        **fields.phases(speed),
        "distance_to_port_nm": geo.great_circle_nm(lat, lon, *PORT),
        "bearing_to_port": geo.bearing_deg(lat, lon, *PORT),
        "distance_to_terminal_nm": terminal,
        "harbor_basin_proximity": geo.proximity(terminal),
        "distance_to_coast_nm": raster,
        "distance_to_land_raster": raster,
        "flag_land_ingress": (raster == 0.0).cast("int"),
    }


class RowView:
    """Field access on a flat row, so current and previous rows read alike."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def current() -> RowView:
    return RowView()


def with_previous(df: DataFrame, track: Track = BY_SEQUENCE, lags: int = 2) -> DataFrame:
    return stitch(df, track, Stitch(carry=CARRY, lags=lags))


def motion_features(df: DataFrame, track: Track = BY_SEQUENCE) -> DataFrame:
    """All lag features; ``track`` chooses the partition and the row order."""
    rows = with_previous(df, track)
    columns = motion_columns(current(), F.col("prev1"), F.col("prev2"))
    return rows.withColumns(columns).drop("prev1", "prev2")


def place_features(df: DataFrame) -> DataFrame:
    return df.withColumns(place_columns())
