"""Feature registry, class vocabularies and other fixed values."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Names, order and codes must stay exactly as they are, because
# feature order, ledgers and stored cohort ids depend on them.
# ---------------------------------------------------------------------------
PHYSICS = [
    "speed_raw", "actual_speed_knots", "course_change", "acceleration", "turn_rate", "jerk",
    "delta_x_nm", "delta_y_nm", "course_sin", "course_cos", "log_time_diff",
    "distance_to_port_nm", "bearing_to_port", "turn_rate_speed_ratio",
]
WEATHER = [
    "wind_speed", "wind_direction", "temperature", "visibility", "gust_factor", "pressure",
    "humidity", "headwind_component", "crosswind_component",
]
CONTEXT = [
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "voyage_phase_anchoring", "voyage_phase_cruising", "voyage_phase_departure",
    "voyage_phase_maneuvering",
    "distance_to_coast_nm", "distance_to_terminal_nm", "harbor_basin_proximity",
    "distance_to_land_raster",
]
QUALITY = [
    "flag_speed_anomaly", "flag_frozen_position", "flag_position_jump", "flag_null_course",
    "reliability_score", "flag_land_ingress",
]
FEATURES = PHYSICS + WEATHER + CONTEXT + QUALITY

SCALED = PHYSICS + WEATHER + [
    "distance_to_coast_nm", "distance_to_terminal_nm", "harbor_basin_proximity",
    "distance_to_land_raster", "turn_rate_speed_ratio",
]
TARGETS = [
    "speed_raw", "course_change", "acceleration", "turn_rate", "jerk", "delta_x_nm",
    "delta_y_nm", "turn_rate_speed_ratio", "wind_speed", "visibility", "headwind_component",
]
DERIVED_TARGETS = [
    "acceleration", "jerk", "turn_rate", "turn_rate_speed_ratio", "harbor_basin_proximity",
    "distance_to_piraeus", "berth_zone_score",
]
MIN_TARGET_SCALE = 0.01
CIRCLE_PAIRS = [("course_sin", "course_cos"), ("hour_sin", "hour_cos"), ("day_sin", "day_cos")]

SUPERCLASS = {
    "Unknown": 0, "Reserved": 1, "WIG": 2, "Fishing": 3, "TugTowing": 4, "SpecialOps": 5,
    "Military": 6, "PleasureSailing": 7, "HighSpeed": 8, "ServiceVessel": 9, "Passenger": 10,
    "Cargo": 11, "Tanker": 12, "Other": 13,
}
BEHAVIOUR = {
    "Generic": 0, "Hazardous": 1, "Trawling": 2, "StandardTug": 3, "LargeTug": 4, "Dredging": 5,
    "Diving": 6, "Tactical": 7, "Sailing": 8, "Leisure": 9, "HighSpeedTransit": 10, "SAR": 11,
    "PilotVessel": 12, "PortService": 13, "TransitFerry": 14, "DeepSea": 15, "LiquidBulk": 16,
    "Standard": 17,
}
# Ship-type codes and the (superclass, behaviour) they stand for.
TYPE_CODES = [
    (range(1, 20), "Reserved", "Generic"),
    ([30], "Fishing", "Trawling"),
    ([31, 52], "TugTowing", "StandardTug"),
    ([32], "TugTowing", "LargeTug"),
    ([33], "SpecialOps", "Dredging"),
    ([34], "SpecialOps", "Diving"),
    ([35], "Military", "Tactical"),
    ([36], "PleasureSailing", "Sailing"),
    ([37], "PleasureSailing", "Leisure"),
    ([40, 45, 46, 47, 48, 49], "HighSpeed", "HighSpeedTransit"),
    ([50], "ServiceVessel", "PilotVessel"),
    ([51], "ServiceVessel", "SAR"),
    (range(53, 60), "ServiceVessel", "PortService"),
    ([60, 65, 66, 67, 68, 69], "Passenger", "TransitFerry"),
    ([70, 75, 76, 77, 78, 79], "Cargo", "DeepSea"),
    ([80, 85, 86, 87, 88, 89], "Tanker", "LiquidBulk"),
]
# Codes ending in 1-4 mark hazardous cargo. As published, their class id is the
# tens digit; the true class of each decade is kept for ``corrected=True``.
HAZARD_DECADES = {2: "WIG", 4: "HighSpeed", 6: "Passenger", 7: "Cargo", 8: "Tanker", 9: "Other"}

# (velocity floor in knots, anchor limit in seconds) by superclass.
CLASS_LIMITS = {3: (0.2, 28800), 4: (0.4, 14400), 11: (1.0, 7200), 12: (1.0, 7200)}
DEFAULT_LIMITS = (0.5, 14400)

PORT = (37.93757531153567, 23.620630391770646)
TERMINAL = (37.964200, 23.610500)
EARTH_RADIUS_NM = 3440.065
RASTER = {"lat_max": 38.1, "lon_min": 23.1, "res": 0.001, "rows": 600, "cols": 899}
RASTER_OUTSIDE_NM = 5.0
LAND_BOX = (38.05, 23.93)
COASTLINE = [
    (37.6502, 24.0201), (37.7815, 23.7504), (37.8620, 23.7408), (37.9401, 23.6652),
    (37.9354, 23.6248), (37.9482, 23.6121), (37.9645, 23.6102), (37.9621, 23.5654),
    (37.9504, 23.5412), (37.9298, 23.5391), (37.8812, 23.4605), (37.9450, 23.5011),
    (37.9422, 23.5154),
]

WEATHER_ALIASES = {
    "temperature": "TMP", "gust_factor": "GUST", "visibility": "VIS", "wind_speed": "WSPD",
    "wind_direction": "WDIRMET", "pressure": "PRMSL", "humidity": "RH", "zonal_wind": "UGRD",
    "meridional_wind": "VGRD", "timestamp_sec": "timestamp_",
}
MESH_REQUIRED = ["timestamp_", "lon", "lat", "TMP", "GUST", "PRMSL", "RH", "UGRD", "VGRD"]
MESH_VARIABLES = ["TMP", "GUST", "VIS", "PRMSL", "RH", "UGRD", "VGRD"]
DEFAULT_VISIBILITY_M = 10000.0
WEATHER_DEFAULTS = {
    "wind_speed": (4.5, 3.0), "wind_direction": (180.0, 90.0), "temperature": (293.15, 8.0),
    "visibility": (10000.0, 2000.0), "gust_factor": (6.0, 4.0), "pressure": (101325.0, 800.0),
    "humidity": (75.0, 15.0), "headwind_component": (0.0, 4.0),
    "crosswind_component": (0.0, 4.0),
}
# Quality penalties taken off a reliability of 1.
PENALTIES = {
    "flag_speed_anomaly": 0.30, "flag_position_jump": 0.50, "flag_frozen_position": 0.20,
    "flag_null_course": 0.05, "long_gap": 0.10, "flag_land_ingress": 0.80,
}
SCENARIOS = ["dead_reckoning", "coastal_creep", "loitering"]
FRONTIER_PERCENTILES = [90.0, 92.5, 95.0, 97.5, 98.0, 99.0, 99.5, 99.7, 99.9]
TIERS = ["critical", "reconstruction", "manifold", "normal"]
# ------------------------------- end of fixed values -----------------------

SCHEMA_HASH = hashlib.md5(",".join(FEATURES).encode()).hexdigest()


def group_of(feature: str) -> str:
    groups = (("physics", PHYSICS), ("weather", WEATHER), ("context", CONTEXT), ("quality", QUALITY))
    return next(name for name, members in groups if feature in members)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as a literal relation, so that reading it starts no job."""

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("'", "\\'") + "'"
        return f"{value!r}D" if isinstance(value, float) else str(value)

    fields = [f.split() for f in schema.split(",")]
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in fields)
        return spark.sql(f"SELECT {nulls} WHERE false")
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def features_frame(spark: SparkSession) -> DataFrame:
    """One row per feature: name, group, position, and whether it is scaled or a target."""
    rows = [(f, group_of(f), i, f in SCALED, f in TARGETS) for i, f in enumerate(FEATURES)]
    return inline(spark, rows, "feature string, grp string, ordinal int, scaled boolean, target boolean")


def taxonomy_rows(corrected: bool = False) -> list[tuple[int, int, int]]:
    """(code, superclass, behaviour) for every code that decodes to a known class."""
    rows = [
        (code, SUPERCLASS[cls], BEHAVIOUR[beh])
        for codes, cls, beh in TYPE_CODES
        for code in codes
    ]
    for tens, cls in HAZARD_DECADES.items():
        class_id = SUPERCLASS[cls] if corrected else tens
        rows += [(tens * 10 + i, class_id, BEHAVIOUR["Hazardous"]) for i in range(1, 5)]
    return sorted(rows)


def taxonomy_frame(spark: SparkSession, corrected: bool = False) -> DataFrame:
    """Ship-type dimension; codes are 0-99, so it can always be broadcast."""
    return inline(
        spark, taxonomy_rows(corrected), "shiptype bigint, vessel_superclass_id int, vessel_behavior_id int")
