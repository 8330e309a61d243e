"""Hand-computed values of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, one, values
from wakeline import registry
from wakeline.functions import fields, geo, scoring
from wakeline.operators import clean


def test_vessel_id(spark):
    df = frame(spark, [("123456789",), ("a0123456789abcde",), ("12zz",), ("9" * 25,), ("",)], "t string")
    got = [r[0] for r in df.select(fields.vessel_id(F.col("t"))).collect()]
    assert got == [123456789, 5124095576030430, 0, 0, 0]


def test_epoch_seconds(spark):
    texts = ["1561939201", "1561939201000", "1561939201000000", "1561939201000000000", "x", None]
    df = frame(spark, [(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fields.epoch_seconds(F.col("t"))).collect()] == [1561939201] * 4 + [None] * 2


@pytest.mark.parametrize("code,expected", [
    (70.0, (11, 15)), (71.0, (7, 1)), (31.0, (4, 3)), (52.0, (4, 3)), (38.0, (0, 0)), (None, (0, 0)),
    (float("nan"), (0, 0)), (25.0, (0, 0)), (90.0, (0, 0)), (91.0, (9, 1)), (5.0, (1, 0))])
def test_taxonomy(spark, code, expected):
    out = clean.with_taxonomy(frame(spark, [(code,)], "shiptype double"))
    assert values(out.select("vessel_superclass_id", "vessel_behavior_id")) == [expected]


def test_taxonomy_corrected(spark):
    out = clean.with_taxonomy(frame(spark, [(71.0,), (81.0,)], "shiptype double"), corrected=True)
    assert values(out.select("shiptype", "vessel_superclass_id"), "shiptype") == [(71.0, 11), (81.0, 12)]


def test_registry_shape(spark):
    assert len(registry.FEATURES) == 41 and len(registry.SCALED) == 28 and len(registry.TARGETS) == 11
    assert registry.features_frame(spark).count() == 41
    assert len(registry.SCHEMA_HASH) == 32


def test_great_circle_and_bearing(spark):
    df = spark.range(1)
    assert one(df.select(geo.great_circle_nm(37.90, 23.60, 37.91, 23.62))) == pytest.approx(1.121693, abs=1e-6)
    assert one(df.select(geo.great_circle_nm(37.90, 23.60, 37.90, 23.60))) == pytest.approx(0.217569, abs=1e-6)
    assert one(df.select(geo.great_circle_nm(37.90, 23.60, *registry.PORT))) == pytest.approx(2.458566, abs=1e-6)
    terminal = geo.great_circle_nm(37.90, 23.60, *registry.TERMINAL)
    assert one(df.select(terminal)) == pytest.approx(3.886537, abs=1e-6)
    assert one(df.select(geo.proximity(terminal))) == pytest.approx(2.089984e-05, rel=1e-5)
    assert one(df.select(geo.bearing_deg(37.90, 23.60, *registry.PORT))) == pytest.approx(23.412497, abs=1e-6)


def test_raster(spark):
    df = frame(spark, [(37.8995, 23.6005), (30.0, 23.6005), (38.0995, 23.9405), (38.1005, 23.5)], "lat double, lon double")
    got = [r[0] for r in df.select(geo.raster_distance(F.col("lat"), F.col("lon"))).collect()]
    assert got[0] == pytest.approx(2.593361, abs=1e-5)
    assert got[1] == 5.0 and got[2] == 0.0
    assert got[3] != 5.0  # truncation toward zero: up to one cell above the top edge is row 0


def test_wind(spark):
    u, v, c = F.lit(3.0), F.lit(-4.0), F.lit(90.0)
    row = spark.range(1).select(
        geo.wind_speed(u, v), geo.wind_direction(u, v), geo.headwind(u, v, c), geo.crosswind(u, v, c),
        geo.wind_direction(F.lit(0.0), F.lit(0.0)), geo.wind_direction_valid(F.lit(0.0), F.lit(0.0))).collect()[0]
    assert row[0] == 5.0 and row[1] == pytest.approx(323.130102, abs=1e-6)
    assert row[2] == pytest.approx(-3.0) and row[3] == pytest.approx(4.0)
    assert math.isnan(row[4]) and row[5] == 0


def test_reliability(spark):
    zero = {n: F.lit(0) for n in ("flag_position_jump", "flag_frozen_position", "flag_null_course")}
    fast = scoring.reliability({**zero, "flag_speed_anomaly": F.lit(1), "flag_land_ingress": F.lit(0)}, F.lit(1.0))
    lost = scoring.reliability({**zero, "flag_speed_anomaly": F.lit(1), "flag_position_jump": F.lit(1),
                                "flag_land_ingress": F.lit(1)}, F.lit(9.0))
    assert one(spark.range(1).select(fast)) == pytest.approx(0.70)
    assert one(spark.range(1).select(lost)) == 0.0


def test_fusion_gate_display(spark):
    df = spark.range(1)
    assert one(df.select(scoring.fused(F.lit(0.6), F.lit(0.3)))) == pytest.approx(0.627)
    assert one(df.select(scoring.rescaled_distance(F.lit(0.3), F.lit(0.1467), F.lit(0.4984)))) == pytest.approx(0.435883, abs=1e-6)
    assert one(df.select(scoring.rescaled_distance(F.lit(0.1), F.lit(0.1467), F.lit(0.4984)))) == 0.0
    status, score = scoring.presentation(F.lit(0.96), F.lit(0.96), F.lit(1.0), F.lit(1.0))
    assert df.select(status, score).collect()[0][:] == ("JOINT", pytest.approx(0.5225))


def test_md5_groups(spark):
    df = frame(spark, [("1_0",), ("2_100",)], "t string")
    assert [r[0] for r in df.select(scoring.md5_mod(F.col("t"))).collect()] == [2, 2]


def test_required_columns_and_conformance(spark):
    with pytest.raises(ValueError, match="missing columns"):
        clean.require_columns(spark.range(1), ["id", "nope"], "x")
    assert clean.conform(spark.range(1)).schema == clean.CANONICAL


def test_scaling_edges(spark):
    df = spark.range(1)
    assert one(df.select(scoring.robust_scaled(F.lit(3.0), F.lit(1.0), F.lit(1e-9)))) == 2.0
    assert one(df.select(scoring.robust_scaled(F.lit(3.0), F.lit(None).cast("double"), F.lit(2.0)))) == 3.0
    for value, expected in [(float("inf"), 50.0), (float("-inf"), -50.0), (float("nan"), 0.0), (7.0, 7.0)]:
        assert one(df.select(scoring.sanitised(F.lit(value)))) == expected
