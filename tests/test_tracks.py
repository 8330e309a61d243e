"""Slice-stitched tracks against plain loops, and the properties of trips."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, plan_text, random_tracks, values
from wakeline.operators import kinematics, quality, segmentation, slices
from wakeline.operators.slices import Stitch, Track, dense_sequence, fitted, running_sum, stitch
from wakeline.plans import ingest

WIDTHS = [7, 500, 10_000_000]


def by_time(width):
    return Track(width=width)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("seed", [1, 2])
def test_stitch_equals_loop(spark, width, seed):
    pdf = random_tracks(random.Random(seed))
    out = stitch(spark.createDataFrame(pdf), by_time(width), Stitch(
        carry=["timestamp_sec", "speed_raw"], lags=2, leads=1,
        counters={"fast": lambda c, p: c["speed_raw"] > p["speed_raw"]},
        fills={"seen": (lambda c, p: c["speed_raw"] > 10, lambda c, p: c["timestamp_sec"])}))
    got = {r["global_lsn"]: r for r in out.collect()}
    assert len(got) == len(pdf)
    for _, group in pdf.groupby("vessel_id_int"):
        rows = group.sort_values(["timestamp_sec", "global_lsn"]).to_dict("records")
        fast, seen = 0, None
        for i, row in enumerate(rows):
            r = got[row["global_lsn"]]
            before = lambda k: rows[i - k]["global_lsn"] if i >= k else None
            assert (r["prev1"] and r["prev1"]["global_lsn"]) == before(1)
            assert (r["prev2"] and r["prev2"]["global_lsn"]) == before(2)
            after = rows[i + 1]["global_lsn"] if i + 1 < len(rows) else None
            assert (r["next1"] and r["next1"]["global_lsn"]) == after
            fast += i > 0 and row["speed_raw"] > rows[i - 1]["speed_raw"]
            seen = row["timestamp_sec"] if row["speed_raw"] > 10 else seen
            assert (r["fast"], r["seen"]) == (fast, seen)


@pytest.mark.parametrize("width", WIDTHS)
def test_running_sum_and_trips_do_not_depend_on_slices(spark, width):
    df = spark.createDataFrame(random_tracks(random.Random(3), rows=200))
    base = values(segmentation.assign_class_trips(df, by_time(10**9)).select("global_lsn", "static_seconds", "trip_no"), "global_lsn")
    assert values(segmentation.assign_class_trips(df, by_time(width)).select("global_lsn", "static_seconds", "trip_no"), "global_lsn") == base
    one = df.withColumn("one", F.lit(1).cast("bigint"))
    rows = running_sum(one, by_time(width), "one", "n").orderBy("vessel_id_int", "timestamp_sec", "global_lsn").collect()
    seen = {}
    for r in rows:
        seen[r["vessel_id_int"]] = seen.get(r["vessel_id_int"], 0) + 1
        assert r["n"] == seen[r["vessel_id_int"]]


def test_crowded_slices_are_cut_for_their_vessel_alone(spark):
    busy = spark.range(1_000).selectExpr("1L as vessel_id_int", "id as timestamp_sec", "id as global_lsn")
    quiet = spark.range(50).selectExpr("2L as vessel_id_int", "id * 20 as timestamp_sec", "id + 5000 as global_lsn")
    df = busy.unionByName(quiet).withColumn("one", F.lit(1).cast("bigint"))
    track = fitted(df, by_time(500), 100)
    sizes = {(r["vessel_id_int"], r["_slice"]): r["count"] for r in track.sliced(df).groupBy("vessel_id_int", "_slice").count().collect()}
    assert sorted(n for (v, _), n in sizes.items() if v == 1) == [100] * 10
    assert sorted(n for (v, _), n in sizes.items() if v == 2) == [25, 25]
    whole = values(running_sum(df, by_time(500), "one", "n").select("global_lsn", "n"), "global_lsn")
    assert values(running_sum(df, track, "one", "n").select("global_lsn", "n"), "global_lsn") == whole
    assert fitted(df.limit(0), by_time(500)).dense.count() == 0


def test_trips_and_runs_fit_their_slices(spark, monkeypatch):
    """Over half of the rows are one vessel's, within one slice; no slice keeps much more than the limit."""
    df = spark.createDataFrame(random_tracks(random.Random(8), rows=400, span=20_000))
    calls = {
        "trips": lambda: segmentation.assign_trips(df).select("global_lsn", "trip_id"),
        "class": lambda: segmentation.assign_class_trips(df).select("global_lsn", "static_seconds", "trip_no"),
    }
    whole = {n: values(f(), "global_lsn") for n, f in calls.items()}
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", 20)
    stitched, largest = segmentation.stitch, []

    def watched(rows, track, what):
        largest.append(track.sliced(rows).groupBy(*track.key, "_slice").count().agg({"count": "max"}).first()[0])
        return stitched(rows, track, what)

    monkeypatch.setattr(segmentation, "stitch", watched)
    assert {n: values(f(), "global_lsn") for n, f in calls.items()} == whole
    assert len(largest) == 2 and max(largest) <= 50


def test_trip_counters(spark):
    rows = [(0, 0, 5.0), (1, 600, 5.0), (2, 3000, 5.0), (3, 3100, 0.5)]
    df = frame(spark, [(1, t, lsn, s) for lsn, t, s in rows], "vessel_id_int long, timestamp_sec long, global_lsn long, speed_raw double")
    assert [r[0] for r in values(segmentation.assign_trips(df, by_time(700)).select("trip_no", "global_lsn"), "global_lsn")] == [0, 0, 1, 2]


def test_trip_counter_never_falls(spark):
    df = segmentation.assign_trips(spark.createDataFrame(random_tracks(random.Random(5))), by_time(900))
    last = {}
    for r in df.orderBy("vessel_id_int", "timestamp_sec", "global_lsn").collect():
        assert r["trip_no"] >= last.get(r["vessel_id_int"], 0)
        last[r["vessel_id_int"]] = r["trip_no"]


def test_every_late_static_row_breaks(spark):
    rows = [(1, i * 1000, i, 0.0, 11) for i in range(12)]
    df = frame(spark, rows, "vessel_id_int long, timestamp_sec long, global_lsn long, speed_raw double, vessel_superclass_id int")
    got = [r[0] for r in values(segmentation.assign_class_trips(df, by_time(2500)).select("trip_no", "global_lsn"), "global_lsn")]
    assert got == [0] * 8 + [1, 2, 3, 4]


def _pair(spark, a, b, seconds=30):
    cols = "vessel_id_int long, timestamp_sec long, global_lsn long, lat_raw double, lon_raw double, speed_raw double, course_raw double"
    return frame(spark, [(1, 0, 0, *a), (1, seconds, 1, *b)], cols)


def test_course_change_wraps(spark):
    for c1, c2, expected in [(350.0, 10.0, 20.0), (10.0, 350.0, -20.0), (0.0, 180.0, -180.0)]:
        rows = kinematics.motion_features(_pair(spark, (37.0, 23.0, 5.0, c1), (37.0, 23.0, 5.0, c2)))
        assert rows.where("global_lsn = 1").select("course_change").collect()[0][0] == expected


def test_gap_gates_and_log_time(spark):
    a, b = (37.90, 23.60, 5.0, 0.0), (37.91, 23.62, 9.0, 90.0)
    near = kinematics.motion_features(_pair(spark, a, b, 30)).where("global_lsn = 1").collect()[0]
    far = kinematics.motion_features(_pair(spark, a, b, 901)).where("global_lsn = 1").collect()[0]
    back = kinematics.motion_features(_pair(spark, a, b, -5)).where("global_lsn = 1").collect()[0]
    # degrees are truncated to 1e-7 before they are differenced, hence the wider tolerance
    assert near["geodetic_distance_nm"] == pytest.approx(1.121693, abs=1e-5)
    assert near["log_time_diff"] == pytest.approx(3.433987, abs=1e-6)
    assert near["acceleration"] == pytest.approx(4 / 30) and near["jerk"] == pytest.approx(4 / 900)
    assert far["acceleration"] == far["jerk"] == far["turn_rate"] == far["geodetic_distance_nm"] == 0.0
    assert far["course_change"] == 90.0
    assert back["log_time_diff"] == 0.0
    first = kinematics.motion_features(_pair(spark, a, b)).where("global_lsn = 0").collect()[0]
    assert first["log_time_diff"] == pytest.approx(math.log(2)) and first["geodetic_distance_nm"] == 0.0


def test_frozen_position(spark):
    rows = _pair(spark, (37.9, 23.6, 5.0, 0.0), (37.9, 23.6, 5.0, 0.0), 5_000)
    assert values(quality.frozen_positions(rows).select("global_lsn", "flag_frozen_position"), "global_lsn") == [(0, 0), (1, 1)]


def test_dense_sequence(spark):
    pdf = random_tracks(random.Random(9))
    day, hour = F.floor(F.col("timestamp_sec") / 9000), F.floor(F.col("timestamp_sec") / 300)
    out = dense_sequence(spark.createDataFrame(pdf), ["timestamp_sec", "global_lsn"], "n", day, hour, start=5)
    got = [r["n"] for r in out.orderBy("timestamp_sec", "global_lsn").collect()]
    assert got == list(range(5, 5 + len(pdf)))


def test_first_and_latest_rows(spark):
    df = frame(spark, [(1, 10, 3, "a"), (1, 5, 4, "b"), (2, 7, 1, None)], "vessel_id_int long, timestamp_sec long, global_lsn long, x string")
    assert values(segmentation.first_rows(df).select("vessel_id_int", "x"), "vessel_id_int") == [(1, "b"), (2, None)]
    assert values(segmentation.latest_rows(df).select("vessel_id_int", "x"), "vessel_id_int") == [(1, "b"), (2, None)]


def test_feature_plan_shape(spark):
    """No Python, no cartesian product, no window over a bare vessel except on the summary."""
    from wakeline.plans import views

    df = ingest.feature_table(views.tracks(spark, "/root/testdata/sf0.001"))
    text = plan_text(df)
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert text.count("Exchange hashpartitioning(vessel_id_int") - text.count("_slice") <= 2
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_slice" in line]
    assert 2 <= len(wide) <= 3
