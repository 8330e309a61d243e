"""Registered queries against their reference SQL in DuckDB."""

import os

import duckdb
import pytest

import check
from wakeline.plans.catalog import load

SF = os.environ.get("WAKELINE_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
# A spread over every topic; WAKELINE_FULL=1 runs them all.
SPREAD = """p1_vessel_id p3_epoch_units p11_arrival_sequence p16_robust_scaling j1_ship_type_join j2_taxonomy
w7_great_circle_displacement w8_acceleration_turn_jerk w9_frozen_position w11_static_duration w12_class_trips w13_trip_assign
entry_trip_summary j4_trip_offset f4_raster_distance f16_hash_group j6_lattice_gaps j7_trilinear_weather j8_asof_join
a5_cohort_scales a6_weather_scales j14_hold_forward w17_grid_windows a10_window_statistics t2_cohort_neighbours
t3_distinct_peers w22_prototype_drift w23_rolling_threshold a12_distance_anchors a15_auroc a20_threshold_frontier
a21_best_f1_threshold f15_scenario_delta a23_attribution a26_weighted_loss s2_header_probe s9_row_slice m2_state_upsert
m4_carried_rows m8_streaming_drift m9_gap_sessions""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"a31_effective_rank", "x3_linear_encoder"}
    assert set(SPREAD) <= set(QUERIES)


def test_every_operator_is_registered():
    have = {n.split("_")[0].upper() for n in QUERIES}
    sizes = {"S": 13, "P": 21, "J": 18, "A": 34, "W": 23, "T": 7, "U": 3, "F": 20, "M": 9, "X": 4}
    assert {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)} <= have


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("WAKELINE_FULL") else SPREAD)
def test_matches_sql(spark, con, name):
    status, note, _ = check.compare(name, QUERIES[name](spark, SF), ORACLES.get(name), con)
    assert status in ("ok", "ROWS"), note


@pytest.mark.parametrize("name", ["w12_class_trips", "w17_grid_windows", "j16_linear_grid"])
def test_chained_scans_read_the_source_at_most_twice(spark, name):
    from tests.helpers import plan_text

    assert plan_text(QUERIES[name](spark, SF)).count("events.parquet") <= 2


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
