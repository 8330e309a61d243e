"""State, carried rows and online operators."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, plan_text, random_tracks, values
from wakeline.operators import drift, segmentation
from wakeline.session import shared_folder, stored
from wakeline.sources import lake, positions
from wakeline.streaming import ingest, latest, sessions
from wakeline.streaming import state as states
from wakeline.streaming.state import STATE, StateTable


def test_drift_fixture(spark):
    rows = [(i, 1, i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])]
    df = frame(spark, rows, "embedding_id long, vessel_id_int long, timestamp_sec long, embedding array<double>")
    got = [r[0] for r in values(drift.prototype_drift(df).select("drift", "embedding_id"), "embedding_id")]
    assert got == pytest.approx([0.0, 1.0, 0.006116], abs=1e-6)


@pytest.mark.parametrize("piece_rows", [7, 60, 1000])
def test_long_histories_are_split_exactly(spark, piece_rows):
    """Pieces equal the plain fold, whatever their size."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < 0.7), i, [float(x) for x in rng.normal(0.5, 1, 4)]) for i in range(900)]
    df = frame(spark, rows, "embedding_id long, vessel_id_int long, timestamp_sec long, embedding array<double>")
    out = drift.prototype_drift(df, buffer=12, min_seen=5, piece_rows=piece_rows)
    got = {r["embedding_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for v in (0, 1):
        known, roll, limit = None, drift.RollingPercentile(12, 0.95), 0.45
        for i, vessel, _, vector in rows:
            if vessel != v:
                continue
            first = known is None
            d, known = drift.step(known, np.array(vector), 0.1)
            if not first:
                roll.add(d)
                limit = roll.value() if len(roll.recent) >= 5 else limit
            assert got[i]["drift"] == pytest.approx(d, abs=1e-9)
            assert got[i]["threshold"] == pytest.approx(limit, abs=1e-9)


@pytest.mark.parametrize("buffer,slice_rows", [(7, 3), (7, 11), (1, 5), (400, 50)])
def test_shared_buffer_equals_a_deque(spark, buffer, slice_rows):
    """One buffer over all vessels; one vessel holds most rows and times tie."""
    rng = random.Random(buffer)
    rows = [(i, 0 if rng.random() < .6 else rng.randrange(9), rng.randrange(60), rng.random()) for i in range(150)]
    seen_of, full = {}, []
    for i, v, t, d in sorted(rows, key=lambda r: (r[2], r[0])):
        full.append((i, v, t, seen_of.get(v, 0), d if v in seen_of else 0.0))
        seen_of[v] = seen_of.get(v, 0) + 1
    recent, want = deque(maxlen=buffer), {}
    for i, _, _, row_no, d in full:
        if row_no:
            recent.append(d)
        limit = float(np.percentile(list(recent), 95)) if len(recent) >= 5 else drift.BASE_THRESHOLD
        want[i] = (limit, int(row_no > 0 and d > limit))
    df = frame(spark, full, "embedding_id long, vessel_id_int long, timestamp_sec long, row_no long, drift double")
    out = drift.shared_threshold(df, buffer, 5, slice_rows)
    got = {r["embedding_id"]: (r["threshold"], r["outlier"]) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == pytest.approx(want[i][0]) and got[i][1] == want[i][1] for i in want)


def test_a_pass_reads_the_folder_of_its_piece(spark):
    rows = frame(spark, [(i, i // 4) for i in range(12)], "row_no long, piece long")
    one = stored(rows, "pieces", ["piece"]).where("piece = 1")
    assert len({r[0] for r in one.select(F.input_file_name()).collect()}) <= 4
    assert "PartitionFilters: [isnotnull(piece" in plan_text(one)


def test_rolling_percentile():
    import numpy as np

    rng = random.Random(0)
    roll, seen = drift.RollingPercentile(20, 0.95), []
    for _ in range(100):
        x = rng.choice([rng.random(), 0.5])
        seen.append(x)
        roll.add(x)
        assert roll.value() == pytest.approx(np.percentile(seen[-20:], 95))


def _states(spark, rows):
    full = [(v, ts, 1.0, 2.0, 3.0, 0, 0, ts, lsn) for v, ts, lsn in rows]
    return spark.createDataFrame(full, STATE)


def test_merge_is_idempotent_and_order_free(spark):
    a, b = _states(spark, [(1, 10, 5), (2, 20, 9)]), _states(spark, [(1, 8, 3), (3, 1, 1)])
    once = values(states.merged(a, b), "vessel_id_int")
    assert once == values(states.merged(b, a), "vessel_id_int")
    assert once == values(states.merged(states.merged(a, b), b), "vessel_id_int")
    assert [(r[0], r[8]) for r in once] == [(1, 5), (2, 9), (3, 1)]


MESSAGE = "vessel_id_int long, global_lsn long, timestamp_sec long, speed_raw double, lon_raw double, lat_raw double"


def _gated(spark, root, chunks, **options):
    def run(stream):
        ingest.run_available(latest.gate_latest(stream, **options), f"{root}/ckpt", ingest.numbered_batches(f"{root}/gate"))

    ingest.feed(spark, [frame(spark, c, MESSAGE) for c in chunks], f"{root}/in", run)
    state = values(latest.stored_latest(spark, f"{root}/ckpt").select("vessel_id_int", "global_lsn", "last_speed"), "vessel_id_int")
    return state, values(spark.read.parquet(f"{root}/gate").select("batch_no", "vessel_id_int", "global_lsn", "accepted"), "batch_no", "vessel_id_int")


def test_gate_state_restart_and_initial_state(spark):
    """Late rows are rejected, ties taken; a restarted query goes on, a new one starts from a given state."""
    big = 2 ** 60 + 1  # beyond what a double holds
    row = lambda v, lsn, ts=0: (v, lsn, ts, 0.5 * (lsn % 7), 1.0, 2.0)
    root = shared_folder(spark, "gate")
    state, gate = _gated(spark, root, [[row(1, 5), row(1, 4), row(2, big)], [row(1, 3), row(2, big), row(3, 1)], [row(3, 2)]])
    assert gate == [(0, 1, 5, 1), (0, 2, big, 1), (1, 1, 3, 0), (1, 2, big, 1), (1, 3, 1, 1), (2, 3, 2, 1)]
    assert [s[:2] for s in state] == [(1, 5), (2, big), (3, 2)] and state[0][2] == 2.5
    # what a batch before left behind can still be read
    assert [r[0] for r in values(latest.stored_latest(spark, f"{root}/ckpt", batch=0).select("global_lsn"), "global_lsn")] == [5, big]
    again, gate = _gated(spark, shared_folder(spark, "cold"), [[row(1, 4), row(4, 9)]], initial=latest.stored_latest(spark, f"{root}/ckpt"))
    assert gate == [(0, 1, 4, 0), (0, 4, 9, 1)] and [s[:2] for s in again] == [(1, 5), (2, big), (3, 2), (4, 9)]


def test_vessels_not_seen_are_forgotten_by_timer(spark):
    row = lambda v, lsn, ts: (v, lsn, ts, 1.0, 1.0, 2.0)
    state, _ = _gated(spark, shared_folder(spark, "ttl"), [[row(1, 1, 100), row(2, 2, 100)], [row(1, 3, 140)], [row(3, 4, 151)]], retention=50)
    assert [s[0] for s in state] == [1, 3]


def test_sequence_continues_over_csv_chunks_and_replay(spark):
    root = shared_folder(spark, "sequence")
    handle = ingest.sequenced(f"{root}/out", ["timestamp", "mmsi_str"], F.floor(F.col("timestamp").cast("long") / 100), F.floor(F.col("timestamp").cast("long") / 10), start=7)
    rows = [[(str(100 * c + 3 * i), f"{i % 2}", 1.0, 2.0, 3.0, 4.0, 5.0) for i in range(n)] for c, n in enumerate((20, 1, 33))]
    chunks = [spark.createDataFrame(r, positions.RAW_SCHEMA).repartition(3) for r in rows]
    ingest.feed_csv(spark, chunks, f"{root}/in", lambda s: ingest.run_available(s, f"{root}/ckpt", handle))
    read = lambda: values(spark.read.parquet(f"{root}/out/rows").select("global_lsn", "batch_no", "timestamp"), "global_lsn")
    got = read()
    assert [g[0] for g in got] == list(range(7, 61)) and [g[1] for g in got] == [0] * 20 + [1] + [2] * 33
    assert [g[2] for g in got] == [r[0] for part in rows for r in part]
    handle(chunks[1], 1)  # the same batch once more
    assert read() == got


def test_carried_rows_respect_the_limit(spark):
    cols = "vessel_id_int long, timestamp_sec long, global_lsn long, speed_raw double, lon_raw double, lat_raw double, course_raw double, extra string"
    batch = frame(spark, [(v, 10_000, 50 + v, 1.0, 2.0, 3.0, 4.0, "x") for v in (1, 2, 3, 4)], cols)
    old = _states(spark, [(1, 6_400, 1), (2, 6_399, 2), (3, 10_000, 3), (9, 9_999, 4)])
    ghosts = ingest.with_carried_rows(batch, old).where("is_ghost = 1").collect()
    assert [(g["vessel_id_int"], g["extra"]) for g in ghosts] == [(1, None)]


@pytest.mark.parametrize("parts", [1, 3])
def test_trips_in_batches_equal_one_batch(spark, parts):
    tracks = spark.createDataFrame(random_tracks(random.Random(7), rows=90)).repartition(3)
    expected = values(segmentation.assign_trips(tracks).select("global_lsn", "trip_id"), "global_lsn")
    root = shared_folder(spark, "test")
    size = 40_000 // parts + 1
    chunks = [tracks.where(F.floor(F.col("timestamp_sec") / size) == c) for c in range(parts)]
    handle = ingest.trips_with_state(StateTable(spark, f"{root}/state"), f"{root}/out")
    ingest.feed(spark, chunks, f"{root}/in", lambda s: ingest.run_available(s, f"{root}/ckpt", handle))
    assert values(spark.read.parquet(f"{root}/out").select("global_lsn", "trip_id"), "global_lsn") == expected


def test_replayed_batch_changes_nothing(spark):
    tracks = spark.createDataFrame(random_tracks(random.Random(8), rows=40))
    root = shared_folder(spark, "replay")
    table = StateTable(spark, f"{root}/state")
    handle = ingest.trips_with_state(table, f"{root}/out")
    handle(tracks.where("timestamp_sec < 20000"), 0)
    handle(tracks.where("timestamp_sec >= 20000"), 1)
    before = values(table.after(1), "vessel_id_int")
    handle(tracks.where("timestamp_sec >= 20000"), 1)
    assert values(table.after(1), "vessel_id_int") == before


def test_session_gap_edge(spark):
    df = frame(spark, [(1, 0), (1, 1_800), (1, 3_601)], "vessel_id_int long, timestamp_sec long")
    got = values(sessions.gap_sessions(df).select("start_sec", "end_sec", "points"), "start_sec")
    assert got == [(0, 1_800, 2), (3_601, 3_601, 1)]


def test_mixed_headers(spark):
    root = shared_folder(spark, "csv")
    lines = ["﻿Timestamp,vessel_id,lon,lat,heading,speed,course", "100,7,23.1,37.5,1,2,3", "200,8,x,37.5,1,,3"]
    frame(spark, [(line,) for line in lines], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{root}/t")
    text = spark.read.schema(positions.TEXT_SCHEMA).csv(f"{root}/t")
    got = values(positions.typed_positions(text).select("timestamp", "mmsi_str", "lon_raw", "speed_raw"), "timestamp")
    assert got == [("100", "7", 23.1, 2.0), ("200", "8", None, None)]


def test_lake_prunes_and_overwrites_partitions(spark):
    path = shared_folder(spark, "lake")
    rows = frame(spark, [(2018, 5, 0, 1), (2019, 6, 0, 2), (2019, 7, 1, 3)], "year int, month int, vessel_bucket int, x int")
    lake.write_lake(rows, path)
    lake.write_lake(rows.where("month = 7").withColumn("x", F.lit(9)), path)
    assert values(lake.read_lake(spark, path).select("x"), "x") == [(1,), (2,), (9,)]
    pruned = lake.read_lake(spark, path, lake.up_to(2019, 6, 2018), ["x"])
    assert values(pruned, "x") == [(1,), (2,)]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(" in plan


def test_embedding_shards(spark):
    path = shared_folder(spark, "emb")
    df = frame(spark, [(i, [1.0, 2.0]) for i in range(25)], "embedding_id long, embedding array<double>").coalesce(1)
    lake.append_embeddings(df, path, 2, shard_rows=10)
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() == 3
    with pytest.raises(Exception, match="embedding must have 3"):
        lake.append_embeddings(df, path, 3)


def test_stored_reads_back(spark):
    assert values(stored(spark.range(3), "t"), "id") == [(0,), (1,), (2,)]
