"""Small frames and plan text for tests."""

from __future__ import annotations

import pandas as pd


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *order):
    rows = df.orderBy(*order).collect() if order else df.collect()
    return [tuple(r) for r in rows]


def one(df):
    return df.collect()[0][0]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def random_tracks(rng, vessels=4, rows=120, span=40_000) -> pd.DataFrame:
    """Uneven tracks; one vessel holds most rows."""
    n = rows
    ids = [0 if rng.random() < 0.5 else rng.randrange(1, vessels) for _ in range(n)]
    ts = sorted(rng.randrange(span) for _ in range(n))
    return pd.DataFrame({
        "global_lsn": range(n), "vessel_id_int": ids, "timestamp_sec": ts,
        "lat_raw": [37.5 + rng.random() * 0.6 for _ in range(n)],
        "lon_raw": [23.1 + rng.random() * 0.9 for _ in range(n)],
        "speed_raw": [rng.choice([0.1, 0.7, 3.0, 12.0]) for _ in range(n)],
        "course_raw": [float(rng.randrange(360)) for _ in range(n)],
        "vessel_superclass_id": [(i * 3) % 14 for i in ids],
    })
