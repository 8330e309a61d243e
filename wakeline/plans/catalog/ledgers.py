"""Scale ledgers, scaling, audits and fitted scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import kinematics, ledger
from wakeline.plans import views
from wakeline.plans.catalog.base import MOTION, TRACKS, query, r6, with_blocks
from wakeline.registry import DERIVED_TARGETS, FEATURES, TARGETS, WEATHER, WEATHER_DEFAULTS, inline
from wakeline.session import stored

NAMES = ["speed_raw", "course_change", "acceleration", "turn_rate", "jerk", "delta_x_nm", "delta_y_nm",
         "course_sin", "course_cos", "log_time_diff", "turn_rate_speed_ratio"]
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT global_lsn, vessel_superclass_id AS cohort, '{n}' AS feature, {n}::DOUBLE AS value FROM motion WHERE speed_raw > 0.5"
    for n in NAMES) + ")"
GLOBAL = """g AS (SELECT feature, quantile_cont(value, 0.5) AS center,
  CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 1e-5
  THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1.0 END AS scale FROM long GROUP BY 1)"""
COHORTS = ["""sizes AS (SELECT vessel_superclass_id AS cohort FROM motion WHERE speed_raw > 0.5 GROUP BY 1 HAVING count(*) >= 50)""",
    """co AS (SELECT cohort, feature, quantile_cont(value, 0.5) AS center,
  CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 1e-5
  THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1.0 END AS scale FROM long
  WHERE cohort IN (SELECT cohort FROM sizes) GROUP BY 1, 2)""",
    """ledger AS (SELECT c.cohort, g.feature, coalesce(co.center, g.center) AS center, coalesce(co.scale, g.scale) AS scale
  FROM g, range(1, 14) c(cohort) LEFT JOIN co ON co.cohort = c.cohort AND co.feature = g.feature
  UNION ALL SELECT 0, feature, center, scale FROM g)"""]
LEDGER = [LONG, GLOBAL, *COHORTS]


def _rows(spark, sf):
    """Features as a stored table, the way the ledger is built from the lake."""
    columns = ["global_lsn", "vessel_superclass_id", "geodetic_distance_nm", *NAMES]
    return stored(kinematics.motion_features(views.tracks(spark, sf)).select(*columns), "features")


def _ledger(rows):
    return stored(ledger.cohort_scales(ledger.moving(rows), NAMES), "ledger")


def _round(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


@query("a3_spatial_envelope", with_blocks(["raw"], """SELECT floor((min(lon_raw)-0.05::DOUBLE)*20)/20.0::DOUBLE AS lon_min,
  ceil((max(lon_raw)+0.05::DOUBLE)*20)/20.0::DOUBLE AS lon_max, floor((min(lat_raw)-0.05::DOUBLE)*20)/20.0::DOUBLE AS lat_min,
  ceil((max(lat_raw)+0.05::DOUBLE)*20)/20.0::DOUBLE AS lat_max FROM raw WHERE speed_raw > 0.5"""))
def a3(spark, sf):
    return ledger.envelope(ledger.moving(views.raw_tracks(spark, sf)))


@query("a4_global_scales", with_blocks(MOTION, "SELECT feature, r6(center) AS center, r6(scale) AS scale FROM g", extra=[LONG, GLOBAL]))
def a4(spark, sf):
    return _round(ledger.global_scales(ledger.moving(_rows(spark, sf)), NAMES), "center", "scale")


@query("a5_cohort_scales", with_blocks(MOTION, "SELECT cohort::INT AS cohort, feature, r6(center) AS center, r6(scale) AS scale FROM ledger", extra=LEDGER))
def a5(spark, sf):
    return _round(_ledger(_rows(spark, sf)), "center", "scale")


WEATHER_VALUES = "SELECT event_id, value AS wind_speed, 280.0::DOUBLE + value/10.0 AS temperature, 5.0::DOUBLE AS humidity FROM events"


def _weather_rows(spark, sf):
    v = F.col("value")
    return views.table(spark, sf, "events").select(
        "event_id", v.alias("wind_speed"), (F.lit(280.0) + v / 10.0).alias("temperature"), F.lit(5.0).alias("humidity"))


DEFAULTS_SQL = ", ".join(f"('{f}', {c}::DOUBLE, {s}::DOUBLE)" for f, (c, s) in WEATHER_DEFAULTS.items())
WLEDGER = [f"wv AS ({WEATHER_VALUES})",
    """wl AS (SELECT 'wind_speed' AS feature, wind_speed AS value FROM wv UNION ALL SELECT 'temperature', temperature FROM wv
      UNION ALL SELECT 'humidity', humidity FROM wv)""",
    """wm AS (SELECT feature, quantile_cont(value, 0.5) AS center, CASE WHEN quantile_cont(value, 0.75)-quantile_cont(value, 0.25) > 1e-4
      THEN quantile_cont(value, 0.75)-quantile_cont(value, 0.25) ELSE 1.0 END AS scale FROM wl GROUP BY 1)""",
    f"wd(feature, c0, s0) AS (VALUES {DEFAULTS_SQL})",
    """weather AS (SELECT wd.feature, coalesce(center, c0) AS center, coalesce(scale, s0) AS scale FROM wd LEFT JOIN wm USING (feature))"""]


@query("a6_weather_scales", "WITH " + ", ".join(WLEDGER) + " SELECT feature, r6(center) AS center, r6(scale) AS scale FROM weather")
def a6(spark, sf):
    return _round(ledger.weather_scales(_weather_rows(spark, sf)), "center", "scale")


@query("a7_phase_weights", with_blocks(["raw"], """SELECT phase, n AS count, r6((sum(n) OVER ())::DOUBLE / (n + 1e-5)) AS weight FROM (
  SELECT 'anchoring' AS phase, count(*) FILTER (speed_raw < 1) AS n FROM raw UNION ALL SELECT 'cruising', count(*) FILTER (speed_raw >= 5) FROM raw
  UNION ALL SELECT 'departure', 0 UNION ALL SELECT 'maneuvering', count(*) FILTER (speed_raw >= 1 AND speed_raw < 5) FROM raw)"""))
def a7(spark, sf):
    from wakeline.functions import fields

    rows = views.raw_tracks(spark, sf).select(*[c.alias(n) for n, c in fields.phases(F.col("speed_raw")).items()])
    return _round(ledger.phase_weights(rows), "weight")


@query("p16_robust_scaling", with_blocks(MOTION, """SELECT m.global_lsn, r6((m.speed_raw - ls.center)/CASE WHEN abs(ls.scale) > 1e-6 THEN ls.scale ELSE 1 END) AS speed_raw,
  r6((m.turn_rate - lt.center)/CASE WHEN abs(lt.scale) > 1e-6 THEN lt.scale ELSE 1 END) AS turn_rate,
  r6((m.delta_x_nm - lx.center)/CASE WHEN abs(lx.scale) > 1e-6 THEN lx.scale ELSE 1 END) AS delta_x_nm
FROM motion m JOIN ledger ls ON ls.cohort = m.vessel_superclass_id AND ls.feature = 'speed_raw'
JOIN ledger lt ON lt.cohort = m.vessel_superclass_id AND lt.feature = 'turn_rate'
JOIN ledger lx ON lx.cohort = m.vessel_superclass_id AND lx.feature = 'delta_x_nm'""", extra=LEDGER))
def p16(spark, sf):
    names = ["speed_raw", "turn_rate", "delta_x_nm"]
    rows = _rows(spark, sf)
    out = ledger.scaled(rows, _ledger(rows), names)
    return _round(out.select("global_lsn", *names), *names)


@query("j12_cohort_scale_fallback", with_blocks(MOTION, """SELECT m.global_lsn, r6((m.speed_raw - l.center)/CASE WHEN abs(l.scale) > 1e-6 THEN l.scale ELSE 1 END) AS speed_raw,
  r6(m.jerk) AS jerk FROM motion m JOIN ledger l ON l.feature = 'speed_raw' AND l.cohort = CASE WHEN m.vessel_superclass_id IN (0, 7, 10) THEN m.vessel_superclass_id ELSE 0 END""", extra=LEDGER))
def j12(spark, sf):
    rows = _rows(spark, sf)
    part = _ledger(rows).where(F.col("cohort").isin(0, 7, 10) & (F.col("feature") != "jerk"))
    names = ["speed_raw", "jerk"]
    return _round(ledger.scaled(rows, part, names).select("global_lsn", *names), *names)


@query("j13_weather_scale_default", "WITH " + ", ".join(WLEDGER) + """ SELECT event_id, r6((wind_speed - w.center)/w.scale) AS wind_speed,
  temperature, r6((humidity - h.center)/h.scale) AS humidity FROM wv JOIN weather w ON w.feature = 'wind_speed' JOIN weather h ON h.feature = 'humidity'""")
def j13(spark, sf):
    rows = _weather_rows(spark, sf)
    wl = ledger.weather_scales(rows).where(F.col("feature") != "temperature")
    none = wl.select(F.lit(0).alias("cohort"), "feature", "center", "scale").where(F.lit(False))
    names = ["wind_speed", "temperature", "humidity"]
    out = ledger.scaled(rows.withColumn("vessel_superclass_id", F.lit(0)), none, names, weather_ledger=wl)
    return _round(out.select("event_id", *names), "wind_speed", "humidity")


@query("p17_min_max_position", with_blocks(["raw"], """SELECT global_lsn, r6((lon_raw - lo0)/(lo1 - lo0 + 1e-7)) AS lon_raw,
  r6((lat_raw - la0)/(la1 - la0 + 1e-7)) AS lat_raw FROM raw, (SELECT floor((min(lon_raw)-0.05)*20)/20.0 AS lo0, ceil((max(lon_raw)+0.05)*20)/20.0 AS lo1,
   floor((min(lat_raw)-0.05)*20)/20.0 AS la0, ceil((max(lat_raw)+0.05)*20)/20.0 AS la1 FROM raw WHERE speed_raw > 0.5)"""))
def p17(spark, sf):
    rows = views.raw_tracks(spark, sf)
    bounds = ledger.envelope(ledger.moving(rows))
    none = inline(spark, [], "cohort int, feature string, center double, scale double")
    out = ledger.scaled(rows.withColumn("vessel_superclass_id", F.lit(0)), none, [], bounds=bounds)
    return _round(out.select("global_lsn", "lon_raw", "lat_raw"), "lon_raw", "lat_raw")


@query("p19_neutralise_weather", "WITH " + ", ".join(WLEDGER) + """ SELECT event_id, r6(w.center) AS wind_speed, r6(t.center) AS temperature,
  r6(h.center) AS humidity FROM wv JOIN weather w ON w.feature = 'wind_speed' JOIN weather h ON h.feature = 'humidity' JOIN weather t ON t.feature = 'temperature'""")
def p19(spark, sf):
    rows = _weather_rows(spark, sf)
    return _round(ledger.neutralised(rows, ledger.weather_scales(rows)), "wind_speed", "temperature", "humidity")


_REG = ", ".join(f"('{f}', {f in TARGETS})" for f in FEATURES)
_NAMED = ", ".join(f"'{n}'" for n in NAMES)


@query("p21_ledger_audit", with_blocks(MOTION, f"""SELECT coalesce(r.feature, l.feature) AS feature,
  CASE WHEN l.feature IS NULL THEN 'missing' ELSE l.place END AS place,
  CASE WHEN r.feature IS NULL THEN 'orphan' WHEN l.feature IS NOT NULL THEN 'scaled' WHEN r.target THEN 'unscaled target' ELSE 'unscaled' END AS state
FROM (VALUES {_REG}) r(feature, target) FULL JOIN (SELECT feature, 'cohort' AS place FROM ledger WHERE cohort = 0
  UNION ALL SELECT 'geodetic_distance_nm', 'cohort' UNION ALL SELECT feature, 'weather' FROM (VALUES {DEFAULTS_SQL}) w(feature, c, s)) l USING (feature)""", extra=LEDGER))
def p21(spark, sf):
    rows = ledger.moving(_rows(spark, sf))
    own = ledger.global_scales(rows, [*NAMES, "geodetic_distance_nm"]).withColumn("cohort", F.lit(0))
    return ledger.audit(own, ledger.weather_scales(rows))


@query("a27_active_targets", with_blocks(MOTION, f"""SELECT feature, r6(max_scale) AS max_scale FROM (SELECT feature, max(scale) AS max_scale FROM ledger
   WHERE feature IN ({", ".join(f"'{t}'" for t in TARGETS if t not in WEATHER)}) GROUP BY 1
   UNION ALL SELECT feature, scale FROM weather WHERE feature IN ({", ".join(f"'{t}'" for t in TARGETS if t in WEATHER)}))
WHERE max_scale >= 0.01 AND feature NOT IN ({", ".join(f"'{t}'" for t in DERIVED_TARGETS)})""", extra=[*LEDGER, *WLEDGER]))
def a27(spark, sf):
    return _round(ledger.active_targets(_ledger(_rows(spark, sf)), ledger.weather_scales(_weather_rows(spark, sf))), "max_scale")


FIT = ["l_quantity", "l_extendedprice", "l_discount"]


def _fit_sql(fit):
    cols = ", ".join(f"r6((l.{f} - f.{f}_c)/f.{f}_s) AS {f}" for f in FIT)
    fits = ", ".join(fit(f) for f in FIT)
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, {cols} FROM lineitem l, (SELECT {fits} FROM lineitem WHERE l_suppkey % 5 <> 0) f
WHERE l_suppkey % 5 = 0"""


def _fit(spark, sf, fitter):
    rows = views.table(spark, sf, "lineitem")
    held = F.pmod(F.col("l_suppkey"), F.lit(5)) == 0
    out = ledger.transform(rows.where(held), fitter(rows.where(~held), FIT), FIT)
    return _round(out.select("l_orderkey", "l_linenumber", "l_partkey", *FIT), *FIT)


@query("a28_standard_scaler", _fit_sql(lambda f: f"avg({f}) AS {f}_c, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS {f}_s"))
def a28(spark, sf):
    return _fit(spark, sf, ledger.fit_standard)


@query("a29_robust_scaler", _fit_sql(lambda f: f"quantile_cont({f}, 0.5) AS {f}_c, CASE WHEN quantile_cont({f}, 0.75) = quantile_cont({f}, 0.25) THEN 1 ELSE quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) END AS {f}_s"))
def a29(spark, sf):
    return _fit(spark, sf, ledger.fit_robust)


@query("s12_scale_ledger_roundtrip", with_blocks(MOTION, "SELECT feature, r6(center) AS center, r6(scale) AS scale FROM g", extra=[LONG, GLOBAL]))
def s12(spark, sf):
    from wakeline.session import shared_folder
    from wakeline.sources import lake

    path = shared_folder(spark, "ledger")
    lake.save_ledger(ledger.global_scales(ledger.moving(_rows(spark, sf)), NAMES), path)
    return _round(lake.load_ledger(spark, path), "center", "scale")


@query("a9_dataset_totals", with_blocks(TRACKS, "SELECT count(*) AS n_rows, count(DISTINCT mmsi_str) AS vessels FROM tracks"))
def a9(spark, sf):
    from wakeline.operators import diagnostics

    return diagnostics.totals(views.raw_tracks(spark, sf), "mmsi_str")
