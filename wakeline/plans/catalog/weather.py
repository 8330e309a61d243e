"""Weather lattice, interpolation join and set operations on slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import asof, mesh
from wakeline.plans import views
from wakeline.plans.catalog.base import TRACKS, query, r6, with_blocks

MESH = """mesh AS (SELECT k*21600 AS timestamp_, round(23.1::DOUBLE + i*0.15::DOUBLE, 6) AS lon,
  round(37.5::DOUBLE + j*0.15::DOUBLE, 6) AS lat, i, j, k,
  280.0::DOUBLE + i*0.5::DOUBLE + j*0.25::DOUBLE + (k % 1000)*0.01::DOUBLE AS "TMP", g + i*0.1::DOUBLE AS "GUST",
  101000.0::DOUBLE + i*10.0::DOUBLE - j*5.0::DOUBLE AS "PRMSL", 60.0::DOUBLE + i + j*2.0::DOUBLE AS "RH",
  ((i*7+j*3+k*5) % 11 - 5)::DOUBLE AS "UGRD", ((i*5+j*9+k*2) % 13 - 6)::DOUBLE AS "VGRD"
  FROM (SELECT timestamp_sec // 21600 AS k, avg(speed_raw) AS g FROM raw GROUP BY 1), range(0,7) a(i), range(0,4) b(j))"""
EXTENT = "ext AS (SELECT min(k) AS k0, max(k) AS k1 FROM mesh)"


def _cell(causal: bool, by_clamp: bool = True):
    t_index = "least(greatest(timestamp_sec // 21600, k0), k1)" if causal else "least(greatest(timestamp_sec // 21600, k0), k1 - 1)"
    wt = "0.0::DOUBLE" if causal else "(least(greatest(timestamp_sec, k0*21600), k1*21600) - ti*21600)::DOUBLE/21600.0::DOUBLE"
    return [
        EXTENT,
        f"""loc AS (SELECT t.*, {t_index} AS ti,
          least(list_count(list_filter([23.1,23.25,23.4,23.55,23.7,23.85,24.0]::DOUBLE[], lambda a: a <= lon_raw))-1, 5) AS xi,
          least(list_count(list_filter([37.5,37.65,37.8,37.95]::DOUBLE[], lambda a: a <= lat_raw))-1, 2) AS yi, k0, k1,
          (lat_raw > 37.95::DOUBLE OR lon_raw > 24.0::DOUBLE OR timestamp_sec > k1*21600 OR timestamp_sec < k0*21600)::INT AS out_of_mesh_flag
          FROM tracks t, ext)""",
        f"""wts AS (SELECT *, {wt} AS wt,
          (lon_raw - round(23.1::DOUBLE+xi*0.15::DOUBLE,6))/(round(23.1::DOUBLE+(xi+1)*0.15::DOUBLE,6) - round(23.1::DOUBLE+xi*0.15::DOUBLE,6)) AS wx,
          (least(lat_raw, 37.95::DOUBLE) - round(37.5::DOUBLE+yi*0.15::DOUBLE,6))/(round(37.5::DOUBLE+(yi+1)*0.15::DOUBLE,6) - round(37.5::DOUBLE+yi*0.15::DOUBLE,6)) AS wy
          FROM loc)""",
        """wsum AS (SELECT global_lsn, any_value(course_raw) AS course_raw, any_value(out_of_mesh_flag) AS out_of_mesh_flag,
          sum(w*"TMP") AS temperature, sum(w*"GUST") AS gust_factor, sum(w*"PRMSL") AS pressure, sum(w*"RH") AS humidity,
          sum(w*"UGRD") AS u, sum(w*"VGRD") AS v FROM (
            SELECT q.*, m.*, (CASE WHEN m.k = ti THEN 1-wt ELSE wt END)*(CASE WHEN m.i = xi THEN 1-wx ELSE wx END)*(CASE WHEN m.j = yi THEN 1-wy ELSE wy END) AS w
            FROM wts q JOIN mesh m ON m.k IN (ti, ti+1) AND m.i IN (xi, xi+1) AND m.j IN (yi, yi+1)
            WHERE (m.k = ti OR wt > 0)) GROUP BY global_lsn)""",
    ]


def _weather_sql(causal=False, columns=("temperature", "gust_factor", "pressure", "humidity")):
    picked = ", ".join(f"r6({c}) AS {c}" for c in columns)
    return with_blocks(TRACKS, f"""SELECT global_lsn, out_of_mesh_flag, {picked}, r6(sqrt(u*u+v*v)) AS wind_speed,
  r6(-(u*sin(radians(course_raw)) + v*cos(radians(course_raw)))) AS headwind_component,
  r6(u*cos(radians(course_raw)) - v*sin(radians(course_raw))) AS crosswind_component FROM wsum""", extra=[MESH, *_cell(causal)])


def _weather(df, columns=("temperature", "gust_factor", "pressure", "humidity")):
    names = [*columns, "wind_speed", "headwind_component", "crosswind_component"]
    return df.select("global_lsn", "out_of_mesh_flag", *[r6(F.col(c)).alias(c) for c in names])


@query("j5_lattice", with_blocks(["raw"], "SELECT DISTINCT timestamp_, lon, lat FROM mesh", extra=[MESH]))
def j5(spark, sf):
    return mesh.lattice(views.mesh(spark, sf))


HOLES = "holes AS (SELECT * FROM mesh WHERE (i + j*3 + k) % 5 <> 0)"


@query("j6_lattice_gaps", with_blocks(["raw"], """SELECT t.timestamp_, x.lon, y.lat FROM (SELECT DISTINCT timestamp_ FROM holes) t,
  (SELECT DISTINCT lon FROM holes) x, (SELECT DISTINCT lat FROM holes) y
  WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE h.timestamp_ = t.timestamp_ AND h.lon = x.lon AND h.lat = y.lat)
  ORDER BY 1, 2, 3 LIMIT 5""", extra=[MESH, HOLES]))
def j6(spark, sf):
    i = F.round((F.col("lon") - 23.1) / 0.15).cast("int")
    j = F.round((F.col("lat") - 37.5) / 0.15).cast("int")
    k = F.floor(F.col("timestamp_") / F.lit(views.MESH_STEP_SEC))
    return mesh.lattice_gaps(views.mesh(spark, sf).where(F.pmod(i + j * 3 + k, F.lit(5)) != 0))


@query("j7_trilinear_weather", _weather_sql())
def j7(spark, sf):
    return _weather(mesh.interpolate(views.tracks(spark, sf), views.mesh(spark, sf)))


@query("j7_newest_node_version", _weather_sql())
def j7_versions(spark, sf):
    """Every node comes twice; the older version is far off."""
    nodes = views.mesh(spark, sf)
    old = nodes.withColumns({"TMP": F.col("TMP") + 500.0, "UGRD": F.lit(99.0), "version_id": F.lit(1)})
    both = nodes.withColumn("version_id", F.lit(2)).unionByName(old)
    return _weather(mesh.interpolate(views.tracks(spark, sf), both))


@query("j8_causal_weather", _weather_sql(causal=True))
def j8(spark, sf):
    return _weather(mesh.interpolate(views.tracks(spark, sf), views.mesh(spark, sf), run_mode="causal"))


@query("j8_asof_join", """SELECT l.event_id, r.event_id AS last_purchase, r.value AS last_value
FROM (SELECT * FROM events WHERE event_type <> 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def j8_asof(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")
    ev = views.table(spark, sf, "events").select("event_id", "user_id", micros, "event_type", "value")
    buys = ev.where(F.col("event_type") == "purchase").select(
        "user_id", "micros", "event_id", F.col("event_id").alias("last_purchase"), F.col("value").alias("last_value"))
    rest = ev.where(F.col("event_type") != "purchase").select("event_id", "user_id", "micros")
    out = asof.asof_backward(rest, buys, ["user_id"], "micros", ["last_purchase", "last_value"], "event_id",
                             width=86_400_000_000)
    return out.select("event_id", "last_purchase", "last_value")


@query("j9_out_of_mesh", with_blocks(TRACKS, """SELECT global_lsn, out_of_mesh_flag,
  CASE WHEN out_of_mesh_flag = 0 THEN r6(temperature) END AS temperature FROM wsum""", extra=[MESH, *_cell(False)]))
def j9(spark, sf):
    out = mesh.interpolate(views.tracks(spark, sf), views.mesh(spark, sf), boundary="nan")
    blank = F.nanvl(F.col("temperature"), F.lit(None).cast("double"))
    return out.select("global_lsn", "out_of_mesh_flag", r6(blank).alias("temperature"))


# A ring of twelve 30-degree columns: a field of the column number only, linear between columns.
@query("j10_cyclic_longitude", with_blocks(TRACKS, """SELECT global_lsn, r6(CASE WHEN c < 11 THEN c0 + (c1-c0)*f ELSE c0 + (c1-c0)*f END) AS temperature
FROM (SELECT global_lsn, f, c, 280.0 + (c*c % 7) AS c0, 280.0 + (((c+1) % 12)*((c+1) % 12) % 7) AS c1 FROM
 (SELECT global_lsn, (((global_lsn*7919) % 7200)::DOUBLE/10.0)::DOUBLE - 360.0 AS lon, CAST(floor(((global_lsn*7919) % 3600)::DOUBLE/300.0) AS INT) AS c,
   ((global_lsn*7919) % 300)::DOUBLE/300.0 AS f FROM tracks))"""))
def j10(spark, sf):
    lon = F.pmod(F.col("global_lsn") * 7919, F.lit(7200)) / F.lit(10.0) - 360.0
    slots = views.tracks(spark, sf).groupBy(F.floor(F.col("timestamp_sec") / F.lit(43_200)).cast("bigint").alias("k")).count()
    c = F.col("c")
    nodes = slots.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn(
        "lat", F.explode(F.array(F.lit(37.0), F.lit(39.0)))).select(
        (F.col("k") * 43_200).alias("timestamp_"), (c * 30.0).alias("lon"), "lat",
        (F.lit(280.0) + F.pmod(c * c, F.lit(7))).alias("TMP"),
        *[F.lit(1.0).alias(v) for v in ("GUST", "PRMSL", "RH", "UGRD", "VGRD")])
    rows = views.tracks(spark, sf).withColumn("lon_raw", lon)
    out = mesh.interpolate(rows, nodes, cyclic=True)
    return out.select("global_lsn", r6(F.col("temperature")).alias("temperature"))


# Months: the mesh covers the odd months only; orders in even months stay without weather.
@query("j11_month_routing", """SELECT o_orderkey, CASE WHEN month(o_orderdate) % 2 = 1
  THEN 200.0::DOUBLE + year(o_orderdate)*0.5 + month(o_orderdate) END AS temperature FROM orders""")
def j11(spark, sf):
    ts = F.col("o_orderdate").cast("timestamp")
    orders = views.table(spark, sf, "orders").select(
        "o_orderkey", F.unix_seconds(ts).alias("timestamp_sec"), F.lit(23.5).alias("lon_raw"),
        F.lit(37.9).alias("lat_raw"), F.lit(0.0).alias("course_raw"))
    start = F.trunc("o_orderdate", "month")
    months = views.table(spark, sf, "orders").select(start.alias("m")).distinct().where(F.pmod(F.month("m"), F.lit(2)) == 1)
    first = F.unix_seconds(F.col("m").cast("timestamp"))
    last = F.unix_seconds(F.add_months("m", 1).cast("timestamp")) - 1
    nodes = months.withColumn("timestamp_", F.explode(F.array(first, last))).withColumn(
        "lon", F.explode(F.array(F.lit(23.0), F.lit(24.0)))).withColumn(
        "lat", F.explode(F.array(F.lit(37.0), F.lit(39.0)))).select(
        "timestamp_", "lon", "lat", (F.lit(200.0) + F.year("m") * 0.5 + F.month("m")).alias("TMP"),
        *[F.lit(1.0).alias(v) for v in ("GUST", "PRMSL", "RH", "UGRD", "VGRD")])
    return mesh.interpolate(orders, nodes, by_month=True).select("o_orderkey", "temperature")


@query("w15_latest_node_version", """SELECT l_shipdate_sec AS timestamp_, l_suppkey::DOUBLE AS lon, l_linenumber::DOUBLE AS lat, max(l_orderkey) AS version_id
FROM (SELECT *, epoch_us(l_shipdate)//1000000 AS l_shipdate_sec FROM lineitem) GROUP BY ALL""")
def w15(spark, sf):
    nodes = views.table(spark, sf, "lineitem").select(
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp_"),
        F.col("l_suppkey").cast("double").alias("lon"), F.col("l_linenumber").cast("double").alias("lat"),
        F.col("l_orderkey").alias("version_id"))
    return mesh.latest_nodes(nodes)


@query("u1_union_carried", """SELECT event_id, value, 0 AS is_ghost FROM events UNION ALL
SELECT event_id, NULL, 1 FROM events WHERE event_type = 'error'""")
def u1(spark, sf):
    ev = views.table(spark, sf, "events")
    carried = ev.where(F.col("event_type") == "error").select("event_id", F.lit(1).alias("is_ghost"))
    return ev.select("event_id", "value", F.lit(0).alias("is_ghost")).unionByName(carried, allowMissingColumns=True)


@query("u2_union_months", """SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, r6(sum(o_totalprice)) AS total
FROM orders GROUP BY 1, 2""")
def u2(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    odd = F.pmod(F.month("o_orderdate"), F.lit(2)) == 1
    both = orders.where(odd).unionByName(orders.where(~odd))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100.0
    return both.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").cast("bigint").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), r6(cents).alias("total"))


@query("u3_axis_values", with_blocks(["raw"], """SELECT 'time' AS axis, timestamp_::DOUBLE AS value FROM mesh GROUP BY 2
 UNION ALL SELECT 'lon', lon FROM mesh GROUP BY 2 UNION ALL SELECT 'lat', lat FROM mesh GROUP BY 2""", extra=[MESH]))
def u3(spark, sf):
    nodes = views.mesh(spark, sf)
    parts = [mesh.axis_values(nodes, c).select(F.lit(a).alias("axis"), F.col(c).cast("double").alias("value"))
             for a, c in (("time", "timestamp_"), ("lon", "lon"), ("lat", "lat"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
