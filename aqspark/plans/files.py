"""Sources and sinks. Documents are built from the given tables, then parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.operators import quality
from aqspark.plans.marts import STATS, rounded
from aqspark.plans.quality import CHECKS
from aqspark.plans.registry import query
from aqspark.plans.tables import AS_OF, as_of, sql_piecewise
from aqspark.session import ensure_checkpoint_dir
from aqspark.sinks import rules, tables
from aqspark.sources import documents as docs

PAGE = 100
UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def work_path(t) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/out-{uuid.uuid4()}"


def pages(t, overlap: int = 0):
    """Readings as measurement documents of at most a hundred entries each."""
    r = t.readings
    entry = F.struct(
        "location", "city", "country", "parameter",
        F.when(F.col("k") == 11, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"), "unit",
        F.struct(F.date_format("timestamp_utc", UTC_TEXT).alias("utc"), F.date_format("timestamp_utc", UTC_TEXT).alias("local")).alias("date"),
        F.struct("latitude", "longitude").alias("coordinates"),
    )
    page = F.floor((F.col("reading_id") + overlap) / PAGE)
    return r.groupBy(page.alias("page")).agg(
        F.to_json(F.struct(F.collect_list(entry).alias("results"), F.struct(F.count(F.lit(1)).alias("found")).alias("meta"))).alias("body")
    )


MEASURED = """SELECT location, city, country, parameter, CASE WHEN k <> 11 THEN value END AS value, unit, timestamp_utc, timestamp_utc AS timestamp_local, latitude, longitude FROM readings"""


@query("s01_latest_snapshot", """
SELECT reading_id, city, parameter, value FROM readings WHERE CAST(timestamp_utc AS DATE) = (SELECT max(CAST(timestamp_utc AS DATE)) FROM readings)""")
def snapshot(t):
    rows = t.readings.withColumn("ingest_ts", F.to_date("timestamp_utc"))
    return docs.latest_snapshot(rows).select("reading_id", "city", "parameter", "value")


@query("s02_flatten_measurements", MEASURED)
def measurements(t):
    return docs.parse_measurements(pages(t))


@query("s03_combine_pages", MEASURED)
def combined(t):
    return docs.combine_pages(pages(t).unionByName(pages(t, overlap=50)))


@query("s04_reference_tables", "SELECT location, city, latitude AS lat, longitude AS lon FROM stations")
def reference(t):
    entry = F.struct("location", "city", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    page = F.pmod(F.xxhash64("location"), F.lit(1000))
    body = t.stations.groupBy(page.alias("p")).agg(F.to_json(F.struct(F.collect_list(entry).alias("results"))).alias("body"))
    return docs.parse_reference(body, "location: string, city: string, lat: double, lon: double")


def station_documents(t):
    """One document per reading in turn under the alternate keys, with a pollutant map."""
    r = t.readings
    pollutants = F.struct(
        F.struct(F.col("value").alias("avg")).alias("PM2.5"), F.col("value").alias("NO2"), F.struct(F.lit("5.5").alias("value")).alias("CO")
    )
    a = F.struct(F.array(F.struct(F.col("location").alias("stationName"), F.col("value").cast("string").alias("aqi"), "latitude", "longitude", pollutants.alias("pollutants"))).alias("stations"))
    b = F.struct(F.struct(F.col("location").alias("station"), F.col("value").alias("AQI"), "latitude", "longitude", pollutants.alias("parameters")).alias("data"))
    body = F.when(F.col("reading_id") % 2 == 0, F.to_json(a)).otherwise(F.to_json(b))
    return r.select("city", F.col("timestamp_utc").alias("fetched_at"), body.alias("body"))


_S5 = "SELECT location, city, 'IN' AS country, '{p}' AS parameter, {v} AS value, '{u}' AS unit, timestamp_utc, latitude, longitude FROM readings"


@query("s05_station_documents", " UNION ALL ".join([
    _S5.format(p="aqi", v="value", u="NAQI"), _S5.format(p="pm25", v="value", u="µg/m³"),
    _S5.format(p="no2", v="value", u="µg/m³"), _S5.format(p="co", v="55e-1", u="mg/m³"),
]))
def stations(t):
    return docs.parse_stations(station_documents(t))


LIST_ITEM = '<li><a href="/([^"]*)">([^<]*)</a></li>'


@query("s06_html_row_pattern", f"""
SELECT page_id, unnest(regexp_extract_all(html, '{LIST_ITEM}', 1)) AS location FROM pages""")
def html_rows(t):
    found = docs.parse_html(t.raw("pages"), "page_id", row_pattern=LIST_ITEM)
    # the list items hold a link and its text; trimming as for station names
    return found.select("page_id", "location")


@query("s06_html_embedded_json", "SELECT page_id, CAST(0 AS INTEGER) AS row_number, 'Station ' || page_id AS location, CAST(page_id AS DOUBLE) AS value, 285e-1 AS latitude, 772e-1 AS longitude FROM pages")
def html_json(t):
    script = F.concat(F.lit('<script>var aqiData = [{"stationName":"Station '), "page_id", F.lit('","aqi":"'), "page_id",
                      F.lit('","latitude":28.5,"longitude":77.2}];</script>'))
    whole = t.raw("pages").withColumn("html", F.concat("html", script))
    return docs.parse_html(whole, "page_id")


@query("s07_station_history", """SELECT city, location, parameter, value, timestamp_utc, 'IN' AS country, 'µg/m³' AS unit FROM readings""")
def history(t):
    when = F.date_format("timestamp_utc", UTC_TEXT)
    a = F.to_json(F.struct(F.array(F.struct(F.col("location").alias("station"), "value", when.alias("date"))).alias("readings")))
    b = F.to_json(F.struct(F.array(F.struct(F.col("location").alias("station"), F.col("value").alias("avg"), when.alias("timestamp"))).alias("data")))
    body = F.when(F.col("reading_id") % 2 == 0, a).otherwise(b)
    return docs.parse_history(t.readings.select("city", "parameter", body.alias("body")))


HOURLY = ["temperature_2m", "relative_humidity_2m", "precipitation"]


@query("s08_hourly_weather_arrays", "SELECT latitude, longitude, timestamp_utc, temperature_2m, relative_humidity_2m, precipitation FROM weather")
def hourly_weather(t):
    rows = t.weather.withColumn("page", F.floor(F.col("weather_id") / 500))
    local = F.date_format(F.from_utc_timestamp("timestamp_utc", "Asia/Kolkata"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    packed = rows.groupBy("page", "latitude", "longitude").agg(F.sort_array(F.collect_list(F.struct(local.alias("time"), *HOURLY))).alias("_r"))
    body = F.to_json(F.struct(F.struct(*[F.col(f"_r.{c}").alias(c) for c in ("time", *HOURLY)]).alias("hourly")))
    return docs.parse_hourly_weather(packed.select("latitude", "longitude", body.alias("body")), HOURLY)


DAILY = ["temperature_2m_max", "temperature_2m_min", "precipitation_sum"]


@query("s09_daily_weather_arrays", """
SELECT latitude, longitude, CAST(timestamp_utc AS DATE) AS date, max(temperature_2m) AS temperature_2m_max, min(temperature_2m) AS temperature_2m_min,
  round(sum(precipitation), 6) AS precipitation_sum FROM weather GROUP BY 1, 2, 3""")
def daily_weather(t):
    days = t.weather.groupBy("latitude", "longitude", F.to_date("timestamp_utc").alias("d")).agg(
        F.max("temperature_2m").alias("temperature_2m_max"), F.min("temperature_2m").alias("temperature_2m_min"),
        F.sum("precipitation").alias("precipitation_sum"),
    )
    # one entry per place and day of a month
    packed = days.groupBy("latitude", "longitude", F.date_trunc("month", "d").alias("m")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("d").cast("string").alias("time"), *DAILY))).alias("_r")
    )
    body = F.to_json(F.struct(F.struct(*[F.col(f"_r.{c}").alias(c) for c in ("time", *DAILY)]).alias("daily")))
    out = docs.parse_daily_weather(packed.select("latitude", "longitude", body.alias("body")), DAILY)
    return out.withColumn("precipitation_sum", F.round("precipitation_sum", 6))


@query("s10_date_chunks", """
sp AS (SELECT o_custkey % 10 AS span_id, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1)
SELECT span_id, a AS date_from, b AS date_to, CAST(s AS DATE) AS chunk_start, least(CAST(s AS DATE) + 89, b) AS chunk_end
FROM sp, LATERAL (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b - 1 AS TIMESTAMP), INTERVAL 90 DAY)) AS s)""")
def chunks(t):
    spans = t.raw("orders").groupBy((F.col("o_custkey") % 10).alias("span_id")).agg(
        F.to_date(F.min("o_orderdate")).alias("date_from"), F.to_date(F.max("o_orderdate")).alias("date_to")
    )
    return docs.date_chunks(spans)


_XY = lambda i: "CASE city " + " ".join(f"WHEN '{c}' THEN CAST({xy[i]} AS DOUBLE)" for c, xy in dims.CITY_COORDINATES.items()) + " END"


@query("s11_city_coordinates", f"SELECT city, {_XY(0)} AS city_latitude, {_XY(1)} AS city_longitude, count(*) AS readings FROM readings GROUP BY 1")
def coordinates(t):
    return docs.with_coordinates(t.readings.groupBy("city").agg(F.count(F.lit(1)).alias("readings")))


@query("s12_city_scan", "SELECT reading_id, timestamp_utc, value FROM readings WHERE city = 'Delhi' AND timestamp_utc BETWEEN '2024-01-05' AND '2024-01-20'")
def city_scan(t):
    return docs.city_scan(t.readings, "Delhi", "2024-01-05", "2024-01-20").select("reading_id", "timestamp_utc", "value")


WIDE = ["pm25", "pm10", "no2", "so2"]


@query("s13_wide_extract", f"""
w AS (SELECT city, date_trunc('hour', timestamp_utc) AS timestamp_utc, {", ".join(f"arg_min(value, reading_id) FILTER (WHERE parameter = '{p}') AS {p}" for p in WIDE)}
  FROM readings WHERE parameter IN ({", ".join(f"'{p}'" for p in WIDE)}) GROUP BY 1, 2)
SELECT *, round({sql_piecewise('pm25', dims.EPA_TRAINING_PM25_BREAKPOINTS, 'CASE WHEN pm25 > 500 THEN 5e2 END')}, 6) AS aqi FROM w""")
def wide(t):
    rows = t.readings.withColumn("timestamp_utc", F.date_trunc("hour", "timestamp_utc"))
    return docs.wide_extract(rows, WIDE, ["reading_id"]).withColumn("aqi", F.round("aqi", 6))


# --- sinks: written to the shared work folder and read back ---


@query("k02_documents_round_trip", "SELECT reading_id, city, parameter, CASE WHEN k <> 12 THEN value END AS value FROM readings")
def documents(t):
    path = work_path(t)
    rows = t.readings.select("reading_id", "city", "parameter", F.when(F.col("k") == 12, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    tables.write_documents(rows, path)
    return t.spark.read.schema("reading_id long, city string, parameter string, value double").json(path)


@query("k01_append_table", "SELECT reading_id, city, parameter, value FROM readings UNION ALL SELECT reading_id, city, parameter, value FROM readings WHERE parameter = 'aqi'")
def append(t):
    name = f"readings_{uuid.uuid4().hex}"
    rows = t.readings.select("reading_id", "city", "parameter", "value")
    tables.append_table(rows, name, ["parameter"])
    tables.append_table(rows.where(F.col("parameter") == "aqi"), name, ["parameter"])
    return t.spark.table(name).select(*rows.columns)


@query("k03_rollup_exports", "SELECT city, parameter, CAST(date_trunc('month', timestamp_utc) AS DATE) AS month_start, " + STATS + " FROM readings GROUP BY 1, 2, 3")
def exports(t):
    return rounded(tables.write_rollups(t.readings, work_path(t))["month"]())


@query("k04_feature_files", "SELECT reading_id, city, value, CAST(hour(timestamp_utc) AS INTEGER) AS hour FROM readings")
def features(t):
    folder = work_path(t)
    tables.save_features(t.readings.select("reading_id", "city", "value", F.hour("timestamp_utc").alias("hour")), folder, "hours")
    return tables.load_features(t.spark, folder, "hours")


# the texts of the details have no twin
@query("k05_check_results", CHECKS + f"""
SELECT 'readings' AS dataset_name, name AS check_name, passed, severity, TIMESTAMP '{AS_OF}' AS timestamp FROM checks""")
def checks(t):
    path = work_path(t)
    tables.append_checks(quality.run_all_checks(t.readings, as_of()), path, "readings", as_of())
    return t.spark.read.parquet(path).drop("details")


@query("k06_write_rules", """
f AS (SELECT forecast_id, predicted_aqi AS predicted_value, forecast_horizon_hours - 1 AS h FROM forecasts)
SELECT forecast_id, concat_ws(',', CASE WHEN predicted_value < 0 THEN 'valid_predicted_value' END, CASE WHEN h <= 0 THEN 'valid_forecast_horizon' END) AS violations FROM f""")
def write_rules(t):
    f = t.forecasts.select("forecast_id", F.col("predicted_aqi").alias("predicted_value"), (F.col("forecast_horizon_hours") - 1).alias("forecast_horizon_hours"))
    return rules.mark_violations(f, rules.FORECAST_RULES).select("forecast_id", F.array_join("violations", ",").alias("violations"))


@query("k06_quarantine", "SELECT reading_id, value, parameter FROM readings WHERE NOT coalesce(value - 20 >= 0, true)")
def quarantine(t):
    shifted = t.readings.select("reading_id", (F.col("value") - 20).alias("value"), "parameter")
    bad = rules.split_valid(shifted, rules.READING_RULES)[1]
    return bad.select("reading_id", (F.col("value") + 20).alias("_v"), "parameter").join(
        t.readings.select("reading_id", "value"), "reading_id").select("reading_id", "value", "parameter")


# years of readings: one for each order, on its day
LONG_AS_OF = "2000-01-01"
LONG = """lr AS (SELECT 'city-' || o_custkey % 10 AS city, o_orderstatus AS parameter, CAST(o_totalprice AS DOUBLE) AS value,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS timestamp_utc FROM orders)"""


def long_readings(t):
    return t.raw("orders").select(
        F.concat(F.lit("city-"), F.col("o_custkey") % 10).alias("city"), F.col("o_orderstatus").alias("parameter"), F.col("o_totalprice").cast("double").alias("value"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("timestamp_utc"),
    )


@query("k07_retention_tiers", LONG + f"""
SELECT city, parameter, timestamp_utc, round(value, 6) AS value, CAST(1 AS BIGINT) AS readings, 'raw' AS tier FROM lr WHERE timestamp_utc >= TIMESTAMP '{LONG_AS_OF}' - INTERVAL 30 DAY
UNION ALL SELECT city, parameter, date_trunc('hour', timestamp_utc), round(avg(value), 6), count(*), 'hourly' FROM lr
  WHERE timestamp_utc < TIMESTAMP '{LONG_AS_OF}' - INTERVAL 30 DAY AND timestamp_utc >= TIMESTAMP '{LONG_AS_OF}' - INTERVAL 365 DAY GROUP BY 1, 2, 3
UNION ALL SELECT city, parameter, date_trunc('day', timestamp_utc), round(avg(value), 6), count(*), 'daily' FROM lr
  WHERE timestamp_utc < TIMESTAMP '{LONG_AS_OF}' - INTERVAL 365 DAY AND timestamp_utc >= TIMESTAMP '{LONG_AS_OF}' - INTERVAL 730 DAY GROUP BY 1, 2, 3""")
def retention(t):
    return rounded(rules.retention(long_readings(t), F.lit(LONG_AS_OF).cast("timestamp")))


