"""Dashboard panels, alerts, administration, top lists and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.operators import alerts as al
from aqspark.operators import dashboards as db
from aqspark.operators import health, marts, quality
from aqspark.plans.health import DEMOGRAPHIC, EXPOSURE, IX, OUTCOMES, TEMPORAL, VULNERABILITY, ix
from aqspark.plans.hotspots import HOTSPOTS, grid_hotspots
from aqspark.plans.marts import LATEST, UNHEALTHY_24H, rounded
from aqspark.plans.registry import query
from aqspark.plans.tables import AS_OF, as_of

T = f"TIMESTAMP '{AS_OF}'"
# user tables end later than the readings: orders run into 1999 and beyond
ORDERS_AS_OF = "1999-01-01 00:00:00"


@query("a29_pm25_week_series", f"""SELECT city, timestamp_utc, round(avg(value), 6) AS avg_aqi FROM readings
WHERE parameter = 'pm25' AND is_cleaned AND timestamp_utc >= {T} - INTERVAL 7 DAY GROUP BY 1, 2""")
def week_series(t):
    return rounded(db.pm25_series(t.readings, as_of()))


@query("a29_current_by_city", LATEST + " SELECT city, value AS aqi FROM latest WHERE parameter = 'aqi'")
def current(t):
    return db.current_by_city(t.readings)


@query("a29_pm25_month_daily", f"""SELECT city, CAST(timestamp_utc AS DATE) AS reading_date, round(avg(value), 6) AS avg_value FROM readings
WHERE parameter = 'pm25' AND is_cleaned AND quality_flag = 'valid' AND CAST(timestamp_utc AS DATE) >= CAST({T} AS DATE) - 30 GROUP BY 1, 2""")
def month_daily(t):
    return db.pm25_daily(t.readings, as_of(), digits=6)


@query("a29_category_mix", f"""SELECT aqi_category, count(*) AS count FROM readings WHERE is_cleaned AND timestamp_utc >= {T} - INTERVAL 24 HOUR GROUP BY 1""")
def category_mix(t):
    return db.category_mix(t.readings, as_of())


@query("a29_parameter_means", f"""SELECT city, parameter, round(avg(value), 6) AS avg_value FROM readings
WHERE is_cleaned AND timestamp_utc >= {T} - INTERVAL 24 HOUR GROUP BY 1, 2""")
def parameter_means(t):
    return rounded(db.parameter_means(t.readings, as_of()))


@query("a29_unhealthy_hours_panel", UNHEALTHY_24H)
def unhealthy_panel(t):
    return marts.unhealthy_hours(t.readings, as_of(), digits=6)


@query("a30_quality_counters", f"""SELECT round((epoch_us({T}) - epoch_us(max(timestamp_utc))) / 36e8, 6) AS aqi_hours_ago,
  count(*) FILTER (WHERE timestamp_utc >= {T} - INTERVAL 24 HOUR) AS readings_24h,
  (SELECT round((epoch_us({T}) - epoch_us(max(timestamp_utc))) / 36e8, 6) FROM weather) AS weather_hours_ago,
  (SELECT count(*) FROM stations WHERE is_active) AS active_stations FROM readings""")
def counters(t):
    return rounded(db.quality_counters(t.readings, t.weather, t.stations, as_of()))


@query("a30_daily_completeness", f"""SELECT CAST(timestamp_utc AS DATE) AS date, city, count(DISTINCT parameter) / 8e0 * 100 AS completeness_pct FROM readings
WHERE timestamp_utc >= {T} - INTERVAL 30 DAY GROUP BY 1, 2""")
def daily_completeness(t):
    return db.daily_completeness(t.readings, as_of())


@query("a30_hourly_rate", f"SELECT date_trunc('hour', timestamp_utc) AS hour, count(*) AS records FROM readings WHERE timestamp_utc >= {T} - INTERVAL 48 HOUR GROUP BY 1")
def hourly_rate(t):
    return db.hourly_rate(t.readings, as_of())


@query("a30_source_mix", f"SELECT source, count(*) AS count FROM readings WHERE timestamp_utc >= {T} - INTERVAL 24 HOUR GROUP BY 1")
def source_mix(t):
    return db.source_mix(t.readings, as_of())


@query("a30_parameter_coverage", f"SELECT city, parameter, count(*) AS count FROM readings WHERE is_cleaned AND timestamp_utc >= {T} - INTERVAL 24 HOUR GROUP BY 1, 2")
def coverage(t):
    return db.parameter_coverage(t.readings, as_of())


@query("a31_total_exposed", EXPOSURE + " SELECT sum(total_population_millions) AS total_population_exposed FROM ex WHERE health_category <> 'Good'")
def total_exposed(t):
    return db.total_exposed(health.exposure_by_category(ix(t)))


@query("a31_cities_in_poor", f"SELECT count(DISTINCT city) AS cities_in_poor FROM readings WHERE parameter = 'aqi' AND value > 200 AND timestamp_utc >= {T} - INTERVAL 24 HOUR")
def cities_in_poor(t):
    return db.cities_over(t.readings, as_of())


@query("a31_vulnerability_and_cases", IX + ", " + VULNERABILITY + ", " + OUTCOMES + """
SELECT (SELECT round(avg(vulnerability_index), 6) FROM vul) AS avg_vulnerability, (SELECT CAST(sum(pollution_attributable_cases) AS BIGINT) FROM ho) AS attributable_cases""")
def averages(t):
    v = health.city_vulnerability(ix(t), digits=6).agg(F.round(F.avg("vulnerability_index"), 6).alias("avg_vulnerability"))
    cases = health.health_outcomes(ix(t)).agg(F.sum("pollution_attributable_cases"))
    return v.select("avg_vulnerability", cases.scalar().alias("attributable_cases"))


@query("a31_demographic_panel", IX + ", " + DEMOGRAPHIC + " SELECT demographic, city, risk_score FROM dr")
def demographic_panel(t):
    return health.risk_by_demographic(ix(t), digits=6).select("demographic", "city", "risk_score")


@query("a31_outcome_panel", IX + ", " + OUTCOMES + " SELECT city, health_outcome, pollution_attributable_cases FROM ho")
def outcome_panel(t):
    return health.health_outcomes(ix(t)).select("city", "health_outcome", "pollution_attributable_cases")


@query("a31_temporal_panel", IX + ", " + TEMPORAL + " SELECT city, time_period, avg_aqi FROM tr")
def temporal_panel(t):
    return rounded(health.temporal_risk(ix(t)).select("city", "time_period", "avg_aqi"))


@query("a31_hotspot_panels", HOTSPOTS + """
SELECT severity, count(*) AS count, CAST(sum(estimated_exposed_pop) AS BIGINT) AS exposed FROM hotspots WHERE severity IN ('severe', 'high') GROUP BY 1""")
def hotspot_panels(t):
    return grid_hotspots(t).where(F.col("severity").isin("severe", "high")).groupBy("severity").agg(
        F.count(F.lit(1)).alias("count"), F.sum("estimated_exposed_pop").alias("exposed")
    )


@query("a31_latest_wind", f"SELECT city, latitude, longitude, wind_speed_10m, wind_direction_10m FROM weather WHERE timestamp_utc >= {T} - INTERVAL 1 HOUR")
def wind(t):
    return db.wind_now(t.weather, as_of())


@query("j13_latest_per_station", """
l AS (SELECT location, value FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp_utc DESC, reading_id DESC) AS rn FROM readings WHERE parameter = 'aqi') WHERE rn = 1)
SELECT s.location, s.city, s.latitude, s.longitude, l.value AS aqi FROM stations s JOIN l USING (location) WHERE s.is_active""")
def latest_station(t):
    return db.latest_per_station(t.readings, t.stations)


@query("j13_station_heat", f"""SELECT s.latitude, s.longitude, round(avg(a.value), 6) AS avg_aqi FROM stations s JOIN readings a USING (location)
WHERE a.timestamp_utc >= {T} - INTERVAL 24 HOUR AND a.parameter = 'pm25' AND a.is_cleaned GROUP BY 1, 2""")
def heat(t):
    return db.station_heat(t.readings, t.stations, as_of()).withColumn("avg_aqi", F.round("avg_aqi", 6))


@query("j14_silent_stations", f"""
l AS (SELECT location, max(timestamp_utc) AS last_reading FROM readings GROUP BY 1)
SELECT s.location, s.city, last_reading, round((epoch_us({T}) - epoch_us(last_reading)) / 36e8, 6) AS gap_hours FROM stations s LEFT JOIN l USING (location)
WHERE s.is_active AND (last_reading IS NULL OR {T} - last_reading > INTERVAL 2 HOUR)""")
def silent(t):
    return rounded(db.silent_stations(t.readings, t.stations, as_of()))


@query("s14_station_dimension", "SELECT * FROM stations")
def station_dimension(t):
    return t.stations


_SCORE = "greatest(0e0, 1e0 - (CASE WHEN value > 500 THEN 6e-1 ELSE 0e0 END + CASE WHEN source IS DISTINCT FROM 'cpcb' THEN 5e-2 ELSE 0e0 END))"


def with_score(t):
    r = t.readings.withColumns({"_range": F.col("value") > 500, "_no": F.lit(False)})
    return quality.quality_score(r, "_range", "_no", "_no", "_no")


@query("a34_source_quality", f"""SELECT source, count(*) AS total_readings, round(avg({_SCORE}), 6) AS avg_quality, count(*) FILTER (WHERE {_SCORE} < 5e-1) AS low_quality_count
FROM readings WHERE timestamp_utc >= {T} - INTERVAL 24 HOUR GROUP BY 1""")
def source_quality(t):
    return rounded(db.source_quality(with_score(t), as_of()))


@query("a34_source_freshness", f"SELECT source, max(timestamp_utc) AS latest, round((epoch_us({T}) - epoch_us(max(timestamp_utc))) / 36e8, 6) AS age_hours FROM readings GROUP BY 1")
def source_freshness(t):
    return rounded(db.source_freshness(t.readings, as_of()))


@query("a35_table_audit", """
SELECT 'readings' AS table_name, count(*) AS row_count, min(timestamp_utc) AS earliest, max(timestamp_utc) AS latest FROM readings
UNION ALL SELECT 'weather', count(*), min(timestamp_utc), max(timestamp_utc) FROM weather
UNION ALL SELECT 'forecasts', count(*), min(timestamp_utc), max(timestamp_utc) FROM forecasts
UNION ALL SELECT 'stations', count(*), NULL, NULL FROM stations""")
def audit(t):
    return db.table_audit({"readings": t.readings, "weather": t.weather, "forecasts": t.forecasts, "stations": t.stations})


DAILY_AQI = "da AS (SELECT city, CAST(timestamp_utc AS DATE) AS date, avg(value) AS aqi FROM readings WHERE parameter = 'pm25' GROUP BY 1, 2)"


def daily_aqi(t):
    rows = t.readings.where(F.col("parameter") == "pm25")
    return rows.groupBy("city", F.to_date("timestamp_utc").alias("date")).agg(F.avg("value").alias("aqi"))


@query("a33_period_summary", DAILY_AQI + """
SELECT city, CAST(floor(avg(aqi) + 5e-1) AS BIGINT) AS avg, round(min(aqi), 6) AS min, round(max(aqi), 6) AS max,
  round(arg_max(aqi, date) - arg_min(aqi, date), 6) AS trend, count(*) FILTER (WHERE aqi <= 50) AS good_days FROM da GROUP BY 1""")
def period_summary(t):
    return rounded(db.period_summary(daily_aqi(t)))


@query("a33_safe_outdoor_hours", DAILY_AQI + f"""
SELECT city, date, CAST(floor(greatest(1e0, 8e0 - aqi / 80) + 5e-1) AS INTEGER) AS hours FROM da WHERE date >= CAST({T} AS DATE) - 7""")
def outdoor_hours(t):
    return db.safe_outdoor_hours(daily_aqi(t), as_of())


# --- alerts and administration ---


@query("p29_parse_conditions", """
c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'AQI>150' WHEN 1 THEN 'O3>0.07' WHEN 2 THEN 'AQI>175' ELSE 'AQI above ' || c_custkey END AS condition FROM customer)
SELECT c_custkey, lower(nullif(regexp_extract(condition, '^(AQI|PM25|PM10|O3|NO2|SO2|CO)>(\\d+\\.?\\d*)$', 1), '')) AS alert_parameter,
  TRY_CAST(nullif(regexp_extract(condition, '^(AQI|PM25|PM10|O3|NO2|SO2|CO)>(\\d+\\.?\\d*)$', 2), '') AS DOUBLE) AS threshold,
  condition IN (""" + ", ".join(f"'{c}'" for c in dims.ALERT_CONDITIONS) + ") AS is_valid FROM c")
def conditions(t):
    key = F.col("c_custkey")
    texts = F.when(key % 4 == 0, F.lit("AQI>150")).when(key % 4 == 1, F.lit("O3>0.07")).when(
        key % 4 == 2, F.lit("AQI>175")).otherwise(F.concat(F.lit("AQI above "), key))
    return al.parse_conditions(t.raw("customer").select("c_custkey", texts.alias("condition"))).drop("condition")


@query("p33_delivery_schedule", """
SELECT reading_id, NOT (strftime(timestamp_utc, '%H:%M') >= '22:00' OR strftime(timestamp_utc, '%H:%M') < '06:30')
  AND isodow(timestamp_utc) IN (1, 2, 3, 4, 5) AND parameter IN ('pm25', 'aqi') AS deliver FROM readings""")
def schedule(t):
    days, pollutants = F.array(*[F.lit(d) for d in al.DAY_NAMES[:5]]), F.array(F.lit("pm25"), F.lit("aqi"))
    ok = al.within_schedule(F.col("timestamp_utc"), F.lit("22:00"), F.lit("06:30"), days, pollutants, F.col("parameter"))
    return t.readings.select("reading_id", ok.alias("deliver"))


@query("j16_threshold_matches", LATEST + """,
s AS (SELECT *, lower(regexp_extract(condition, '^([A-Z0-9]+)>', 1)) AS p, CAST(regexp_extract(condition, '>(.*)$', 1) AS DOUBLE) AS threshold FROM subscriptions WHERE active)
SELECT s.subscription_id, s.user_id, s.location, s.condition, l.value AS current_value FROM s JOIN users u ON u.user_id = s.user_id AND NOT u.is_suspended
JOIN latest l ON l.city = s.location AND l.parameter = s.p WHERE l.value > s.threshold""")
def matches(t):
    out = al.threshold_matches(t.subscriptions, marts.latest_city_aqi(t.readings), t.users)
    return out.select("subscription_id", "user_id", "location", "condition", "current_value")


@query("a32_system_stats", f"""
SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM users WHERE NOT is_suspended) AS active_users,
  (SELECT count(*) FROM users WHERE is_suspended) AS suspended_users, (SELECT count(*) FROM users WHERE role = 'admin') AS admin_users,
  (SELECT count(*) FROM users WHERE created_at >= {T} - INTERVAL 7 DAY) AS recent_signups, (SELECT count(*) FROM subscriptions) AS total_alerts,
  (SELECT count(*) FROM subscriptions WHERE active) AS active_alerts, (SELECT count(*) FROM notifications) AS total_notifications,
  (SELECT count(*) FROM notifications WHERE NOT read) AS unread_notifications, (SELECT count(*) FROM saved_locations) AS total_locations""")
def system_stats(t):
    return al.system_stats(t.users, t.subscriptions, t.saved_locations, t.notifications, as_of())


@query("a32_user_stats", """
SELECT u.user_id, coalesce(s.n, 0) AS alerts, coalesce(s.a, 0) AS active_alerts, coalesce(l.n, 0) AS saved_locations, coalesce(n.n, 0) AS notifications, coalesce(n.u, 0) AS unread
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE active) AS a FROM subscriptions GROUP BY 1) s USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n FROM saved_locations GROUP BY 1) l USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE NOT read) AS u FROM notifications GROUP BY 1) n USING (user_id)""")
def user_stats(t):
    return al.user_stats(t.users, t.subscriptions, t.saved_locations, t.notifications)


@query("l02_popular_conditions", "SELECT condition, count(*) AS count FROM subscriptions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def popular_conditions(t):
    return al.popular(t.subscriptions, "condition")


@query("l02_popular_locations", "SELECT location, count(*) AS count FROM subscriptions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def popular_locations(t):
    return al.popular(t.subscriptions, "location")


@query("l03_user_page", """SELECT user_id, name, role, created_at, (SELECT count(*) FROM users WHERE name ILIKE '%CUSTOMER#%1%' OR email ILIKE '%CUSTOMER#%1%') AS total
FROM users WHERE name ILIKE '%CUSTOMER#%1%' OR email ILIKE '%CUSTOMER#%1%' ORDER BY created_at DESC, user_id LIMIT 20 OFFSET 20""")
def user_page(t):
    found = al.search_users(t.users, "CUSTOMER#%1").select("user_id", "name", "role", "created_at")
    return al.page(found, [F.col("created_at").desc(), "user_id"], page_number=2)


@query("l01_top_hotspots", HOTSPOTS + " SELECT hotspot_id, affected_cities, avg_aqi, risk_score FROM hotspots ORDER BY risk_score DESC, hotspot_id LIMIT 20")
def top_hotspots(t):
    rows = grid_hotspots(t).select("hotspot_id", "affected_cities", "avg_aqi", "risk_score")
    return rows.orderBy(F.col("risk_score").desc(), "hotspot_id").limit(20)


@query("l01_top_vulnerable_cities", IX + ", " + VULNERABILITY + " SELECT city, vulnerability_index FROM vul ORDER BY vulnerability_index DESC, city LIMIT 10")
def top_vulnerable(t):
    rows = health.city_vulnerability(ix(t), digits=6).select("city", "vulnerability_index")
    return rows.orderBy(F.col("vulnerability_index").desc(), "city").limit(10)


ERROR_LOG = "el AS (SELECT event_id, ts AS timestamp, upper(event_type) AS level, 'task-' || user_id AS task, 'value ' || k AS message FROM ev WHERE event_type = 'error')"


def error_log(t):
    return t._events.where(F.col("event_type") == "error").select(
        "event_id", F.col("ts").alias("timestamp"), F.upper("event_type").alias("level"), F.concat(F.lit("task-"), "user_id").alias("task"),
        F.concat(F.lit("value "), "k").alias("message"),
    )


@query("l04_latest_errors", ERROR_LOG + f" SELECT * FROM el WHERE timestamp >= {T} - INTERVAL 24 HOUR ORDER BY timestamp DESC, event_id DESC LIMIT 50")
def latest_errors(t):
    rows = marts.since(error_log(t), as_of(), "24 HOURS", ts="timestamp")
    return rows.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(50)


@query("u02_distinct_lists", """SELECT 'city' AS kind, city AS name FROM (SELECT DISTINCT city FROM stations)
UNION ALL SELECT 'parameter', parameter FROM (SELECT DISTINCT parameter FROM readings)""")
def lists(t):
    cities = t.stations.select(F.lit("city").alias("kind"), F.col("city").alias("name")).distinct()
    return cities.unionByName(t.readings.select(F.lit("parameter").alias("kind"), F.col("parameter").alias("name")).distinct())


@query("u01_union_of_sources", """
SELECT 'readings' AS feed, reading_id AS id, city, parameter, value, CAST(NULL AS DOUBLE) AS temperature_2m FROM readings
UNION ALL SELECT 'weather', weather_id, city, NULL, NULL, temperature_2m FROM weather""")
def union_sources(t):
    r = t.readings.select(F.lit("readings").alias("feed"), F.col("reading_id").alias("id"), "city", "parameter", "value")
    w = t.weather.select(F.lit("weather").alias("feed"), F.col("weather_id").alias("id"), "city", "temperature_2m")
    return r.unionByName(w, allowMissingColumns=True)


@query("k08_drop_read_notifications", f"SELECT * FROM notifications WHERE NOT (read AND created_at < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY)")
def drop_read(t):
    return al.drop_read_notifications(t.notifications, F.lit(ORDERS_AS_OF).cast("timestamp"))


