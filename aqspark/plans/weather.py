"""Weather joins, fills and derived weather columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import calendar
from aqspark.functions import weather as wx
from aqspark.operators import weather_join as wj
from aqspark.plans.registry import query
from aqspark.plans.tables import sql_right_closed, sql_season

ORDER = ["timestamp_utc", "weather_id"]
FILLED = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation"]
ROW_ORDER = ["timestamp_utc", "parameter", "location", "reading_id"]


def base(t):
    return t.readings.select(
        "reading_id", "city", "location", "parameter", "value", "timestamp_utc", "latitude", "longitude"
    )


HOURLY = """hourly AS (SELECT * FROM (SELECT *, date_trunc('hour', timestamp_utc) AS hb, row_number() OVER (
  PARTITION BY city, date_trunc('hour', timestamp_utc) ORDER BY timestamp_utc, weather_id) AS rn FROM weather) WHERE rn = 1),
hj AS (SELECT r.reading_id, r.city, r.location, r.parameter, r.value, r.timestamp_utc, r.latitude, r.longitude,
  h.temperature_2m, h.relative_humidity_2m, h.wind_speed_10m, h.wind_direction_10m, h.precipitation, h.visibility,
  h.latitude AS latitude_weather, h.longitude AS longitude_weather
  FROM readings r LEFT JOIN hourly h ON r.city = h.city AND date_trunc('hour', r.timestamp_utc) = h.hb)"""
NEAR = """near AS (SELECT * FROM (SELECT hj.reading_id AS rid, w.*, row_number() OVER (PARTITION BY hj.reading_id
    ORDER BY abs(epoch_us(w.timestamp_utc) - epoch_us(hj.timestamp_utc)), w.timestamp_utc, w.weather_id) AS rn
  FROM hj JOIN weather w ON w.city = hj.city AND w.timestamp_utc BETWEEN hj.timestamp_utc - INTERVAL 30 MINUTE
    AND hj.timestamp_utc + INTERVAL 30 MINUTE WHERE hj.temperature_2m IS NULL) WHERE rn = 1),
joined AS (SELECT hj.reading_id, hj.city, hj.location, hj.parameter, hj.value, hj.timestamp_utc, hj.latitude, hj.longitude,
  coalesce(hj.temperature_2m, n.temperature_2m) AS temperature_2m,
  coalesce(hj.relative_humidity_2m, n.relative_humidity_2m) AS relative_humidity_2m,
  coalesce(hj.wind_speed_10m, n.wind_speed_10m) AS wind_speed_10m,
  coalesce(hj.wind_direction_10m, n.wind_direction_10m) AS wind_direction_10m,
  coalesce(hj.precipitation, n.precipitation) AS precipitation, coalesce(hj.visibility, n.visibility) AS visibility,
  coalesce(hj.latitude_weather, n.latitude) AS latitude_weather, coalesce(hj.longitude_weather, n.longitude) AS longitude_weather
  FROM hj LEFT JOIN near n ON n.rid = hj.reading_id)"""


@query("j01_weather_by_hour", HOURLY + " SELECT * FROM hj")
def by_hour(t):
    return wj.join_on_hour(base(t), t.weather, ORDER)


@query("j02_weather_nearest_time", HOURLY + ", " + NEAR + " SELECT * FROM joined")
def nearest(t):
    return wj.join_weather(base(t), t.weather, "reading_id", ORDER)


@query("j03_weather_nearest_place", """
p AS (SELECT * FROM (SELECT r.reading_id, w.temperature_2m, w.relative_humidity_2m, w.wind_speed_10m, row_number() OVER (
    PARTITION BY r.reading_id ORDER BY sqrt((r.latitude - w.latitude) * (r.latitude - w.latitude)
      + (r.longitude - w.longitude) * (r.longitude - w.longitude)), w.timestamp_utc, w.weather_id) AS rn
  FROM readings r JOIN weather w ON w.timestamp_utc BETWEEN r.timestamp_utc - INTERVAL 30 MINUTE
    AND r.timestamp_utc + INTERVAL 30 MINUTE) WHERE rn = 1)
SELECT r.reading_id, p.temperature_2m, p.relative_humidity_2m, p.wind_speed_10m FROM readings r LEFT JOIN p USING (reading_id)""")
def nearest_place(t):
    out = wj.join_on_coordinates(base(t), t.weather, "reading_id", ORDER)
    return out.select("reading_id", "temperature_2m", "relative_humidity_2m", "wind_speed_10m")


def merged(t):
    return wj.join_on_hour(base(t), t.weather, ORDER)


_ORDER_SQL = ", ".join(ROW_ORDER)


@query("w08_forward_fill", HOURLY + f"""
SELECT reading_id, {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY {_ORDER_SQL} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}" for c in FILLED)} FROM hj""")
def ffill(t):
    return wj.fill_weather(merged(t), FILLED, ROW_ORDER, "ffill", 3).select("reading_id", *FILLED)


@query("w08_backward_fill", HOURLY + f"""
SELECT reading_id, {", ".join(f"first_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY {_ORDER_SQL} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS {c}" for c in FILLED)} FROM hj""")
def bfill(t):
    return wj.fill_weather(merged(t), FILLED, ROW_ORDER, "bfill", 3).select("reading_id", *FILLED)


@query("w09_interpolate", HOURLY + f""",
n AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY {_ORDER_SQL}) AS rn FROM hj),
e AS (SELECT *, last_value(temperature_2m IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN temperature_2m IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS pr,
  first_value(temperature_2m IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN temperature_2m IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS nr
  FROM n WINDOW b AS (PARTITION BY city ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY city ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT reading_id, round(CASE WHEN temperature_2m IS NOT NULL THEN temperature_2m WHEN rn - pr <= 3 THEN
  CASE WHEN nr IS NOT NULL THEN pv + (nv - pv) * (rn - pr) / (nr - pr) ELSE pv END END, 6) AS temperature_2m FROM e""")
def interpolate(t):
    out = wj.fill_weather(merged(t), ["temperature_2m"], ROW_ORDER, "interpolate", 3)
    return out.select("reading_id", F.round("temperature_2m", 6).alias("temperature_2m"))


@query("p19_derived_weather", HOURLY + f"""
SELECT reading_id, round(5e-1 * (temperature_2m + 61e0 + ((temperature_2m - 68e0) * 12e-1) + relative_humidity_2m * 94e-3), 6) AS heat_index,
  round(temperature_2m * relative_humidity_2m / 100, 6) AS temp_humidity_index,
  CASE WHEN precipitation > 0 THEN 1 ELSE 0 END AS is_raining, CASE WHEN visibility < 2000 THEN 1 ELSE 0 END AS low_visibility,
  CAST(hour(timestamp_utc) AS INTEGER) AS hour_of_day, CASE WHEN isodow(timestamp_utc) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  {sql_season('timestamp_utc')} AS season FROM hj""")
def derived(t):
    out = wj.add_derived(merged(t))
    return out.select(
        "reading_id", F.round("heat_index", 6).alias("heat_index"), F.round("temp_humidity_index", 6).alias("temp_humidity_index"),
        "is_raining", "low_visibility", "hour_of_day", "is_weekend", "season",
    )


@query("p20_wind_category", f"SELECT weather_id, {sql_right_closed('wind_speed_10m', dims.WIND_BINS)} AS wind_category FROM weather")
def wind(t):
    return t.weather.select("weather_id", wx.wind_category("wind_speed_10m").alias("wind_category"))


_ORDERS_TS = "o_orderdate"


@query("p21_season_names", f"""
SELECT o_orderkey, {sql_season(_ORDERS_TS)} AS season, {sql_season(_ORDERS_TS, 'post_monsoon')} AS season_late FROM orders""")
def seasons(t):
    return t.raw("orders").select(
        "o_orderkey",
        calendar.season("o_orderdate").alias("season"),
        calendar.season("o_orderdate", "post_monsoon").alias("season_late"),
    )


@query("q12_join_stats", HOURLY + ", " + NEAR + """
SELECT count(*) AS aqi_records, count(*) AS matched_records, CAST(0 AS BIGINT) AS unmatched_records,
  count(temperature_2m) AS with_weather, 1e2 AS fill_rate, round(count(temperature_2m) / count(*) * 100, 6) AS weather_rate FROM joined""")
def stats(t):
    return wj.join_stats(wj.join_weather(base(t), t.weather, "reading_id", ORDER))
