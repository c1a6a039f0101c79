"""Feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import weather as wx
from aqspark.operators import features as ft
from aqspark.operators import weather_join as wj
from aqspark.plans.marts import rounded
from aqspark.plans.registry import query
from aqspark.plans.tables import sql_right_closed, sql_season
from aqspark.plans.weather import HOURLY, merged

ORDER = ["timestamp_utc", "reading_id"]
BY_SERIES = "PARTITION BY city, parameter ORDER BY timestamp_utc, reading_id"
HOLIDAYS = ", ".join(f"'{d}'" for d in dims.HOLIDAYS)


def series_rows(t):
    return ft.positioned(t.readings.select("reading_id", "city", "parameter", "value", "timestamp_utc"), ORDER)


def named(df, *drop):
    return rounded(df.drop("_pos", "_n", "city", "parameter", "value", "timestamp_utc", *drop))


@query("w01_lag_features", "SELECT reading_id, " + ", ".join(
    f"round(lag(value, {n}) OVER s, 6) AS value_lag_{n}h, round(value - lag(value, {n}) OVER s, 6) AS value_diff_{n}h, "
    f"round(value / nullif(lag(value, {n}) OVER s, 0) - 1, 6) AS value_pct_{n}h" for n in dims.LAG_HOURS
) + f" FROM readings WINDOW s AS ({BY_SERIES})")
def lags(t):
    return named(ft.lag_features(series_rows(t)))


def _rolling_sql(with_median: bool) -> str:
    parts = []
    for n in dims.ROLLING_WINDOWS:
        f = f"OVER ({BY_SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        if with_median:
            parts.append(f"round(median(value) {f}, 6) AS value_roll_median_{n}h")
        else:
            parts += [
                f"round({fn}(value) {f}, 6) AS value_roll_{name}_{n}h"
                for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
            ]
    return "SELECT reading_id, " + ", ".join(parts) + " FROM readings"


@query("w02_rolling_statistics", _rolling_sql(False))
def rolling(t):
    return named(ft.rolling_features(series_rows(t), median=False))


@query("w03_rolling_median", _rolling_sql(True))
def rolling_median(t):
    out = ft.rolling_features(series_rows(t))
    return rounded(out.select("reading_id", *[f"value_roll_median_{n}h" for n in dims.ROLLING_WINDOWS]))


EMA_SPANS = [3, 6, 12, 24, 48, 168]


# the twin sums over each row's last rows in closed form: weights below 1e-12 are left out
def _ema_sql(span: int, rows: int) -> str:
    d = 1.0 - 2.0 / (span + 1.0)
    return f"""e{span} AS (SELECT a.reading_id, sum(b.value * pow(CAST({d!r} AS DOUBLE), a.rn - b.rn))
      / sum(pow(CAST({d!r} AS DOUBLE), a.rn - b.rn)) AS ema FROM n a JOIN n b ON a.city = b.city AND a.parameter = b.parameter
      AND b.rn BETWEEN a.rn - {rows} AND a.rn GROUP BY a.reading_id)"""


@query("w04_exponential_mean", f"n AS (SELECT *, row_number() OVER ({BY_SERIES}) AS rn FROM readings), "
       + ", ".join(_ema_sql(s, 15 * s) for s in EMA_SPANS) + " SELECT reading_id, " + ", ".join(f"round(e{s}.ema, 6) AS value_ema_{s}h" for s in EMA_SPANS)
       + " FROM e3 " + " ".join(f"JOIN e{s} USING (reading_id)" for s in EMA_SPANS[1:]))
def ema(t):
    return named(ft.ema_features(series_rows(t), spans=EMA_SPANS))


def weather_series(t):
    return ft.positioned(merged(t), ORDER)


_W24 = f"({BY_SERIES} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query("w05_weather_windows", HOURLY + f"""
SELECT reading_id, round(lag(temperature_2m, 24) OVER s, 6) AS temp_lag_24h,
  round(temperature_2m - lag(temperature_2m, 24) OVER s, 6) AS temp_diff_24h,
  round(avg(temperature_2m) OVER {_W24}, 6) AS temp_roll_mean_24h,
  round(avg(relative_humidity_2m) OVER {_W24}, 6) AS humidity_roll_mean_24h FROM hj WINDOW s AS ({BY_SERIES})""")
def weather_windows(t):
    out = ft.weather_window_features(weather_series(t))
    return rounded(out.select("reading_id", "temp_lag_24h", "temp_diff_24h", "temp_roll_mean_24h", "humidity_roll_mean_24h"))


@query("w06_rain_sum", HOURLY + f"""
SELECT reading_id, round(sum(precipitation) OVER {_W24}, 6) AS precip_roll_sum_24h FROM hj""")
def rain_sum(t):
    return rounded(ft.weather_window_features(weather_series(t)).select("reading_id", "precip_roll_sum_24h"))


@query("w07_rows_since_rain", HOURLY + f""",
n AS (SELECT *, row_number() OVER ({BY_SERIES}) AS rn FROM hj)
SELECT reading_id, rn - max(CASE WHEN precipitation > 0 THEN rn END) OVER (PARTITION BY city, parameter ORDER BY rn) AS hours_since_rain FROM n""")
def since_rain(t):
    return ft.rows_since(weather_series(t), "precipitation", "hours_since_rain").select("reading_id", "hours_since_rain")


def _cyclic(ts: str, year: str) -> str:
    parts = []
    for name, v, p in (("hour", f"hour({ts})", 24), ("dow", f"(isodow({ts}) - 1)", 7), ("month", f"month({ts})", 12), ("doy", f"dayofyear({ts})", year)):
        parts += [f"round(sin(2 * pi() * {v} / {p}), 6) AS {name}_sin", f"round(cos(2 * pi() * {v} / {p}), 6) AS {name}_cos"]
    return ", ".join(parts)


def _as_int(expr: str, name: str) -> str:
    return f"CAST({expr} AS INTEGER) AS {name}"


@query("p22_calendar_features", f"""
SELECT reading_id, {_cyclic('timestamp_utc', '365')}, {_as_int('hour(timestamp_utc)', 'hour_of_day')},
  {_as_int('isodow(timestamp_utc) - 1', 'day_of_week')}, {_as_int('month(timestamp_utc)', 'month')},
  {_as_int('isodow(timestamp_utc) >= 6', 'is_weekend')}, {_as_int('hour(timestamp_utc) IN (8,9,10,17,18,19)', 'is_rush_hour')},
  {sql_season('timestamp_utc', 'post_monsoon')} AS season,
  {", ".join(_as_int(f"{sql_season('timestamp_utc', 'post_monsoon')} = '{s}'", f"season_{s}") for s in ("winter", "spring", "monsoon", "post_monsoon"))},
  {_as_int(f"strftime(timestamp_utc, '%Y-%m-%d') IN ({HOLIDAYS})", 'is_holiday')},
  {_as_int('hour(timestamp_utc) BETWEEN 6 AND 18', 'is_daytime')} FROM readings""")
def calendar(t):
    return rounded(t.readings.select("reading_id", "timestamp_utc").withColumns(ft.time_columns()).drop("timestamp_utc"))


@query("p25_builder_calendar", f"""
SELECT o_orderkey, {_cyclic('o_orderdate', '365.25e0')}, {_as_int('hour(o_orderdate)', 'hour')},
  {_as_int('isodow(o_orderdate) - 1', 'day_of_week')}, {_as_int('month(o_orderdate)', 'month')},
  {_as_int('dayofyear(o_orderdate)', 'day_of_year')}, {_as_int('isodow(o_orderdate) >= 6', 'is_weekend')},
  {_as_int('hour(o_orderdate) IN (7,8,9,17,18,19)', 'is_rush_hour')} FROM orders""")
def builder_calendar(t):
    return rounded(t.raw("orders").select("o_orderkey", "o_orderdate").withColumns(ft.builder_time_columns("o_orderdate")).drop("o_orderdate"))


@query("p23_interactions", HOURLY + """
SELECT reading_id, round(temperature_2m * relative_humidity_2m / 100, 6) AS temp_x_humidity, round(wind_speed_10m * value, 6) AS wind_x_aqi,
  round(1e0 / (wind_speed_10m + 1e-1), 6) AS stagnation_index,
  round(1e0 / (wind_speed_10m + 1e-1) * relative_humidity_2m / 100 * CASE WHEN temperature_2m < 20 THEN 20e0 - temperature_2m
    WHEN temperature_2m >= 20 THEN 0e0 END, 6) AS inversion_proxy, round(precipitation * value, 6) AS rain_cleanup FROM hj""")
def interactions(t):
    return rounded(merged(t).select("reading_id", *[c.alias(n) for n, c in wx.interactions("value").items()]))


@query("p24_wind_components", """
SELECT weather_id, round(wind_speed_10m * cos(radians(wind_direction_10m)), 6) AS wind_u,
  round(wind_speed_10m * sin(radians(wind_direction_10m)), 6) AS wind_v, CAST(wind_speed_10m < 15e-1 AS INTEGER) AS is_calm_wind,
  CAST(relative_humidity_2m > 80 AS INTEGER) AS is_high_humidity FROM weather""")
def wind_components(t):
    return rounded(t.weather.select("weather_id", *[c.alias(n) for n, c in ft.wind_columns().items()]))


@query("p27_category_one_hot", "SELECT reading_id, " + ", ".join(
    f"CASE WHEN {sql_right_closed('value', dims.AQI_ONE_HOT_BINS)} = '{n}' THEN 1 ELSE 0 END AS aqi_cat_{n}" for _, _, n in dims.AQI_ONE_HOT_BINS
) + " FROM readings")
def one_hot(t):
    return t.readings.select("reading_id", *[c.alias(n) for n, c in ft.category_one_hot("value").items()])


@query("w22_city_instant_statistics", """
SELECT reading_id, round(avg(value) OVER c, 6) AS city_mean_aqi, round(stddev_samp(value) OVER c, 6) AS city_std_aqi,
  round(min(value) OVER c, 6) AS city_min_aqi, round(max(value) OVER c, 6) AS city_max_aqi, count(value) OVER c AS city_station_count
FROM (SELECT reading_id, city, value, date_trunc('hour', timestamp_utc) AS ts FROM readings) WINDOW c AS (PARTITION BY city, ts)""")
def spatial(t):
    rows = t.readings.select("reading_id", "city", "value", F.date_trunc("hour", "timestamp_utc").alias("ts"))
    return rounded(ft.spatial_features(rows, ts="ts").drop("city", "value", "ts"))


@query("j06_group_statistics_on_rows", """
g AS (SELECT city, date_trunc('hour', timestamp_utc) AS ts, avg(value) AS m, count(*) AS n FROM readings GROUP BY 1, 2)
SELECT r.reading_id, round(r.value - g.m, 6) AS above_city_mean, g.n AS city_station_count
FROM readings r JOIN g ON r.city = g.city AND date_trunc('hour', r.timestamp_utc) = g.ts""")
def group_on_rows(t):
    rows = t.readings.select("reading_id", "city", "value", F.date_trunc("hour", "timestamp_utc").alias("ts"))
    out = ft.spatial_features(rows, ts="ts")
    return out.select("reading_id", F.round(F.col("value") - F.col("city_mean_aqi"), 6).alias("above_city_mean"), "city_station_count")


# --- hourly grid ---

WX = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m"]


def aqi_readings(t):
    return t.readings.where(F.col("parameter") == "aqi").select("city", "timestamp_utc", "value")


def _grid_sql(name: str, source: str, where: str, cols: dict[str, str]) -> str:
    """CTEs giving an hourly grid per city with linear interpolation of each column."""
    means = ", ".join(f"avg({e}) AS {c}" for c, e in cols.items())
    edges = ", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER b AS {c}_p0, last_value({c} IGNORE NULLS) OVER b AS {c}_v0, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER f AS {c}_p1, first_value({c} IGNORE NULLS) OVER f AS {c}_v1"
        for c in cols
    )
    out = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_p1 IS NOT NULL THEN {c}_v0 + ({c}_v1 - {c}_v0) * ((epoch(ts) - {c}_p0) / ({c}_p1 - {c}_p0)) "
        f"ELSE {c}_v0 END AS {c}" for c in cols
    )
    return f"""{name}_h AS (SELECT city, date_trunc('hour', timestamp_utc) AS ts, {means} FROM {source} {where} GROUP BY 1, 2),
{name}_g AS (SELECT city, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {name}_h GROUP BY city),
{name}_e AS (SELECT g.city, g.ts, {", ".join(f"h.{c}" for c in cols)} FROM {name}_g g LEFT JOIN {name}_h h ON g.city = h.city AND g.ts = h.ts),
{name}_w AS (SELECT *, {edges} FROM {name}_e WINDOW b AS (PARTITION BY city ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  f AS (PARTITION BY city ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT city, ts, {out} FROM {name}_w)"""


GRID = _grid_sql("grid", "readings", "WHERE parameter = 'aqi'", {"aqi": "value"})
WX_GRID = _grid_sql("wgrid", "weather", "", {c: c for c in WX})
_FF = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS {c}" for c in ["aqi", *WX])
_BF = ", ".join(f"first_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS {c}" for c in ["aqi", *WX])
TRAINING = GRID + ",\n" + WX_GRID + f""",
tj AS (SELECT g.city, g.ts, g.aqi, {", ".join("w." + c for c in WX)} FROM grid g LEFT JOIN wgrid w ON g.city = w.city AND g.ts = w.ts),
tf AS (SELECT city, ts, {_FF} FROM tj), tb AS (SELECT city, ts, {_BF} FROM tf),
training AS (SELECT * REPLACE (least(greatest(aqi, 0e0), 5e2) AS aqi) FROM tb)"""


def training(t):
    return ft.training_table(aqi_readings(t), t.weather, WX)


@query("w24_training_table", TRAINING + f" SELECT city, ts, {', '.join(f'round({c}, 6) AS {c}' for c in ['aqi', *WX])} FROM training")
def training_table(t):
    return rounded(training(t))


@query("j17_weather_on_hourly_series", GRID + ",\n" + WX_GRID + """
SELECT g.city, g.ts, round(g.aqi, 6) AS aqi, round(w.temperature_2m, 6) AS temperature_2m FROM grid g LEFT JOIN wgrid w ON g.city = w.city AND g.ts = w.ts""")
def weather_on_grid(t):
    grid = ft.hourly_grid(aqi_readings(t))
    wgrid = ft.hourly_grid(t.weather, "temperature_2m", "temperature_2m")
    return rounded(grid.join(wgrid, ["city", "ts"], "left"))


def _builder_sql(windows) -> str:
    parts = [f"round(lag(aqi, {n}) OVER s, 6) AS aqi_lag_{n}" for n in dims.BUILDER_LAGS]
    for n in windows:
        f = f"OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("median", "median")):
            parts.append(f"round(CASE WHEN count(aqi) {f} = {n} THEN {fn}(aqi) {f} END, 6) AS aqi_roll_{name}_{n}")
    return GRID + " SELECT city, ts, " + ", ".join(parts) + " FROM grid WINDOW s AS (PARTITION BY city ORDER BY ts)"


@query("w10_full_window_features", _builder_sql(dims.ROLLING_WINDOWS))
def full_windows(t):
    return rounded(ft.builder_features(ft.hourly_grid(aqi_readings(t))).drop("aqi"))


@query("w11_delta_features", GRID + """
SELECT city, ts, round(aqi - lag(aqi, 1) OVER s, 6) AS aqi_diff_1, round(aqi - lag(aqi, 3) OVER s, 6) AS aqi_diff_3,
  round(aqi - lag(aqi, 24) OVER s, 6) AS aqi_diff_24, round(aqi / nullif(lag(aqi, 1) OVER s, 0) - 1, 6) AS aqi_pct_change_1,
  round(aqi / nullif(lag(aqi, 24) OVER s, 0) - 1, 6) AS aqi_pct_change_24,
  round((aqi - lag(aqi, 1) OVER s) - (lag(aqi, 1) OVER s - lag(aqi, 2) OVER s), 6) AS aqi_accel
FROM grid WINDOW s AS (PARTITION BY city ORDER BY ts)""")
def deltas(t):
    return rounded(ft.delta_features(ft.hourly_grid(aqi_readings(t))).drop("aqi"))


@query("p26_weather_products", TRAINING + """,
l AS (SELECT *, lag(aqi, 1) OVER (PARTITION BY city ORDER BY ts) AS l1 FROM training)
SELECT city, ts, round(temperature_2m * relative_humidity_2m, 6) AS wx_temperature_2m_x_relative_humidity_2m,
  round(temperature_2m * wind_speed_10m, 6) AS wx_temperature_2m_x_wind_speed_10m, round(temperature_2m * l1, 6) AS wx_temperature_2m_x_aqi_lag1,
  round(relative_humidity_2m * wind_speed_10m, 6) AS wx_relative_humidity_2m_x_wind_speed_10m,
  round(relative_humidity_2m * l1, 6) AS wx_relative_humidity_2m_x_aqi_lag1, round(wind_speed_10m * l1, 6) AS wx_wind_speed_10m_x_aqi_lag1 FROM l""")
def products(t):
    table = ft.builder_features(training(t), lags=[1], windows=[3], median=False)
    return rounded(table.select("city", "ts", *[c.alias(n) for n, c in ft.weather_interactions(WX).items()]))


@query("w23_sequences", GRID + """,
q AS (SELECT city, ts, list(aqi) OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS i,
  list(aqi) OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 72 FOLLOWING) AS o FROM grid)
SELECT city, ts, CAST(len(i) AS INTEGER) AS n_inputs, CAST(len(o) AS INTEGER) AS n_targets, round(i[1], 6) AS first_input,
  round(i[168], 6) AS last_input, round(o[1], 6) AS first_target, round(o[72], 6) AS last_target FROM q WHERE len(i) = 168 AND len(o) = 72""")
def sequences(t):
    s = ft.sequences(ft.hourly_grid(aqi_readings(t)))
    at = lambda c, i: F.round(F.element_at(c, i), 6)
    return s.select(
        "city", "ts", F.size("inputs").alias("n_inputs"), F.size("targets").alias("n_targets"),
        at("inputs", 1).alias("first_input"), at("inputs", -1).alias("last_input"),
        at("targets", 1).alias("first_target"), at("targets", -1).alias("last_target"),
    )


@query("w10_feature_set_whole")
def whole_feature_set(t):
    """All feature groups in one table (rows-only: its parts have twins)."""
    return ft.create_features(merged(t), ORDER)
