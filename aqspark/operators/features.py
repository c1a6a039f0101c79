"""Feature tables for forecasting: lags, rolling statistics, calendar, weather, space.

Raw readings of a (city, parameter) series may be very many, so lag and rolling
features run on position blocks (see ``series``). Features of the hourly city
grid use plain windows: a city has one row per hour there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import calendar
from aqspark.functions import weather as wx
from aqspark.functions.bins import flag, right_closed
from aqspark.operators.series import MIN_BLOCK, ewm_mean, null_safe_join, running, series_window, with_position

SERIES = ["city", "parameter"]


def positioned(df: DataFrame, order: list, keys: list[str] | None = None) -> DataFrame:
    return with_position(df, keys or SERIES, order)


def lag_columns(w: WindowSpec, value: str, lags: list[int]) -> dict[str, Column]:
    """Lag, difference and relative change per step count; null where there is no basis."""
    out: dict[str, Column] = {}
    for n in lags:
        before = F.lag(value, n).over(w)
        out[f"{value}_lag_{n}h"] = before
        out[f"{value}_diff_{n}h"] = F.col(value) - before
        out[f"{value}_pct_{n}h"] = F.try_divide(F.col(value), before) - 1
    return out


def rolling_columns(w: WindowSpec, value: str, windows: list[int], median: bool = True) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        out[f"{value}_roll_mean_{n}h"] = F.avg(value).over(frame)
        out[f"{value}_roll_std_{n}h"] = F.stddev_samp(value).over(frame)
        out[f"{value}_roll_min_{n}h"] = F.min(value).over(frame)
        out[f"{value}_roll_max_{n}h"] = F.max(value).over(frame)
        if median:
            out[f"{value}_roll_median_{n}h"] = F.percentile(value, F.lit(0.5)).over(frame)
    return out


def lag_features(placed: DataFrame, value="value", lags=None, keys=None, min_block: int = MIN_BLOCK) -> DataFrame:
    lags = lags or dims.LAG_HOURS
    return series_window(placed, keys or SERIES, lambda w: lag_columns(w, value, lags), before=max(lags), min_block=min_block)


def rolling_features(
    placed: DataFrame, value="value", windows=None, median: bool = True, keys=None, min_block: int = MIN_BLOCK
) -> DataFrame:
    windows = windows or dims.ROLLING_WINDOWS
    return series_window(
        placed, keys or SERIES, lambda w: rolling_columns(w, value, windows, median), before=max(windows), min_block=min_block
    )


def ema_features(placed: DataFrame, value="value", spans=None, keys=None, source: DataFrame | None = None) -> DataFrame:
    return ewm_mean(placed, keys or SERIES, value, {f"{value}_ema_{s}h": s for s in spans or dims.ROLLING_WINDOWS}, source)


def weather_window_columns(w: WindowSpec, columns: list[str]) -> dict[str, Column]:
    day = w.rowsBetween(-23, 0)
    out: dict[str, Column] = {}
    if "temperature_2m" in columns:
        out["temp_lag_24h"] = F.lag("temperature_2m", 24).over(w)
        out["temp_diff_24h"] = F.col("temperature_2m") - F.lag("temperature_2m", 24).over(w)
        out["temp_roll_mean_24h"] = F.avg("temperature_2m").over(day)
    if "relative_humidity_2m" in columns:
        out["humidity_roll_mean_24h"] = F.avg("relative_humidity_2m").over(day)
    if "precipitation" in columns:
        out["precip_roll_sum_24h"] = F.sum("precipitation").over(day)
    return out


def weather_window_features(placed: DataFrame, keys=None, min_block: int = MIN_BLOCK) -> DataFrame:
    return series_window(
        placed, keys or SERIES, lambda w: weather_window_columns(w, placed.columns), before=24, min_block=min_block
    )


def rows_since(
    placed: DataFrame, column: str, name: str, threshold: float = 0.0, keys=None, source: DataFrame | None = None
) -> DataFrame:
    """Rows since ``column`` last exceeded the threshold; null before the first time."""
    event = F.when(F.col(column) > threshold, F.col("_pos"))
    out = running(placed, keys or SERIES, lasts={"_event": event}, source=source)
    return out.withColumn(name, F.col("_pos") - F.col("_event")).drop("_event")


def wind_columns(speed="wind_speed_10m", direction="wind_direction_10m", humidity="relative_humidity_2m") -> dict[str, Column]:
    u, v = wx.wind_components(speed, direction)
    return {"wind_u": u, "wind_v": v, "is_calm_wind": flag(F.col(speed) < 1.5), "is_high_humidity": flag(F.col(humidity) > 80)}


def time_columns(ts: str = "timestamp_utc") -> dict[str, Column]:
    """Calendar features with holidays, season one-hots, rush hours and daytime."""
    out = calendar.calendar_columns(ts)
    out.pop("day_of_year")
    out.update(calendar.season_columns(ts))
    out["is_holiday"] = calendar.is_holiday(ts)
    out["is_daytime"] = calendar.is_daytime(ts)
    return out


def builder_time_columns(ts: str) -> dict[str, Column]:
    """Second calendar set: earlier rush hours and a year of 365.25 days."""
    out = calendar.calendar_columns(ts, rush_hours=dims.RUSH_HOURS_EARLY, year_days=365.25)
    out["hour"] = out.pop("hour_of_day")
    return out


def spatial_features(df: DataFrame, value: str = "value", ts: str = "timestamp_utc") -> DataFrame:
    """Statistics of the city at the same instant, on every row."""
    stats = df.groupBy("city", ts).agg(
        F.avg(value).alias("city_mean_aqi"),
        F.stddev_samp(value).alias("city_std_aqi"),
        F.min(value).alias("city_min_aqi"),
        F.max(value).alias("city_max_aqi"),
        F.count(value).alias("city_station_count"),
    )
    return null_safe_join(df, stats, ["city", ts])


def category_one_hot(value: str, prefix: str = "aqi_cat") -> dict[str, Column]:
    label = right_closed(value, dims.AQI_ONE_HOT_BINS)
    return {f"{prefix}_{name}": flag(label == name) for _, _, name in dims.AQI_ONE_HOT_BINS}


def weather_interactions(columns: list[str], lag: str = "aqi_lag_1") -> dict[str, Column]:
    out = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            out[f"wx_{a}_x_{b}"] = F.col(a) * F.col(b)
        out[f"wx_{a}_x_aqi_lag1"] = F.col(a) * F.col(lag)
    return out


def create_features(df: DataFrame, order: list, lags=None, windows=None, median: bool = True) -> DataFrame:
    """The whole first feature set over merged readings and weather.

    Each step that moves rows moves all columns made before it, so the windows,
    which make most of them, come last, and sums of blocks are taken from the
    narrow rows.
    """
    placed = positioned(df, order)
    lags, windows = lags or dims.LAG_HOURS, windows or dims.ROLLING_WINDOWS
    window_columns = lambda w: {
        **lag_columns(w, "value", lags),
        **rolling_columns(w, "value", windows, median),
        **weather_window_columns(w, df.columns),
    }
    rows = spatial_features(placed)
    spatial = [c for c in rows.columns if c not in placed.columns]
    rows = ema_features(rows, spans=windows, source=placed)
    since = []
    if "precipitation" in df.columns:
        rows, since = rows_since(rows, "precipitation", "hours_since_rain", source=placed), ["hours_since_rain"]
    wide = series_window(rows, SERIES, window_columns, before=max([*lags, *windows, 24]))
    made = [c for c in wide.columns if c not in rows.columns]
    out = wide.select(*df.columns, *made, *[f"value_ema_{s}h" for s in windows], *since, *spatial)
    out = out.withColumns(time_columns())
    if {"wind_speed_10m", "wind_direction_10m", "relative_humidity_2m", "temperature_2m", "precipitation"} <= set(df.columns):
        out = out.withColumns({**wind_columns(), **wx.interactions("value")})
    return out.select(*[c for c in out.columns if c not in spatial], *spatial)


# --- hourly grid per city: one row per hour, so windows by city stay bounded ---


def hourly_grid(readings: DataFrame, value: str = "value", name: str = "aqi", keys: list[str] | None = None) -> DataFrame:
    """Hourly means on a gapless grid from the first to the last hour, gaps interpolated."""
    keys = keys or ["city"]
    hourly = readings.groupBy(*keys, F.date_trunc("hour", "timestamp_utc").alias("ts")).agg(F.avg(value).alias(name))
    span = hourly.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    return interpolate_grid(grid.join(hourly, [*keys, "ts"], "left"), [name], keys)


def interpolate_grid(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Linear in time between known hours; hours after the last known one keep its value."""
    so_far = (Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy("ts").rowsBetween(*so_far)
    # the rows ahead are those so far in descending order, a frame Spark grows row by row
    ahead = Window.partitionBy(*keys).orderBy(F.col("ts").desc()).rowsBetween(*so_far)
    out = {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.unix_seconds("ts").alias("p"), F.col(c).alias("v")))
        prev, nxt = F.last(known, ignorenulls=True).over(back), F.last(known, ignorenulls=True).over(ahead)
        share = (F.unix_seconds("ts") - prev["p"]) / (nxt["p"] - prev["p"])
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(
            nxt.isNotNull(), prev["v"] + (nxt["v"] - prev["v"]) * share
        ).otherwise(prev["v"])
    return df.withColumns(out)


def training_table(readings: DataFrame, weather: DataFrame | None, weather_cols: list[str], limit: int = 6) -> DataFrame:
    """Hourly AQI per city with hourly weather, short edge gaps filled, AQI clipped to 0..500."""
    table = hourly_grid(readings)
    if weather is not None:
        means = weather.groupBy("city", F.date_trunc("hour", "timestamp_utc").alias("ts")).agg(
            *[F.avg(c).alias(c) for c in weather_cols]
        )
        span = means.groupBy("city").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
        grid = span.select("city", F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
        hourly = interpolate_grid(grid.join(means, ["city", "ts"], "left"), weather_cols, ["city"])
        table = table.join(hourly, ["city", "ts"], "left")
    cols = ["aqi", *(weather_cols if weather is not None else [])]
    w = Window.partitionBy("city").orderBy("ts")
    table = table.withColumns({c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c in cols})
    table = table.withColumns({c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, limit)) for c in cols})
    return table.withColumn("aqi", F.least(F.greatest("aqi", F.lit(0.0)), F.lit(500.0)))


def _full(w: WindowSpec, value: str, n: int, stat: Column) -> Column:
    """``stat`` only where the frame holds ``n`` known values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, stat.over(frame))


def builder_features(grid: DataFrame, value: str = "aqi", lags=None, windows=None, median: bool = True) -> DataFrame:
    """Second feature set on the hourly grid: full windows only, deltas and acceleration."""
    w = Window.partitionBy("city").orderBy("ts")
    out: dict[str, Column] = {}
    for n in lags or dims.BUILDER_LAGS:
        out[f"aqi_lag_{n}"] = F.lag(value, n).over(w)
    for n in windows or dims.ROLLING_WINDOWS:
        out[f"aqi_roll_mean_{n}"] = _full(w, value, n, F.avg(value))
        out[f"aqi_roll_std_{n}"] = _full(w, value, n, F.stddev_samp(value))
        out[f"aqi_roll_min_{n}"] = _full(w, value, n, F.min(value))
        out[f"aqi_roll_max_{n}"] = _full(w, value, n, F.max(value))
        if median:
            out[f"aqi_roll_median_{n}"] = _full(w, value, n, F.percentile(value, F.lit(0.5)))
    return grid.withColumns(out)


def delta_features(grid: DataFrame, value: str = "aqi") -> DataFrame:
    w = Window.partitionBy("city").orderBy("ts")
    v = F.col(value)
    lag = lambda n: F.lag(value, n).over(w)
    return grid.withColumns({
        "aqi_diff_1": v - lag(1),
        "aqi_diff_3": v - lag(3),
        "aqi_diff_24": v - lag(24),
        "aqi_pct_change_1": F.try_divide(v, lag(1)) - 1,
        "aqi_pct_change_24": F.try_divide(v, lag(24)) - 1,
        "aqi_accel": (v - lag(1)) - (lag(1) - lag(2)),
    })


def sequences(grid: DataFrame, value: str = "aqi", length: int = 168, horizon: int = 72) -> DataFrame:
    """Input and target arrays per hour, only where both are complete."""
    w = Window.partitionBy("city").orderBy("ts")
    out = grid.select("city", "ts", value).withColumns({
        "inputs": F.collect_list(value).over(w.rowsBetween(-(length - 1), 0)),
        "targets": F.collect_list(value).over(w.rowsBetween(1, horizon)),
    })
    return out.where((F.size("inputs") == length) & (F.size("targets") == horizon)).drop(value)
