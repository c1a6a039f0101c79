"""Write-time rules: rows that break one go to quarantine. Null passes, as in a SQL CHECK."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark import dims


def _c(name: str) -> Column:
    return F.col(name)


STATION_RULES = {
    "valid_latitude": lambda: _c("latitude").between(-90, 90),
    "valid_longitude": lambda: _c("longitude").between(-180, 180),
}
READING_RULES = {
    "valid_aqi_value": lambda: _c("value") >= 0,
    "valid_parameter": lambda: _c("parameter").isin(dims.STORED_PARAMETERS),
}
WEATHER_RULES = {
    "valid_temperature": lambda: _c("temperature_2m").between(-60, 60),
    "valid_humidity": lambda: _c("relative_humidity_2m").between(0, 100),
}
FORECAST_RULES = {
    "valid_predicted_value": lambda: _c("predicted_value") >= 0,
    "valid_forecast_horizon": lambda: _c("forecast_horizon_hours") > 0,
}
ALERT_RULES = {
    "valid_severity": lambda: _c("severity").isin("info", "warning", "critical", "emergency"),
    "valid_alert_type": lambda: _c("alert_type").isin("aqi_threshold", "trend_spike", "forecast_warning", "data_quality"),
}


def mark_violations(df: DataFrame, rules: dict) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks."""
    names = [F.when(~F.coalesce(cond(), F.lit(True)), F.lit(name)) for name, cond in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*names)))


def split_valid(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    marked = mark_violations(df, rules)
    bad = F.size("violations") > 0
    return marked.where(~bad).drop("violations"), marked.where(bad)


def retention(readings: DataFrame, as_of: Column, raw_days: int = 30, hourly_days: int = 365, keep_days: int = 730) -> DataFrame:
    """Readings as stored by age: raw, then hourly means, then daily means, then gone."""
    age = lambda days: as_of - F.make_dt_interval(F.lit(days))
    ts = F.col("timestamp_utc")

    def means(rows: DataFrame, unit: str) -> DataFrame:
        return rows.groupBy("city", "parameter", F.date_trunc(unit, ts).alias("timestamp_utc")).agg(
            F.avg("value").alias("value"), F.count("value").alias("readings")
        ).withColumn("tier", F.lit({"hour": "hourly", "day": "daily"}[unit]))

    raw = readings.where(ts >= age(raw_days)).select(
        "city", "parameter", "timestamp_utc", "value", F.lit(1).cast("long").alias("readings"), F.lit("raw").alias("tier")
    )
    hourly = means(readings.where((ts < age(raw_days)) & (ts >= age(hourly_days))), "hour")
    daily = means(readings.where((ts < age(hourly_days)) & (ts >= age(keep_days))), "day")
    return raw.unionByName(hourly).unionByName(daily)
