"""Reporting views and marts over cleaned readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import index
from aqspark.functions.bins import lookup, upper_cuts


def cleaned(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("is_cleaned"))


def valid(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("is_cleaned") & (F.col("quality_flag") == "valid"))


def since(df: DataFrame, as_of: Column, interval: str, ts: str = "timestamp_utc") -> DataFrame:
    """Rows not older than ``interval`` before ``as_of``."""
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {interval}"))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as an aggregate, so only one row per key and task is shuffled."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(newest.alias("_r")).select("_r.*")


def latest_city_aqi(readings: DataFrame, tiebreak: str = "reading_id") -> DataFrame:
    rows = valid(readings).select("city", "parameter", "value", "aqi_category", "timestamp_utc", "source", tiebreak)
    return latest_by(rows, ["city", "parameter"], ["timestamp_utc", tiebreak]).drop(tiebreak)


def daily_city_aqi(readings: DataFrame, digits: int = 2) -> DataFrame:
    return (
        valid(readings)
        .groupBy("city", "parameter", F.to_date("timestamp_utc").alias("reading_date"))
        .agg(
            F.round(F.avg("value"), digits).alias("avg_value"),
            F.round(F.min("value"), digits).alias("min_value"),
            F.round(F.max("value"), digits).alias("max_value"),
            F.round(F.stddev_samp("value"), digits).alias("std_value"),
            F.count(F.lit(1)).alias("reading_count"),
            F.max("aqi_category").alias("dominant_category"),
        )
    )


def unhealthy_hours(readings: DataFrame, as_of: Column, interval: str = "24 HOURS", digits: int = 2) -> DataFrame:
    v = F.col("value")
    return (
        since(valid(readings), as_of, interval)
        .groupBy("city", "parameter")
        .agg(
            F.count_if(v > 200).alias("unhealthy_hours"),
            F.count_if(v > 300).alias("very_poor_hours"),
            F.count_if(v > 400).alias("severe_hours"),
            F.count(F.lit(1)).alias("total_hours"),
        )
        .withColumn("unhealthy_pct", F.round(F.col("unhealthy_hours") / F.col("total_hours") * 100, digits))
    )


def daily_weather(weather: DataFrame) -> DataFrame:
    return weather.groupBy("city", F.to_date("timestamp_utc").alias("reading_date")).agg(
        F.avg("temperature_2m").alias("_temp"),
        F.avg("wind_speed_10m").alias("_wind"),
        F.sum("precipitation").alias("_rain"),
        F.count(F.lit(1)).alias("_rows"),
    )


def between(start: str | None, end: str | None, ts: str = "timestamp_utc") -> Column:
    """From ``start`` on and before ``end``; a bound that is not given bounds nothing."""
    low = F.lit(True) if start is None else F.col(ts) >= F.lit(start).cast("timestamp")
    return low if end is None else low & (F.col(ts) < F.lit(end).cast("timestamp"))


def kpi_daily(
    readings: DataFrame,
    weather: DataFrame,
    start: str | None = None,
    end: str | None = None,
    fanout: bool = False,
    digits: int = 2,
) -> DataFrame:
    """Daily indicators per city with the day's weather.

    Weather is reduced to one row per city and day before the join. With
    ``fanout`` the counts and the rain total are those of joining every reading
    to every weather row of the day, worked out from the two row counts. Days
    before ``start`` or from ``end`` on are left out where those are given.
    """
    v, p = F.col("value"), F.col("parameter")

    def only(name: str) -> Column:
        return F.when(p == name, v)

    days = (
        valid(readings)
        .where(between(start, end))
        .groupBy("city", F.to_date("timestamp_utc").alias("reading_date"))
        .agg(
            F.round(F.avg(only("pm25")), digits).alias("pm25_avg"),
            F.round(F.max(only("pm25")), digits).alias("pm25_max"),
            F.round(F.min(only("pm25")), digits).alias("pm25_min"),
            F.round(F.avg(only("pm10")), digits).alias("pm10_avg"),
            F.round(F.max(only("pm10")), digits).alias("pm10_max"),
            F.round(F.avg(only("aqi")), digits).alias("aqi_avg"),
            F.round(F.max(only("aqi")), digits).alias("aqi_peak"),
            index.aqi_cut_category(F.avg(only("aqi")), null_label=dims.TOP_LABEL).alias("health_category"),
            F.count_if((p == "pm25") & (v > 60)).alias("pm25_unhealthy_hours"),
            F.count_if((p == "aqi") & (v > 200)).alias("aqi_poor_hours"),
            # the stored parameters are a fixed list, so the set stays tiny
            F.size(F.collect_set("parameter")).cast("long").alias("parameters_measured"),
            F.count(F.lit(1)).alias("total_readings"),
        )
    )
    joined = days.join(daily_weather(weather), ["city", "reading_date"], "left")
    rain = F.col("_rain")
    if fanout:
        times = F.greatest(F.coalesce(F.col("_rows"), F.lit(1)), F.lit(1))
        rain = rain * F.col("total_readings")
        joined = joined.withColumn("_times", times).withColumn("_rain_out", rain)
        for c in ("pm25_unhealthy_hours", "aqi_poor_hours", "total_readings"):
            joined = joined.withColumn(c, F.col(c) * F.col("_times"))
        rain = F.col("_rain_out")
    return joined.withColumns({
        "avg_temp": F.round("_temp", digits),
        "avg_wind_speed": F.round("_wind", digits),
        "total_precipitation": F.round(rain, digits),
    }).drop("_temp", "_wind", "_rain", "_rows", "_times", "_rain_out")


def hourly_city_mean(readings: DataFrame, as_of: Column, interval: str = "30 DAYS") -> DataFrame:
    hour = F.date_trunc("hour", "timestamp_utc")
    rows = since(valid(readings), as_of, interval).where(F.col("parameter").isin("aqi", "pm25"))
    h = F.hour("hour_bin")
    return rows.groupBy("city", hour.alias("hour_bin")).agg(F.avg("value").alias("hourly_aqi")).withColumn(
        "time_weight",
        F.when(h.isin(dims.RUSH_HOURS), F.lit(1.5)).when(h.between(6, 22), F.lit(1.0)).otherwise(F.lit(0.7)),
    )


def exposure_score(readings: DataFrame, as_of: Column, interval: str = "30 DAYS", digits: int = 2) -> DataFrame:
    """Population-weighted exposure per city over the look-back."""
    a, w = F.col("hourly_aqi"), F.col("time_weight")
    night = w == 0.7
    parts = hourly_city_mean(readings, as_of, interval).groupBy("city").agg(
        F.round(F.avg(a * w), digits).alias("intensity_score"),
        F.round(F.count_if(a > 200) / F.count(F.lit(1)) * 100, digits).alias("unhealthy_duration_pct"),
        # one value per hour of the look-back, so the exact percentile is bounded
        F.round(F.percentile(a, F.lit(0.95)), digits).alias("peak_aqi_95th"),
        F.max(a).alias("max_aqi"),
        F.round(F.try_divide(F.count_if((a > 100) & night), F.count_if(night)) * 100, digits).alias(
            "nighttime_unhealthy_pct"
        ),
        F.count(F.lit(1)).alias("total_hours"),
    )
    people = lookup(dims.CITY_POPULATION_MILLIONS, "city")
    scored = parts.withColumn("population_millions", people).withColumn(
        "_score",
        F.least(
            F.col("intensity_score") / 500 * 100 * 0.40
            + F.col("unhealthy_duration_pct") * 0.25
            + F.col("peak_aqi_95th") / 500 * 100 * 0.20
            + F.coalesce(F.col("population_millions") / 30 * 100, F.lit(10.0)) * 0.15,
            F.lit(100.0),
        ),
    )
    return scored.withColumns({
        "exposure_score": F.round("_score", digits),
        "exposure_category": upper_cuts("_score", [(25, "Low"), (50, "Moderate"), (75, "High")], "Critical"),
    }).drop("_score")


def daily_mean_aqi(readings: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    ts = F.col("timestamp_utc")
    return (
        valid(readings)
        .where(F.col("parameter").isin("aqi", "pm25"))
        .where(between(start, end))
        .groupBy("city", F.to_date(ts).alias("reading_date"))
        .agg(F.avg("value").alias("daily_avg_aqi"))
    )


def unhealthy_streaks(daily: DataFrame, threshold: float = 200, break_on_gap: bool = False) -> DataFrame:
    """Add the number of bad days in the run each day belongs to.

    One row per city and calendar day, so a city's window is bounded by days.
    """
    by_city = Window.partitionBy("city").orderBy("reading_date")
    good = F.when(F.col("daily_avg_aqi") <= threshold, 1).otherwise(0)
    if break_on_gap:
        skipped = F.date_diff("reading_date", F.lag("reading_date").over(by_city)) > 1
        good = F.when(F.coalesce(skipped, F.lit(False)), 1).otherwise(good)
        daily = daily.withColumn("_break", good)
        good = F.col("_break")
    grouped = daily.withColumn("grp", F.sum(good).over(by_city))
    bad = F.sum(F.when(F.col("daily_avg_aqi") > threshold, 1).otherwise(0))
    return grouped.withColumn("consecutive_unhealthy", bad.over(Window.partitionBy("city", "grp"))).drop("_break")


def unhealthy_days(
    readings: DataFrame, threshold: float = 200, start: str | None = None, end: str | None = None, digits: int = 2
) -> DataFrame:
    a = F.col("daily_avg_aqi")
    runs = unhealthy_streaks(daily_mean_aqi(readings, start, end), threshold)
    return runs.groupBy("city").agg(
        F.count(F.lit(1)).alias("total_days_monitored"),
        F.count_if(a > 100).alias("moderate_days"),
        F.count_if(a > 200).alias("poor_days"),
        F.count_if(a > 300).alias("very_poor_days"),
        F.count_if(a > 400).alias("severe_days"),
        F.round(F.count_if(a > threshold) / F.count(F.lit(1)) * 100, digits).alias("unhealthy_days_pct"),
        F.round(F.avg(a), digits).alias("avg_daily_aqi"),
        F.round(F.max(a), digits).alias("worst_day_aqi"),
        F.max(F.when(a > 300, F.col("reading_date"))).alias("last_very_poor_day"),
        F.max("consecutive_unhealthy").alias("longest_unhealthy_streak"),
    )
