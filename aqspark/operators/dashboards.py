"""Panel queries of the trend, quality, health and hotspot dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.functions.bins import flag
from aqspark.operators.marts import cleaned, daily_city_aqi, latest_by, latest_city_aqi, since

HOUR = F.date_trunc


def pm25_series(readings: DataFrame, as_of: Column) -> DataFrame:
    rows = since(cleaned(readings).where(F.col("parameter") == "pm25"), as_of, "7 DAYS")
    return rows.groupBy("city", "timestamp_utc").agg(F.avg("value").alias("avg_aqi"))


def current_by_city(readings: DataFrame) -> DataFrame:
    return latest_city_aqi(readings).where(F.col("parameter") == "aqi").select("city", F.col("value").alias("aqi"))


def pm25_daily(readings: DataFrame, as_of: Column, digits: int = 2) -> DataFrame:
    days = daily_city_aqi(readings.where(F.col("parameter") == "pm25"), digits)
    return days.where(F.col("reading_date") >= F.date_sub(F.to_date(as_of), 30)).select("city", "reading_date", "avg_value")


def category_mix(readings: DataFrame, as_of: Column) -> DataFrame:
    return since(cleaned(readings), as_of, "24 HOURS").groupBy("aqi_category").agg(F.count(F.lit(1)).alias("count"))


def parameter_means(readings: DataFrame, as_of: Column) -> DataFrame:
    return since(cleaned(readings), as_of, "24 HOURS").groupBy("city", "parameter").agg(F.avg("value").alias("avg_value"))


def hours_old(df: DataFrame, as_of: Column) -> DataFrame:
    age = (F.unix_micros(as_of) - F.unix_micros(F.max("timestamp_utc"))) / F.lit(3_600_000_000.0)
    return df.agg(age.alias("hours_ago"))


def quality_counters(readings: DataFrame, weather: DataFrame, stations: DataFrame, as_of: Column) -> DataFrame:
    """Freshness of both feeds, active stations and the last day's rows, as one row."""
    recent = flag(F.col("timestamp_utc") >= as_of - F.expr("INTERVAL 24 HOURS"))
    age = (F.unix_micros(as_of) - F.unix_micros(F.max("timestamp_utc"))) / F.lit(3_600_000_000.0)
    return readings.agg(age.alias("aqi_hours_ago"), F.sum(recent).cast("long").alias("readings_24h")).select(
        "aqi_hours_ago",
        "readings_24h",
        hours_old(weather, as_of).scalar().alias("weather_hours_ago"),
        stations.agg(F.count_if("is_active")).scalar().alias("active_stations"),
    )


def daily_completeness(readings: DataFrame, as_of: Column, expected: float = 8.0) -> DataFrame:
    """Share of the eight parameters seen per day and city."""
    seen = F.size(F.collect_set("parameter"))
    rows = since(readings, as_of, "30 DAYS")
    return rows.groupBy(F.to_date("timestamp_utc").alias("date"), "city").agg(
        (seen / F.lit(expected) * 100).alias("completeness_pct")
    )


def hourly_rate(readings: DataFrame, as_of: Column) -> DataFrame:
    return since(readings, as_of, "48 HOURS").groupBy(F.date_trunc("hour", "timestamp_utc").alias("hour")).agg(
        F.count(F.lit(1)).alias("records")
    )


def source_mix(readings: DataFrame, as_of: Column) -> DataFrame:
    return since(readings, as_of, "24 HOURS").groupBy("source").agg(F.count(F.lit(1)).alias("count"))


def parameter_coverage(readings: DataFrame, as_of: Column) -> DataFrame:
    return since(cleaned(readings), as_of, "24 HOURS").groupBy("city", "parameter").agg(F.count(F.lit(1)).alias("count"))


def total_exposed(exposure: DataFrame) -> DataFrame:
    return exposure.where(F.col("health_category") != "Good").agg(
        F.sum("total_population_millions").alias("total_population_exposed")
    )


def cities_over(readings: DataFrame, as_of: Column, threshold: float = 200) -> DataFrame:
    rows = since(readings.where((F.col("parameter") == "aqi") & (F.col("value") > threshold)), as_of, "24 HOURS")
    return rows.select("city").distinct().agg(F.count(F.lit(1)).alias("cities_in_poor"))


def latest_per_station(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Newest AQI reading of each active station."""
    newest = latest_by(
        readings.where(F.col("parameter") == "aqi").select("location", "value", "timestamp_utc", "reading_id"),
        ["location"],
        ["timestamp_utc", "reading_id"],
    )
    active = stations.where("is_active")
    return active.join(newest, "location").select("location", "city", "latitude", "longitude", F.col("value").alias("aqi"))


def station_heat(readings: DataFrame, stations: DataFrame, as_of: Column) -> DataFrame:
    rows = since(cleaned(readings).where(F.col("parameter") == "pm25"), as_of, "24 HOURS").select("location", "value")
    sums = rows.groupBy("location").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    joined = stations.select("location", "latitude", "longitude").join(sums, "location")
    return joined.groupBy("latitude", "longitude").agg((F.sum("_s") / F.sum("_n")).alias("avg_aqi"))


def wind_now(weather: DataFrame, as_of: Column) -> DataFrame:
    return since(weather, as_of, "1 HOURS").select("city", "latitude", "longitude", "wind_speed_10m", "wind_direction_10m")


def silent_stations(readings: DataFrame, stations: DataFrame, as_of: Column, interval_hours: float = 2) -> DataFrame:
    """Active stations without a reading in the last hours, or without any."""
    last = readings.groupBy("location").agg(F.max("timestamp_utc").alias("last_reading"))
    out = stations.where("is_active").join(last, "location", "left")
    gap = (F.unix_micros(as_of) - F.unix_micros("last_reading")) / F.lit(3_600_000_000.0)
    return out.withColumn("gap_hours", gap).where((F.col("gap_hours") > interval_hours) | F.col("gap_hours").isNull()).select(
        "location", "city", "last_reading", "gap_hours"
    )


def source_quality(readings: DataFrame, as_of: Column, score: str = "quality_score") -> DataFrame:
    return since(readings, as_of, "24 HOURS").groupBy("source").agg(
        F.count(F.lit(1)).alias("total_readings"),
        F.avg(score).alias("avg_quality"),
        F.count_if(F.col(score) < 0.5).alias("low_quality_count"),
    )


def source_freshness(readings: DataFrame, as_of: Column) -> DataFrame:
    age = (F.unix_micros(as_of) - F.unix_micros("latest")) / F.lit(3_600_000_000.0)
    return readings.groupBy("source").agg(F.max("timestamp_utc").alias("latest")).withColumn("age_hours", age)


def table_audit(tables: dict[str, DataFrame], ts: str = "timestamp_utc") -> DataFrame:
    """Row count and time range per table, one row each."""
    out = None
    for name, df in tables.items():
        first, last = (F.min(ts), F.max(ts)) if ts in df.columns else (F.lit(None).cast("timestamp"),) * 2
        row = df.agg(F.count(F.lit(1)).alias("row_count"), first.alias("earliest"), last.alias("latest")).select(
            F.lit(name).alias("table_name"), "row_count", "earliest", "latest"
        )
        out = row if out is None else out.unionByName(row)
    return out


def period_summary(daily: DataFrame, aqi: str = "aqi", day: str = "date") -> DataFrame:
    """Rounded mean, extremes, change from first to last day, good days per city."""
    v, d = F.col(aqi), F.col(day)
    return daily.groupBy("city").agg(
        F.floor(F.avg(v) + 0.5).alias("avg"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.max_by(v, d) - F.min_by(v, d)).alias("trend"),
        F.count_if(v <= 50).alias("good_days"),
    )


def safe_outdoor_hours(daily: DataFrame, as_of: Column, days: int = 7, aqi: str = "aqi", day: str = "date") -> DataFrame:
    """Outdoor hours for each of the last days: max(1, 8 - aqi / 80), rounded half up."""
    recent = daily.where(F.col(day) >= F.date_sub(F.to_date(as_of), days))
    hours = F.floor(F.greatest(F.lit(1.0), F.lit(8.0) - F.col(aqi) / 80) + 0.5)
    return recent.select("city", day, hours.cast("int").alias("hours"))
