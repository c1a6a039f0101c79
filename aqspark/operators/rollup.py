"""Rollups of readings by hour, day, week and month, and summaries of daily means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import index
from aqspark.functions.bins import flag
from aqspark.operators.quantiles import exact_quantiles
from aqspark.operators.series import null_safe_join

PERIODS = {
    "hour": ("timestamp_hourly", lambda ts: F.date_trunc("hour", ts)),
    "day": ("date", lambda ts: F.to_date(ts)),
    "week": ("week_start", lambda ts: F.to_date(F.date_trunc("week", ts))),
    "month": ("month_start", lambda ts: F.to_date(F.date_trunc("month", ts))),
}
EXPECTED_ROWS = {"day": 24, "week": 24 * 7}
COUNTED_IN_PLACE = ("hour", "day")  # periods whose medians come from one aggregate
AGGREGATES = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
}


def _medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Medians of all columns per key from one pass over (column, value) rows; no task holds a group."""
    pairs = F.array(*(F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns))
    rows = exact_quantiles(df.select(*keys, F.inline(pairs)), [*keys, "_column"], "_value", {"_median": 0.5})
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("_column") == c, F.col("_median"))).alias(f"{c}_median") for c in columns))


def rollup(df: DataFrame, period: str, ts: str = "timestamp_utc") -> DataFrame:
    """One row per city, parameter and period with value and weather statistics.

    Within an hour or a day a median is an aggregate beside the others: equal
    values are counted map-side and the counts merge, so a group costs its
    distinct values, of which sensors with fixed steps report few. Weeks and
    months take the pass that spreads a group over all tasks.
    """
    name, trunc = PERIODS[period]
    keys = ["city", "parameter", name]
    binned = df.withColumn(name, trunc(F.col(ts)))
    wanted = {"value": [*dims.FULL_STATISTICS, "count"]}
    wanted.update({c: s for c, s in dims.WEATHER_STATISTICS[period].items() if c in df.columns})
    aggs, medians = [], []
    for column, stats in wanted.items():
        for s in stats:
            if s == "median" and period in COUNTED_IN_PLACE:
                aggs.append(F.percentile(F.col(column).cast("double"), 0.5).alias(f"{column}_median"))
            elif s == "median":
                medians.append(column)
            else:
                aggs.append(AGGREGATES[s](column).alias(f"{column}_{s}"))
    out = binned.groupBy(*keys).agg(*aggs)
    if medians:
        out = null_safe_join(out, _medians(binned, keys, medians), keys)
    return out.withColumns(_derived(period)) if _derived(period) else out


def _derived(period: str) -> dict[str, Column]:
    mean, n = F.col("value_mean"), F.col("value_count")
    if period == "day":
        return {
            "value_peak_to_mean": F.try_divide(F.col("value_max"), mean),
            "value_diurnal_range": F.col("value_max") - F.col("value_min"),
            "value_cv": F.try_divide(F.col("value_std"), mean),
            "data_completeness_pct": _completeness(n, period),
        }
    if period == "week":
        return {
            "data_completeness_pct": _completeness(n, period),
            "estimated_unhealthy_hours": flag(mean > 100) * n,
        }
    return {}


def _completeness(n: Column, period: str) -> Column:
    return F.least(n / F.lit(float(EXPECTED_ROWS[period])) * 100, F.lit(100.0))


def city_daily_summary(daily: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """One row per city and day: parameter means, dominant pollutant, category."""
    parameters = parameters or dims.PARAMETERS
    wide = daily.groupBy("city", "date").pivot("parameter", parameters).agg(F.first("value_mean"))
    ratios = [(p, F.col(p) / F.lit(s)) for p, s in dims.POLLUTANT_STANDARDS.items() if p in parameters]
    top = F.greatest(*[r for _, r in ratios])
    dominant = F.when(top > 0, F.coalesce(*[F.when(r == top, F.lit(p)) for p, r in ratios]))
    if "aqi" in parameters:
        category = index.aqi_cut_category("aqi")
    else:
        category = index.pm25_cut_category("pm25")
    return wide.withColumns({"dominant_pollutant": dominant, "health_category": category})


def exceedance_days(daily: DataFrame, threshold: float = 100, digits: int = 2) -> DataFrame:
    """Cities with at least one daily mean over the threshold, in one pass."""
    mean = F.col("value_mean")
    over = F.when(mean > threshold, mean)
    return (
        daily.where(F.col("parameter").isin("aqi", "pm25"))
        .groupBy("city")
        .agg(
            F.count(over).alias("exceedance_days"),
            F.avg(over).alias("avg_exceedance_value"),
            F.max(over).alias("max_exceedance_value"),
            F.count(mean).alias("total_days"),
        )
        .where(F.col("exceedance_days") > 0)
        .withColumn("exceedance_pct", F.round(F.col("exceedance_days") / F.col("total_days") * 100, digits))
    )


def station_aggregate(df: DataFrame) -> DataFrame:
    """Mean, peak and count per station, with weather means where present."""
    keys = [c for c in ("city", "location", "latitude", "longitude") if c in df.columns]
    aggs = [F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.count("value").alias("reading_count")]
    aggs += [
        F.avg(c).alias(f"{c}_mean")
        for c in ("temperature_2m", "wind_speed_10m", "relative_humidity_2m")
        if c in df.columns
    ]
    return df.groupBy(*keys).agg(*aggs)
