"""Zones over time, trends, seasons, rankings and episode persistence per city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import calendar, index
from aqspark.functions.bins import lookup
from aqspark.operators.series import MIN_BLOCK, running, series_window, with_position

PERIOD_UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}


def zone_cohorts(df: DataFrame, period: str = "weekly", value: str = "value", ts: str = "timestamp_utc") -> DataFrame:
    """City by period with its zone and the change from the period before.

    A city has one row per period, so its window is bounded by the calendar.
    """
    rows = df.groupBy("city", F.to_date(F.date_trunc(PERIOD_UNITS[period], ts)).alias("period")).agg(
        F.avg(value).alias("avg_aqi"),
        F.max(value).alias("max_aqi"),
        F.min(value).alias("min_aqi"),
        F.stddev_samp(value).alias("std_aqi"),
        F.count(value).alias("reading_count"),
    ).withColumn("zone", index.zone("avg_aqi"))
    w = Window.partitionBy("city").orderBy("period")
    return rows.withColumn("prev_zone", F.lag("zone").over(w)).withColumn("zone_change", zone_change("prev_zone", "zone"))


def zone_change(prev: str, current: str) -> Column:
    order = {name: i for i, (_, _, name) in enumerate(dims.ZONE_BANDS)}
    p, c = lookup(order, prev), lookup(order, current)
    return (
        F.when(F.col(prev).isNull(), F.lit("new"))
        .when(p.isNull() | c.isNull(), F.lit("unknown"))
        .when(c < p, F.lit("improved"))
        .when(c > p, F.lit("degraded"))
        .otherwise(F.lit("stable"))
    )


def trends(
    df: DataFrame, value: str = "value", ts: str = "timestamp_utc", min_rows: int = 10, min_days: int = 7, digits=(4, 2)
) -> DataFrame:
    """Least-squares slope of daily means against their index, per city."""
    days = df.groupBy("city", F.to_date(ts).alias("day")).agg(
        F.avg(value).alias("y"), F.count(value).alias("_rows"), F.sum(value).alias("_sum")
    ).where(F.col("y").isNotNull())
    w = Window.partitionBy("city").orderBy("day")
    indexed = days.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    y, x = F.col("y"), F.col("x")
    fit = indexed.groupBy("city").agg(
        F.regr_slope(y, x).alias("slope"),
        F.coalesce(F.regr_r2(y, x), F.lit(0.0)).alias("r2"),
        F.min("day").alias("period_start"),
        F.max("day").alias("period_end"),
        F.count(F.lit(1)).alias("data_points"),
        F.avg("y").alias("avg_aqi"),
        F.sum("_rows").alias("_rows"),
    )
    s = F.col("slope")
    return fit.where((F.col("_rows") >= min_rows) & (F.col("data_points") >= min_days)).select(
        "city",
        F.bround(s, digits[0]).alias("trend_slope"),
        F.when(s < -0.5, F.lit("improving")).when(s > 0.5, F.lit("degrading")).otherwise(F.lit("stable")).alias(
            "trend_direction"
        ),
        F.bround(F.abs(s) * 30, digits[1]).alias("monthly_aqi_change"),
        F.bround("r2", digits[0]).alias("r_squared"),
        "period_start",
        "period_end",
        "data_points",
        F.bround("avg_aqi", digits[1]).alias("avg_aqi"),
    )


def seasonal(df: DataFrame, value: str = "value", ts: str = "timestamp_utc") -> DataFrame:
    return df.groupBy("city", calendar.season(ts, "post_monsoon").alias("season")).agg(
        F.avg(value).alias("avg_aqi"),
        F.max(value).alias("max_aqi"),
        F.min(value).alias("min_aqi"),
        F.stddev_samp(value).alias("std_aqi"),
        F.count(value).alias("reading_count"),
    )


def season_extremes(seasonal_rows: DataFrame, digits: int = 2) -> DataFrame:
    """Worst and best season per city in one pass; ties go to the first name."""
    # highest mean first, then the alphabetically first season
    worst = F.min_by("season", F.struct(-F.col("avg_aqi"), F.col("season")))
    best = F.min_by("season", F.struct(F.col("avg_aqi"), F.col("season")))
    out = seasonal_rows.groupBy("city").agg(
        worst.alias("worst_season"),
        F.max("avg_aqi").alias("worst_season_avg_aqi"),
        best.alias("best_season"),
        F.min("avg_aqi").alias("best_season_avg_aqi"),
    )
    gap = F.col("worst_season_avg_aqi") - F.col("best_season_avg_aqi")
    return out.withColumn("seasonal_variation", F.bround(gap, digits))


def season_extremes_by_join(seasonal_rows: DataFrame, digits: int = 2) -> DataFrame:
    """The same from two halves met in a full outer join on city."""
    worst = seasonal_rows.groupBy("city").agg(
        F.min_by("season", F.struct(-F.col("avg_aqi"), F.col("season"))).alias("worst_season"),
        F.max("avg_aqi").alias("worst_season_avg_aqi"),
    )
    best = seasonal_rows.groupBy("city").agg(
        F.min_by("season", F.struct(F.col("avg_aqi"), F.col("season"))).alias("best_season"),
        F.min("avg_aqi").alias("best_season_avg_aqi"),
    )
    gap = F.col("worst_season_avg_aqi") - F.col("best_season_avg_aqi")
    return worst.join(best, "city", "full_outer").withColumn("seasonal_variation", F.bround(gap, digits))


def rankings(df: DataFrame, value: str = "value", threshold: float = 200) -> DataFrame:
    """Cities ranked by mean, peak and bad hours. One row per city enters the windows."""
    v = F.col(value)
    cities = df.groupBy("city").agg(
        F.avg(v).alias("avg_aqi"),
        F.max(v).alias("max_aqi"),
        F.stddev_samp(v).alias("std_aqi"),
        F.count(v).alias("reading_count"),
        F.count_if(v > threshold).alias("unhealthy_hours"),
    )
    ranked = cities.withColumns({
        "rank_avg": _rank_of("avg_aqi", True),
        "rank_peak": _rank_of("max_aqi", True),
        "rank_unhealthy": _rank_of("unhealthy_hours", True),
    })
    score = F.col("rank_avg") * 0.4 + F.col("rank_peak") * 0.3 + F.col("rank_unhealthy") * 0.3
    return ranked.withColumn("_score", score).withColumn("composite_rank", _rank_of("_score", False)).drop("_score")


def _rank_of(column: str, descending: bool) -> Column:
    """Rank in which ties share the mean of their places, cut to a whole number."""
    order = F.col(column).desc() if descending else F.col(column).asc()
    place = F.rank().over(Window.orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(column))
    return F.floor(place + (ties - 1) / 2)


def episode_rows(
    df: DataFrame, order: list, value: str = "value", threshold: float = 200, min_block: int = MIN_BLOCK
) -> DataFrame:
    """Readings with ``is_poor`` and the number of the run of equal flags they are in."""
    placed = with_position(df, ["city"], order).withColumn("is_poor", F.col(value) > threshold)
    changed = series_window(
        placed,
        ["city"],
        lambda w: {"_new": F.when(F.lag("is_poor", 1).over(w).eqNullSafe(F.col("is_poor")), 0).otherwise(1)},
        before=1,
        min_block=min_block,
    )
    return running(changed, ["city"], sums={"run_id": F.col("_new")}, min_block=min_block).drop("_new")


def episodes(rows: DataFrame) -> DataFrame:
    """Length of each run of poor readings; copies of a run collapse before the shuffle."""
    return rows.where("is_poor").groupBy("city", "run_id").agg(F.count(F.lit(1)).alias("length"))


def persistence(
    df: DataFrame, order: list, value: str = "value", threshold: float = 200, min_rows: int = 10, digits=(2, 1)
) -> DataFrame:
    """Share of poor readings and the number and length of episodes per city."""
    rows = episode_rows(df, order, value, threshold)
    runs = rows.groupBy("city", "run_id", "is_poor").agg(F.count(F.lit(1)).alias("length"))
    poor = F.when(F.col("is_poor"), F.col("length"))
    per_city = runs.groupBy("city").agg(
        F.sum("length").alias("_rows"),
        F.coalesce(F.sum(poor), F.lit(0)).alias("total_poor_hours"),
        F.count(poor).alias("num_episodes"),
        F.coalesce(F.avg(poor), F.lit(0.0)).alias("_mean"),
        F.coalesce(F.max(poor), F.lit(0)).alias("max_episode_length_hours"),
    ).where(F.col("_rows") >= min_rows)
    return per_city.select(
        "city",
        F.lit(threshold).alias("poor_threshold"),
        "total_poor_hours",
        F.bround(F.col("total_poor_hours") / F.col("_rows") * 100, digits[0]).alias("poor_pct"),
        "num_episodes",
        F.bround("_mean", digits[1]).alias("avg_episode_length_hours"),
        "max_episode_length_hours",
    )
