"""Forecast accuracy: metrics, error histogram, direction, skill, tracking and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import index
from aqspark.functions.bins import flag, right_closed
from aqspark.operators.quantiles import exact_quantiles
from aqspark.operators.series import MIN_BLOCK, null_safe_join, series_window, with_position

ACTUAL, PREDICTED = "actual_aqi", "predicted_aqi"


def scored(df: DataFrame) -> DataFrame:
    """Rows with both values, plus ``error`` = predicted - actual."""
    both = F.col(ACTUAL).isNotNull() & F.col(PREDICTED).isNotNull()
    return df.where(both).withColumn("error", F.col(PREDICTED) - F.col(ACTUAL))


def _percent(cond: Column) -> Column:
    return F.avg(flag(cond)) * 100


def r_squared(actual: Column, error: Column) -> Column:
    spread = F.var_pop(actual) * F.count(actual)
    return F.when(spread == 0, F.lit(0.0)).otherwise(1 - F.try_divide(F.sum(error * error), spread))


def metrics(df: DataFrame) -> DataFrame:
    """Overall, per-city and per-horizon metrics from one pass with grouping sets.

    ``scope`` tells the three kinds apart. Median errors are joined from an
    exact percentile, since the overall group holds every row.
    """
    rows = scored(df)
    a, p, e = F.col(ACTUAL), F.col(PREDICTED), F.col("error")
    miss = F.abs(e)
    close = F.abs(e / F.greatest(a, F.lit(1.0)))
    sets = rows.groupingSets([[], ["city"], ["forecast_horizon_hours"]], "city", "forecast_horizon_hours").agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("records"),
        F.avg(miss).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(a != 0, F.abs(e / a))) * 100).alias("mape"),
        r_squared(a, e).alias("r_squared"),
        _percent(index.class_index(a) == index.class_index(p)).alias("category_accuracy"),
        F.avg(e).alias("mean_bias"),
        _percent(close <= 0.10).alias("within_10_pct"),
        _percent(close <= 0.20).alias("within_20_pct"),
        _percent(miss <= 50).alias("within_50_aqi"),
    )
    scope = F.when(F.col("_gid") == 3, F.lit("overall")).when(F.col("_gid") == 1, F.lit("city")).otherwise(F.lit("horizon"))
    key = F.coalesce(F.col("city"), F.col("forecast_horizon_hours").cast("string"), F.lit("all"))
    b = F.col("mean_bias")
    direction = F.when(b > 0, F.lit("over_prediction")).when(b < 0, F.lit("under_prediction")).otherwise(F.lit("unbiased"))
    out = sets.select(scope.alias("scope"), key.alias("key"), *[c for c in sets.columns if c not in (
        "city", "forecast_horizon_hours", "_gid")], direction.alias("bias_direction"))
    return null_safe_join(out, median_errors(rows), ["scope", "key"])


def median_errors(rows: DataFrame) -> DataFrame:
    """Exact median error per scope and key."""
    tagged = rows.select(
        "error",
        F.explode(F.array(
            F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("key")),
            F.struct(F.lit("city").alias("scope"), F.col("city").alias("key")),
            F.struct(F.lit("horizon").alias("scope"), F.col("forecast_horizon_hours").cast("string").alias("key")),
        )).alias("_s"),
    ).select("_s.scope", "_s.key", "error")
    return exact_quantiles(tagged, ["scope", "key"], "error", {"median_bias": 0.5})


def directional_accuracy(df: DataFrame, order: list, min_block: int = MIN_BLOCK) -> DataFrame:
    """Share of steps whose predicted and actual change agree; both flat agrees too."""
    placed = with_position(scored(df).select("city", ACTUAL, PREDICTED, *order), ["city"], order)
    steps = series_window(
        placed,
        ["city"],
        lambda w: {
            "_da": F.col(ACTUAL) - F.lag(ACTUAL, 1).over(w),
            "_dp": F.col(PREDICTED) - F.lag(PREDICTED, 1).over(w),
        },
        before=1,
        min_block=min_block,
    ).where(F.col("_da").isNotNull())
    agree = (F.col("_da") * F.col("_dp") > 0) | ((F.col("_da") == 0) & (F.col("_dp") == 0))
    return steps.agg(
        F.count_if(agree).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if(agree) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100).alias("directional_accuracy"),
    )


def skill_score(df: DataFrame, order: list, min_block: int = MIN_BLOCK) -> DataFrame:
    """1 - RMSE(model) / RMSE(previous actual), over all rows in the given order."""
    placed = with_position(scored(df).select(ACTUAL, PREDICTED, *order), [], order)
    rows = series_window(placed, [], lambda w: {"_prev": F.lag(ACTUAL, 1).over(w)}, before=1, min_block=min_block)
    a, p, prev = F.col(ACTUAL), F.col(PREDICTED), F.col("_prev")
    known = rows.where(prev.isNotNull())
    out = known.agg(
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse_model"), F.sqrt(F.avg((a - prev) * (a - prev))).alias("rmse_naive")
    )
    ratio = F.try_divide(F.col("rmse_model"), F.col("rmse_naive"))
    return out.withColumn("skill_score", F.coalesce(1 - ratio, F.lit(0.0)))


def error_distribution(df: DataFrame) -> DataFrame:
    """Rows per error bin; bins without rows stay, errors beyond the bins are in the null bin."""
    counted = scored(df).groupBy(right_closed("error", dims.ERROR_BINS).alias("error_bin")).agg(
        F.count("error").alias("_count"), F.avg("error").alias("avg_error")
    )
    bins = df.sparkSession.createDataFrame(
        [(i, label) for i, (_, _, label) in enumerate(dims.ERROR_BINS)] + [(len(dims.ERROR_BINS), None)],
        "bin_order int, error_bin string",
    )
    joined = null_safe_join(bins, counted, ["error_bin"]).withColumn("count", F.coalesce(F.col("_count"), F.lit(0))).drop("_count")
    binned = F.sum(F.when(F.col("error_bin").isNotNull(), F.col("count"))).over(Window.partitionBy())
    return joined.withColumn(
        "pct", F.when(F.col("error_bin").isNotNull(), F.try_divide(F.col("count"), binned) * 100)
    )


def recent_rows(df: DataFrame, keys: list[str], order: list[str], size: int = 100) -> DataFrame:
    """Last ``size`` rows per key; Spark cuts each task's rows to that many before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).drop("_rn")


def recent_accuracy(df: DataFrame, order: list[str], keys: list[str] | None = None, size: int = 100) -> DataFrame:
    """Accuracy over the latest predictions with actuals (bias = actual - predicted)."""
    keys = keys or ["city", "model_name"]
    rows = recent_rows(scored(df), keys, order, size)
    a = F.col(ACTUAL)
    e = a - F.col(PREDICTED)
    miss = F.abs(e)
    safe = a + F.lit(1e-8)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.avg(miss).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        (F.avg(F.abs(e / safe)) * 100).alias("mape"),
        # at most ``size`` rows per group from here on
        F.percentile(miss, F.lit(0.5)).alias("median_ae"),
        F.max(miss).alias("max_ae"),
        _percent(miss / safe <= 0.10).alias("within_10_pct"),
        _percent(miss / safe <= 0.25).alias("within_25_pct"),
        F.percentile(miss, F.lit(0.9)).alias("p90_error"),
    )


def accuracy_by_horizon(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    e = F.col(ACTUAL) - F.col(PREDICTED)
    return scored(df).groupBy(*(keys or []), "forecast_horizon_hours").agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
    )


def accuracy_alerts(
    current: DataFrame, baseline: str = "baseline_mae", max_mae: float = 30, max_bias: float = 15, degradation_pct: float = 20
) -> DataFrame:
    """Alert rows for metric rows that break a limit; ``baseline`` is a column of them."""
    mae, bias, base = F.col("mae"), F.abs("bias"), F.col(baseline)
    worse = F.try_divide(mae - base, base) * 100
    kinds = F.array(
        F.when(mae > max_mae, F.struct(F.lit("high_mae").alias("alert_type"), mae.alias("value"), F.lit(float(max_mae)).alias("threshold"))),
        F.when(bias > max_bias, F.struct(F.lit("high_bias").alias("alert_type"), bias.alias("value"), F.lit(float(max_bias)).alias("threshold"))),
        F.when(
            (base > 0) & (worse > degradation_pct),
            F.struct(F.lit("degradation").alias("alert_type"), worse.alias("value"), F.lit(float(degradation_pct)).alias("threshold")),
        ),
    )
    keys = [c for c in ("city", "model_name") if c in current.columns]
    return current.select(*keys, F.inline(F.filter(kinds, lambda k: k.isNotNull())))


def tracking_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count(ACTUAL).alias("predictions_with_actuals"),
        F.count_if(F.col(ACTUAL).isNull()).alias("pending_actuals"),
    )


def attach_actuals(predictions: DataFrame, actuals: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Fill missing actuals by key; an actual already stored is kept.

    Several actuals for one key are first reduced to the newest one.
    """
    newest = actuals.groupBy(*keys).agg(F.max_by("actual_value", id_column).alias("_actual"))
    return predictions.join(newest, keys, "left").withColumn(ACTUAL, F.coalesce(F.col(ACTUAL), F.col("_actual"))).drop("_actual")
