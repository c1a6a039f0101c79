"""Scaling, splits, baseline forecasters, ensembles, backtests, registry and serving.

Inputs are hourly series: one row per city and hour (columns city, ts, aqi), so
a window by city is bounded by the hours of the calendar, not by the readings.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import index

Y = "aqi"
EPS = 1e-8


def by_city() -> WindowSpec:
    return Window.partitionBy("city").orderBy("ts")


# --- scaling and splits ---------------------------------------------------------


def fit_scaler(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """One row of offsets and scales; a constant column gets scale 1."""
    out = []
    for c in columns:
        if method == "standard":
            offset, scale = F.avg(c), F.stddev_pop(c)
        else:
            offset, scale = F.min(c), F.max(c) - F.min(c)
        out += [offset.alias(f"offset_{c}"), F.when(scale == 0, F.lit(1.0)).otherwise(scale).alias(f"scale_{c}")]
    return df.agg(*out)



def scale(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled columns; nulls stay null. The one row of parameters is a scalar subquery."""
    p = params.select(F.struct("*")).scalar()
    return df.withColumn("_p", p).withColumns({
        c: (F.col(c) - F.col(f"_p.offset_{c}")) / F.col(f"_p.scale_{c}") for c in columns
    }).drop("_p")


def unscale(df: DataFrame, params: DataFrame, columns: list[str], clip: bool = False) -> DataFrame:
    p = params.select(F.struct("*")).scalar()

    def back(c: str) -> Column:
        v = F.col(c) * F.col(f"_p.scale_{c}") + F.col(f"_p.offset_{c}")
        # least and greatest skip nulls, so a null is kept apart
        return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(500.0))) if clip else v

    return df.withColumn("_p", p).withColumns({c: back(c) for c in columns}).drop("_p")


def chronological_split(df: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Add ``part``: the first floor(n * (1 - share)) rows of a city train, the rest test."""
    n = F.count(F.lit(1)).over(Window.partitionBy("city"))
    cut = F.floor(n * F.lit(1.0 - test_share))
    return df.withColumn("part", F.when(F.row_number().over(by_city()) <= cut, F.lit("train")).otherwise(F.lit("test")))


# --- baselines ------------------------------------------------------------------


def residual_metrics(rows: DataFrame, keys: list[str], actual: str = Y, predicted: str = "predicted") -> DataFrame:
    a = F.col(actual)
    e = a - F.col(predicted)
    return rows.where(a.isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e / (a + F.lit(EPS)))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def wma_weights(window: int, legacy: bool = False, weights: list[float] | None = None) -> list[float]:
    """Weights from oldest to newest value, summing to one.

    By default the newest value weighs most; ``legacy`` gives the oldest most.
    """
    raw = weights or ([float(window - i) for i in range(window)] if legacy else [float(i + 1) for i in range(window)])
    if len(raw) != window:
        raise ValueError("need one weight per value in the window")
    return [w / sum(raw) for w in raw]


def dot(values: Column, weights: list[float]) -> Column:
    pairs = F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda v, w: v * w)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def mean_of(values: Column, n: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / n


def one_step(grid: DataFrame, persistence=(1, 24, 168), sma: int = 24, wma: int = 24, legacy: bool = False) -> DataFrame:
    """What each baseline says about every hour from the hours before it, one column per model."""
    w = by_city()
    before = lambda n: w.rowsBetween(-n, -1)
    full = lambda n: F.count(Y).over(before(n)) == n
    out = {f"persistence_{n}": F.lag(Y, n).over(w) for n in persistence}
    if sma:
        out[f"sma_{sma}"] = F.when(full(sma), F.avg(Y).over(before(sma)))
    if wma:
        out[f"wma_{wma}"] = F.when(full(wma), dot(F.collect_list(Y).over(before(wma)), wma_weights(wma, legacy)))
    return grid.withColumns(out)


def long_predictions(wide: DataFrame, models: list[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(m).alias("predicted")) for m in models])
    return wide.select("city", "ts", Y, F.inline(entries))


def last_values(grid: DataFrame, n: int) -> DataFrame:
    """Per city the last ``n`` values oldest first, and the last hour."""
    ranked = grid.withColumn("_rn", F.row_number().over(Window.partitionBy("city").orderBy(F.col("ts").desc())))
    tail = ranked.where(F.col("_rn") <= n)
    return tail.groupBy("city").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", Y))), lambda s: s[Y]).alias("values"),
        F.max("ts").alias("origin"),
    ).where(F.size("values") == n)


def _unfold(df: DataFrame, steps: Column) -> DataFrame:
    out = df.select("*", F.posexplode(steps).alias("_i", "forecast"))
    return out.select(
        "city",
        (F.col("_i") + 1).alias("step"),
        (F.col("origin") + F.make_dt_interval(hours=F.col("_i") + 1)).alias("ts"),
        "forecast",
    )


def persistence_forecast(grid: DataFrame, lag: int = 1, horizon: int = 24, seasonal: bool = False) -> DataFrame:
    """The value ``lag`` steps back repeated, or cycled over the last ``lag`` values."""
    tail = last_values(grid, lag)
    pick = lambda i: F.element_at("values", (i % lag + 1).cast("int")) if seasonal else F.element_at("values", 1)
    return _unfold(tail, F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), pick))


def moving_average_forecast(grid: DataFrame, window: int = 24, horizon: int = 24, rolling: bool = False) -> DataFrame:
    return _averaged(grid, window, horizon, rolling, lambda v: mean_of(v, window))


def weighted_average_forecast(
    grid: DataFrame, window: int = 24, horizon: int = 24, rolling: bool = True, legacy: bool = False,
    weights: list[float] | None = None,
) -> DataFrame:
    w = wma_weights(window, legacy, weights)
    return _averaged(grid, window, horizon, rolling, lambda v: dot(v, w))


def _averaged(grid, window, horizon, rolling, combine: Callable[[Column], Column]) -> DataFrame:
    tail = last_values(grid, window)
    if not rolling:
        return _unfold(tail, F.array_repeat(combine(F.col("values")), horizon))

    # each step's forecast joins the window of the next one
    def step(buffer: Column, _: Column) -> Column:
        return F.concat(buffer, F.array(combine(F.slice(buffer, -window, window))))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("values"), step)
    return _unfold(tail, F.slice(grown, window + 1, horizon))


def with_interval(forecast: DataFrame, metrics: DataFrame, z: float = dims.NORMAL_Z_95) -> DataFrame:
    """Normal interval z * RMSE around the forecast, RMSE per city."""
    joined = forecast.join(metrics.select("city", "rmse"), "city", "left")
    margin = F.lit(z) * F.coalesce(F.col("rmse"), F.lit(0.0))
    return joined.withColumns({"lower": F.col("forecast") - margin, "upper": F.col("forecast") + margin}).drop("rmse")


# --- ensembles ------------------------------------------------------------------


def inverse_error_weights(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Weight per model (and key) inverse to its MAE, summing to one."""
    keys = keys or []
    mae = residual_metrics(predictions, [*keys, "model_name"])
    inverse = F.lit(1.0) / (F.col("mae") + F.lit(EPS))
    # one row per model and key
    total = F.sum(inverse).over(Window.partitionBy(*keys))
    return mae.select(*keys, "model_name", (inverse / total).alias("weight"))


def ensemble(predictions: DataFrame, weights: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Mean of the models per hour, or the weighted sum when weights are given."""
    rows = predictions.where(F.col("predicted").isNotNull())
    if weights is None:
        combined = F.avg("predicted")
    else:
        rows = rows.join(weights, [*(keys or []), "model_name"])
        combined = F.sum(F.col("weight") * F.col("predicted"))
    return rows.groupBy("city", "ts").agg(
        F.first(Y).alias(Y), combined.alias("predicted"), F.count(F.lit(1)).alias("n_models")
    )


# --- backtests ------------------------------------------------------------------


def numbered(grid: DataFrame) -> DataFrame:
    return grid.withColumns({
        "pos": F.row_number().over(by_city()) - 1,
        "n": F.count(F.lit(1)).over(Window.partitionBy("city")),
    })


def fold_rows(grid: DataFrame, initial: int = 720, step: int = 168, horizon: int = 72) -> DataFrame:
    """Test rows with their fold, by arithmetic on the position; no range join."""
    rows = numbered(grid)
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - initial - horizon + 1) / step)).cast("int")
    last = F.least(F.floor((F.col("pos") - initial) / step), F.floor((F.col("n") - horizon - initial) / step)).cast("int")
    folds = F.when((F.col("pos") >= initial) & (first <= last), F.sequence(first, last))
    return rows.select("*", F.explode(folds).alias("fold"))


def origin_values(grid: DataFrame, persistence=(1, 24), sma: int = 24, wma: int = 24) -> DataFrame:
    """What each baseline, fitted up to a row, would forecast from the next row on."""
    w = by_city()
    upto = lambda n: w.rowsBetween(-(n - 1), 0)
    out = {f"persistence_{n}": F.lag(Y, n - 1).over(w) for n in persistence}
    out[f"sma_{sma}"] = F.avg(Y).over(upto(sma))
    out[f"wma_{wma}"] = dot(F.collect_list(Y).over(upto(wma)), wma_weights(wma))
    return numbered(grid).withColumns(out)


def backtest(
    grid: DataFrame, initial: int = 720, step: int = 168, horizon: int = 72, method: str = "expanding",
    persistence=(1, 24), sma: int = 24, wma: int = 24,
) -> DataFrame:
    """Fold metrics of all baselines and cities in one job."""
    models = [*(f"persistence_{n}" for n in persistence), f"sma_{sma}", f"wma_{wma}"]
    tests = fold_rows(grid, initial, step, horizon)
    origins = origin_values(grid, persistence, sma, wma).where(
        (F.col("pos") >= initial - 1) & ((F.col("pos") + 1 - initial) % step == 0)
    ).select("city", ((F.col("pos") + 1 - initial) / step).cast("int").alias("fold"), *models)
    joined = tests.select("city", "fold", Y).join(origins, ["city", "fold"])
    entries = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(m).alias("predicted")) for m in models])
    scored = joined.select("city", "fold", Y, F.inline(entries))
    return fold_metrics(scored, initial, step, method)


def fold_metrics(scored: DataFrame, initial: int, step: int, method: str) -> DataFrame:
    a = F.col(Y)
    e = a - F.col("predicted")
    train = F.lit(initial) if method == "rolling" else F.lit(initial) + F.col("fold") * step
    return scored.groupBy("city", "model_name", "fold").agg(
        F.count(F.lit(1)).alias("test_size"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(a))).alias("r2"),
        (F.avg(F.abs(e / (a + F.lit(EPS)))) * 100).alias("mape"),
    ).withColumn("train_size", train)


def backtest_custom(
    grid: DataFrame, forecaster: Callable[[pd.Series, int], list[float]], name: str,
    initial: int = 720, step: int = 168, horizon: int = 72,
) -> DataFrame:
    """Rolling backtest of a user's forecaster (history, horizon) -> values.

    A group is one city and fold: ``initial`` training rows and ``horizon`` test
    rows, so its size is fixed by the parameters.
    """
    rows = numbered(grid)
    lowest = F.greatest(F.lit(0), F.ceil((F.col("pos") - initial - horizon + 1) / step)).cast("int")
    highest = F.least(F.floor(F.col("pos") / step), F.floor((F.col("n") - horizon - initial) / step)).cast("int")
    placed = rows.select("*", F.explode(F.when(lowest <= highest, F.sequence(lowest, highest))).alias("fold"))
    placed = placed.withColumn("is_test", F.col("pos") >= initial + F.col("fold") * step)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        test = part[part.is_test]
        history = part[~part.is_test].set_index("ts")[Y]
        return pd.DataFrame({
            "city": test.city, "fold": test.fold, Y: test[Y], "model_name": name,
            "predicted": [float(v) for v in forecaster(history, len(test))],
        })

    scored = placed.groupBy("city", "fold").applyInPandas(
        run, f"city string, fold int, {Y} double, model_name string, predicted double"
    )
    return fold_metrics(scored, initial, step, "rolling")


def backtest_summary(folds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of the fold metrics."""
    out = []
    for m in ("mae", "rmse", "r2"):
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return folds.groupBy(*(keys or ["city", "model_name"])).agg(*out, F.count(F.lit(1)).alias("n_folds"))


def leaderboard(summary: DataFrame, metric: str = "mae_mean", keys: list[str] | None = None) -> DataFrame:
    """Models by error, best first; models without a result are left out. One row per model."""
    w = Window.partitionBy(*(keys or [])).orderBy(metric)
    ranked = summary.where(F.col(metric).isNotNull()).withColumn("place", F.rank().over(w))
    return ranked.withColumn("is_champion", F.col("place") == 1)


# --- registry -------------------------------------------------------------------


def current_champion(registry: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Champion per key: the entry promoted last."""
    newest = F.max_by(F.struct(*registry.columns), F.struct("promoted_at", "model_name"))
    rows = registry.where(F.col("status") == "champion")
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys or []]).agg(newest.alias("_r")).select("_r.*")


def promotion(candidates: DataFrame, champions: DataFrame, keys: list[str], max_degradation_pct: float = 5.0) -> DataFrame:
    """Decide per candidate: promoted without a champion, or at most so much worse than it."""
    held = champions.select(*keys, F.col("model_name").alias("champion"), F.col("mae").alias("champion_mae"))
    joined = candidates.join(held, keys, "left")
    worse = F.try_divide(F.col("mae") - F.col("champion_mae"), F.col("champion_mae")) * 100
    return joined.withColumn("degradation_pct", worse).withColumn(
        "promote", F.col("champion_mae").isNull() | F.coalesce(worse <= max_degradation_pct, F.lit(False))
    )


def registry_changes(decisions: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """Rows to append: the new champion, and the one it replaces as archived."""
    won = decisions.where("promote")
    new = won.select(*keys, "model_name", "mae", F.lit("champion").alias("status"), as_of.alias("changed_at"), F.lit(None).cast("string").alias("reason"))
    old = won.where(F.col("champion").isNotNull()).select(
        *keys, F.col("champion").alias("model_name"), F.col("champion_mae").alias("mae"), F.lit("archived").alias("status"),
        as_of.alias("changed_at"), F.concat(F.lit("Replaced by "), "model_name").alias("reason"),
    )
    return new.unionByName(old)


def retraining_due(registry: DataFrame, as_of: Column, schedule: str = "weekly", keys: list[str] | None = None) -> DataFrame:
    hours = dims.RETRAIN_HOURS.get(schedule, dims.RETRAIN_HOURS["weekly"])
    age = (F.unix_micros(as_of) - F.unix_micros(F.max("promoted_at"))) / F.lit(3_600_000_000.0)
    return registry.groupBy(*(keys or [])).agg(age.alias("age_hours")).withColumn(
        "is_due", F.coalesce(F.col("age_hours") >= hours, F.lit(True))
    )


# --- serving --------------------------------------------------------------------


def serve(forecast: DataFrame, digits: int = 1) -> DataFrame:
    """Served points: clipped to 0..500, rounded, with bounds and category."""
    clipped = F.least(F.greatest("forecast", F.lit(0.0)), F.lit(500.0))
    return forecast.select(
        "city",
        "step",
        "ts",
        F.bround(clipped, digits).alias("aqi"),
        F.bround("lower", digits).alias("aqi_lower"),
        F.bround("upper", digits).alias("aqi_upper"),
        index.epa_category(clipped).alias("category"),
    )


def outlook(forecast: DataFrame) -> DataFrame:
    v = F.least(F.greatest("forecast", F.lit(0.0)), F.lit(500.0))
    return forecast.groupBy("city").agg(
        F.max(v).alias("peak_aqi"),
        F.avg(v).alias("avg_aqi"),
        F.min(v).alias("min_aqi"),
        F.count_if(v > 100).alias("hours_above_100"),
        F.count_if(v > 150).alias("hours_above_150"),
    )


def risk_outlook(forecast: DataFrame, safe: float = 100.0) -> DataFrame:
    """Next 24 hours per city: trend, highest risk score, longest run of safe hours.

    Trend compares the mean of the last six hours with that of the first six:
    a change over 10% either way is a trend, and a spread over half the mean
    without one is fluctuation. These rules are our own.
    """
    day = forecast.where(F.col("step") <= 24)
    w = Window.partitionBy("city").orderBy("step")
    ok = F.col("forecast") <= safe
    runs = day.withColumn("_safe", ok).withColumn("_run", F.col("step") - F.sum(F.when(ok, 1).otherwise(0)).over(w))
    longest = runs.where("_safe").groupBy("city", "_run").agg(
        F.count(F.lit(1)).alias("hours"), F.min("ts").alias("start"), F.max("ts").alias("end")
    ).groupBy("city").agg(F.max_by(F.struct("start", "end", "hours"), F.struct("hours", -F.unix_seconds("start"))).alias("safe_window"))
    first, last = F.avg(F.when(F.col("step") <= 6, F.col("forecast"))), F.avg(F.when(F.col("step") > 18, F.col("forecast")))
    shift, spread = F.try_divide(last - first, first), F.try_divide(F.stddev_pop("forecast"), F.avg("forecast"))
    trend = F.when(shift > 0.1, "worsening").when(shift < -0.1, "improving").when(spread > 0.5, "fluctuating").otherwise("stable")
    return day.groupBy("city").agg(
        trend.alias("next_24h_trend"), F.max(index.risk_score("forecast")).alias("next_24h_max_risk")
    ).join(longest, "city", "left")


def gauges(readings: DataFrame, scored: DataFrame, as_of: Column, features: list[str]) -> DataFrame:
    """Monitoring values as rows (metric, label_1, label_2, value)."""
    missing = readings.agg(*[F.avg(F.when(F.col(f).isNull(), 1.0).otherwise(0.0)).alias(f) for f in features])
    ratio = missing.select(F.inline(F.array(*[
        F.struct(F.lit("data_missing_ratio").alias("metric"), F.lit(f).alias("label_1"), F.lit(None).cast("string").alias("label_2"), F.col(f).alias("value"))
        for f in features
    ])))
    age = (F.unix_micros(as_of) - F.unix_micros(F.max("timestamp_utc"))) / F.lit(1_000_000.0)
    fresh = readings.groupBy("city").agg(age.alias("value")).select(
        F.lit("data_freshness_seconds").alias("metric"), F.col("city").alias("label_1"), F.lit(None).cast("string").alias("label_2"), "value"
    )
    from aqspark.operators.accuracy import ACTUAL, PREDICTED, r_squared

    a, e = F.col(ACTUAL), F.col(PREDICTED) - F.col(ACTUAL)
    per_model = scored.where(a.isNotNull()).groupBy("model_name", "city").agg(
        F.avg(F.abs(e)).alias("model_mae"), F.sqrt(F.avg(e * e)).alias("model_rmse"), r_squared(a, e).alias("model_r2")
    ).select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col("model_name").alias("label_1"), F.col("city").alias("label_2"), F.col(m).alias("value"))
        for m in ("model_mae", "model_rmse", "model_r2")
    ])))
    return ratio.unionByName(fresh).unionByName(per_model)
