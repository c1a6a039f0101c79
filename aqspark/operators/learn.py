"""Learned forecasters on the hourly table: boosted trees, trend and seasonality, stacking."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from aqspark.operators import features as ft
from aqspark.operators.forecast import Y, by_city, chronological_split
from aqspark.operators.series import null_safe_join
from aqspark.session import ensure_checkpoint_dir, settle

LAGS = [1, 3, 6, 12, 24, 48]
WINDOWS = [6, 12, 24, 48]
ROWS_PER_TASK = 50_000  # training rows in a partition
FITS_AT_ONCE = 4


def tree_features(table: DataFrame, weather: list[str] | None = None, past_only: bool = False) -> tuple[DataFrame, list[str]]:
    """Feature table and its column names; rows with a missing feature are dropped.

    Rolling statistics include the hour itself, as the first model does; with
    ``past_only`` they end at the hour before, so a fit cannot read its target.
    """
    if past_only:
        shifted = table.withColumn("_past", F.lag(Y, 1).over(by_city()))
        wide = ft.builder_features(shifted, "_past", lags=[n - 1 for n in LAGS], windows=WINDOWS, median=False)
        wide = wide.withColumnsRenamed({f"aqi_lag_{n - 1}": f"aqi_lag_{n}" for n in sorted(LAGS, reverse=True)}).drop("_past")
    else:
        wide = ft.builder_features(table, Y, lags=LAGS, windows=WINDOWS, median=False)
    calendar = ft.builder_time_columns("ts")
    times = ["hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
    wide = wide.withColumns({n: calendar[n] for n in times})
    rolls = [f"aqi_roll_{s}_{w}" for w in WINDOWS for s in ("mean", "std", "min", "max")]
    names = [*(f"aqi_lag_{n}" for n in LAGS), *rolls, *times, *(weather or [])]
    # training passes over these rows many times, so they are stored once
    return settle(wide.na.drop(subset=[*names, Y])), names


def tree_pipeline(
    names: list[str], iterations: int = 500, depth: int = 6, step: float = 0.05, subsample: float = 0.8, seed: int = 42
) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="features"),
        GBTRegressor(
            featuresCol="features", labelCol=Y, predictionCol="predicted", maxIter=iterations, maxDepth=depth, stepSize=step,
            subsamplingRate=subsample, seed=seed,
        ),
    ])


def fit_metrics(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    a, e = F.col(Y), F.col(Y) - F.col("predicted")
    return scored.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(a))).alias("r2"),
    )


def sized_rows(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as their number asks for.

    A tree level is one job over all partitions, so a small table in many
    partitions spends its time on starting tasks.
    """
    return rows.repartition(max(1, -(-rows.count() // ROWS_PER_TASK)))


def expanding_folds(table: DataFrame, folds: int = 5) -> DataFrame:
    """Add ``block`` 1..folds+1 by time within each city; fold i trains on blocks up to i."""
    return table.withColumn("block", F.ntile(folds + 1).over(by_city()))


def prefix_predictions(model, iterations: list[int]) -> dict[int, Callable[[DataFrame], DataFrame]]:
    """What the first n trees of a boosted model predict, for each n.

    Boosting adds trees one after the other, so with equal seed, depth, step and
    subsample a fit of n trees is the beginning of a fit of more: one fit serves
    all its prefixes.
    """
    assembler, trees = model.stages
    whole = trees._java_obj
    uid, count = whole.uid(), whole.getNumTrees()
    out = {}
    for n in iterations:
        if n > count:
            raise ValueError(f"the model has {count} trees")
        gateway = SparkContext._active_spark_context._gateway
        parts = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
        weights = gateway.new_array(gateway.jvm.double, n)
        for k, (tree, weight) in enumerate(zip(whole.trees()[:n], whole.treeWeights()[:n])):
            parts[k], weights[k] = tree, weight
        first = GBTRegressionModel(gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, parts, weights))
        first.setFeaturesCol("features").setPredictionCol("predicted")
        out[n] = lambda rows, first=first: first.transform(assembler.transform(rows))
    return out


def stored_fit(spark: SparkSession, path: str, work: Callable[[], DataFrame]) -> DataFrame:
    """Result rows of one fit, from ``path`` if an earlier run has left them there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        work().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fit_all(spark: SparkSession, folder: str | None, fits: dict[str, Callable[[], DataFrame]], at_once: int = FITS_AT_ONCE) -> DataFrame:
    """Rows of all fits, ``at_once`` of them side by side, each stored when it is done.

    With a ``folder`` of its own a run that is started again repeats only the fits
    that had not ended.
    """
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/fits-{uuid.uuid4()}"
    jobs = [inheritable_thread_target(spark)(partial(stored_fit, spark, f"{folder}/{name}", work)) for name, work in fits.items()]
    with ThreadPoolExecutor(at_once) as pool:
        done = [f.result() for f in [pool.submit(job) for job in jobs]]
    return reduce(DataFrame.unionByName, done)


def fold_scores(placed: DataFrame, names: list[str], fold: int, iterations: list[int], **params) -> DataFrame:
    """Metrics of one fold's next block after each number of iterations, from one fit of the most."""
    train = sized_rows(placed.where(F.col("block") <= fold))
    model = tree_pipeline(names, iterations=max(iterations), **params).fit(train)
    ahead = placed.where(F.col("block") == fold + 1)
    rows = [
        fit_metrics(predict(ahead)).select(F.lit(fold).alias("fold"), F.lit(n).alias("iterations"), "*")
        for n, predict in prefix_predictions(model, iterations).items()
    ]
    return reduce(DataFrame.unionByName, rows)


def cross_validate(table: DataFrame, names: list[str], folds: int = 5, iterations: int = 500, folder: str | None = None, **params) -> DataFrame:
    """Expanding time-series validation: metrics of each fold's next block."""
    placed = settle(expanding_folds(table, folds))
    fits = {f"fold={i}": partial(fold_scores, placed, names, i, [iterations], **params) for i in range(1, folds + 1)}
    return fit_all(table.sparkSession, folder, fits).drop("iterations")


def grid_search(table: DataFrame, names: list[str], grid: list[dict], folds: int = 3, folder: str | None = None) -> DataFrame:
    """Mean validation error per parameter set, best first.

    Sets that differ in their number of iterations alone share one fit a fold.
    """
    spark, placed = table.sparkSession, settle(expanding_folds(table, folds))
    rest = lambda params: tuple(sorted((k, v) for k, v in params.items() if k != "iterations"))
    kinds = {}
    for trial, params in enumerate(grid):
        kinds.setdefault(rest(params), {}).setdefault(params.get("iterations", 500), []).append(trial)
    fits = {
        f"kind={k}/fold={i}": (lambda k=k, i=i, kind=kind, wanted=wanted: fold_scores(placed, names, i, sorted(wanted), **dict(kind)).withColumn("kind", F.lit(k)))
        for k, (kind, wanted) in enumerate(kinds.items()) for i in range(1, folds + 1)
    }
    scores = fit_all(spark, folder, fits).groupBy("kind", "iterations").agg(*(F.avg(c).alias(c) for c in ("mae", "rmse", "r2")))
    trials = spark.createDataFrame(
        [(t, str(grid[t]), k, n) for k, wanted in enumerate(kinds.values()) for n, ts in wanted.items() for t in ts], "trial int, parameters string, kind int, iterations int"
    )
    out = trials.join(scores, ["kind", "iterations"]).select("trial", "parameters", "mae", "rmse", "r2")
    return out.withColumn("place", F.rank().over(Window.orderBy("mae")))


def importances(spark: SparkSession, model, names: list[str], top: int = 20) -> DataFrame:
    """Most important features of a fitted model; one value per feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    return rows.orderBy(F.col("importance").desc(), "feature").limit(top)


def horizon_rows(table: DataFrame, horizons: list[int]) -> DataFrame:
    """Each feature row once per horizon, with the value that many hours later as its target."""
    ahead = table.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")).withColumn(
        "target_ts", F.col("ts") + F.make_dt_interval(hours=F.col("horizon"))
    )
    target = table.select("city", F.col("ts").alias("target_ts"), F.col(Y).alias("_target"))
    return ahead.join(target, ["city", "target_ts"], "left").withColumn("_y0", F.col(Y)).withColumn(Y, F.col("_target")).drop("_target")


def multi_horizon_forecast(table: DataFrame, names: list[str], horizons: list[int], **params) -> DataFrame:
    """Direct forecasts for every horizon from each city's last row; the horizon is a feature."""
    rows = settle(horizon_rows(table, horizons))
    model = tree_pipeline([*names, "horizon", "_y0"], **params).fit(sized_rows(rows.where(F.col(Y).isNotNull())))
    newest = table.groupBy("city").agg(F.max("ts").alias("ts"))
    origin = rows.join(newest, ["city", "ts"])
    return model.transform(origin).select(
        "city", F.col("horizon").alias("step"), F.col("target_ts").alias("ts"), F.greatest("predicted", F.lit(0.0)).alias("forecast")
    )


# --- sums of products ---

GROUPS_AT_ONCE = 500  # groups whose sums a task holds before it hands them on


def product_sums(rows: DataFrame, keys: list[str], design: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """Per key the sums of all products of the columns that ``design`` makes of a batch of rows.

    One row per key and entry (i, j), i <= j, of the symmetric matrix. A task
    adds up its batches and hands on one matrix per group, so what is shuffled
    follows tasks and groups, not rows. Sums of parts add up to sums of wholes.
    """
    fields = [rows.schema[k] for k in keys]
    schema = StructType([*fields, StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("s", DoubleType())])

    def emit(held: dict) -> pd.DataFrame:
        first = next(iter(held.values()))
        i, j = np.triu_indices(len(first))
        out = {k: np.repeat(np.array([key[n] for key in held], dtype=object), len(i)) for n, k in enumerate(keys)}
        out.update(i=np.tile(i, len(held)), j=np.tile(j, len(held)), s=np.concatenate([m[i, j] for m in held.values()]))
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for batch in batches:
            for key, part in batch.groupby(keys, dropna=False, sort=False):
                x = design(part)
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = held[key] + x.T @ x if key in held else x.T @ x
                if len(held) >= GROUPS_AT_ONCE:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    return rows.mapInPandas(run, schema).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))


def square(entries: list, size: int) -> np.ndarray:
    """The symmetric matrix of (i, j, s) entries."""
    out = np.zeros((size, size))
    for i, j, s in entries:
        out[i, j] = out[j, i] = s
    return out


# --- trend and seasonality ---

CHANGEPOINTS = 25
CHANGE_SPAN = 0.8  # share of the history that may hold changes of trend
BOUND = 1.2815515655446004  # fixed value: normal quantile of a two-sided share of 0.8


def seasonal_columns(days: np.ndarray, span: np.ndarray, yearly: int = 10, weekly: int = 3, daily: int = 10, changes: int = CHANGEPOINTS) -> np.ndarray:
    """Intercept, trend, hinges at even distances over the first part of ``span``, Fourier terms of the three periods."""
    cols = [np.ones_like(days), days / 365.25]
    for k in range(1, changes + 1):
        cols.append(np.maximum(days - span * (CHANGE_SPAN * k / changes), 0.0) / 365.25)
    for period, order in ((365.25, yearly), (7.0, weekly), (1.0, daily)):
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * days / period
            cols += [np.sin(angle), np.cos(angle)]
    return np.column_stack(cols)


def with_days(grid: DataFrame, cut: Column | None = None) -> DataFrame:
    """Add days since a city's first known value, and the days from there to the last one up to ``cut``."""
    known = F.col(Y).isNotNull()
    past = known if cut is None else known & cut
    day = F.lit(86_400_000_000.0)
    ends = grid.groupBy("city").agg(F.min(F.when(past, F.col("ts"))).alias("_first"), F.max(F.when(past, F.col("ts"))).alias("_last"))
    out = null_safe_join(grid, ends, ["city"]).where(F.col("_first").isNotNull())
    return out.withColumns({
        "_days": (F.unix_micros("ts") - F.unix_micros("_first")) / day, "_span": (F.unix_micros("_last") - F.unix_micros("_first")) / day,
    })


def _seasonal_design(orders: dict, extra: list[str]) -> Callable[[pd.DataFrame], np.ndarray]:
    def design(part: pd.DataFrame) -> np.ndarray:
        x = seasonal_columns(part["_days"].to_numpy(), part["_span"].to_numpy(), **orders)
        return np.column_stack([x, part[extra].fillna(0.0).to_numpy(dtype=float)]) if extra else x

    return design


def seasonal_sums(rows: DataFrame, orders: dict | None = None, regressors: list[str] | None = None) -> DataFrame:
    """Per city the sums of products of the model's columns and, as the last one, the value."""
    extra = regressors or []
    columns = _seasonal_design(orders or {}, extra)
    known = rows.where(F.col(Y).isNotNull()).select("city", "_days", "_span", F.col(Y).cast("double").alias(Y), *extra)
    return product_sums(known, ["city"], lambda part: np.column_stack([columns(part), part[Y].to_numpy()]))


def seasonal_fit(sums: DataFrame, penalty: float, hinge_penalty: float, changes: int) -> DataFrame:
    """Per city the coefficients and the deviation of the residuals, solved from the sums alone."""
    packed = sums.groupBy("city").agg(F.collect_list(F.struct("i", "j", "s")).alias("entries"), F.max("i").alias("last"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            betas, sigmas = [], []
            for entries, last in zip(batch["entries"], batch["last"]):
                whole = square([(e["i"], e["j"], e["s"]) for e in entries], last + 1)
                xx, xy, yy, n = whole[:last, :last], whole[:last, last], whole[last, last], whole[0, 0]
                ridge = np.full(last, penalty)
                ridge[:2], ridge[2 : 2 + changes] = 1e-9, hinge_penalty
                beta = np.linalg.solve(xx + np.diag(ridge), xy)
                rest = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
                betas.append(beta.tolist())
                sigmas.append(float(np.sqrt(rest / n)))
            yield pd.DataFrame({"city": batch["city"], "beta": betas, "sigma": sigmas})

    return packed.mapInPandas(solve, "city string, beta array<double>, sigma double")


def _seasonal_values(rows: DataFrame, fits: DataFrame, orders: dict, extra: list[str]) -> DataFrame:
    columns = _seasonal_design(orders, extra)
    joined = null_safe_join(rows, fits, ["city"], how="inner")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            mid = np.einsum("ij,ij->i", columns(part), np.array(part["beta"].tolist(), dtype=float).reshape(len(part), -1)) if len(part) else []
            out = part[["city", "ts", Y, "is_forecast"]].copy()
            out["predicted"] = np.maximum(mid, 0.0)
            out["lower"] = np.maximum(mid - BOUND * part["sigma"].to_numpy(), 0.0)
            out["upper"] = np.maximum(mid + BOUND * part["sigma"].to_numpy(), 0.0)
            yield out

    schema = f"city string, ts timestamp, {Y} double, is_forecast boolean, predicted double, lower double, upper double"
    return joined.mapInPandas(run, schema)


def _hours_ahead(rows: DataFrame, horizon: int, extra: list[str]) -> DataFrame:
    """The hours after each city's last value; ahead of the data a regressor keeps its last known value."""
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in extra]
    ends = rows.groupBy("city").agg(F.first("_last").alias("_last"), F.first("_span").alias("_span"), *kept)
    steps = ends.withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(
        "city", (F.col("_last") + F.make_dt_interval(hours=F.col("_h"))).alias("ts"), F.lit(None).cast("double").alias(Y), *extra,
        (F.col("_span") + F.col("_h") / 24.0).alias("_days"), "_span", F.lit(True).alias("is_forecast"),
    )


def seasonal_forecast(
    grid: DataFrame, horizon: int = 72, yearly: int = 10, weekly: int = 3, daily: int = 10, penalty: float = 10.0,
    regressors: list[str] | None = None, changes: int = CHANGEPOINTS, hinge_penalty: float = 20.0,
) -> DataFrame:
    """Ridge fit of trend with hinges, seasonality and regressors per city: the fit, the hours ahead, and bounds of 80 %.

    The rows are reduced to sums of products in one aggregation; what is solved
    per city is one small system, whatever the length of its series. The bounds
    are the residuals' deviation, from the same sums.
    """
    extra, orders = regressors or [], dict(yearly=yearly, weekly=weekly, daily=daily, changes=changes)
    rows = settle(with_days(grid.select("city", "ts", F.col(Y).cast("double").alias(Y), *extra)))
    fits = seasonal_fit(seasonal_sums(rows, orders, extra), penalty, hinge_penalty, changes)
    known = rows.where(F.col(Y).isNotNull()).select("city", "ts", Y, *extra, "_days", "_span", F.lit(False).alias("is_forecast"))
    return _seasonal_values(known.unionByName(_hours_ahead(rows, horizon, extra)), fits, orders, extra)


def seasonal_held_out(
    grid: DataFrame, test_share: float = 0.2, yearly: int = 10, weekly: int = 3, daily: int = 10, penalty: float = 10.0,
    regressors: list[str] | None = None, changes: int = CHANGEPOINTS, hinge_penalty: float = 20.0,
) -> DataFrame:
    """Error per city on the later rows of a fit of the earlier ones, and the share of values within the bounds."""
    extra, orders = regressors or [], dict(yearly=yearly, weekly=weekly, daily=daily, changes=changes)
    split = settle(chronological_split(grid.select("city", "ts", F.col(Y).cast("double").alias(Y), *extra).where(F.col(Y).isNotNull()), test_share))
    rows = settle(with_days(split, F.col("part") == "train"))
    fits = seasonal_fit(seasonal_sums(rows.where("part = 'train'"), orders, extra), penalty, hinge_penalty, changes)
    later = rows.where("part = 'test'").withColumn("is_forecast", F.lit(True))
    scored = _seasonal_values(later, fits, orders, extra)
    inside = scored.groupBy("city").agg(F.avg(F.col(Y).between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"))
    return null_safe_join(fit_metrics(scored, ["city"]), inside, ["city"])


# --- stacking ---

PENALTIES = [float(x) for x in np.logspace(-3, 3, 10)]


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and weights from sums of products over (1, columns, value); each column is shrunk by its own variance."""
    n, size = sums[0, 0], len(sums) - 1
    means = sums[0, 1:] / n
    spread = sums[1:, 1:] / n - np.outer(means, means)
    xx, xy = spread[: size - 1, : size - 1], spread[: size - 1, size - 1]
    scales = np.maximum(np.diag(xx), 1e-12)
    weights = np.linalg.solve(xx + penalty * np.diag(scales), xy)
    return np.concatenate([[means[-1] - weights @ means[:-1]], weights])


def mean_square(sums: np.ndarray, beta: np.ndarray) -> float:
    """Mean squared error of ``beta`` on the rows behind the sums."""
    xx, xy, yy = sums[:-1, :-1], sums[:-1, -1], sums[-1, -1]
    return float(max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0) / sums[0, 0])


def stacked(predictions: DataFrame, models: list[str], train_share: float = 0.8, penalties: list[float] | None = None) -> DataFrame:
    """Ridge over the models' predictions, penalty chosen on the later part of the training hours.

    The sums of products of both parts come from one pass; every penalty is fitted
    and scored from them, and only two small matrices are solved, in a task.
    """
    tried = penalties or PENALTIES
    wide = predictions.groupBy("city", "ts").pivot("model_name", models).agg(F.first("predicted"))
    truth = predictions.groupBy("city", "ts").agg(F.first(Y).alias(Y))
    rows = wide.join(truth, ["city", "ts"]).na.drop()
    n = F.count(F.lit(1)).over(Window.partitionBy("city"))
    share = F.row_number().over(by_city()) / n
    part = F.when(share <= train_share * 0.8, "fit").when(share <= train_share, "pick").otherwise("later")
    placed = settle(rows.withColumn("part", part))
    train = placed.where("part <> 'later'").select("part", *models, Y)
    sums = product_sums(train, ["part"], lambda p: np.column_stack([np.ones(len(p)), p[[*models, Y]].to_numpy(dtype=float)]))
    entries = sums.agg(F.collect_list(F.struct("part", "i", "j", "s")).alias("entries"))
    size = len(models) + 2

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for got in batch["entries"]:
                fit, pick = (square([(e["i"], e["j"], e["s"]) for e in got if e["part"] == p], size) for p in ("fit", "pick"))
                if fit[0, 0]:
                    betas = [ridge(fit, penalty) for penalty in tried]
                    best = min(betas, key=lambda b: mean_square(pick, b)) if pick[0, 0] else betas[0]
                    yield pd.DataFrame({"beta": [best.tolist()]})

    beta = entries.mapInPandas(choose, "beta array<double>").agg(F.first("beta").alias("beta")).scalar()
    later = placed.where("part = 'later'").withColumn("_beta", beta)
    terms = [F.element_at("_beta", k + 2) * F.col(m) for k, m in enumerate(models)]
    return later.select("city", "ts", Y, reduce(lambda a, b: a + b, terms, F.element_at("_beta", 1)).alias("predicted"))
