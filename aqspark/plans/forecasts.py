"""Baseline forecasts, ensembles, backtests, registry and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.operators import features as ft
from aqspark.operators import forecast as fc
from aqspark.plans.features import GRID, TRAINING, _grid_sql, aqi_readings, training
from aqspark.plans.files import LONG, long_readings
from aqspark.plans.marts import rounded
from aqspark.plans.registry import query
from aqspark.plans.tables import AS_OF, FACTOR, as_of, sql_band_case, sql_cut_case
from aqspark.session import settle

COLS = ["aqi", "temperature_2m", "wind_speed_10m"]
SP = f"""sp AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) - min({c}) AS r_{c}" for c in COLS)} FROM training)"""


def grid(t):
    return ft.hourly_grid(aqi_readings(t))


@query("m01_standard_scaling", TRAINING + ", " + SP + f" SELECT city, ts, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in COLS)} FROM training, sp")
def standard(t):
    table = training(t).select("city", "ts", *COLS)
    return rounded(fc.scale(table, fc.fit_scaler(table, COLS), COLS))


@query("m01_min_max_scaling", TRAINING + ", " + SP + f" SELECT city, ts, {', '.join(f'round(({c} - lo_{c}) / r_{c}, 6) AS {c}' for c in COLS)} FROM training, sp")
def min_max(t):
    table = training(t).select("city", "ts", *COLS)
    return rounded(fc.scale(table, fc.fit_scaler(table, COLS, "minmax"), COLS))


# widened predictions are scaled back and clipped, so some values meet the bounds
@query("m01_inverse_scaling", TRAINING + ", " + SP + " SELECT city, ts, round(least(greatest(((aqi - m_aqi) / s_aqi * 2) * s_aqi + m_aqi, 0e0), 5e2), 6) AS aqi FROM training, sp")
def inverse(t):
    table = training(t).select("city", "ts", "aqi")
    params = fc.fit_scaler(table, ["aqi"])
    wide = fc.scale(table, params, ["aqi"]).withColumn("aqi", F.col("aqi") * 2)
    return rounded(fc.unscale(wide, params, ["aqi"], clip=True))


SPLIT = """split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY city ORDER BY ts) <= floor(count(*) OVER (PARTITION BY city) * 8e-1) THEN 'train' ELSE 'test' END AS part FROM {src})"""


@query("m02_chronological_split", GRID + ", " + SPLIT.format(src="grid") + " SELECT city, ts, part FROM split")
def split(t):
    return fc.chronological_split(grid(t)).select("city", "ts", "part")


W24 = fc.wma_weights(24)
_WMA = " + ".join(f"lag(aqi, {24 - i}) OVER s * CAST({w!r} AS DOUBLE)" for i, w in enumerate(W24))
ONE = GRID + f""",
one AS (SELECT city, ts, aqi, lag(aqi, 1) OVER s AS persistence_1, lag(aqi, 24) OVER s AS persistence_24, lag(aqi, 168) OVER s AS persistence_168,
  CASE WHEN lag(aqi, 24) OVER s IS NOT NULL THEN avg(aqi) OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS sma_24,
  {_WMA} AS wma_24 FROM grid WINDOW s AS (PARTITION BY city ORDER BY ts)),
lp AS (SELECT city, ts, aqi, unnest(['persistence_1', 'persistence_24', 'persistence_168', 'sma_24', 'wma_24']) AS model_name,
  unnest([persistence_1, persistence_24, persistence_168, sma_24, wma_24]) AS predicted FROM one),
rm AS (SELECT city, model_name, avg(abs(aqi - predicted)) AS mae, sqrt(avg((aqi - predicted) * (aqi - predicted))) AS rmse,
  avg(abs((aqi - predicted) / (aqi + 1e-8))) * 100 AS mape, count(*) AS n_samples FROM lp WHERE predicted IS NOT NULL GROUP BY 1, 2)"""
MODELS = ["persistence_1", "persistence_24", "persistence_168", "sma_24", "wma_24"]


def one_step(t):
    return fc.long_predictions(fc.one_step(grid(t)), MODELS)


def _metrics_sql(like: str) -> str:
    return ONE + f" SELECT city, model_name, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape, n_samples FROM rm WHERE model_name LIKE '{like}'"


@query("m08_persistence_metrics", _metrics_sql("persistence%"))
def persistence_metrics(t):
    rows = one_step(t).where(F.col("model_name").startswith("persistence"))
    return rounded(fc.residual_metrics(rows, ["city", "model_name"]))


_LAST = "last AS (SELECT city, list(aqi ORDER BY ts) AS v, max(ts) AS origin FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts DESC) AS rn FROM grid) WHERE rn <= {n} GROUP BY 1)"
Z = f"CAST({dims.NORMAL_Z_95!r} AS DOUBLE)"
PERSIST = ONE + ", " + _LAST.format(n=24) + f""",
pf AS (SELECT l.city, CAST(s AS INTEGER) AS step, origin + to_hours(CAST(s AS INTEGER)) AS ts, v[1] AS forecast, v[1] - {Z} * rmse AS lower, v[1] + {Z} * rmse AS upper
  FROM last l JOIN rm ON rm.city = l.city AND model_name = 'persistence_24', generate_series(1, 24) g(s))"""


def persistence(t):
    g = grid(t)
    metrics = fc.residual_metrics(one_step(t).where(F.col("model_name") == "persistence_24"), ["city"])
    return fc.with_interval(fc.persistence_forecast(g, lag=24, horizon=24), metrics)


@query("m08_persistence_forecast", PERSIST + " SELECT city, step, ts, round(forecast, 6) AS forecast, round(lower, 6) AS lower, round(upper, 6) AS upper FROM pf")
def persistence_forecast(t):
    return rounded(persistence(t))


SEASONAL = GRID + ", " + _LAST.format(n=24) + """,
sf AS (SELECT city, CAST(s AS INTEGER) AS step, origin + to_hours(CAST(s AS INTEGER)) AS ts, v[(s - 1) % 24 + 1] AS forecast FROM last, generate_series(1, 48) g(s))"""


def seasonal(t):
    return fc.persistence_forecast(grid(t), lag=24, horizon=48, seasonal=True)


@query("m08_seasonal_persistence", SEASONAL + " SELECT city, step, ts, round(forecast, 6) AS forecast FROM sf")
def seasonal_persistence(t):
    return rounded(seasonal(t))


@query("m09_moving_average_flat", GRID + ", " + _LAST.format(n=24) + """
SELECT city, CAST(s AS INTEGER) AS step, origin + to_hours(CAST(s AS INTEGER)) AS ts, round(list_sum(v) / 24, 6) AS forecast FROM last, generate_series(1, 24) g(s)""")
def sma_flat(t):
    return rounded(fc.moving_average_forecast(grid(t), 24, 24))


def _fed_back(combine: str) -> str:
    return GRID + ", " + _LAST.format(n=24) + f""",
fb(city, origin, step, buf) AS (SELECT city, origin, 0, v FROM last
  UNION ALL SELECT city, origin, step + 1, list_append(buf[2:], {combine}) FROM fb WHERE step < 24)
SELECT city, step, origin + to_hours(step) AS ts, round(buf[24], 6) AS forecast FROM fb WHERE step > 0"""


@query("m09_moving_average_rolling", _fed_back("list_sum(buf) / 24"))
def sma_rolling(t):
    return rounded(fc.moving_average_forecast(grid(t), 24, 24, rolling=True))


@query("m09_moving_average_metrics", _metrics_sql("sma%"))
def sma_metrics(t):
    return rounded(fc.residual_metrics(one_step(t).where(F.col("model_name") == "sma_24"), ["city", "model_name"]))


@query("m10_weighted_average_metrics", _metrics_sql("wma%"))
def wma_metrics(t):
    return rounded(fc.residual_metrics(one_step(t).where(F.col("model_name") == "wma_24"), ["city", "model_name"]))


@query("m10_weighted_average_rolling", _fed_back(" + ".join(f"buf[{i + 1}] * CAST({w!r} AS DOUBLE)" for i, w in enumerate(W24))))
def wma_rolling(t):
    return rounded(fc.weighted_average_forecast(grid(t), 24, 24))


@query("m10_weighted_average_oldest_first", _fed_back(" + ".join(f"buf[{i + 1}] * CAST({w!r} AS DOUBLE)" for i, w in enumerate(fc.wma_weights(24, legacy=True)))))
def wma_legacy(t):
    return rounded(fc.weighted_average_forecast(grid(t), 24, 24, legacy=True))


# --- ensembles: weights from the first 80% of hours, applied to the rest ---

ENS = ONE + ", " + SPLIT.format(src="grid") + """,
lt AS (SELECT lp.*, part FROM lp JOIN split USING (city, ts)),
wt AS (SELECT model_name, 1 / (mae + 1e-8) / sum(1 / (mae + 1e-8)) OVER () AS weight FROM (
  SELECT model_name, avg(abs(aqi - predicted)) AS mae FROM lt WHERE part = 'train' AND predicted IS NOT NULL GROUP BY 1)),
wc AS (SELECT city, model_name, 1 / (mae + 1e-8) / sum(1 / (mae + 1e-8)) OVER (PARTITION BY city) AS weight FROM (
  SELECT city, model_name, avg(abs(aqi - predicted)) AS mae FROM lt WHERE part = 'train' AND predicted IS NOT NULL GROUP BY 1, 2))"""


def parts(t):
    labelled = fc.chronological_split(grid(t)).select("city", "ts", "part")
    rows = one_step(t).join(labelled, ["city", "ts"])
    return rows.where(F.col("part") == "train"), rows.where(F.col("part") == "test")


@query("m12_ensemble_mean", ENS + " SELECT city, ts, round(max(aqi), 6) AS aqi, round(avg(predicted), 6) AS predicted, count(*) AS n_models FROM lt WHERE part = 'test' AND predicted IS NOT NULL GROUP BY 1, 2")
def ensemble_mean(t):
    return rounded(fc.ensemble(parts(t)[1]))


@query("m12_ensemble_weights", ENS + " SELECT model_name, round(weight, 6) AS weight FROM wt")
def ensemble_weights(t):
    return rounded(fc.inverse_error_weights(parts(t)[0]))


@query("m12_ensemble_weighted", ENS + " SELECT city, ts, round(max(aqi), 6) AS aqi, round(sum(weight * predicted), 6) AS predicted, count(*) AS n_models FROM lt JOIN wt USING (model_name) WHERE part = 'test' AND predicted IS NOT NULL GROUP BY 1, 2")
def ensemble_weighted(t):
    train, test = parts(t)
    return rounded(fc.ensemble(test, fc.inverse_error_weights(train)))


@query("m12_ensemble_dynamic", ENS + " SELECT city, ts, round(max(aqi), 6) AS aqi, round(sum(weight * predicted), 6) AS predicted, count(*) AS n_models FROM lt JOIN wc USING (city, model_name) WHERE part = 'test' AND predicted IS NOT NULL GROUP BY 1, 2")
def ensemble_dynamic(t):
    train, test = parts(t)
    return rounded(fc.ensemble(test, fc.inverse_error_weights(train, ["city"]), ["city"]))


# --- backtests ---

BT = dict(initial=240, step=72, horizon=24)
_WO = " + ".join(f"lag(aqi, {23 - i}) OVER s * CAST({w!r} AS DOUBLE)" for i, w in enumerate(W24))
BACKTEST = GRID + f""",
nb AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY city) AS n FROM grid),
ov AS (SELECT city, pos, aqi AS persistence_1, lag(aqi, 23) OVER s AS persistence_24,
  avg(aqi) OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS sma_24, {_WO} AS wma_24 FROM nb WINDOW s AS (PARTITION BY city ORDER BY ts)),
fo AS (SELECT city, CAST(f AS INTEGER) AS fold, 240 + 72 * f AS start FROM (SELECT city, max(n) AS n FROM nb GROUP BY 1), generate_series(0, 1000) g(f) WHERE 240 + 72 * f + 24 <= n),
ft AS (SELECT fo.city, fold, start, nb.aqi, unnest(['persistence_1', 'persistence_24', 'sma_24', 'wma_24']) AS model_name, unnest([persistence_1, persistence_24, sma_24, wma_24]) AS p
  FROM fo JOIN nb ON nb.city = fo.city AND nb.pos >= start AND nb.pos < start + 24 JOIN ov ON ov.city = fo.city AND ov.pos = start - 1),
fm AS (SELECT city, model_name, fold, count(*) AS test_size, avg(abs(aqi - p)) AS mae, sqrt(avg((aqi - p) * (aqi - p))) AS rmse,
  1 - sum((aqi - p) * (aqi - p)) / nullif(var_pop(aqi) * count(*), 0) AS r2, avg(abs((aqi - p) / (aqi + 1e-8))) * 100 AS mape, CAST(max(start) AS INTEGER) AS train_size FROM ft GROUP BY 1, 2, 3),
bs AS (SELECT city, model_name, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std, count(*) AS n_folds FROM fm GROUP BY 1, 2)"""


def folds(t):
    return fc.backtest(grid(t), **BT)


@query("m14_backtest_folds", BACKTEST + " SELECT city, model_name, fold, test_size, train_size, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 4) AS r2, round(mape, 6) AS mape FROM fm")
def backtest_folds(t):
    return folds(t).select("city", "model_name", "fold", "test_size", "train_size", *[F.round(c, 4 if c == "r2" else 6).alias(c) for c in ("mae", "rmse", "r2", "mape")])


@query("m14_backtest_summary", BACKTEST + " SELECT city, model_name, round(mae_mean, 6) AS mae_mean, round(mae_std, 6) AS mae_std, round(rmse_mean, 6) AS rmse_mean, round(rmse_std, 6) AS rmse_std, n_folds FROM bs")
def backtest_summary(t):
    return rounded(fc.backtest_summary(folds(t)).drop("r2_mean", "r2_std"))


def _last_mean(history, horizon):
    return [float(history.tail(24).mean())] * horizon


@query("m14_backtest_custom_forecaster", BACKTEST + " SELECT city, fold, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM fm WHERE model_name = 'sma_24'")
def custom(t):
    return rounded(fc.backtest_custom(grid(t), _last_mean, "mean_of_last_day", **BT).select("city", "fold", "mae", "rmse"))


@query("m15_leaderboard", BACKTEST + """,
lb AS (SELECT model_name, avg(mae) AS mae_mean, avg(rmse) AS rmse_mean, count(*) AS n_folds FROM fm GROUP BY 1)
SELECT model_name, round(mae_mean, 6) AS mae_mean, round(rmse_mean, 6) AS rmse_mean, n_folds, CAST(rank() OVER (ORDER BY mae_mean) AS INTEGER) AS place,
  rank() OVER (ORDER BY mae_mean) = 1 AS is_champion FROM lb""")
def leaderboard(t):
    board = fc.leaderboard(fc.backtest_summary(folds(t), ["model_name"]))
    return rounded(board.select("model_name", "mae_mean", "rmse_mean", "n_folds", "place", "is_champion"))


# --- the reference's windows and fold sizes, over years of readings, as a month is too short for them ---

LAGS_SWEPT = (1, 24, 168)
WINDOWS_SWEPT = (6, 12, 24, 48, 168)


LONG_GRID = LONG + ",\n" + _grid_sql("lgrid", "lr", "", {"aqi": f"value * CAST({FACTOR!r} AS DOUBLE)"})


def _swept_sql(kind: str) -> str:
    """One-step error of each window over the long grid."""
    def mean(n: int) -> str:
        if kind == "sma":
            return f"avg(aqi) OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        return " + ".join(f"lag(aqi, {n - i}) OVER s * CAST({w!r} AS DOUBLE)" for i, w in enumerate(fc.wma_weights(n)))

    parts = " UNION ALL ".join(
        f"SELECT city, '{kind}_{n}' AS model_name, aqi, CASE WHEN lag(aqi, {n}) OVER s IS NOT NULL THEN {mean(n)} END AS p FROM lgrid WINDOW s AS (PARTITION BY city ORDER BY ts)"
        for n in WINDOWS_SWEPT
    )
    return LONG_GRID + f""",
sw AS ({parts})
SELECT city, model_name, round(avg(abs(aqi - p)), 6) AS mae, round(sqrt(avg((aqi - p) * (aqi - p))), 6) AS rmse,
  round(avg(abs((aqi - p) / (aqi + 1e-8))) * 100, 6) AS mape, count(*) AS n_samples FROM sw WHERE p IS NOT NULL GROUP BY 1, 2"""


_ALL = [
    *((f"persistence_{k}", f"v[-{k}]") for k in LAGS_SWEPT),
    *((f"sma_{n}", f"list_avg(v[-{n}:])") for n in WINDOWS_SWEPT),
    *((f"wma_{n}", f"list_dot_product(v[-{n}:], [{', '.join(f'CAST({w!r} AS DOUBLE)' for w in fc.wma_weights(n))}])") for n in WINDOWS_SWEPT),
]
LONG_BACKTEST = LONG_GRID + f""",
lb AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY city) AS n FROM lgrid),
lo AS (SELECT city, CAST(f AS INTEGER) AS fold, 720 + 168 * f AS start FROM (SELECT city, max(n) AS n FROM lb GROUP BY 1), generate_series(0, 5000) g(f) WHERE 720 + 168 * f + 72 <= n),
lv AS (SELECT lo.city, fold, start, list(aqi ORDER BY pos) AS v FROM lo JOIN lb ON lb.city = lo.city AND pos >= start - 168 AND pos < start GROUP BY ALL),
lf AS (SELECT city, fold, start, unnest([{", ".join(f"'{m}'" for m, _ in _ALL)}]) AS model_name, unnest([{", ".join(e for _, e in _ALL)}]) AS p FROM lv),
fm AS (SELECT lf.city, model_name, fold, count(*) AS test_size, avg(abs(aqi - p)) AS mae, sqrt(avg((aqi - p) * (aqi - p))) AS rmse,
  1 - sum((aqi - p) * (aqi - p)) / nullif(var_pop(aqi) * count(*), 0) AS r2, avg(abs((aqi - p) / (aqi + 1e-8))) * 100 AS mape, CAST(max(start) AS INTEGER) AS train_size
  FROM lf JOIN lb ON lb.city = lf.city AND pos >= start AND pos < start + 72 GROUP BY 1, 2, 3)"""
FOLD_SQL = " SELECT city, model_name, fold, test_size, {train} AS train_size, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(r2, 3) AS r2, round(mape, 3) AS mape FROM fm"


def long_grid(t):
    # prices have two decimals; scaled, their means meet no tie when rounded
    return settle(ft.hourly_grid(long_readings(t).withColumn("value", F.col("value") * FACTOR)))


def swept_metrics(t, kind: str):
    g, out = long_grid(t), None
    for n in WINDOWS_SWEPT:
        wide = fc.one_step(g, persistence=(), sma=n if kind == "sma" else 0, wma=n if kind == "wma" else 0)
        rows = fc.long_predictions(wide, [f"{kind}_{n}"])
        part = fc.residual_metrics(rows, ["city", "model_name"])
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("m09_moving_average_long", _swept_sql("sma"))
def sma_long(t):
    return swept_metrics(t, "sma")


@query("m10_weighted_average_long", _swept_sql("wma"))
def wma_long(t):
    return swept_metrics(t, "wma")


def long_folds(t):
    """Folds of all 13 baselines with the full fold sizes."""
    g, out = long_grid(t), None
    for k, n in enumerate(WINDOWS_SWEPT):
        part = fc.backtest(g, persistence=() if k else LAGS_SWEPT, sma=n, wma=n)
        out = part if out is None else out.unionByName(part)
    return out


def fold_columns(df):
    """Scores rounded as in the twin: to three digits, so that none of the many meets a tie on which two engines differ."""
    return df.select("city", "model_name", "fold", "test_size", "train_size", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "r2", "mape")])


@query("m14_backtest_folds_long", LONG_BACKTEST + FOLD_SQL.format(train="train_size"))
def backtest_folds_long(t):
    return fold_columns(long_folds(t))


@query("m14_backtest_summary_long", LONG_BACKTEST + """
SELECT city, model_name, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std,
  round(avg(r2), 4) AS r2_mean, round(stddev_pop(r2), 4) AS r2_std, count(*) AS n_folds FROM fm GROUP BY 1, 2""")
def backtest_summary_long(t):
    out = fc.backtest_summary(long_folds(t))
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("r2_mean", "r2_std")}))


@query("m14_backtest_custom_forecaster_long", LONG_BACKTEST + FOLD_SQL.format(train=720).replace("model_name,", "'mean_of_last_day' AS model_name,", 1) + " WHERE model_name = 'sma_24'")
def custom_long(t):
    return fold_columns(fc.backtest_custom(long_grid(t), _last_mean, "mean_of_last_day"))


@query("m15_leaderboard_long", LONG_BACKTEST + """,
bo AS (SELECT model_name, avg(mae) AS mae_mean, avg(rmse) AS rmse_mean, count(*) AS n_folds FROM fm GROUP BY 1)
SELECT model_name, round(mae_mean, 6) AS mae_mean, round(rmse_mean, 6) AS rmse_mean, n_folds, CAST(rank() OVER (ORDER BY mae_mean) AS INTEGER) AS place,
  rank() OVER (ORDER BY mae_mean) = 1 AS is_champion FROM bo""")
def leaderboard_long(t):
    board = fc.leaderboard(fc.backtest_summary(long_folds(t), ["model_name"]))
    return rounded(board.select("model_name", "mae_mean", "rmse_mean", "n_folds", "place", "is_champion"))


# registry: the best model of the first folds holds the title, that of the later folds challenges it
REG = BACKTEST + f""",
rg AS (SELECT city, model_name, avg(mae) FILTER (WHERE fold < 3) AS m0, avg(mae) FILTER (WHERE fold >= 3) AS m1 FROM fm GROUP BY 1, 2),
ch AS (SELECT city, model_name AS champion, m0 AS champion_mae FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY m0, model_name) AS rn FROM rg) WHERE rn = 1),
cd AS (SELECT city, model_name, m1 AS mae FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY m1, model_name) AS rn FROM rg) WHERE rn = 1),
dc AS (SELECT city, model_name, mae, champion, champion_mae, (mae - champion_mae) / champion_mae * 100 AS degradation_pct,
  (mae - champion_mae) / champion_mae * 100 <= 5 AS promote FROM cd LEFT JOIN ch USING (city))"""


def decisions(t):
    from pyspark.sql import Window

    per = folds(t).groupBy("city", "model_name").agg(
        F.avg(F.when(F.col("fold") < 3, F.col("mae"))).alias("m0"), F.avg(F.when(F.col("fold") >= 3, F.col("mae"))).alias("m1")
    )
    best = lambda m: per.withColumn("rn", F.row_number().over(Window.partitionBy("city").orderBy(m, "model_name"))).where("rn = 1")
    registry = best("m0").select(
        "city", "model_name", F.col("m0").alias("mae"), F.lit("champion").alias("status"), F.lit("2024-01-20").cast("timestamp").alias("promoted_at")
    )
    champions = fc.current_champion(registry, ["city"])
    return fc.promotion(best("m1").select("city", "model_name", F.col("m1").alias("mae")), champions, ["city"]), registry


@query("m16_promotion_gate", REG + " SELECT city, model_name, round(mae, 6) AS mae, champion, round(champion_mae, 6) AS champion_mae, round(degradation_pct, 6) AS degradation_pct, promote FROM dc")
def promotion(t):
    return rounded(decisions(t)[0])


@query("m16_registry_changes", REG + f"""
SELECT city, model_name, round(mae, 6) AS mae, 'champion' AS status, TIMESTAMP '{AS_OF}' AS changed_at, NULL AS reason FROM dc WHERE promote
UNION ALL SELECT city, champion, round(champion_mae, 6), 'archived', TIMESTAMP '{AS_OF}', 'Replaced by ' || model_name FROM dc WHERE promote AND champion IS NOT NULL""")
def registry_changes(t):
    return rounded(fc.registry_changes(decisions(t)[0], as_of(), ["city"]))


@query("m16_retraining_due", REG + " SELECT city, 264e0 AS age_hours, true AS is_due FROM ch")
def due(t):
    return fc.retraining_due(decisions(t)[1], as_of(), "weekly", ["city"])


# --- serving ---

_CLIP = "least(greatest(forecast, 0e0), 5e2)"


@query("m23_serve_table", PERSIST + f"""
SELECT city, step, ts, round({_CLIP}, 5) AS aqi, round(lower, 5) AS aqi_lower, round(upper, 5) AS aqi_upper, {sql_band_case(_CLIP, dims.EPA_BANDS, 'Hazardous', 'Hazardous')} AS category FROM pf""")
def serve(t):
    return fc.serve(persistence(t), digits=5)


@query("m24_forecast_outlook", SEASONAL + f"""
SELECT city, round(max({_CLIP}), 6) AS peak_aqi, round(avg({_CLIP}), 6) AS avg_aqi, round(min({_CLIP}), 6) AS min_aqi,
  count(*) FILTER (WHERE {_CLIP} > 100) AS hours_above_100, count(*) FILTER (WHERE {_CLIP} > 150) AS hours_above_150 FROM sf GROUP BY 1""")
def outlook(t):
    return rounded(fc.outlook(seasonal(t)))


@query("m25_gauges", f"""
SELECT 'data_missing_ratio' AS metric, 'source' AS label_1, NULL AS label_2, round(1 - count(source) / count(*), 6) AS value FROM readings
UNION ALL SELECT 'data_missing_ratio', 'aqi_category', NULL, round(1 - count(aqi_category) / count(*), 6) FROM readings
UNION ALL SELECT 'data_freshness_seconds', city, NULL, round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(timestamp_utc))) / 1e6, 6) FROM readings GROUP BY city
UNION ALL SELECT 'model_mae', model_name, city, round(avg(abs(predicted_aqi - actual_aqi)), 6) FROM predictions WHERE actual_aqi IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'model_rmse', model_name, city, round(sqrt(avg((predicted_aqi - actual_aqi) * (predicted_aqi - actual_aqi))), 6) FROM predictions WHERE actual_aqi IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'model_r2', model_name, city, round(1 - sum((predicted_aqi - actual_aqi) * (predicted_aqi - actual_aqi)) / (var_pop(actual_aqi) * count(*)), 6) FROM predictions WHERE actual_aqi IS NOT NULL GROUP BY 2, 3""")
def gauges(t):
    return rounded(fc.gauges(t.readings, t.predictions, as_of(), ["source", "aqi_category"]))


_RISK = sql_cut_case("forecast", dims.RISK_SCORE_CUTS, dims.RISK_SCORE_TOP)


@query("m26_risk_outlook", SEASONAL + f""",
rd AS (SELECT *, forecast <= 100 AS ok FROM sf WHERE step <= 24),
rr AS (SELECT *, step - sum(CAST(ok AS INTEGER)) OVER (PARTITION BY city ORDER BY step) AS run FROM rd),
ru AS (SELECT city, min(ts) AS start, max(ts) AS last, count(*) AS hours FROM rr WHERE ok GROUP BY city, run),
rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY hours DESC, start) AS rn FROM ru) WHERE rn = 1),
rt AS (SELECT city, avg(forecast) FILTER (WHERE step <= 6) AS a, avg(forecast) FILTER (WHERE step > 18) AS z, stddev_pop(forecast) / avg(forecast) AS spread, max({_RISK}) AS risk FROM rd GROUP BY 1)
SELECT city, CASE WHEN (z - a) / a > 1e-1 THEN 'worsening' WHEN (z - a) / a < -1e-1 THEN 'improving' WHEN spread > 5e-1 THEN 'fluctuating' ELSE 'stable' END AS next_24h_trend,
  risk AS next_24h_max_risk, start AS safe_start, last AS safe_end, hours AS safe_hours FROM rt LEFT JOIN rb USING (city)""")
def risk_outlook(t):
    out = fc.risk_outlook(seasonal(t))
    window = {"safe_start": "start", "safe_end": "end", "safe_hours": "hours"}
    return out.select("city", "next_24h_trend", "next_24h_max_risk", *(F.col(f"safe_window.{c}").alias(n) for n, c in window.items()))


