"""Forecast accuracy and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.operators import accuracy as ac
from aqspark.operators import drift as dr
from aqspark.plans.health import sql_numeric_bands
from aqspark.plans.marts import rounded
from aqspark.plans.registry import query
from aqspark.plans.tables import sql_right_closed

ORDER = ["timestamp_utc", "forecast_id"]
_CLS = lambda c: sql_numeric_bands(c, [(a, b, i) for i, (a, b, _) in enumerate(dims.CPCB_BANDS)], 0, 5)
METRICS = f"""round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e / a)) FILTER (WHERE a <> 0) * 100, 6) AS mape,
  round(1 - sum(e * e) / (var_pop(a) * count(*)), 6) AS r_squared, round(avg(CAST({_CLS('a')} = {_CLS('p')} AS INTEGER)) * 100, 6) AS category_accuracy,
  round(avg(e), 6) AS mean_bias, round(avg(CAST(abs(e / greatest(a, 1e0)) <= 1e-1 AS INTEGER)) * 100, 6) AS within_10_pct,
  round(avg(CAST(abs(e / greatest(a, 1e0)) <= 2e-1 AS INTEGER)) * 100, 6) AS within_20_pct, round(avg(CAST(abs(e) <= 50 AS INTEGER)) * 100, 6) AS within_50_aqi,
  CASE WHEN avg(e) > 0 THEN 'over_prediction' WHEN avg(e) < 0 THEN 'under_prediction' ELSE 'unbiased' END AS bias_direction, round(median(e), 6) AS median_bias"""
FE = "fe AS (SELECT *, actual_aqi AS a, predicted_aqi AS p, predicted_aqi - actual_aqi AS e FROM predictions WHERE actual_aqi IS NOT NULL)"


@query("a23_forecast_metrics", FE + f"""
SELECT 'overall' AS scope, 'all' AS key, count(*) AS records, {METRICS} FROM fe
UNION ALL SELECT 'city', city, count(*), {METRICS} FROM fe GROUP BY city
UNION ALL SELECT 'horizon', CAST(forecast_horizon_hours AS VARCHAR), count(*), {METRICS} FROM fe GROUP BY forecast_horizon_hours""")
def metrics(t):
    return rounded(ac.metrics(t.predictions))


@query("w15_directional_accuracy", FE + """,
fd AS (SELECT a - lag(a) OVER w AS da, p - lag(p) OVER w AS dp FROM fe WINDOW w AS (PARTITION BY city ORDER BY timestamp_utc, forecast_id))
SELECT count(*) FILTER (WHERE da * dp > 0 OR (da = 0 AND dp = 0)) AS correct, count(*) AS total,
  round(count(*) FILTER (WHERE da * dp > 0 OR (da = 0 AND dp = 0)) / count(*) * 100, 6) AS directional_accuracy FROM fd WHERE da IS NOT NULL""")
def direction(t):
    return rounded(ac.directional_accuracy(t.predictions, ORDER))


@query("w16_skill_score", FE + """,
fs AS (SELECT a, p, lag(a) OVER (ORDER BY timestamp_utc, forecast_id) AS prev FROM fe),
fr AS (SELECT sqrt(avg((a - p) * (a - p))) AS m, sqrt(avg((a - prev) * (a - prev))) AS n FROM fs WHERE prev IS NOT NULL)
SELECT round(m, 6) AS rmse_model, round(n, 6) AS rmse_naive, round(1 - m / n, 6) AS skill_score FROM fr""")
def skill(t):
    return rounded(ac.skill_score(t.predictions, ORDER))


_BIN = sql_right_closed("e", dims.ERROR_BINS)
_BIN_ROWS = ", ".join(f"({i}, '{lab}')" for i, (_, _, lab) in enumerate(dims.ERROR_BINS)) + f", ({len(dims.ERROR_BINS)}, NULL)"


@query("a24_error_distribution", FE + f""",
bd(bin_order, error_bin) AS (VALUES {_BIN_ROWS}),
eb AS (SELECT {_BIN} AS error_bin, count(*) AS n, avg(e) AS m FROM fe GROUP BY 1)
SELECT bin_order, bd.error_bin, round(m, 6) AS avg_error, coalesce(n, 0) AS count,
  CASE WHEN bd.error_bin IS NOT NULL THEN round(coalesce(n, 0) / (SELECT sum(n) FROM eb WHERE error_bin IS NOT NULL) * 100, 6) END AS pct
FROM bd LEFT JOIN eb ON bd.error_bin IS NOT DISTINCT FROM eb.error_bin""")
def errors(t):
    return rounded(ac.error_distribution(t.predictions))


RECENT = FE + """,
rw AS (SELECT * FROM (SELECT *, a - p AS d, row_number() OVER (PARTITION BY city, model_name ORDER BY timestamp_utc DESC, forecast_id DESC) AS rn FROM fe) WHERE rn <= 100),
ra AS (SELECT city, model_name, count(*) AS n_predictions, avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse, avg(d) AS bias,
  avg(abs(d / (a + 1e-8))) * 100 AS mape, median(abs(d)) AS median_ae, max(abs(d)) AS max_ae,
  avg(CAST(abs(d) / (a + 1e-8) <= 1e-1 AS INTEGER)) * 100 AS within_10_pct, avg(CAST(abs(d) / (a + 1e-8) <= 25e-2 AS INTEGER)) * 100 AS within_25_pct,
  quantile_cont(abs(d), 0.9) AS p90_error FROM rw GROUP BY 1, 2)"""
_RECENT_COLS = ["mae", "rmse", "bias", "mape", "median_ae", "max_ae", "within_10_pct", "within_25_pct", "p90_error"]


@query("a25_recent_accuracy", RECENT + " SELECT city, model_name, n_predictions, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RECENT_COLS) + " FROM ra")
def recent(t):
    return rounded(ac.recent_accuracy(t.predictions, ORDER))


@query("a26_accuracy_by_horizon", FE + """
SELECT city, forecast_horizon_hours, count(*) AS n_predictions, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(-e), 6) AS bias
FROM fe GROUP BY 1, 2""")
def by_horizon(t):
    return rounded(ac.accuracy_by_horizon(t.predictions, ["city"]))


# the whole-history MAE per city and model is the baseline of its recent window
@query("a27_accuracy_alerts", RECENT + """,
bl AS (SELECT city, model_name, avg(abs(e)) AS b FROM fe GROUP BY 1, 2),
m AS (SELECT ra.city, ra.model_name, mae, abs(bias) AS ab, b FROM ra JOIN bl USING (city, model_name))
SELECT city, model_name, 'high_mae' AS alert_type, round(mae, 6) AS value, 30e0 AS threshold FROM m WHERE mae > 30
UNION ALL SELECT city, model_name, 'high_bias', round(ab, 6), 15e0 FROM m WHERE ab > 15
UNION ALL SELECT city, model_name, 'degradation', round((mae - b) / b * 100, 6), 2e1 FROM m WHERE b > 0 AND (mae - b) / b * 100 > 20""")
def alerts(t):
    base = ac.scored(t.predictions).groupBy("city", "model_name").agg(F.avg(F.abs("error")).alias("baseline_mae"))
    now = ac.recent_accuracy(t.predictions, ORDER).join(base, ["city", "model_name"])
    return rounded(ac.accuracy_alerts(now))


@query("a28_tracking_summary", """
SELECT count(*) AS total_predictions, count(actual_aqi) AS predictions_with_actuals, count(*) - count(actual_aqi) AS pending_actuals FROM predictions""")
def summary(t):
    return ac.tracking_summary(t.predictions)


@query("j15_attach_actuals", """
ac AS (SELECT city, timestamp_utc, arg_max(actual_aqi + 1, forecast_id) AS v FROM forecasts GROUP BY 1, 2)
SELECT p.forecast_id, p.city, p.model_name, coalesce(p.actual_aqi, ac.v) AS actual_aqi FROM predictions p LEFT JOIN ac USING (city, timestamp_utc)""")
def actuals(t):
    found = t.forecasts.select("city", "timestamp_utc", (F.col("actual_aqi") + 1).alias("actual_value"), "forecast_id")
    out = ac.attach_actuals(t.predictions, found, ["city", "timestamp_utc"], "forecast_id")
    return out.select("forecast_id", "city", "model_name", "actual_aqi")


# --- drift: the first half of the month against the second ---

SPLIT = "2024-01-16"
FEATURES = ["value", "k", "latitude"]


def halves(t):
    cut = F.lit(SPLIT).cast("timestamp")
    return t.readings.where(F.col("timestamp_utc") < cut), t.readings.where(F.col("timestamp_utc") >= cut)


DRIFT = f"""dv AS (SELECT timestamp_utc < '{SPLIT}' AS ref, unnest(['value', 'k', 'latitude']) AS feature, unnest([value, CAST(k AS DOUBLE), latitude]) AS v FROM readings),
dt AS (SELECT feature, count(*) FILTER (WHERE ref) AS nr, count(*) FILTER (WHERE NOT ref) AS nc, min(v) AS lo, max(v) AS hi FROM dv GROUP BY 1),
dh AS (SELECT feature, v, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM dv GROUP BY 1, 2),
dc AS (SELECT feature, v, sum(r) OVER w AS cr, sum(c) OVER w AS cc, lead(v) OVER w AS nv FROM dh WINDOW w AS (PARTITION BY feature ORDER BY v)),
dd AS (SELECT feature, max(abs(cr / nr - cc / nc)) AS ks, sum(abs(cr / nr - cc / nc) * (nv - v)) AS wd, max(nr) AS nr, max(nc) AS nc FROM dc JOIN dt USING (feature) GROUP BY 1),
dx AS (SELECT *, ks * sqrt(nr * nc / (nr + nc)) AS x FROM dd),
dp AS (SELECT *, CASE WHEN x < 2e-1 THEN 1e0 ELSE least(1e0, greatest(0e0, (SELECT sum(2 * pow(-1e0, g - 1) * exp(-2 * g * g * x * x)) FROM generate_series(1, 100) s(g)))) END AS pv FROM dx),
db AS (SELECT feature, CAST(least(floor((v - lo) / ((hi + 1e-6 - lo) / 10)), 9) AS INTEGER) AS bin, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c
  FROM dv JOIN dt USING (feature) GROUP BY 1, 2),
dg AS (SELECT feature, nr, nc, unnest(generate_series(0, 9)) AS bin FROM dt),
de AS (SELECT feature, coalesce(r, 0) / nr + 1e-6 AS e, coalesce(c, 0) / nc + 1e-6 AS a FROM dg LEFT JOIN db USING (feature, bin)),
ds AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM de GROUP BY 1)"""


@query("m17_ks_statistic", DRIFT + " SELECT feature, nr AS n_ref, nc AS n_cur, round(ks, 6) AS ks_statistic, round(pv, 6) AS ks_pvalue FROM dp")
def ks(t):
    d = dr.ecdf_distances(dr.paired_histogram(*halves(t), FEATURES))
    p = dr.ks_pvalue(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"))
    return rounded(d.withColumn("ks_pvalue", p).drop("wasserstein_distance"))


@query("m18_wasserstein", DRIFT + " SELECT feature, round(wd, 6) AS wasserstein_distance FROM dd")
def wasserstein(t):
    return rounded(dr.ecdf_distances(dr.paired_histogram(*halves(t), FEATURES)).select("feature", "wasserstein_distance"))


@query("m19_stability_index", DRIFT + " SELECT feature, round(psi, 6) AS psi FROM ds")
def stability(t):
    return rounded(dr.psi(dr.paired_histogram(*halves(t), FEATURES)))


_SEV = DRIFT + """,
dz AS (SELECT feature, CAST(pv < 5e-2 AS INTEGER) + CAST(wd > 5e-1 AS INTEGER) + CAST(psi > 2e-1 AS INTEGER) AS tests_failed FROM dp JOIN ds USING (feature)),
dq AS (SELECT *, tests_failed > 0 AS drift_detected, CASE tests_failed WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity FROM dz)"""


@query("m20_drift_severity", _SEV + " SELECT * FROM dq")
def severity(t):
    return dr.feature_drift(*halves(t), FEATURES).select("feature", "tests_failed", "drift_detected", "severity")


@query("m20_retrain_decision", _SEV + """
SELECT count(*) AS features_checked, count(*) FILTER (WHERE drift_detected) AS features_drifted,
  count(*) FILTER (WHERE severity = 'high') > 0 OR count(*) FILTER (WHERE severity = 'medium') >= 3 AS should_retrain FROM dq""")
def retrain(t):
    return dr.retrain_decision(dr.feature_drift(*halves(t), FEATURES))


@query("m21_prediction_drift", DRIFT + f"""
SELECT 'value' AS feature, nr AS n_ref, nc AS n_cur, round(ks, 6) AS ks_statistic, round(wd, 6) AS wasserstein_distance, round(pv, 6) AS ks_pvalue,
  pv < 5e-2 AS drift_detected, (SELECT round(avg(value), 6) FROM readings WHERE timestamp_utc < '{SPLIT}') AS prediction_mean_ref,
  (SELECT round(avg(value), 6) FROM readings WHERE timestamp_utc >= '{SPLIT}') AS prediction_mean_cur,
  (SELECT round(stddev_pop(value), 6) FROM readings WHERE timestamp_utc < '{SPLIT}') AS prediction_std_ref,
  (SELECT round(stddev_pop(value), 6) FROM readings WHERE timestamp_utc >= '{SPLIT}') AS prediction_std_cur FROM dp WHERE feature = 'value'""")
def prediction(t):
    return rounded(dr.prediction_drift(*halves(t), "value"))


# one check per day: how many parameters moved their mean by over a fifth since the day before
_DAYS = """hd AS (SELECT CAST(timestamp_utc AS DATE) AS d, parameter, avg(value) AS m FROM readings GROUP BY 1, 2),
hl AS (SELECT d, count(*) FILTER (WHERE abs(m - pm) > 2e-1 * pm) AS n FROM (SELECT *, lag(m) OVER (PARTITION BY parameter ORDER BY d) AS pm FROM hd) GROUP BY 1)"""


@query("m22_drift_history_summary", _DAYS + """
SELECT count(*) AS total_checks, max(d) AS last_check, arg_max(n, d) AS last_drift_count, CAST(sum(n) AS BIGINT) AS total_drifts_detected FROM hl""")
def history(t):
    from pyspark.sql import Window

    days = t.readings.groupBy(F.to_date("timestamp_utc").alias("checked_at"), "parameter").agg(F.avg("value").alias("m"))
    before = F.lag("m").over(Window.partitionBy("parameter").orderBy("checked_at"))
    moved = F.abs(F.col("m") - F.col("pm")) > 0.2 * F.col("pm")
    checks = days.withColumn("pm", before).groupBy("checked_at").agg(F.count_if(moved).alias("n_features_drifted"))
    return dr.drift_summary(checks)
