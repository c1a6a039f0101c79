"""Fits from sums of products, and the streams that reduce rows before they join or count them."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aqspark.operators import learn, rollup
from aqspark.streaming import jobs

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def waves(spark):
    """Values that follow the hour, the weather and a trend; one city without a name, one without any value."""
    rows = []
    for k, city in enumerate(["a", None]):
        for h in range(24 * 40):
            warm = float((h * 13) % 17)
            rows.append((city, T0 + timedelta(hours=h), 200.0 + 20 * k + 30 * float(np.sin(2 * np.pi * h / 24)) + 2 * warm + 0.02 * h, warm))
    rows += [("none", T0 + timedelta(hours=h), None, 1.0) for h in range(5)]
    return spark.createDataFrame(rows, "city string, ts timestamp, aqi double, warm double").repartition(7)


def test_sums_equal_the_whole_matrix(waves):
    rows = learn.with_days(waves)
    got = {}
    for r in learn.seasonal_sums(rows, regressors=["warm"]).collect():
        got.setdefault(r.city, []).append((r.i, r.j, r.s))
    assert set(got) == {"a", None}
    for city, entries in got.items():
        part = rows.where(F.col("city").eqNullSafe(F.lit(city))).toPandas()
        x = np.column_stack([learn.seasonal_columns(part["_days"].to_numpy(), part["_span"].to_numpy()), part[["warm", "aqi"]].to_numpy()])
        np.testing.assert_allclose(learn.square(entries, x.shape[1]), x.T @ x, rtol=1e-9, atol=1e-6)


def test_seasonal_fit_and_hours_ahead(waves):
    out = learn.seasonal_forecast(waves, horizon=6, yearly=0, penalty=0.1, regressors=["warm"]).toPandas()
    ahead = out[out["is_forecast"]]
    assert len(ahead) == 12 and ahead["ts"].min() == T0 + timedelta(hours=24 * 40) and ahead["aqi"].isna().all()
    assert (out["lower"] <= out["predicted"]).all() and (out["predicted"] <= out["upper"]).all()
    known = out[~out["is_forecast"]]
    assert len(known) == 2 * 24 * 40 and (known["aqi"] - known["predicted"]).abs().max() < 2


def test_held_out_error_is_of_later_rows(waves):
    out = {r.city: r for r in learn.seasonal_held_out(waves, yearly=0, penalty=0.1, regressors=["warm"]).collect()}
    assert set(out) == {"a", None}
    assert all(r.n == 24 * 8 and r.mae < 5 and r.r2 > 0.9 and 0 <= r.coverage <= 1 for r in out.values())


def test_stack_weighs_the_better_model(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h in range(500):
        y = 100 + 50 * float(np.sin(h / 9))
        for m, p in (("good", y + rng.normal(0, 1)), ("poor", 100 + rng.normal(0, 40))):
            rows.append(("a", T0 + timedelta(hours=h), m, float(p), y))
    long = spark.createDataFrame(rows, "city string, ts timestamp, model_name string, predicted double, aqi double")
    out = learn.stacked(long, ["good", "poor"]).toPandas()
    assert len(out) == 100 and (out["aqi"] - out["predicted"]).abs().mean() < 1.5


def test_ridge_equals_the_direct_solution():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 3)) * [1, 5, 20], rng.normal(size=50)
    whole = np.column_stack([np.ones(50), x, y])
    beta = learn.ridge(whole.T @ whole, 0.3)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z / 50 + 0.3 * np.eye(3), z.T @ (y - y.mean()) / 50) / x.std(0)
    np.testing.assert_allclose(beta[1:], want)
    error = np.mean((y - beta[0] - x @ beta[1:]) ** 2)
    assert learn.mean_square(whole.T @ whole, beta) == pytest.approx(error)


def test_an_actual_that_comes_again_never_repeats_a_forecast(spark, tmp_path):
    """A corrected actual in a later batch replaces the first; the forecast stays one row."""
    schema = "id long, city string, ts timestamp, value double"
    at = [T0 + timedelta(hours=h) for h in range(8)]
    batches = [[(1, "a", at[0], 10.0), (2, "a", at[1], 20.0)], [(3, "a", at[1], 21.0), (4, "a", at[2], 30.0)], [(5, "a", at[7], 70.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{k}"))
    read = lambda: jobs.read_stream(spark, str(tmp_path / "in/*"), schema, maxFilesPerTrigger=1)
    forecasts = read().where("id <> 3").select("id", "city", F.col("ts").alias("target_ts"))
    actuals = read().where("id <> 4").select("id", "city", F.col("ts").alias("timestamp_utc"), "value")
    out = jobs.attach_actuals_stream(forecasts, actuals, "id")
    jobs.write_available(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r.id, r.actual_value) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 10.0), (2, 21.0), (4, None)]


def test_hour_medians_equal_the_spread_ones(spark):
    rows = [("a", "pm25", T0 + timedelta(minutes=7 * n), float(n * n % 13) if n % 5 else None) for n in range(400)]
    df = spark.createDataFrame(rows, "city string, parameter string, timestamp_utc timestamp, value double")
    got = {r.date: r.value_median for r in rollup.rollup(df, "day").collect()}
    want = df.groupBy(F.to_date("timestamp_utc").alias("d")).agg(F.median("value").alias("m"))
    assert got == {r.d: r.m for r in want.collect()}
