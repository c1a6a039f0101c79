"""Learned forecasters on small real fits, and the full sizes of the registered ones."""

import inspect
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aqspark.operators import learn
from aqspark.plans import forecasts, learning
from aqspark.plans.registry import runner

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hours(spark):
    """Two cities' hourly values that repeat each day, with a feature that tells the hour."""
    rows = [(c, datetime(2024, 1, 1) + timedelta(hours=h), 100.0 * k + 10.0 * (h % 24) + (h * 7 % 5), float(h % 24)) for k, c in enumerate("ab") for h in range(240)]
    return spark.createDataFrame(rows, "city string, ts timestamp, aqi double, hour double").withColumn("base", F.when(F.col("city") == "a", 0.0).otherwise(100.0))


SMALL = dict(depth=3, step=0.3, subsample=0.8)
NAMES = ["hour", "base"]


def test_prefixes_of_a_fit_are_fits(hours):
    rows = learn.sized_rows(hours)
    whole = learn.tree_pipeline(NAMES, iterations=6, **SMALL).fit(rows)
    for n, predict in learn.prefix_predictions(whole, [1, 4, 6]).items():
        alone = learn.tree_pipeline(NAMES, iterations=n, **SMALL).fit(rows).transform(hours)
        want = {(r.city, r.ts): r.predicted for r in alone.collect()}
        assert {(r.city, r.ts): r.predicted for r in predict(hours).collect()} == want
    with pytest.raises(ValueError):
        learn.prefix_predictions(whole, [7])


def test_folds_train_on_the_past(hours):
    out = {r.fold: r for r in learn.cross_validate(hours, NAMES, folds=3, iterations=8, **SMALL).collect()}
    assert sorted(out) == [1, 2, 3] and all(r.n == 120 and 0 < r.mae <= r.rmse < 30 and r.r2 > 0.9 for r in out.values())


def test_search_scores_every_setting_and_resumes(hours, tmp_path, monkeypatch):
    grid = [dict(depth=d, step=0.3, subsample=0.8, iterations=n) for d in (1, 3) for n in (2, 8)]
    found = learn.grid_search(hours, NAMES, grid, folds=2, folder=str(tmp_path)).collect()
    by_trial = {r.trial: r for r in found}
    assert sorted(by_trial) == [0, 1, 2, 3] and {r.place for r in found if r.mae == min(x.mae for x in found)} == {1}
    assert by_trial[3].mae < by_trial[0].mae and str(grid[2]) == by_trial[2].parameters
    alone = learn.cross_validate(hours, NAMES, folds=2, **grid[2]).agg(F.avg("mae")).first()[0]
    assert by_trial[2].mae == pytest.approx(alone, abs=1e-12)
    monkeypatch.setattr(learn, "fold_scores", None)  # all fits are stored, so none runs again
    again = learn.grid_search(hours, NAMES, grid, folds=2, folder=str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_every_horizon_is_forecast(hours):
    out = learn.multi_horizon_forecast(hours, NAMES, [1, 5, 24], iterations=8, **SMALL).collect()
    assert sorted((r.city, r.step) for r in out) == [(c, h) for c in "ab" for h in (1, 5, 24)]
    for r in out:
        assert abs(r.forecast - (100.0 * (r.city == "b") + 10.0 * (r.ts.hour))) < 45


def test_registered_learners_use_the_full_values():
    defaults = lambda fn: {k: p.default for k, p in inspect.signature(fn).parameters.items()}
    assert defaults(learn.tree_pipeline)["iterations"] == 500 and defaults(learn.tree_pipeline)["depth"] == 6
    assert len({str(x) for x in learning.SETTINGS}) == 81 and learning.HORIZONS == list(range(1, 73))
    assert defaults(learn.cross_validate)["folds"] == 5 and defaults(learn.grid_search)["folds"] == 3


def test_all_baselines_over_years(spark):
    board = runner("m15_leaderboard_long")(spark, SF_DIR).collect()
    want = {f"persistence_{n}" for n in forecasts.LAGS_SWEPT} | {f"{k}_{n}" for k in ("sma", "wma") for n in forecasts.WINDOWS_SWEPT}
    assert {r.model_name for r in board} == want and len(want) == 13
    folds = runner("m14_backtest_custom_forecaster_long")(spark, SF_DIR).collect()
    assert {(r.test_size, r.train_size) for r in folds} == {(72, 720)}
    for kind in ("m09_moving_average_long", "m10_weighted_average_long"):
        assert len({r.model_name for r in runner(kind)(spark, SF_DIR).collect()}) == 5
