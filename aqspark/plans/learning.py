"""Learned forecasters: fits have rows and properties only, the sums they are solved from a twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark.operators import forecast as fc
from aqspark.operators import learn
from aqspark.operators.series import null_safe_join
from aqspark.plans.features import TRAINING, training
from aqspark.plans.forecasts import one_step
from aqspark.plans.registry import query
from aqspark.session import settle

WEATHER = ["temperature_2m", "wind_speed_10m"]
HORIZONS = list(range(1, 73))
# fixed values: the reference's search space
SETTINGS = [
    dict(depth=d, step=s, iterations=n, subsample=u)
    for d in (4, 6, 8) for s in (0.01, 0.05, 0.1) for n in (300, 500, 800) for u in (0.7, 0.8, 0.9)
]


def table(t):
    return learn.tree_features(training(t).select("city", "ts", "aqi", *WEATHER), WEATHER, past_only=True)


@query("m03_boosted_trees")
def trees(t):
    rows, names = table(t)
    parts = settle(fc.chronological_split(rows))
    model = learn.tree_pipeline(names).fit(parts.where("part = 'train'"))
    return learn.fit_metrics(model.transform(parts.where("part = 'test'")), ["city"])


# The three below run for longer than a check of all queries allows (README), so they are called by name only.
def validation(t):
    rows, names = table(t)
    return learn.cross_validate(rows, names)


def search(t):
    rows, names = table(t)
    return learn.grid_search(rows, names, SETTINGS)


def horizons(t):
    rows, names = table(t)
    return learn.multi_horizon_forecast(rows, names, HORIZONS)


@query("m07_feature_importance")
def importance(t):
    rows, names = table(t)
    return learn.importances(t.spark, learn.tree_pipeline(names).fit(rows), names)


def seasonal_rows(t):
    return training(t).select("city", "ts", "aqi", *WEATHER)


@query("m11_trend_and_seasonality")
def seasonality(t):
    return learn.seasonal_forecast(seasonal_rows(t), horizon=72, regressors=WEATHER)


@query("m11_seasonal_held_out")
def seasonality_held_out(t):
    return learn.seasonal_held_out(seasonal_rows(t), regressors=WEATHER)


_WAVES = ", ".join(f"flatten([[sin(2 * pi() * k * d / {p}), cos(2 * pi() * k * d / {p})] for k in range(1, {n + 1})])" for p, n in (("365.25e0", 10), ("7e0", 3), ("1e0", 10)))


# the means of all products of the model's columns (intercept, trend, hinges, waves, weather) and the value
@query("m11_product_means", TRAINING + f""",
tn AS (SELECT * FROM training WHERE aqi IS NOT NULL),
te AS (SELECT city, min(ts) AS first, max(ts) AS last FROM tn GROUP BY 1),
td AS (SELECT city, aqi, {", ".join(f"coalesce({c}, 0e0) AS {c}" for c in WEATHER)}, (epoch_us(ts) - epoch_us(first)) / 864e8 AS d,
  (epoch_us(last) - epoch_us(first)) / 864e8 AS span FROM tn JOIN te USING (city)),
tx AS (SELECT city, flatten([[1e0, d / 365.25e0], [greatest(d - span * (8e-1 * k / 25), 0e0) / 365.25e0 for k in range(1, 26)],
  {_WAVES}, [{", ".join(WEATHER)}, aqi]]) AS x FROM td)
SELECT city, CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(avg(x[a.i + 1] * x[b.j + 1]), 5) + 0e0 AS mean
FROM tx, range(76) a(i), range(76) b(j) WHERE a.i <= b.j GROUP BY 1, 2, 3""")
def product_means(t):
    sums = settle(learn.seasonal_sums(learn.with_days(seasonal_rows(t)), regressors=WEATHER))
    counts = sums.where("i = 0 AND j = 0").select("city", F.col("s").alias("n"))
    return null_safe_join(sums, counts, ["city"]).select("city", "i", "j", (F.round(F.col("s") / F.col("n"), 5) + 0.0).alias("mean"))


@query("m13_stacking")
def stacking(t):
    models = ["persistence_1", "persistence_24", "sma_24", "wma_24"]
    return learn.stacked(one_step(t).where(F.col("model_name").isin(models)), models)
