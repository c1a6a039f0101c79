"""The whole feature set has every group of the given method."""

import datetime as dt
import random
from statistics import median
from types import SimpleNamespace

from aqspark import dims
from aqspark.plans.features import whole_feature_set

T0 = dt.datetime(2024, 1, 1)
READING = "reading_id bigint, city string, location string, parameter string, value double, timestamp_utc timestamp, latitude double, longitude double"
WEATHER = """weather_id bigint, city string, latitude double, longitude double, timestamp_utc timestamp, temperature_2m double,
relative_humidity_2m double, wind_speed_10m double, wind_direction_10m double, precipitation double, visibility double"""


def test_whole_feature_set_has_rolling_medians(spark):
    rng = random.Random(8)
    keys = [(c, p) for c in ("Delhi", "Pune", None) for p in ("aqi", "pm25")]
    rows = [
        (1000 * k + n, c, "S", p, None if n < 4 or rng.random() < 0.1 else rng.choice([7.0, rng.uniform(0, 400)]), T0 + dt.timedelta(hours=n), 1.0, 2.0)
        for k, (c, p) in enumerate(keys) for n in range(200)
    ]
    weather = [(n, "Delhi", 1.0, 2.0, T0 + dt.timedelta(hours=n), 20.0, 50.0, 2.0, 90.0, 0.0, 9.0) for n in range(100)]
    out = whole_feature_set(SimpleNamespace(
        readings=spark.createDataFrame(rng.sample(rows, len(rows)), READING), weather=spark.createDataFrame(weather, WEATHER)
    ))
    statistics = [f"value_roll_{s}_{n}h" for n in dims.ROLLING_WINDOWS for s in ("mean", "std", "min", "max", "median")]
    assert [c for c in statistics + [f"value_ema_{n}h" for n in dims.ROLLING_WINDOWS] if c not in out.columns] == []
    found = {r["reading_id"]: r for r in out.select("reading_id", *statistics).collect()}
    assert len(found) == len(rows)
    for k in range(len(keys)):
        values = [r[4] for r in rows[200 * k : 200 * (k + 1)]]
        for at in range(200):
            for n in dims.ROLLING_WINDOWS:
                known = [v for v in values[max(0, at - n + 1) : at + 1] if v is not None]
                got = found[1000 * k + at][f"value_roll_median_{n}h"]
                assert got is None if not known else abs(got - median(known)) < 1e-9
