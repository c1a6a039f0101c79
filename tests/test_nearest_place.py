"""Nearest weather place by rings of cells against all pairs."""

import datetime as dt
import math

import numpy as np
import pytest

from aqspark.operators import weather_join
from aqspark.operators.weather_join import join_on_coordinates

READING = "reading_id long, latitude double, longitude double, timestamp_utc timestamp, note string"
WEATHER = "weather_id long, latitude double, longitude double, timestamp_utc timestamp, temperature_2m double"
START = dt.datetime(2024, 1, 1)
BAND = dt.timedelta(minutes=30)


def known(r):
    return r[3] is not None and all(x is not None and math.isfinite(x) for x in r[1:3])


def plain(readings, weather):
    """Reading id to temperature, by looking at every weather row."""
    out = {}
    for r in readings:
        near = [
            (math.sqrt((r[1] - w[1]) ** 2 + (r[2] - w[2]) ** 2), w[3], w[0], w[4])
            for w in weather
            if known(r) and known(w) and abs(w[3] - r[3]) <= BAND
        ]
        out[r[0]] = min(near)[3] if near else None
    return out


def joined(spark, readings, weather):
    df = join_on_coordinates(
        spark.createDataFrame(readings, READING), spark.createDataFrame(weather, WEATHER), "reading_id", ["timestamp_utc", "weather_id"]
    )
    assert df.columns == ["reading_id", "latitude", "longitude", "timestamp_utc", "note", "temperature_2m"]
    rows = df.collect()
    assert len(rows) == len(readings)
    return {r.reading_id: r.temperature_2m for r in rows}


def moment(rng, hours):
    return START + dt.timedelta(minutes=int(rng.integers(0, hours * 60)))


@pytest.mark.parametrize("places, per_place, crowded", [(1, 5, False), (40, 3, True), (200, 2, False)])
def test_equals_all_pairs(spark, monkeypatch, places, per_place, crowded):
    if crowded:
        monkeypatch.setattr(weather_join, "MARKS_PER_BUCKET", 0)
        monkeypatch.setattr(weather_join, "FIRST_PLACES", 2)
    rng = np.random.default_rng(places)
    # most places crowd into one town, the others are far apart; some share a distance
    town = rng.random(places) < 0.6
    lat = np.where(town, 20 + rng.integers(0, 6, places) * 0.01, rng.integers(-40, 60, places))
    lon = np.where(town, 75 + rng.integers(0, 6, places) * 0.01, rng.integers(-170, 170, places))
    weather = [
        (p * 100 + i, float(lat[p]), float(lon[p]), moment(rng, 12), float(p * 100 + i))
        for p in range(places) for i in range(per_place)
    ]
    spots = [(20.025, 75.025), (20.03, 75.03), (-33.0, 151.0), (0.0, 0.0), (55.5, -120.0)]
    readings = [(i, *spots[int(rng.integers(0, len(spots)))], moment(rng, 14), "x") for i in range(150)]
    assert joined(spark, readings, weather) == plain(readings, weather)


def test_places_equally_far_go_by_time_then_order(spark):
    at = START + dt.timedelta(hours=1)
    weather = [
        (7, 10.0, 11.0, at + dt.timedelta(minutes=5), 7.0), (3, 10.0, 9.0, at + dt.timedelta(minutes=5), 3.0),
        (9, 11.0, 10.0, at - dt.timedelta(minutes=30), 9.0), (1, 9.0, 10.0, at - dt.timedelta(minutes=31), 1.0),
    ]
    readings = [(1, 10.0, 10.0, at, "a"), (2, 10.0, 10.0, at + dt.timedelta(minutes=1), "b"), (3, 10.0, 10.0, at, "copy")]
    assert joined(spark, readings, weather) == {1: 9.0, 2: 3.0, 3: 9.0}


def test_rows_without_time_or_coordinates_match_nothing(spark):
    at = START
    weather = [(1, None, 1.0, at, 1.0), (2, 1.0, math.nan, at, 2.0), (3, 1.0, 1.0, None, 3.0), (4, 50.0, 50.0, at, 4.0)]
    readings = [(1, 1.0, 1.0, at, None), (2, None, 1.0, at, None), (3, math.inf, 1.0, at, None), (4, 1.0, 1.0, None, None)]
    got = joined(spark, readings, weather)
    assert got == {1: 4.0, 2: None, 3: None, 4: None}


def test_empty_tables(spark):
    row = (1, 1.0, 1.0, START, None)
    assert joined(spark, [row], []) == {1: None}
    assert joined(spark, [], [(1, 1.0, 1.0, START, 1.0)]) == {}


def test_moment_without_any_weather_leaves_after_the_first_round(spark):
    far = START + dt.timedelta(days=9)
    weather = [(i, float(i % 30), float(i // 30), START, float(i)) for i in range(300)]
    readings = [(1, 5.0, 5.0, far, None), (2, 5.2, 5.0, START, None), (3, 5.0, 5.0, START + BAND, None)]
    assert joined(spark, readings, weather) == {1: None, 2: 155.0, 3: 155.0}
