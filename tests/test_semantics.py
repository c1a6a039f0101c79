"""Edge cases on small literal frames."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aqspark.functions import index
from aqspark.functions.geo import haversine_km
from aqspark.operators import accuracy, clean, cohort, forecast, hotspot, quality, weather_join

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_integer_bands_leave_gaps(spark):
    df = spark.createDataFrame([(v,) for v in (25.0, 75.0, 150.0, 250.0, 350.0, 450.0, 50.5, 501.0)], "v double")
    assert one(df, index.cpcb_category("v")) == ["Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe", "Unknown", "Severe"]
    assert one(df, index.class_index("v"))[-2:] == [0, 5]
    assert one(df, index.impact_score("v"))[-2:] == [0, 5]
    assert one(df, index.relative_risk("v"))[-2:] == [1.0, 5.0]


def test_pm25_index_gap_and_top(spark):
    df = spark.createDataFrame([(30.5,), (30.0,), (600.0,)], "v double")
    assert one(df, index.cpcb_pm25_index("v")) == [0.0, 50.0, 500.0]
    assert one(df, index.training_pm25_index("v"))[2] == 500.0
    assert one(df, index.epa_sub_index("v", "o3")) == [28, 28, 721]


def test_null_category_policy(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert one(df, index.aqi_cut_category("v")) == ["Unknown"]
    assert one(df, index.aqi_cut_category("v", null_label="Severe")) == ["Severe"]


def readings(spark, rows):
    return spark.createDataFrame(rows, "city string, location string, parameter string, value double, timestamp_utc timestamp, source string")


def test_range_step_removes_what_iqr_skips(spark):
    rows = [("Delhi", "S", "pm25", 50.0, hours(i), "cpcb") for i in range(20)] + [("Delhi", "S", "pm25", 5000.0, hours(21), "cpcb")]
    assert clean.clean(readings(spark, rows)).agg(F.max("value")).first()[0] < 5000


def test_zscore_threshold(spark):
    rows = [("Delhi", "S", "pm25", 50.0, hours(i), "cpcb") for i in range(20)] + [("Delhi", "S", "pm25", 999.0, hours(21), "cpcb")]
    flagged = clean.flag_outliers(readings(spark, rows), "zscore", threshold=2)
    assert [r.value for r in flagged.where("is_outlier").collect()] == [999.0]


def test_duplicates_prefer_source(spark):
    rows = [("Delhi", "S", "pm25", 50.0, T0, "openaq"), ("Delhi", "S", "pm25", 60.0, T0, "cpcb"), ("Mumbai", None, "pm25", 1.0, T0, None)]
    out = {r.city: r.source for r in clean.deduplicate(readings(spark, rows)).collect()}
    assert out == {"Delhi": "cpcb", "Mumbai": None}


def test_nulls_and_text_are_dropped(spark):
    rows = [("nan", "pm25", "1", "2024-01-01"), ("Delhi", "pm25", "x", "2024-01-01"), ("Delhi", None, "1", "2024-01-01"), ("Delhi", "pm25", "7", "2024-01-01")]
    raw = spark.createDataFrame(rows, "city string, parameter string, value string, timestamp_utc string")
    assert [r.value for r in clean.drop_nulls(clean.coerce_types(raw)).collect()] == [7.0]


def test_weather_join_tolerance_and_tie(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    aqi = spark.createDataFrame([(1, "Delhi", at(130)), (2, "Delhi", at(400)), (3, "Delhi", at(610)), (4, "Pune", at(130))], "id int, city string, timestamp_utc timestamp")
    wx = spark.createDataFrame(
        [(1, "Delhi", at(110), 1.0), (2, "Delhi", at(360 - 1), 2.0), (3, "Delhi", at(590), 3.0), (4, "Delhi", at(660), 4.0)],
        "weather_id int, city string, timestamp_utc timestamp, temperature_2m double",
    )
    out = {r.id: r.temperature_2m for r in weather_join.join_weather(aqi, wx, "id", ["timestamp_utc", "weather_id"]).collect()}
    # 20 minutes off is taken, 41 is not, the earlier of two near rows is nearer, other cities stay
    assert out == {1: 1.0, 2: None, 3: 3.0, 4: None}
    tie = spark.createDataFrame([(9, "Delhi", at(1205))], "id int, city string, timestamp_utc timestamp")
    both = spark.createDataFrame([(1, "Delhi", at(1195), 5.0), (2, "Delhi", at(1215 + 50), 6.0)], "weather_id int, city string, timestamp_utc timestamp, temperature_2m double")
    assert weather_join.nearest_weather(tie, both, "id", ["weather_id"], 60).first()._near.temperature_2m == 5.0


def test_fill_limits(spark):
    values = [1.0, None, None, None, None, 6.0, None, None, None, None]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)], "city string, i int, x double")
    got = lambda m: [r.x for r in weather_join.fill_weather(df, ["x"], ["i"], m, 3, min_block=4).orderBy("i").collect()]
    s = pd.Series(values, dtype=float)
    same = lambda a, b: [None if pd.isna(v) else v for v in a] == [None if pd.isna(v) else v for v in b]
    assert same(got("ffill"), s.ffill(limit=3))
    assert same(got("bfill"), s.bfill(limit=3))
    assert same(got("interpolate"), s.interpolate(limit=3))


def test_haversine_delhi_mumbai(spark):
    km = spark.range(1).select(haversine_km(F.lit(28.6139), F.lit(77.2090), F.lit(19.0760), F.lit(72.8777))).first()[0]
    assert 1100 < km < 1200


def test_zone_change_kinds(spark):
    rows = [(None, "green_zone"), ("green_zone", "red_zone"), ("red_zone", "green_zone"), ("red_zone", "red_zone"), ("unknown_zone", "red_zone")]
    df = spark.createDataFrame(rows, "p string, c string")
    assert one(df, cohort.zone_change("p", "c")) == ["new", "degraded", "improved", "stable", "unknown"]


def test_perfect_predictions(spark):
    df = spark.createDataFrame([("A", 1, float(i), float(i)) for i in range(1, 20)], "city string, forecast_horizon_hours int, actual_aqi double, predicted_aqi double")
    m = accuracy.metrics(df).where("scope = 'overall'").first()
    assert m.mae == 0 and m.r_squared == 1 and m.category_accuracy == 100 and m.median_bias == 0


def test_errors_beyond_the_bins_are_kept(spark):
    df = spark.createDataFrame([(0.0, 700.0), (0.0, 5.0)], "actual_aqi double, predicted_aqi double")
    out = {r.error_bin: r["count"] for r in accuracy.error_distribution(df).collect()}
    assert out[None] == 1 and out["0:10"] == 1 and len(out) == 13


def test_sample_moments(spark):
    values = [1.0, 2.0, 2.0, 3.0, 9.0, 4.0, 4.0, 7.0, 1.0, 0.0, 5.0]
    df = spark.createDataFrame([("p", v) for v in values], "parameter string, value double")
    row, s = quality.distribution(df).first(), pd.Series(values)
    assert row.skewness == pytest.approx(s.skew()) and row.kurtosis == pytest.approx(s.kurtosis())


def test_empty_data_fails_report(spark):
    empty = spark.createDataFrame([], "x int")
    row = quality.check_not_empty(empty).first()
    assert not row.passed and row.severity == "critical"


def stations(spark, spots):
    return spark.createDataFrame([("C", f"S{i:03d}", lat, lon, 250.0, 300.0) for i, (lat, lon) in enumerate(spots)],
                                 "city string, location string, latitude double, longitude double, avg_value double, max_value double")


def brute_dbscan(spots, eps, m):
    import math

    def km(a, b):
        la, lb = math.radians(a[0]), math.radians(b[0])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    near = [[j for j in range(len(spots)) if km(spots[i], spots[j]) <= eps] for i in range(len(spots))]
    core = [len(n) >= m for n in near]
    label, c = {}, 0
    for i in range(len(spots)):
        if not core[i] or i in label:
            continue
        queue = [i]
        while queue:
            k = queue.pop()
            for j in near[k]:
                if j not in label:
                    label[j] = c
                    if core[j]:
                        queue.append(j)
        c += 1
    return label


def test_dbscan_equals_brute_force(spark):
    import random

    random.seed(3)
    spots = [(28 + random.gauss(0, 0.25), 77 + random.gauss(0, 0.25)) for _ in range(60)]
    spots += [(60 + random.gauss(0, 0.1), 20 + random.gauss(0, 0.2)) for _ in range(20)] + [spots[0]] * 4
    # over the 180° meridian and around a pole
    spots += [(-17 + random.gauss(0, 0.1), (random.gauss(0, 0.2) + 360) % 360 - 180) for _ in range(20)] + [(-17.0, 180.0), (-17.0, -180.0)]
    spots += [(90 - abs(random.gauss(0, 0.1)), random.uniform(-180, 180)) for _ in range(12)]
    got = {int(r.location[1:]): r.cluster for r in hotspot.dbscan(stations(spark, spots)).collect()}
    assert got == brute_dbscan(spots, 15.0, 3)


def test_weighted_average_orders():
    assert forecast.wma_weights(3) == [1 / 6, 2 / 6, 3 / 6]
    assert forecast.wma_weights(3, legacy=True) == [3 / 6, 2 / 6, 1 / 6]
    with pytest.raises(ValueError):
        forecast.wma_weights(3, weights=[1.0])


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    p = forecast.fit_scaler(df, ["a", "b"])
    back = forecast.unscale(forecast.scale(df, p, ["a", "b"]), p, ["a", "b"])
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_streak_can_break_on_missing_days(spark):
    from aqspark.operators.marts import unhealthy_streaks

    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("A", d, 250.0), ("A", d + dt.timedelta(3), 250.0)], "city string, reading_date date, daily_avg_aqi double")
    assert unhealthy_streaks(df).agg(F.max("consecutive_unhealthy")).first()[0] == 2
    assert unhealthy_streaks(df, break_on_gap=True).agg(F.max("consecutive_unhealthy")).first()[0] == 1


def test_equal_mean_shift_is_found_and_noise_is_not(spark):
    import numpy as np

    from aqspark.operators.drift import feature_drift

    rng = np.random.default_rng(0)
    frame = lambda m, n: spark.createDataFrame([(float(v),) for v in rng.normal(m, 30, n)], "aqi double")
    ref = frame(100, 500)
    assert feature_drift(ref, frame(150, 200), ["aqi"]).first().ks_drift_detected
    assert not feature_drift(ref, frame(102, 200), ["aqi"]).first().ks_drift_detected


def test_accuracy_alert_limits(spark):
    rows = [("A", 31.0, 0.0, 31.0), ("B", 10.0, -16.0, 10.0), ("C", 13.0, 1.0, 10.0), ("D", 30.0, 15.0, 25.0)]
    now = spark.createDataFrame(rows, "city string, mae double, bias double, baseline_mae double").withColumn("model_name", F.lit("m"))
    assert sorted((r.city, r.alert_type) for r in accuracy.accuracy_alerts(now).collect()) == [("A", "high_mae"), ("B", "high_bias"), ("C", "degradation")]


def test_row_count_has_no_upper_bound_by_default(spark):
    df = spark.createDataFrame([("A", 1.0, "aqi")], "city string, value double, parameter string")
    passed = lambda **k: {r.name: r.passed for r in quality.expectations(df, **k).collect()}["row_count"]
    assert passed() and passed(max_rows=1) and not passed(max_rows=0) and not passed(min_rows=2)


def test_series_keys_with_separators_differ(spark):
    from aqspark.operators.series import with_position

    df = spark.createDataFrame([("x\u0001=y", "z"), ("x", "y\u0001=z"), ("1:x", "y"), ("1", "x1:y")], "a string, b string")
    assert {r["_n"] for r in with_position(df, ["a", "b"], ["a"]).collect()} == {1}


def test_feature_set_moves_narrow_rows(spark):
    """The wide columns are made after the last shuffle."""
    import re

    from aqspark.operators import features as ft

    df = spark.createDataFrame([("a", "aqi", None, 1.0, 0.0)], "city string, parameter string, timestamp_utc timestamp, value double, precipitation double")
    out = ft.create_features(df, ["timestamp_utc"], median=False)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert out.count() == 1 and "value_roll_mean_168h" in out.columns
    top = min(m.start() for m in re.finditer("Join|Aggregate", plan))
    assert plan.index("value_roll_mean_168h") < top and "value_roll_mean_168h" not in plan[top:]
