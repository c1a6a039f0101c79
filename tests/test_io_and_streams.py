"""Parsers, readers and the stateful stream on small inputs."""

import datetime as dt
import json

from pyspark.sql import functions as F

from aqspark.sinks import rules
from aqspark.sources import documents as docs
from aqspark.streaming import cooldown, jobs

T0 = dt.datetime(2024, 1, 1)


def bodies(spark, *payloads):
    rows = [("Delhi", T0, json.dumps(p)) for p in payloads]
    return spark.createDataFrame(rows, "city string, fetched_at timestamp, body string")


def test_station_document_shapes(spark):
    out = docs.parse_stations(bodies(
        spark,
        {"stations": [{"stationName": "A", "aqi": "150", "pollutants": {"PM2.5": {"avg": 80.5}, "CO": 1.2, "Pb": {"value": "bad"}}}]},
        {"data": {"station": "B", "AQI": None, "parameters": {"Benzene": {"value": 3}}}},
        [{"station": "C", "AQI": 90}],
        {"stations": []},
    )).collect()
    got = {(r.location, r.parameter): (r.value, r.unit) for r in out}
    assert got == {
        ("A", "aqi"): (150.0, "NAQI"), ("A", "pm25"): (80.5, "µg/m³"), ("A", "co"): (1.2, "mg/m³"), ("A", "pb"): (None, "µg/m³"),
        ("B", "benzene"): (3.0, "µg/m³"), ("C", "aqi"): (90.0, "NAQI"),
    }


def test_html_rows_and_json(spark):
    table = '<table><tr class="x"><td>Anand Vihar</td><td>312</td></tr><tr><td>ITO</td><td>200</td></tr></table>'
    script = 'var aqiData = [{"stationName": "RK Puram", "aqi": "88"}];' + table
    df = spark.createDataFrame([(1, table), (2, script)], "id int, html string")
    rows = docs.parse_html(df, "id").collect()
    got = sorted((r.id, r.location, r.value) for r in rows)
    assert got == [(1, "Anand Vihar", 312.0), (1, "ITO", 200.0), (2, "RK Puram", 88.0)]


def test_empty_page(spark):
    assert docs.parse_measurements(bodies(spark, {"results": [], "meta": {"found": 0}})).count() == 0


def test_local_weather_time_becomes_utc(spark):
    body = json.dumps({"hourly": {"time": ["2024-01-01T05:30"], "temperature_2m": ["x"], "precipitation": [1.5]}})
    df = spark.createDataFrame([(28.6, 77.2, body)], "latitude double, longitude double, body string")
    r = docs.parse_hourly_weather(df, ["temperature_2m", "precipitation"]).first()
    assert (r.timestamp_utc, r.temperature_2m, r.precipitation) == (T0, None, 1.5)


def test_latest_csv(spark, tmp_path):
    for name, v in (("aqi_20240101.csv", 1), ("aqi_20240102.csv", 2), ("weather_20240103.csv", 3)):
        (tmp_path / name).write_text(f"city,value\nDelhi,{v}\n")
    out = docs.read_latest_csv(spark, str(tmp_path), "city string, value double", "aqi")
    assert [r.value for r in out.collect()] == [2.0]


def test_rules_pass_null(spark):
    df = spark.createDataFrame([(None, "pm25"), (-1.0, "pm25"), (1.0, "xyz")], "value double, parameter string")
    good, bad = rules.split_valid(df, rules.READING_RULES)
    assert good.count() == 1 and sorted(r.violations[0] for r in bad.collect()) == ["valid_aqi_value", "valid_parameter"]


def test_sessions_split_after_gap(spark):
    at = [0, 60, 239, 420]  # minutes: the last row comes 181 minutes after the one before
    df = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m)) for m in at], "city string, timestamp_utc timestamp")
    assert sorted(r.rows for r in jobs.sessions(df, ["city"]).collect()) == [1, 3]


def test_cooldown_over_many_batches(spark, tmp_path):
    import random

    random.seed(1)
    schema = "city string, parameter string, value double, timestamp_utc timestamp"
    minutes = sorted(random.sample(range(3000), 400))
    rows = [("Delhi", "aqi", random.choice([90.0, 160.0, 320.0]), T0 + dt.timedelta(minutes=m)) for m in minutes]
    for i in range(4):  # four files in time order, one per batch
        part = spark.createDataFrame(rows[i * 100:(i + 1) * 100], schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame(
        [(1, 1, "AQI>150", "Delhi", "hourly", "email", True), (2, 2, "AQI>150", "Delhi", "hourly", "sms", True), (3, 1, "AQI>300", "Delhi", "daily", "push", True)],
        "subscription_id int, user_id int, condition string, location string, frequency string, channel string, active boolean",
    ).withColumn("created_at", F.lit(T0))
    users = spark.createDataFrame([(1, False), (2, True)], "user_id int, is_suspended boolean")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = jobs.read_stream(spark, str(tmp_path / "in"), schema, maxFilesPerTrigger=1)
    fired = cooldown.triggers(cooldown.exceeding(stream, cooldown.alert_rules(subs)))
    jobs.write_available(fired, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    alerts = spark.read.parquet(str(tmp_path / "out"))

    def brute(threshold, wait):
        out, last = [], None
        for _, _, v, ts in rows:
            if v > threshold and (last is None or ts - last >= wait):
                out.append(ts)
                last = ts
        return out

    got = lambda c: sorted(r.triggered_at for r in alerts.where(F.col("condition") == c).collect())
    assert got("AQI>150") == brute(150, dt.timedelta(hours=1))
    assert got("AQI>300") == brute(300, dt.timedelta(days=1))
    sent = cooldown.to_subscribers(alerts, subs, users)
    assert {r.subscription_id for r in sent.collect()} == {1, 3}


def test_better_source_of_a_later_batch_wins(spark, tmp_path):
    schema = "reading_id int, city string, location string, parameter string, value double, timestamp_utc timestamp, source string"
    row = lambda i, source, day=0: (i, "Delhi", "S", "aqi", float(i), T0 + dt.timedelta(days=day), source)
    write = jobs.priority_batch_writer(str(tmp_path / "best"), "reading_id")
    write(spark.createDataFrame([row(1, "openaq"), row(2, "openaq", 1)], schema), 0)
    for _ in range(2):  # a batch may run again
        write(spark.createDataFrame([row(3, "cpcb"), row(4, "manual", 1), row(5, "manual", 2)], schema), 1)
    assert sorted(r.reading_id for r in spark.read.parquet(str(tmp_path / "best")).collect()) == [2, 3, 5]


def test_stored_rows_without_a_time_stay(spark, tmp_path):
    schema = "reading_id bigint, city string, location string, parameter string, timestamp_utc timestamp, source string"
    write = jobs.priority_batch_writer(str(tmp_path / "best"), "reading_id")
    for k, places in enumerate((["a", "b"], ["b", "c"])):
        write(spark.createDataFrame([(10 * k + n, "Delhi", p, "pm25", None, "cpcb") for n, p in enumerate(places)], schema), k)
    assert sorted((r.location, r.reading_id) for r in spark.read.parquet(str(tmp_path / "best")).collect()) == [("a", 0), ("b", 1), ("c", 11)]


def test_alerts_start_with_the_subscription(spark):
    alerts = spark.createDataFrame([("Delhi", "AQI>1", "daily", T0 + dt.timedelta(days=d)) for d in (0, 2)], "location string, condition string, frequency string, triggered_at timestamp")
    subs = spark.createDataFrame([(1, 1, "AQI>1", "Delhi", "daily", "sms", True, T0 + dt.timedelta(days=1))],
                                 "subscription_id int, user_id int, condition string, location string, frequency string, channel string, active boolean, created_at timestamp")
    users = spark.createDataFrame([(1, False)], "user_id int, is_suspended boolean")
    assert [r.triggered_at for r in cooldown.to_subscribers(alerts, subs, users).collect()] == [T0 + dt.timedelta(days=2)]


def test_default_row_pattern(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>Anand Vihar</td><td>312</td></tr><tr><td class=x>ITO, Delhi</td><td>note</td><td>5</td></tr></table>")], "id int, html string")
    assert [(r.location, r.value) for r in docs.parse_html(df, "id").collect()] == [("Anand Vihar", 312.0), ("ITO, Delhi", 5.0)]


def test_subscribers_of_one_rule_are_spread_over_tasks(spark):
    alerts = spark.createDataFrame([("Delhi", "AQI>1", "daily", T0 + dt.timedelta(days=d)) for d in range(20)], "location string, condition string, frequency string, triggered_at timestamp")
    # one file, one rule; every third subscription is null, one comes twice, and one is of a rule that never fires
    ids = [*(None if n % 3 == 0 else n for n in range(300)), 1, 7]
    subs = spark.createDataFrame([(n, k % 40, "AQI>9" if n == 7 and k > 299 else "AQI>1", "Delhi", "daily", "sms", True, T0 + dt.timedelta(days=k % 20)) for k, n in enumerate(ids)],
                                 "subscription_id int, user_id int, condition string, location string, frequency string, channel string, active boolean, created_at timestamp").coalesce(1)
    users = spark.createDataFrame([(n, n == 5) for n in range(40)], "user_id int, is_suspended boolean")
    expected = sorted((-1 if n is None else n, k % 40, T0 + dt.timedelta(days=d)) for k, n in enumerate(ids[:301]) if k % 40 != 5 for d in range(k % 20, 20))
    out = cooldown.to_subscribers(alerts, subs, users, part_rows=500)
    assert sorted((-1 if r.subscription_id is None else r.subscription_id, r.user_id, r.triggered_at) for r in out.collect()) == expected
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < len(expected) / 2


def test_cooldown_of_copies_and_rows_without_a_time(spark):
    schema = "location string, condition string, frequency string, timestamp_utc timestamp, current_value double, threshold double, cooldown long"
    at = [None, 30, 0, 0, 60, 59, 119, 120, None]  # minutes
    rows = [("A", "AQI>1", "hourly", m if m is None else T0 + dt.timedelta(minutes=m), 9.0 - k, 1.0, 3600) for k, m in enumerate(at)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    fired = cooldown.triggers(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.triggered_at, r.current_value) for r in fired) == [(T0, 6.0), (T0 + dt.timedelta(hours=1), 5.0), (T0 + dt.timedelta(hours=2), 2.0)]
