"""Streaming queries: the events, landed as files of four time ranges, as a stream of four batches."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.operators import quality
from aqspark.plans.cleaning import _PRIO, TWO_FEEDS, two_feeds
from aqspark.plans.dashboards import ERROR_LOG, error_log
from aqspark.plans.files import work_path
from aqspark.plans.marts import rounded
from aqspark.plans.registry import query
from aqspark.plans.tables import AS_OF, EVENT_SCHEMA, Tables, as_of
from aqspark.session import settle
from aqspark.streaming import cooldown, jobs

BATCHES, LANDED_FILES = 4, 4
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StreamTables(Tables):
    """The same tables over a stream of the event file."""

    def raw(self, name: str) -> DataFrame:
        if name != "events":
            return super().raw(name)
        return jobs.read_stream(self.spark, self.landed, EVENT_SCHEMA, maxFilesPerTrigger=LANDED_FILES)

    def batch(self, even: Column) -> Column:
        """The batch that an event is landed in, of those of equal spans of time."""
        return even

    @cached_property
    def landed(self) -> str:
        """All events, landed range by range in order of time, ``LANDED_FILES`` files for each range."""
        path = f"{work_path(self)}/landed"
        events = super().raw("events")
        first, last = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
        batch = self.batch(F.least(F.lit(BATCHES - 1), F.floor((F.unix_micros("ts") - first) * BATCHES / max(last - first, 1))))
        for k in range(BATCHES):
            events.where(batch == k).repartition(LANDED_FILES).write.mode("append").parquet(path)
        return path


class LateTables(StreamTables):
    """Every seventh event is landed a batch after its time."""

    def batch(self, even: Column) -> Column:
        return F.least(F.lit(BATCHES - 1), even + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))


def stream(t) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


def finish(t, df: DataFrame) -> DataFrame:
    """Run the stream over everything present and read what it wrote."""
    path = work_path(t)
    q = jobs.write_available(df, f"{path}/out", f"{path}/state")
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{path}/out")


@query("t01_ingest_stream", "SELECT reading_id, city, parameter, value, timestamp_utc, 'landed' AS source, CAST(timestamp_utc AS DATE) AS ingest_date FROM readings")
def ingest(t):
    rows = stream(t).readings.select("reading_id", "city", "parameter", "value", "timestamp_utc")
    return finish(t, jobs.ingest(rows, "landed"))


def _closed(unit: str) -> str:
    return f"""SELECT city, parameter, date_trunc('{unit}', timestamp_utc) AS window_start, date_trunc('{unit}', timestamp_utc) + INTERVAL 1 {unit} AS window_end,
  round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, count(value) AS value_count
FROM readings WHERE date_trunc('{unit}', timestamp_utc) + INTERVAL 1 {unit} <= (SELECT max(timestamp_utc) - INTERVAL 2 HOUR FROM readings) GROUP BY 1, 2, 3"""


@query("t02_hourly_rollup_stream", _closed("hour"))
def hourly(t):
    return rounded(finish(t, jobs.rollup_stream(stream(t).readings)))


@query("t02_daily_rollup_stream", _closed("day"))
def daily(t):
    return rounded(finish(t, jobs.rollup_stream(stream(t).readings, "1 day")))


@query("t02_late_rows_merged", _closed("hour"))
def late_merged(t):
    """The rollup of a stream with late rows, once the windows of its side table are renewed."""
    late, path = LateTables(t.spark, t.sf_dir), work_path(t)
    rolled = finish(t, jobs.rollup_stream(late.readings))
    q = late.readings.writeStream.foreachBatch(jobs.late_batch_writer(path)).option("checkpointLocation", f"{path}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    side = t.spark.read.schema(t.readings.schema).parquet(f"{path}/late")
    merged = jobs.merge_late(rolled, side, t.readings)
    # windows still open at the end of the stream are not yet due
    edge = t.readings.agg(F.max("timestamp_utc") - F.expr("INTERVAL 2 HOURS")).scalar()
    return rounded(merged.where(F.col("window_end") <= edge))


@query("t03_sliding_unhealthy_hours", """
h AS (SELECT city, parameter, value, date_trunc('hour', timestamp_utc) AS hb FROM readings),
s AS (SELECT city, parameter, value, hb - to_hours(CAST(g AS INTEGER)) AS window_start FROM h, generate_series(0, 23) q(g))
SELECT city, parameter, window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) FILTER (WHERE value > 200) AS unhealthy_hours,
  count(*) FILTER (WHERE value > 300) AS very_poor_hours, count(*) FILTER (WHERE value > 400) AS severe_hours, count(*) AS total_hours FROM s GROUP BY 1, 2, 3""")
def sliding(t):
    return jobs.sliding_unhealthy_hours(t.readings)


@query("t03_sliding_stream", """
h AS (SELECT city, parameter, value, date_trunc('hour', timestamp_utc) AS hb FROM readings),
s AS (SELECT city, parameter, value, hb - to_hours(CAST(g AS INTEGER)) AS window_start FROM h, generate_series(0, 23) q(g))
SELECT city, parameter, window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) FILTER (WHERE value > 200) AS unhealthy_hours,
  count(*) FILTER (WHERE value > 300) AS very_poor_hours, count(*) FILTER (WHERE value > 400) AS severe_hours, count(*) AS total_hours FROM s
WHERE window_start + INTERVAL 24 HOUR <= (SELECT max(timestamp_utc) - INTERVAL 2 HOUR FROM readings) GROUP BY 1, 2, 3""")
def sliding_stream(t):
    out = finish(t, jobs.sliding_stream(stream(t).readings))
    return out.select("city", "parameter", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "unhealthy_hours", "very_poor_hours", "severe_hours", "total_hours")


@query("t04_deduplicate_stream", "SELECT DISTINCT city, location, parameter, timestamp_utc, value FROM readings")
def deduplicate(t):
    rows = two_feeds(stream(t)).select("city", "location", "parameter", "timestamp_utc", "value")
    return finish(t, jobs.deduplicate_stream(rows))


@query("t04_source_priority_batches", TWO_FEEDS + f"""
SELECT reading_id, city, location, parameter, timestamp_utc, value, source FROM (SELECT *, row_number() OVER (
  PARTITION BY city, location, parameter, timestamp_utc ORDER BY {_PRIO}, coalesce(source, ''), reading_id) AS rn FROM feeds) WHERE rn = 1""")
def priority(t):
    path = work_path(t)
    cols = ["reading_id", "city", "location", "parameter", "timestamp_utc", "value", "source"]
    write = jobs.priority_batch_writer(f"{path}/out", "reading_id")
    q = two_feeds(stream(t)).select(*cols).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select(*cols)


@query("t05_alert_cooldown", """
ru AS (SELECT DISTINCT location, condition, frequency, lower(split_part(condition, '>', 1)) AS p, CAST(split_part(condition, '>', 2) AS DOUBLE) AS threshold,
  CASE frequency WHEN 'realtime' THEN 900 WHEN 'hourly' THEN 3600 ELSE 86400 END * CAST(1000000 AS BIGINT) AS wait FROM subscriptions WHERE active),
ex AS (SELECT ru.location, condition, frequency, threshold, wait, epoch_us(timestamp_utc) AS us, min(value) AS current_value
  FROM ru JOIN readings r ON r.city = ru.location AND r.parameter = ru.p AND r.value > ru.threshold GROUP BY ALL),
po AS (SELECT *, min(us) OVER (PARTITION BY location, condition, frequency ORDER BY us RANGE BETWEEN wait FOLLOWING AND UNBOUNDED FOLLOWING) AS follows FROM ex),
fired AS (SELECT location, condition, frequency, min(us) AS us FROM ex GROUP BY 1, 2, 3
  UNION ALL SELECT location, condition, frequency, po.follows FROM fired JOIN po USING (location, condition, frequency, us) WHERE po.follows IS NOT NULL)
SELECT location, condition, frequency, make_timestamp(us) AS triggered_at, round(current_value, 6) AS current_value, threshold, subscription_id, user_id, channel
FROM fired JOIN ex USING (location, condition, frequency, us) JOIN (SELECT * FROM subscriptions WHERE active) s USING (location, condition, frequency)
WHERE s.created_at <= make_timestamp(us) AND user_id IN (SELECT user_id FROM users WHERE NOT is_suspended)""")
def alerts(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rules = settle(cooldown.alert_rules(t.subscriptions))  # each batch reads them
    fired = finish(t, cooldown.triggers(cooldown.exceeding(stream(t).readings, rules)))
    return rounded(cooldown.to_subscribers(fired, t.subscriptions, t.users))


SESSIONS = """o AS (SELECT city, timestamp_utc, epoch_us(timestamp_utc) - epoch_us(lag(timestamp_utc) OVER w) < 10800000000 AS joined FROM {src} WINDOW w AS (PARTITION BY city ORDER BY timestamp_utc, reading_id)),
n AS (SELECT city, timestamp_utc, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY city ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT city, min(timestamp_utc) AS session_start, max(timestamp_utc) AS last_row, count(*) AS rows FROM n GROUP BY city, sid"""


@query("t06_pollution_episodes", SESSIONS.format(src="(SELECT * FROM readings WHERE parameter IN ('aqi', 'pm25') AND value > 200)"))
def pollution_sessions(t):
    poor = t.readings.where(F.col("parameter").isin("aqi", "pm25") & (F.col("value") > 200))
    return jobs.sessions(poor, ["city"]).drop("session_id")


@query("t06_reporting_sessions", SESSIONS.format(src="readings"))
def reporting_sessions(t):
    return jobs.sessions(t.readings, ["city"]).drop("session_id")


@query("t06_session_stream", """
poor AS (SELECT reading_id, city, timestamp_utc FROM readings WHERE parameter IN ('aqi', 'pm25') AND value > 200),
o AS (SELECT *, timestamp_utc - lag(timestamp_utc) OVER (PARTITION BY city ORDER BY timestamp_utc, reading_id) < INTERVAL 3 HOUR AS joined FROM poor),
n AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY city ORDER BY timestamp_utc, reading_id) AS number FROM o),
c AS (SELECT city, min(timestamp_utc) AS session_start, max(timestamp_utc) + INTERVAL 3 HOUR AS session_end, count(*) AS rows FROM n GROUP BY city, number)
SELECT * FROM c WHERE session_end <= (SELECT max(timestamp_utc) - INTERVAL 2 HOUR FROM poor)""")
def session_stream(t):
    poor = stream(t).readings.where(F.col("parameter").isin("aqi", "pm25") & (F.col("value") > 200))
    return finish(t, jobs.session_stream(poor, ["city"]))


@query("t07_feed_health", ERROR_LOG + f""",
h AS (SELECT (SELECT (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(timestamp_utc))) / 36e8 FROM readings) < 1 AS r,
  (SELECT (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(timestamp_utc))) / 36e8 FROM weather) < 2 AS w,
  (SELECT count(*) FROM el WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS e)
SELECT CASE WHEN NOT r AND NOT w THEN 'unhealthy' WHEN e > 0 THEN 'degraded' ELSE 'healthy' END AS status, r AS aqi_ingestion_fresh, w AS weather_ingestion_fresh,
  (SELECT count(*) FROM readings) AS total_aqi_records, (SELECT count(*) FROM weather) AS total_weather_records, e AS recent_errors_24h, (SELECT count(*) FROM el) AS total_errors FROM h""")
def feed_health(t):
    return jobs.feed_health(t.readings, t.weather, error_log(t), as_of())


@query("t08_late_actuals_stream", """
v AS (SELECT city, timestamp_utc, value, reading_id FROM readings WHERE quality_flag = 'valid'),
a AS (SELECT city, timestamp_utc, arg_max(value, reading_id) AS actual_value FROM v GROUP BY 1, 2)
SELECT f.forecast_id, f.city, f.timestamp_utc AS target_ts, round(f.predicted_aqi, 6) AS predicted_aqi, round(a.actual_value, 6) AS actual_value
FROM forecasts f LEFT JOIN a USING (city, timestamp_utc)
WHERE f.timestamp_utc < (SELECT least((SELECT max(timestamp_utc) FROM forecasts), (SELECT max(timestamp_utc) FROM v)) - INTERVAL 2 HOUR)""")
def late_actuals(t):
    s = stream(t)
    f = s.forecasts.select("forecast_id", "city", F.col("timestamp_utc").alias("target_ts"), "predicted_aqi")
    a = s.readings.where(F.col("quality_flag") == "valid").select("city", "timestamp_utc", "value", "reading_id")
    # every landing comes a second time, as sources that are polled again send it
    return rounded(finish(t, jobs.attach_actuals_stream(f, a.unionByName(a), "reading_id")))


@query("t09_checks_per_batch", """
b AS (SELECT *, least(3, CAST(floor((epoch_us(timestamp_utc) - (SELECT epoch_us(min(timestamp_utc)) FROM readings)) * 4.0e0
    / (SELECT epoch_us(max(timestamp_utc)) - epoch_us(min(timestamp_utc)) FROM readings)) AS INTEGER)) AS batch FROM readings),
c AS (SELECT batch, (round(count(city) / count(*), 4) + round(count(parameter) / count(*), 4) + round(count(value) / count(*), 4)
    + round(count(timestamp_utc) / count(*), 4)) / 4 >= 95e-2 AS ok FROM b GROUP BY batch),
u AS (SELECT batch, sum(n - 1) / sum(n) <= 1e-2 AS ok FROM (SELECT batch, count(*) AS n FROM b GROUP BY batch, city, location, parameter, timestamp_utc) GROUP BY batch)
SELECT 'completeness' AS name, ok AS passed, CASE WHEN ok THEN 'info' ELSE 'critical' END AS severity, 'readings' AS dataset_name, batch FROM c
UNION ALL SELECT 'uniqueness', ok, CASE WHEN ok THEN 'info' ELSE 'warning' END, 'readings', batch FROM u""")
def batch_checks(t):
    path = work_path(t)
    checks = lambda b: quality.check_completeness(b).unionByName(quality.check_uniqueness(b))
    write = jobs.check_batch_writer(f"{path}/out", "readings", checks)
    q = stream(t).readings.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select("name", "passed", "severity", "dataset_name", "batch")
