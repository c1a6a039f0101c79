"""Stream transformations. Each also runs on a batch frame unless it keeps state.

Late rows: windows close two hours after their end, the freshness limit of the
quality checks. Rows later than that go to a side table (``late_batch_writer``),
and ``merge_late`` renews the windows they belong to.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aqspark.functions.bins import flag
from aqspark.operators.clean import READING_KEY, source_priority
from aqspark.session import settle

WATERMARK = "2 hours"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """Stream over landed files; the schema is given, never inferred."""
    reader = spark.readStream.format(fmt).schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all files present, then stop; the checkpoint remembers where it got to."""
    return (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest(df: DataFrame, source: str) -> DataFrame:
    """Tag rows with their source and date for a partitioned landing table."""
    return df.withColumns({"source": F.lit(source), "ingest_date": F.to_date("timestamp_utc")})


def window_statistics(df: DataFrame, length: str) -> DataFrame:
    return (
        df.groupBy(F.window("timestamp_utc", length).alias("w"), "city", "parameter")
        .agg(
            F.avg("value").alias("value_mean"),
            F.stddev_samp("value").alias("value_std"),
            F.min("value").alias("value_min"),
            F.max("value").alias("value_max"),
            F.count("value").alias("value_count"),
        )
        .select("city", "parameter", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "value_mean", "value_std", "value_min", "value_max", "value_count")
    )


def rollup_stream(df: DataFrame, length: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Tumbling rollup by city and parameter; all aggregates combine map-side."""
    return window_statistics(df.withWatermark("timestamp_utc", watermark), length)


def sliding_unhealthy_hours(df: DataFrame, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Counts over 200/300/400 in each sliding window.

    Rows are first counted per slide-wide bucket, so only those counts are
    copied into the overlapping windows.
    """
    v = F.col("value")
    buckets = df.groupBy("city", "parameter", F.window("timestamp_utc", slide).alias("b")).agg(
        F.count_if(v > 200).alias("u"), F.count_if(v > 300).alias("p"), F.count_if(v > 400).alias("s"), F.count(F.lit(1)).alias("n")
    )
    out = buckets.groupBy("city", "parameter", F.window(F.col("b.start"), length, slide).alias("w")).agg(
        F.sum("u").alias("unhealthy_hours"), F.sum("p").alias("very_poor_hours"), F.sum("s").alias("severe_hours"), F.sum("n").alias("total_hours")
    )
    return out.select("city", "parameter", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "unhealthy_hours", "very_poor_hours", "severe_hours", "total_hours")


def sliding_stream(df: DataFrame, length: str = "24 hours", slide: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Counts over 200/300/400 in each sliding window, closed by the watermark.

    Two aggregations in one stream: rows are counted per slide-wide window, and
    only those counts, once closed, go into the overlapping windows. State holds
    counts per slide, whatever the number of rows.
    """
    v = F.col("value")
    n = {"unhealthy_hours": v > 200, "very_poor_hours": v > 300, "severe_hours": v > 400, "total_hours": F.lit(True)}
    counts = df.withWatermark("timestamp_utc", watermark).groupBy(F.window("timestamp_utc", slide).alias("b"), "city", "parameter").agg(
        *(F.count_if(cond).alias(c) for c, cond in n.items())
    )
    at = F.window_time("b").alias("_at")
    return counts.select("city", "parameter", at, *n).groupBy(F.window("_at", length, slide).alias("w"), "city", "parameter").agg(
        *(F.sum(c).alias(c) for c in n)
    )


def deduplicate_stream(df: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """First copy of each reading key; state is dropped once the watermark passes it."""
    return df.withWatermark("timestamp_utc", watermark).dropDuplicatesWithinWatermark(READING_KEY)


def priority_batch_writer(path: str, tiebreak: str, ts: str = "timestamp_utc") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that keeps the best source per key over all batches.

    The table is partitioned by day. A batch's rows are reduced together with
    the stored rows of its days, and those days are written again. The reduced
    rows are stored first, so nothing is overwritten while it is read, and a
    batch that runs twice leaves the same table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("event_date", F.to_date(ts))
        try:
            old = batch.sparkSession.read.schema(rows.schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            days = rows.select(F.col("event_date").alias("_day")).distinct()
            # rows without a time have a day of their own, the null one
            rows = rows.unionByName(old.join(days, old["event_date"].eqNullSafe(days["_day"]), "left_semi"))
        best = F.min_by(F.struct(*rows.columns), F.struct(source_priority(), F.coalesce("source", F.lit("")), tiebreak))
        kept = settle(rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in READING_KEY]).agg(best.alias("_b")).select("_b.*"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)

    return write


def late_batch_writer(path: str, hours: int = 2, ts: str = "timestamp_utc") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the rows that come behind the watermark.

    The watermark of a batch is the newest time of the batches before it, less
    ``hours``, as a stream over the same files has it. Each batch has a folder
    for its late rows and one for its newest time, so a batch that runs again
    replaces itself. A row whose window is still open may be among the late
    ones; renewing that window changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
        edge = spark.read.parquet(f"{path}/newest").where(F.col("batch") < batch_id).agg(F.max("newest")).scalar()
        late = batch.where(F.col(ts) < edge - F.expr(f"INTERVAL {hours} HOURS"))
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")

    return write


def merge_late(rolled: DataFrame, late: DataFrame, rows: DataFrame, length: str = "1 hour") -> DataFrame:
    """Rollup rows in which every window that has a late row is made anew from ``rows``; the others stay as they are.

    Late rows name the windows; those are few, and only their rows are read
    into an aggregation. A window that had on-time rows only is not touched.
    """
    keys = ["city", "parameter", "window_start"]
    start = F.window("timestamp_utc", length)["start"]
    touched = late.select("city", "parameter", start.alias("window_start")).distinct()
    placed = rows.withColumn("window_start", start)
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    anew = window_statistics(placed.join(touched, same(placed, touched), "left_semi"), length)
    kept = rolled.join(touched, same(rolled, touched), "left_anti")
    return kept.unionByName(anew)


def check_batch_writer(path: str, dataset: str, checks: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the quality rows of each batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        stored = batch.persist()
        try:
            rows = checks(stored).withColumn("dataset_name", F.lit(dataset))
            # one folder per batch, so a batch run again after a failure replaces itself
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            stored.unpersist()

    return write


def sessions(df: DataFrame, keys: list[str], gap_hours: int = 3, ts: str = "timestamp_utc") -> DataFrame:
    """Sessions separated by more than ``gap_hours`` without a row.

    Rows of one hour can never be in two sessions, so they collapse to one row
    per key and hour first; a key's window is then bounded by the calendar.
    """
    if gap_hours < 1:
        raise ValueError("gap must be at least an hour")
    hours = df.groupBy(*keys, F.date_trunc("hour", ts).alias("_h")).agg(
        F.min(ts).alias("_a"), F.max(ts).alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    w = Window.partitionBy(*keys).orderBy("_h")
    idle = F.unix_micros("_a") - F.unix_micros(F.lag("_b").over(w))
    started = F.when(idle < gap_hours * 3_600_000_000, 0).otherwise(1)
    numbered = hours.withColumn("_new", started).withColumn("session_id", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "session_id").agg(
        F.min("_a").alias("session_start"), F.max("_b").alias("last_row"), F.sum("_n").alias("rows")
    )


def session_stream(df: DataFrame, keys: list[str], gap: str = "3 hours", watermark: str = WATERMARK) -> DataFrame:
    grouped = df.withWatermark("timestamp_utc", watermark).groupBy(*keys, F.session_window("timestamp_utc", gap).alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("rows")).select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "rows")


def feed_health(readings: DataFrame, weather: DataFrame, errors: DataFrame, as_of: Column) -> DataFrame:
    """Fresh within an hour (readings) and two (weather); degraded on errors in the last day."""
    age = lambda c: (F.unix_micros(as_of) - F.unix_micros(F.max(c))) / F.lit(3_600_000_000.0)
    recent = F.col("timestamp") >= as_of - F.expr("INTERVAL 24 HOURS")
    base = readings.agg(age("timestamp_utc").alias("_r"), F.count(F.lit(1)).alias("total_aqi_records"))
    w = weather.agg(F.struct(age("timestamp_utc").alias("age"), F.count(F.lit(1)).alias("n"))).scalar()
    e = errors.agg(F.struct(F.sum(flag(recent)).cast("long").alias("recent"), F.count(F.lit(1)).alias("n"))).scalar()
    out = base.select("_r", "total_aqi_records", w.alias("_w"), e.alias("_e"))
    aqi_ok, weather_ok = F.coalesce(F.col("_r") < 1, F.lit(False)), F.coalesce(F.col("_w.age") < 2, F.lit(False))
    errors_24h = F.coalesce(F.col("_e.recent"), F.lit(0))
    status = F.when(~aqi_ok & ~weather_ok, "unhealthy").when(errors_24h > 0, "degraded").otherwise("healthy")
    return out.select(
        status.alias("status"), aqi_ok.alias("aqi_ingestion_fresh"), weather_ok.alias("weather_ingestion_fresh"),
        "total_aqi_records", F.col("_w.n").alias("total_weather_records"), errors_24h.alias("recent_errors_24h"),
        F.col("_e.n").alias("total_errors"),
    )


def attach_actuals_stream(forecasts: DataFrame, actuals: DataFrame, version: str, within: str = "2 hours") -> DataFrame:
    """Forecasts with the newest actual of their city and time, or null once none can come.

    Actuals are reduced to the one of the highest ``version`` per city and time
    before they are joined, so one that comes again, in the same or in a later
    batch, corrects the value and never repeats the forecast.
    """
    newest = actuals.withWatermark("timestamp_utc", within).groupBy("city", "timestamp_utc").agg(F.max_by("value", version).alias("value"))
    f = forecasts.withWatermark("target_ts", within).alias("f")
    a = newest.alias("a")
    cond = (F.col("f.city") == F.col("a.city")) & (F.col("f.target_ts") == F.col("a.timestamp_utc"))
    return f.join(a, cond, "left_outer").select("f.*", F.col("a.value").alias("actual_value"))
