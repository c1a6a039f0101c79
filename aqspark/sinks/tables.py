"""Tables, documents, exports and feature files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.operators import rollup
from aqspark.operators.clean import nan_to_null
from aqspark.session import settle


def append_table(df: DataFrame, table: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append").format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    df.write.jdbc(url, table, mode="append", properties=properties or {})


def write_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON documents; NaN is written as an absent value."""
    nan_to_null(df).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_rollups(readings: DataFrame, path: str) -> dict[str, Callable[[], DataFrame]]:
    """All six rollup outputs as CSV with a header. Summaries are made from the daily table once it is written.

    The readings are read once: what the rollups use of them is stored first.
    """
    spark = readings.sparkSession
    used = ["city", "parameter", "value", "timestamp_utc", *(c for c in dims.WEATHER_COLUMNS if c in readings.columns)]
    rows = settle(readings.select(*used))

    def export(name: str, df: DataFrame) -> Callable[[], DataFrame]:
        write_csv(df, f"{path}/{name}")
        return lambda: spark.read.schema(df.schema).option("header", True).csv(f"{path}/{name}")

    out = {period: export(period, rollup.rollup(rows, period)) for period in ("hour", "day", "week", "month")}
    out["city_daily"] = export("city_daily", rollup.city_daily_summary(out["day"]()))
    out["exceedance"] = export("exceedance", rollup.exceedance_days(out["day"]()))
    return out


def save_features(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_features(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def append_checks(checks: DataFrame, path: str, dataset: str, checked_at) -> None:
    """Check rows appended to the results table the quality panel reads."""
    checks.select(
        F.lit(dataset).alias("dataset_name"), F.col("name").alias("check_name"), "passed", "severity", "details",
        checked_at.alias("timestamp"),
    ).write.mode("append").parquet(path)
