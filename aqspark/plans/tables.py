"""Air-quality tables derived from the driver's parquet files.

The same mapping exists twice: as DataFrames for Spark and as CTEs for the SQL
twins. Values are scaled by a factor without a short decimal form, so rounding
a mean never meets an exact tie on which two engines could differ.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions.bins import lookup

AS_OF = "2024-01-31 00:00:00"
CITIES = list(dims.CITY_POPULATION_MILLIONS)
PARAMETER_OF = {"view": "pm25", "click": "pm10", "purchase": "aqi", "error": "no2", "signup": "so2"}
CONDITION_OF = {
    "BUILDING": "AQI>150", "AUTOMOBILE": "AQI>200", "MACHINERY": "PM25>150",
    "HOUSEHOLD": "PM10>150", "FURNITURE": "AQI>300",
}
FACTOR = 1.0471975511965976
HORIZONS = [1, 6, 12, 24, 48, 168]
MODELS = ["xgboost", "lstm", "prophet"]
FREQUENCIES = ["realtime", "hourly", "daily"]
CHANNELS = ["email", "push", "sms"]
STATION_TYPES = ["residential", "industrial", "traffic", "background"]


def nth(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# times are stored without a zone and are UTC; read as instants, filters on them reach the file
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(EVENT_SCHEMA) if name == "events" else self.spark.read
        return reader.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _events(self) -> DataFrame:
        e = self.raw("events")
        c = F.col("user_id") % 10
        value = F.col("value") * (F.lit(2.0) + F.lit(0.4) * c) * F.lit(FACTOR)
        return e.select(
            "event_id",
            "user_id",
            "event_type",
            "ts",
            F.col("value").alias("raw"),
            value.alias("value"),
            nth(CITIES, c).alias("city"),
            nth([dims.CITY_COORDINATES[n][0] for n in CITIES], c).alias("lat"),
            nth([dims.CITY_COORDINATES[n][1] for n in CITIES], c).alias("lon"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def readings(self) -> DataFrame:
        from aqspark.functions.index import cpcb_category, cpcb_pm25_index

        shift = ((F.col("user_id") % 7) - 3) * F.lit(0.02)
        base = self._events.select(
            F.col("event_id").alias("reading_id"),
            "city",
            F.concat(F.lit("ST-"), F.col("user_id")).alias("location"),
            F.lit("IN").alias("country"),
            lookup(PARAMETER_OF, "event_type").alias("parameter"),
            "value",
            F.lit("µg/m³").alias("unit"),
            F.col("ts").alias("timestamp_utc"),
            (F.col("lat") + shift).alias("latitude"),
            (F.col("lon") + shift).alias("longitude"),
            nth(["cpcb", "openaq", None], F.col("k") % 3).alias("source"),
            (F.col("k") != 99).alias("is_cleaned"),
            F.when(F.col("k") < 5, F.lit("suspect")).otherwise(F.lit("valid")).alias("quality_flag"),
            "k",
        )
        return base.withColumn(
            "aqi_category",
            F.when(F.col("parameter") == "aqi", cpcb_category("value")).when(
                F.col("parameter") == "pm25", cpcb_category(cpcb_pm25_index("value"))
            ),
        )

    @cached_property
    def weather(self) -> DataFrame:
        v = F.col("raw") * F.lit(FACTOR)
        return self._events.where(F.col("k") % 4 == 0).select(
            F.col("event_id").alias("weather_id"),
            "city",
            F.col("lat").alias("latitude"),
            F.col("lon").alias("longitude"),
            F.col("ts").alias("timestamp_utc"),
            (F.lit(5.0) + v % 35).alias("temperature_2m"),
            F.col("k").cast("double").alias("relative_humidity_2m"),
            (v % 15).alias("wind_speed_10m"),
            (F.col("event_id") % 360).cast("double").alias("wind_direction_10m"),
            F.when(F.col("k") < 30, v % 10).otherwise(F.lit(0.0)).alias("precipitation"),
            ((F.col("event_id") % 50) * 100).cast("double").alias("visibility"),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        return self._events.select(
            F.col("event_id").alias("forecast_id"),
            "city",
            nth(MODELS, F.col("user_id") % 3).alias("model_name"),
            nth(HORIZONS, F.col("user_id") % 6).alias("forecast_horizon_hours"),
            F.col("ts").alias("timestamp_utc"),
            F.col("value").alias("actual_aqi"),
            (F.col("value") + (F.col("k") - 50) * F.lit(0.6 * FACTOR)).alias("predicted_aqi"),
            "k",
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Forecasts of which some still wait for their actual value."""
        return self.forecasts.withColumn("actual_aqi", F.when(F.col("k") % 10 != 7, F.col("actual_aqi")))

    @cached_property
    def stations(self) -> DataFrame:
        u = F.col("user_id")
        shift = ((u % 7) - 3) * F.lit(0.02)
        return self._events.select("user_id", "city", "lat", "lon").distinct().select(
            F.concat(F.lit("ST-"), u).alias("location"),
            "city",
            (F.col("lat") + shift).alias("latitude"),
            (F.col("lon") + shift).alias("longitude"),
            nth(STATION_TYPES, u % 4).alias("station_type"),
            ((u % 11) != 0).alias("is_active"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("subscription_id"),
            (key % 700).alias("user_id"),
            lookup(CONDITION_OF, "c_mktsegment").alias("condition"),
            nth(CITIES, key % 10).alias("location"),
            nth(FREQUENCIES, key % 3).alias("frequency"),
            nth(CHANNELS, F.col("c_nationkey") % 3).alias("channel"),
            ((key % 5) != 0).alias("active"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((key % 31).cast("int"))).alias("created_at"),
        )

    @cached_property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("user_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
            F.when(key % 50 == 0, F.lit("admin")).otherwise(F.lit("user")).alias("role"),
            (F.col("c_acctbal") < 0).alias("is_suspended"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((key % 31).cast("int"))).alias("created_at"),
        )

    @cached_property
    def notifications(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("notification_id"),
            F.col("o_custkey").alias("user_id"),
            (F.col("o_orderstatus") == "F").alias("read"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def saved_locations(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("location_id"),
            (F.col("s_suppkey") * 7 % 100).alias("user_id"),
            nth(CITIES, F.col("s_suppkey") % 10).alias("name"),
        )


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}" for v in values) + "]"


def _case(mapping: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items()) + " END"


def sql_band_case(column: str, bands, default: str, above: str) -> str:
    arms = " ".join(f"WHEN {column} BETWEEN {lo} AND {hi} THEN {lab!r}" for lo, hi, lab in bands)
    return f"(CASE {arms} WHEN {column} > {bands[-1][1]} THEN {above!r} ELSE {default!r} END)"


def sql_cut_case(column: str, cuts, top, null_label=None) -> str:
    null_arm = f"WHEN {column} IS NULL THEN {null_label!r} " if null_label is not None else ""
    arms = " ".join(f"WHEN {column} <= {b} THEN {lab!r}" for b, lab in cuts)
    return f"(CASE {null_arm}{arms} ELSE {top!r} END)"


def sql_right_closed(column: str, bins) -> str:
    arms = " ".join(
        f"WHEN {column} > {lo} " + (f"AND {column} <= {hi} " if hi is not None else "") + f"THEN {lab!r}"
        for lo, hi, lab in bins
    )
    return f"(CASE {arms} END)"


def sql_piecewise(column: str, points, above: str = "NULL") -> str:
    arms = " ".join(
        f"WHEN {column} >= {a} AND {column} <= {b} THEN "
        f"CAST({(ihi - ilo) / (b - a)!r} AS DOUBLE) * ({column} - CAST({float(a)} AS DOUBLE)) + CAST({float(ilo)} AS DOUBLE)"
        for a, b, ilo, ihi in points
    )
    return f"(CASE {arms} WHEN {column} > {points[-1][1]} THEN {above} END)"


def sql_season(ts: str, late_label: str = "autumn") -> str:
    m = f"month({ts})"
    return (
        f"(CASE WHEN {m} IN (12,1,2) THEN 'winter' WHEN {m} IN (3,4,5) THEN 'spring' "
        f"WHEN {m} IN (6,7,8,9) THEN 'monsoon' ELSE '{late_label}' END)"
    )


_LAT = _list(f"CAST({dims.CITY_COORDINATES[n][0]} AS DOUBLE)" for n in CITIES).replace("'", "")
_LON = _list(f"CAST({dims.CITY_COORDINATES[n][1]} AS DOUBLE)" for n in CITIES).replace("'", "")
_PM25_INDEX = f"COALESCE({sql_piecewise('value', dims.CPCB_PM25_BREAKPOINTS, '5e2')}, 0e0)"
_SHIFT = "((user_id % 7) - 3) * 2e-2"

SQL_PREFIX = f"""WITH RECURSIVE ev AS (
  SELECT event_id, user_id, event_type, ts, value AS raw,
         value * (2e0 + 4e-1 * (user_id % 10)) * CAST({FACTOR!r} AS DOUBLE) AS value,
         ({_list(CITIES)})[user_id % 10 + 1] AS city,
         ({_LAT})[user_id % 10 + 1] AS lat, ({_LON})[user_id % 10 + 1] AS lon,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
readings AS (
  SELECT *, CASE parameter WHEN 'aqi' THEN {sql_band_case('value', dims.CPCB_BANDS, 'Unknown', 'Severe')}
            WHEN 'pm25' THEN {sql_band_case('pm25_index', dims.CPCB_BANDS, 'Unknown', 'Severe')} END AS aqi_category
  FROM (SELECT event_id AS reading_id, city, 'ST-' || user_id AS location, 'IN' AS country,
         {_case(PARAMETER_OF, 'event_type')} AS parameter, value, 'µg/m³' AS unit, ts AS timestamp_utc,
         lat + {_SHIFT} AS latitude, lon + {_SHIFT} AS longitude,
         (['cpcb', 'openaq', NULL])[k % 3 + 1] AS source, k <> 99 AS is_cleaned,
         CASE WHEN k < 5 THEN 'suspect' ELSE 'valid' END AS quality_flag, k, {_PM25_INDEX} AS pm25_index
        FROM ev)),
weather AS (
  SELECT event_id AS weather_id, city, lat AS latitude, lon AS longitude, ts AS timestamp_utc,
         5e0 + (raw * CAST({FACTOR!r} AS DOUBLE)) % 35 AS temperature_2m, CAST(k AS DOUBLE) AS relative_humidity_2m,
         (raw * CAST({FACTOR!r} AS DOUBLE)) % 15 AS wind_speed_10m, CAST(event_id % 360 AS DOUBLE) AS wind_direction_10m,
         CASE WHEN k < 30 THEN (raw * CAST({FACTOR!r} AS DOUBLE)) % 10 ELSE 0e0 END AS precipitation,
         CAST(event_id % 50 * 100 AS DOUBLE) AS visibility
  FROM ev WHERE k % 4 = 0),
forecasts AS (
  SELECT event_id AS forecast_id, city, ({_list(MODELS)})[user_id % 3 + 1] AS model_name,
         ({_list(HORIZONS)})[user_id % 6 + 1] AS forecast_horizon_hours, ts AS timestamp_utc,
         value AS actual_aqi, value + (k - 50) * CAST({0.6 * FACTOR!r} AS DOUBLE) AS predicted_aqi, k
  FROM ev),
predictions AS (
  SELECT * REPLACE (CASE WHEN k % 10 <> 7 THEN actual_aqi END AS actual_aqi) FROM forecasts),
stations AS (
  SELECT 'ST-' || user_id AS location, city, lat + {_SHIFT} AS latitude, lon + {_SHIFT} AS longitude,
         ({_list(STATION_TYPES)})[user_id % 4 + 1] AS station_type, user_id % 11 <> 0 AS is_active
  FROM (SELECT DISTINCT user_id, city, lat, lon FROM ev)),
subscriptions AS (
  SELECT c_custkey AS subscription_id, c_custkey % 700 AS user_id, {_case(CONDITION_OF, 'c_mktsegment')} AS condition,
         ({_list(CITIES)})[c_custkey % 10 + 1] AS location, ({_list(FREQUENCIES)})[c_custkey % 3 + 1] AS frequency,
         ({_list(CHANNELS)})[c_nationkey % 3 + 1] AS channel, c_custkey % 5 <> 0 AS active,
         TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 31 AS INTEGER)) AS created_at
  FROM customer),
users AS (
  SELECT c_custkey AS user_id, c_name AS name, lower(c_name) || '@example.org' AS email,
         CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role, c_acctbal < 0 AS is_suspended,
         TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 31 AS INTEGER)) AS created_at
  FROM customer),
notifications AS (
  SELECT o_orderkey AS notification_id, o_custkey AS user_id, o_orderstatus = 'F' AS read, o_orderdate AS created_at
  FROM orders),
saved_locations AS (
  SELECT s_suppkey AS location_id, s_suppkey * 7 % 100 AS user_id, ({_list(CITIES)})[s_suppkey % 10 + 1] AS name
  FROM supplier)"""
