"""Cleaning steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import index
from aqspark.operators import clean
from aqspark.plans.registry import query
from aqspark.plans.tables import sql_band_case, sql_cut_case, sql_piecewise


def raw_text(t):
    """Readings as text, with unparsable values, 'nan' text and nulls as a feed delivers them."""
    k = F.col("k")
    return t.readings.select(
        "reading_id",
        F.when(k == 7, F.lit("nan")).otherwise(F.col("city")).alias("city"),
        "location",
        F.when(k == 9, F.lit(None).cast("string")).otherwise(F.col("country")).alias("country"),
        "parameter",
        F.when(k == 11, F.lit("n/a")).when(k == 12, F.lit("NaN")).otherwise(F.col("value").cast("string")).alias("value"),
        F.when(k == 13, F.lit("nan")).otherwise(F.col("unit")).alias("unit"),
        F.when(k == 14, F.lit("yesterday")).otherwise(F.col("timestamp_utc").cast("string")).alias("timestamp_utc"),
        "source",
    )


RAW_TYPED = """typed AS (SELECT reading_id, CASE WHEN k <> 7 THEN city END AS city, location,
  CASE WHEN k <> 9 THEN country END AS country, parameter, CASE WHEN k NOT IN (11, 12) THEN value END AS value,
  CASE WHEN k <> 13 THEN unit END AS unit, CASE WHEN k <> 14 THEN timestamp_utc END AS timestamp_utc, source FROM readings)"""
_NULL_ROW = "city IS NULL OR parameter IS NULL OR value IS NULL OR timestamp_utc IS NULL"
_RANGE = " OR ".join(f"(parameter = '{p}' AND (value < {lo} OR value > {hi}))" for p, (lo, hi) in dims.PARAMETER_RANGES.items())


@query("p01_coerce_types", RAW_TYPED + " SELECT * FROM typed")
def coerce(t):
    return clean.coerce_types(raw_text(t))


@query("p02_drop_nulls", RAW_TYPED + f"""
SELECT * REPLACE (coalesce(country, 'IN') AS country, coalesce(unit, 'µg/m³') AS unit) FROM typed WHERE NOT ({_NULL_ROW})""")
def nulls(t):
    return clean.drop_nulls(clean.coerce_types(raw_text(t)))


@query("p03_value_ranges", f"SELECT reading_id, city, parameter, value FROM readings WHERE NOT ({_RANGE})")
def ranges(t):
    return t.readings.where(~clean.out_of_range()).select("reading_id", "city", "parameter", "value")


IQR = """q AS (SELECT city, parameter, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n
  FROM {src} GROUP BY 1, 2)"""
IQR_MARK = ("q.n >= 5 AND q3 <> q1 AND (value < q1 - 15e-1 * (q3 - q1) OR value > q3 + 15e-1 * (q3 - q1))")
Z_MARK = "coalesce(z.n >= 5 AND z.s <> 0 AND abs((value - z.m) / z.s) > 3, false)"
ZS = "z AS (SELECT city, parameter, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM readings GROUP BY 1, 2)"


@query("w20_iqr_outliers", IQR.format(src="readings") + f"""
SELECT reading_id, city, parameter, value, {IQR_MARK} AS is_outlier FROM readings JOIN q USING (city, parameter)""")
def iqr(t):
    return clean.flag_outliers(t.readings.select("reading_id", "city", "parameter", "value"))


@query("w21_zscore_outliers", ZS + f"""
SELECT reading_id, city, parameter, value, {Z_MARK} AS is_outlier FROM readings JOIN z USING (city, parameter)""")
def zscore(t):
    return clean.flag_outliers(t.readings.select("reading_id", "city", "parameter", "value"), "zscore")


@query("w21_either_outlier_test", IQR.format(src="readings") + ", " + ZS + f"""
SELECT reading_id, ({IQR_MARK}) OR {Z_MARK} AS is_outlier FROM readings JOIN q USING (city, parameter) JOIN z USING (city, parameter)""")
def both_tests(t):
    return clean.flag_outliers(t.readings.select("reading_id", "city", "parameter", "value"), "both").select(
        "reading_id", "is_outlier"
    )


def two_feeds(t):
    """The readings twice: as stored, and as a second feed under another source."""
    other = F.when(F.col("source") == "cpcb", F.lit("openaq")).when(
        F.col("source") == "openaq", F.lit("cpcb")
    ).otherwise(F.lit("manual"))
    return t.readings.unionByName(t.readings.withColumn("source", other))


TWO_FEEDS = """feeds AS (SELECT * FROM readings UNION ALL SELECT * REPLACE (CASE source WHEN 'cpcb' THEN 'openaq'
  WHEN 'openaq' THEN 'cpcb' ELSE 'manual' END AS source) FROM readings)"""
_PRIO = "CASE source WHEN 'cpcb' THEN 0 WHEN 'openaq' THEN 1 ELSE 2 END"


@query("w19_deduplicate", TWO_FEEDS + f"""
SELECT reading_id, city, location, parameter, timestamp_utc, value, source FROM (SELECT *, row_number() OVER (
  PARTITION BY city, location, parameter, timestamp_utc ORDER BY {_PRIO}, coalesce(source, ''), reading_id) AS rn FROM feeds)
WHERE rn = 1""")
def dedup(t):
    cols = ["reading_id", "city", "location", "parameter", "timestamp_utc", "value", "source"]
    return clean.deduplicate(two_feeds(t).select(*cols), tiebreak=["reading_id"])


@query("p07_local_time", """
SELECT reading_id, timestamp_utc + INTERVAL 330 MINUTE AS timestamp_local,
  CAST(timestamp_utc + INTERVAL 330 MINUTE AS DATE) AS date, CAST(hour(timestamp_utc + INTERVAL 330 MINUTE) AS INTEGER) AS hour,
  CAST(isodow(timestamp_utc + INTERVAL 330 MINUTE) - 1 AS INTEGER) AS day_of_week,
  CAST(month(timestamp_utc + INTERVAL 330 MINUTE) AS INTEGER) AS month FROM readings""")
def local(t):
    return clean.add_local_time(t.readings.select("reading_id", "timestamp_utc")).drop("timestamp_utc")


@query("p08_cpcb_category", "SELECT reading_id, parameter, aqi_category FROM readings")
def category(t):
    return clean.add_category(t.readings.drop("aqi_category")).select("reading_id", "parameter", "aqi_category")


@query("p09_cpcb_pm25_index", f"""
SELECT reading_id, round(coalesce({sql_piecewise('value', dims.CPCB_PM25_BREAKPOINTS, '5e2')}, 0e0), 6) AS pm25_index FROM readings""")
def pm25_index(t):
    return t.readings.select("reading_id", F.round(index.cpcb_pm25_index("value"), 6).alias("pm25_index"))


@query("p10_continuous_category", f"""
SELECT reading_id, {sql_cut_case('v', dims.AQI_CUTS, 'Severe', 'Unknown')} AS python_rule,
  {sql_cut_case('v', dims.AQI_CUTS, 'Severe')} AS sql_rule FROM (SELECT reading_id, CASE WHEN k <> 3 THEN value END AS v FROM readings)""")
def continuous(t):
    v = F.when(F.col("k") != 3, F.col("value"))
    return t.readings.select(
        "reading_id",
        index.aqi_cut_category(v).alias("python_rule"),
        index.aqi_cut_category(v, null_label="Severe").alias("sql_rule"),
    )


@query("p11_pm25_category", f"""
SELECT reading_id, {sql_cut_case('value', dims.PM25_CUTS, 'Severe', 'Unknown')} AS category FROM readings""")
def pm25_category(t):
    return t.readings.select("reading_id", index.pm25_cut_category("value").alias("category"))


@query("p16_portal_category", f"""
SELECT reading_id, {sql_band_case('value', dims.PORTAL_BANDS, 'Unknown', 'Severe')} AS category FROM readings""")
def portal(t):
    return t.readings.select("reading_id", index.portal_category("value").alias("category"))


CLEAN_STAGES = RAW_TYPED + f""",
f AS (SELECT * REPLACE (coalesce(country, 'IN') AS country, coalesce(unit, 'µg/m³') AS unit) FROM typed WHERE NOT ({_NULL_ROW})),
g AS (SELECT * FROM f WHERE NOT ({_RANGE})),
""" + IQR.format(src="g") + f""",
o AS (SELECT g.* FROM g JOIN q USING (city, parameter) WHERE NOT ({IQR_MARK})),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, location, parameter, timestamp_utc
  ORDER BY {_PRIO}, coalesce(source, ''), reading_id) AS rn FROM o) WHERE rn = 1)"""


@query("q11_cleaning_stats", CLEAN_STAGES + """
SELECT (SELECT count(*) FROM typed) AS input_records, (SELECT count(*) FROM typed) - (SELECT count(*) FROM f) AS nulls_removed,
  (SELECT count(*) FROM f) - (SELECT count(*) FROM g) AS range_violations,
  (SELECT count(*) FROM g) - (SELECT count(*) FROM o) AS outliers_removed,
  (SELECT count(*) FROM o) - (SELECT count(*) FROM u) AS duplicates_removed, (SELECT count(*) FROM u) AS output_records,
  round((SELECT count(*) FROM u) / (SELECT count(*) FROM typed) * 100, 6) AS retention_pct""")
def stats(t):
    return clean.cleaning_stats(raw_text(t))


@query("q11_cleaned_rows", CLEAN_STAGES + f"""
SELECT reading_id, city, parameter, value, source, timestamp_utc + INTERVAL 330 MINUTE AS timestamp_local,
  CASE parameter WHEN 'aqi' THEN {sql_band_case('value', dims.CPCB_BANDS, 'Unknown', 'Severe')}
    WHEN 'pm25' THEN {sql_band_case(f"coalesce({sql_piecewise('value', dims.CPCB_PM25_BREAKPOINTS, '5e2')}, 0e0)", dims.CPCB_BANDS, 'Unknown', 'Severe')} END AS aqi_category
FROM u""")
def cleaned_rows(t):
    return clean.clean(raw_text(t), tiebreak=["reading_id"]).select(
        "reading_id", "city", "parameter", "value", "source", "timestamp_local", "aqi_category"
    )
