"""Landed API documents to rows.

A reader returns one row per document with its text in ``body``; a parser turns
such rows into typed columns. Fetching documents is not part of this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions.bins import lookup


def read_documents(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per file, or per line where documents are stored one to a line."""
    return spark.read.text(path, wholetext=multiline).withColumnRenamed("value", "body")


def latest_snapshot(df: DataFrame, column: str = "ingest_ts") -> DataFrame:
    """Rows of the newest snapshot; on a partition column only that partition is read."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def read_latest_csv(spark: SparkSession, directory: str, schema: str, prefix: str = "") -> DataFrame:
    """Newest CSV file of a folder by name."""
    # only names are listed: without its content column this source opens no file
    names = spark.read.format("binaryFile").load(f"{directory}/{prefix}*.csv").select("path")
    newest = names.agg(F.max_by("path", F.element_at(F.split("path", "/"), -1))).first()[0]
    return spark.read.schema(schema).option("header", True).csv(newest)


# --- measurements ---

MEASUREMENTS = """results array<struct<location: string, city: string, country: string, parameter: string, value: string,
  unit: string, date: struct<utc: string, local: string>, coordinates: struct<latitude: double, longitude: double>>>,
  meta struct<found: bigint>"""
MEASUREMENT_KEY = ["city", "location", "parameter", "timestamp_utc"]


def parse_measurements(docs: DataFrame) -> DataFrame:
    """Flat readings from pages of nested results."""
    page = docs.select(F.from_json("body", MEASUREMENTS).alias("p"))
    r = page.select(F.explode("p.results").alias("r"))
    return r.select(
        "r.location",
        "r.city",
        "r.country",
        "r.parameter",
        F.col("r.value").try_cast("double").alias("value"),
        "r.unit",
        F.col("r.date.utc").try_cast("timestamp").alias("timestamp_utc"),
        F.col("r.date.local").try_cast("timestamp").alias("timestamp_local"),
        F.col("r.coordinates.latitude").alias("latitude"),
        F.col("r.coordinates.longitude").alias("longitude"),
    )


def combine_pages(docs: DataFrame) -> DataFrame:
    """All pages of all requests; a row that came in two pages is kept once."""
    rows = parse_measurements(docs)
    return rows.dropDuplicates([*MEASUREMENT_KEY, "value"])


def parse_reference(docs: DataFrame, fields: str) -> DataFrame:
    """City, location or latest tables: the entries of ``results`` with the given fields."""
    return docs.select(F.inline(F.from_json("body", f"results array<struct<{fields}>>").getField("results")))


# --- stations ---


def _first(v: Column, names: list[str], kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def parse_stations(docs: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Station documents to long readings: one row for the index, one per pollutant.

    The list may be under ``stations`` or ``data`` and may be a single object;
    names, index and pollutant values come under alternate keys.
    """
    root = docs.withColumn("_v", F.try_parse_json("body"))
    listed = F.coalesce(
        F.try_variant_get("_v", "$.stations", "array<variant>"),
        F.try_variant_get("_v", "$.data", "array<variant>"),
        F.try_variant_get("_v", "$", "array<variant>"),
        F.array(F.coalesce(F.try_variant_get("_v", "$.stations", "variant"), F.try_variant_get("_v", "$.data", "variant"))),
    )
    s = root.select("city", fetched_at, F.explode(listed).alias("_s"))
    base = s.select(
        F.coalesce(_first(F.col("_s"), ["stationName", "station"], "string"), F.lit("")).alias("location"),
        "city",
        F.lit("IN").alias("country"),
        F.col(fetched_at).alias("timestamp_utc"),
        F.try_variant_get("_s", "$.latitude", "double").alias("latitude"),
        F.try_variant_get("_s", "$.longitude", "double").alias("longitude"),
        _first(F.col("_s"), ["aqi", "AQI"], "string").alias("_aqi"),
        F.coalesce(
            F.try_variant_get("_s", "$.pollutants", "map<string,variant>"),
            F.try_variant_get("_s", "$.parameters", "map<string,variant>"),
        ).alias("_pollutants"),
    )
    cols = ["location", "city", "country", "parameter", "value", "unit", "timestamp_utc", "latitude", "longitude"]
    whole = base.where(F.col("_aqi").isNotNull()).withColumns({
        "parameter": F.lit("aqi"), "value": F.col("_aqi").try_cast("double"), "unit": F.lit("NAQI"),
    })
    p = base.select("*", F.explode("_pollutants").alias("_name", "_data"))
    number = F.coalesce(
        _first(F.col("_data"), ["avg", "value"], "string"), F.try_variant_get("_data", "$", "double").cast("string")
    )
    mapped = F.coalesce(lookup(dims.STATION_PARAMETER_NAMES, "_name"), F.lower("_name"))
    parts = p.where(number.isNotNull()).withColumns({"parameter": mapped, "value": number.try_cast("double")}).withColumn(
        "unit", F.when(F.col("parameter") == "co", F.lit("mg/m³")).otherwise(F.lit("µg/m³"))
    )
    return whole.select(*cols).unionByName(parts.select(*cols))


# fixed value: the script variable of the station page
EMBEDDED_JSON = r"(?s)var\s+aqiData\s*=\s*(\[.*?\]);"
#: A cell without digits and, in the same row, the next cell that is a number.
STATION_ROW = r"(?s)<td[^>]*>\s*([^<>\d]*[^<>\d\s])\s*</td>(?:(?!</tr>).)*?<td[^>]*>\s*(\d+)\s*</td>"


def parse_html(docs: DataFrame, id_column: str, html: str = "html", row_pattern: str = STATION_ROW) -> DataFrame:
    """Station rows of raw pages: the embedded JSON list where there is one, else matches of the row pattern."""
    embedded = F.from_json(
        F.nullif(F.regexp_extract(html, EMBEDDED_JSON, 1), F.lit("")),
        "array<struct<stationName: string, aqi: string, latitude: double, longitude: double>>",
    )
    entry = "struct<location: string, value: double, latitude: double, longitude: double>"
    from_json = F.transform(embedded, lambda s: F.struct(
        F.coalesce(s["stationName"], F.lit("")).alias("location"), s["aqi"].try_cast("double").alias("value"),
        s["latitude"].alias("latitude"), s["longitude"].alias("longitude"),
    ))
    names = F.regexp_extract_all(html, F.lit(row_pattern), F.lit(1))
    numbers = F.regexp_extract_all(html, F.lit(row_pattern), F.lit(2))
    from_rows = F.zip_with(names, numbers, lambda a, b: F.struct(
        F.trim(a).alias("location"), b.try_cast("double").alias("value"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
    ))
    rows = F.when(F.size(from_json) > 0, from_json.cast(f"array<{entry}>")).otherwise(from_rows.cast(f"array<{entry}>"))
    return docs.select(id_column, F.posexplode(rows).alias("row_number", "_r")).select(
        id_column, "row_number", "_r.*"
    )


HISTORY_ENTRY = "array<struct<station: string, value: string, avg: string, date: string, timestamp: string>>"


def parse_history(docs: DataFrame, parameter: str = "parameter", station: str | None = None) -> DataFrame:
    """Historical station readings; list, value and time come under alternate keys."""
    body = F.from_json("body", f"readings {HISTORY_ENTRY}, data {HISTORY_ENTRY}")
    r = docs.select("city", F.col(parameter).alias("parameter"), F.explode(F.coalesce(body["readings"], body["data"])).alias("r"))
    return r.select(
        "city",
        F.coalesce("r.station", F.lit(station)).alias("location"),
        "parameter",
        F.coalesce("r.value", "r.avg").try_cast("double").alias("value"),
        F.coalesce("r.date", "r.timestamp").try_cast("timestamp").alias("timestamp_utc"),
        F.lit("IN").alias("country"),
        F.lit("µg/m³").alias("unit"),
    )


# --- weather ---


def _parallel(docs: DataFrame, group: str, variables: list[str]) -> DataFrame:
    """Rows from parallel arrays; every variable is read as text and then as a number."""
    fields = ", ".join(f"{v}: array<string>" for v in variables)
    body = F.from_json("body", f"{group} struct<time: array<string>, {fields}>")[group]
    zipped = F.arrays_zip(body["time"].alias("time"), *[body[v].alias(v) for v in variables])
    rows = docs.select("latitude", "longitude", F.inline(zipped))
    return rows.withColumns({v: F.col(v).try_cast("double") for v in variables})


def parse_hourly_weather(docs: DataFrame, variables: list[str] | None = None, zone: str = "Asia/Kolkata") -> DataFrame:
    rows = _parallel(docs, "hourly", variables or dims.HOURLY_WEATHER_VARIABLES)
    local = F.col("time").try_cast("timestamp")
    return rows.withColumn("timestamp_utc", F.to_utc_timestamp(local, zone)).drop("time")


def parse_daily_weather(docs: DataFrame, variables: list[str] | None = None) -> DataFrame:
    rows = _parallel(docs, "daily", variables or dims.DAILY_WEATHER_VARIABLES)
    return rows.withColumn("date", F.col("time").try_cast("date")).drop("time")


def date_chunks(spans: DataFrame, first: str = "date_from", last: str = "date_to", days: int = 90) -> DataFrame:
    """Inclusive pieces of at most ``days`` days per span; a next piece starts before the span's last day."""
    starts = F.sequence(F.col(first), F.date_sub(last, 1), F.make_dt_interval(F.lit(days)))
    rows = spans.where(F.col(first) < F.col(last)).withColumn("chunk_start", F.explode(starts))
    return rows.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(last)))


# --- tables ---


def city_coordinates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, lat, lon) for c, (lat, lon) in dims.CITY_COORDINATES.items()], "city string, latitude double, longitude double"
    )


def with_coordinates(df: DataFrame) -> DataFrame:
    """Add the city's coordinates from the fixed list of cities."""
    return df.withColumns({
        "city_latitude": lookup({c: xy[0] for c, xy in dims.CITY_COORDINATES.items()}, "city"),
        "city_longitude": lookup({c: xy[1] for c, xy in dims.CITY_COORDINATES.items()}, "city"),
    })


def city_scan(df: DataFrame, city: str, start: str | None = None, end: str | None = None, ts: str = "timestamp_utc") -> DataFrame:
    """One city's rows between inclusive bounds; both filters reach the file scan."""
    out = df.where(F.col("city") == city)
    if start:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col(ts) <= F.lit(end).cast("timestamp"))
    return out


def wide_extract(readings: DataFrame, parameters: list[str], order: list[str], ts: str = "timestamp_utc") -> DataFrame:
    """One row per city and time with a column per pollutant and the index.

    The first value per cell wins; the index comes from pm25, or is the first
    pollutant asked for.
    """
    from aqspark.functions.index import training_pm25_index

    cells = [
        F.min_by(F.when(F.col("parameter") == p, F.col("value")), F.when(F.col("parameter") == p, F.struct(*order))).alias(p)
        for p in parameters
    ]
    wide = readings.where(F.col("parameter").isin(parameters)).groupBy("city", ts).agg(*cells)
    return wide.withColumn("aqi", training_pm25_index("pm25") if "pm25" in parameters else F.col(parameters[0]))
