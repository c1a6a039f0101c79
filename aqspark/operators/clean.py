"""Cleaning: coercion, nulls, ranges, outliers, duplicates, local time, category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import calendar, index
from aqspark.functions.bins import lookup
from aqspark.operators.quantiles import exact_quantiles
from aqspark.operators.series import null_safe_join
from aqspark.session import settle

NUMERIC = ["value", "latitude", "longitude"]
TIMES = ["timestamp_utc", "timestamp_local"]
STRINGS = ["city", "location", "country", "parameter", "unit", "source"]
CRITICAL = ["value", "city", "parameter", "timestamp_utc"]
SERIES = ["city", "parameter"]
READING_KEY = ["city", "location", "parameter", "timestamp_utc"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null once, so aggregates skip it as they skip null."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def coerce_types(df: DataFrame) -> DataFrame:
    """Parse numbers and times; what does not parse, and 'nan' text, becomes null."""
    have = set(df.columns)
    out: dict[str, Column] = {}
    for c in NUMERIC:
        if c in have:
            number = F.col(c).try_cast("double")
            out[c] = F.when(~F.isnan(number), number)
    for c in TIMES:
        if c in have:
            out[c] = F.col(c).try_cast("timestamp")
    for c in STRINGS:
        if c in have:
            out[c] = F.nullif(F.col(c).cast("string"), F.lit("nan"))
    return df.withColumns(out)


def has_nulls(df: DataFrame) -> Column:
    cond = F.lit(False)
    for c in CRITICAL:
        if c in df.columns:
            cond = cond | F.col(c).isNull()
    return cond


def fill_defaults(df: DataFrame) -> DataFrame:
    fills = {c: v for c, v in {"country": "IN", "unit": "µg/m³"}.items() if c in df.columns}
    return df.na.fill(fills) if fills else df


def drop_nulls(df: DataFrame) -> DataFrame:
    return fill_defaults(df.where(~has_nulls(df)))


def out_of_range(ranges: dict | None = None) -> Column:
    """True where the parameter is known and the value lies outside its range."""
    ranges = ranges or dims.PARAMETER_RANGES
    low = lookup({p: r[0] for p, r in ranges.items()}, "parameter")
    high = lookup({p: r[1] for p, r in ranges.items()}, "parameter")
    return F.coalesce((F.col("value") < low) | (F.col("value") > high), F.lit(False))


def iqr_bounds(df: DataFrame, k: float = 1.5, min_rows: int = 5) -> DataFrame:
    """Per (city, parameter) bounds; null where there are few rows or no spread."""
    q = exact_quantiles(df, SERIES, "value", {"q1": 0.25, "q3": 0.75})
    n = df.groupBy(*SERIES).agg(F.count("value").alias("_count"))
    usable = (F.col("_count") >= min_rows) & (F.col("q3") != F.col("q1"))
    spread = F.lit(k) * (F.col("q3") - F.col("q1"))
    return null_safe_join(q, n, SERIES, "inner").select(
        *SERIES,
        F.when(usable, F.col("q1") - spread).alias("iqr_low"),
        F.when(usable, F.col("q3") + spread).alias("iqr_high"),
    )


def zscore_bounds(df: DataFrame, min_rows: int = 5) -> DataFrame:
    return df.groupBy(*SERIES).agg(
        F.avg("value").alias("z_mean"), F.stddev_samp("value").alias("z_std"), F.count("value").alias("_count")
    ).select(
        *SERIES, "z_mean", F.when((F.col("_count") >= min_rows) & (F.col("z_std") != 0), F.col("z_std")).alias("z_std")
    )


def flag_outliers(
    df: DataFrame, method: str = "iqr", k: float = 1.5, threshold: float = 3.0, min_rows: int = 5
) -> DataFrame:
    """Add ``is_outlier``; 'both' marks a row that either test marks."""
    out, tests, extra = df, [], []
    if method in ("iqr", "both"):
        out = null_safe_join(out, settle(iqr_bounds(df, k, min_rows)), SERIES)
        tests.append((F.col("value") < F.col("iqr_low")) | (F.col("value") > F.col("iqr_high")))
        extra += ["iqr_low", "iqr_high"]
    if method in ("zscore", "both"):
        out = null_safe_join(out, settle(zscore_bounds(df, min_rows)), SERIES)
        tests.append(F.abs(F.try_divide(F.col("value") - F.col("z_mean"), F.col("z_std"))) > threshold)
        extra += ["z_mean", "z_std"]
    marked = F.lit(False)
    for t in tests:
        marked = marked | F.coalesce(t, F.lit(False))
    return out.withColumn("is_outlier", marked).drop(*extra)


def source_priority(source="source") -> Column:
    return lookup(dims.SOURCE_PRIORITY, source, dims.OTHER_SOURCE_PRIORITY)


def deduplicate(df: DataFrame, tiebreak: list[str] | None = None) -> DataFrame:
    """One row per reading key, best source first.

    The best row is an aggregate, so copies collapse before the shuffle and a
    key with very many copies does not land in one task.
    """
    keys = [c for c in READING_KEY if c in df.columns]
    rank = [source_priority(), F.coalesce(F.col("source"), F.lit(""))] if "source" in df.columns else []
    rank += [F.col(c) for c in (tiebreak or ["value"])]
    best = F.min_by(F.struct(*df.columns), F.struct(*rank))
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best.alias("_best")).select("_best.*")


def add_local_time(df: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    local = calendar.local_time("timestamp_utc", zone)
    return df.withColumn("timestamp_local", local).withColumns({
        "date": F.to_date("timestamp_local"),
        "hour": F.hour("timestamp_local"),
        "day_of_week": F.weekday("timestamp_local"),
        "month": F.month("timestamp_local"),
    })


def add_category(df: DataFrame) -> DataFrame:
    p = F.col("parameter")
    return df.withColumn(
        "aqi_category",
        F.when(p == "aqi", index.cpcb_category("value")).when(
            p == "pm25", index.cpcb_category(index.cpcb_pm25_index("value"))
        ),
    )


def flag_reasons(df: DataFrame, method: str = "iqr") -> DataFrame:
    """Add ``reason``: why cleaning drops the row (null, range, outlier) or null to keep it."""
    typed = coerce_types(df)
    # bounds, flags and dropped rows all read the typed rows, so these are parsed and stored once
    staged = settle(fill_defaults(
        typed.withColumn("reason", F.when(has_nulls(typed), F.lit("null")).when(out_of_range(), F.lit("range")))
    ))
    kept = staged.where(F.col("reason").isNull())
    marked = flag_outliers(kept, method).withColumn("reason", F.when(F.col("is_outlier"), F.lit("outlier")))
    return marked.drop("is_outlier").unionByName(staged.where(F.col("reason").isNotNull()))


def clean(df: DataFrame, method: str = "iqr", zone: str = "Asia/Kolkata", tiebreak: list[str] | None = None) -> DataFrame:
    """All cleaning steps in order."""
    kept = flag_reasons(df, method).where(F.col("reason").isNull()).drop("reason")
    return add_category(add_local_time(deduplicate(kept, tiebreak), zone))


def cleaning_stats(df: DataFrame, method: str = "iqr") -> DataFrame:
    """Rows in, rows dropped by reason, rows out and retention, as one row."""
    flagged = flag_reasons(df, method)
    keys = [c for c in READING_KEY if c in df.columns]
    # per reason and key: for kept rows all but one of a key's copies are duplicates
    counted = flagged.groupBy("reason", *keys).agg(F.count(F.lit(1)).alias("n"))

    def total(reason: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("reason") == reason, F.col("n"))), F.lit(0))

    kept = F.col("reason").isNull()
    out = F.coalesce(F.sum(F.when(kept, F.lit(1))), F.lit(0))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_records"),
        total("null").alias("nulls_removed"),
        total("range").alias("range_violations"),
        total("outlier").alias("outliers_removed"),
        F.coalesce(F.sum(F.when(kept, F.col("n") - 1)), F.lit(0)).alias("duplicates_removed"),
        out.alias("output_records"),
        F.round(out / F.greatest(F.sum("n"), F.lit(1)) * 100, 6).alias("retention_pct"),
    )
