"""Quality checks: each gives one row (name, passed, severity, details)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions.bins import flag
from aqspark.operators.clean import READING_KEY, out_of_range
from aqspark.operators.quantiles import exact_quantiles
from aqspark.operators.series import null_safe_join, series_window, with_position

REQUIRED = ["city", "parameter", "value", "timestamp_utc"]


def check_row(df: DataFrame, name: str, passed: Column, details: list[str], severity: str) -> DataFrame:
    """One-row measures to a check row; a passed check is informational."""
    ok = F.coalesce(passed, F.lit(False))
    return df.select(
        F.lit(name).alias("name"),
        ok.alias("passed"),
        F.when(ok, F.lit("info")).otherwise(F.lit(severity)).alias("severity"),
        F.to_json(F.struct(*details)).alias("details"),
    )


# --- measures: one row each, or one per group --------------------------------


def completeness(df: DataFrame) -> DataFrame:
    cols = [c for c in REQUIRED if c in df.columns]
    shares = [F.round(F.avg(flag(F.col(c).isNotNull())), 4).alias(c) for c in cols]
    out = df.agg(*shares)
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / F.lit(float(len(cols)))
    return out.select(*cols, mean.alias("overall_completeness"))


def freshness(df: DataFrame, as_of: Column) -> DataFrame:
    ts = F.col("timestamp_utc")
    edges = df.agg(F.max(ts).alias("max_timestamp"), F.min(ts).alias("min_timestamp"))
    newest, oldest = F.unix_micros("max_timestamp"), F.unix_micros("min_timestamp")
    return edges.withColumns({
        "age_hours": (F.unix_micros(as_of) - newest) / F.lit(3_600_000_000.0),
        "time_range_days": (newest - oldest) / F.lit(86_400_000_000.0),
    })


def range_violations(df: DataFrame) -> DataFrame:
    """Per checked parameter: rows, violations and extremes."""
    bad = out_of_range(dims.CHECK_RANGES)
    return (
        df.where(F.col("parameter").isin(list(dims.CHECK_RANGES)))
        .groupBy("parameter")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(bad).alias("violations"),
            F.min("value").alias("min_found"),
            F.max("value").alias("max_found"),
        )
        .withColumn("violation_pct", F.col("violations") / F.col("records") * 100)
    )


def duplicates(df: DataFrame) -> DataFrame:
    keys = [c for c in READING_KEY if c in df.columns]
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("total_records"), F.sum(F.col("n") - 1).alias("duplicate_count")
    ).withColumn("duplicate_pct", F.col("duplicate_count") / F.col("total_records"))


def pm_pairs(df: DataFrame, time: str = "timestamp_utc") -> DataFrame:
    """Pairs of pm25 and pm10 at one city and instant, and how many have pm25 above pm10.

    Values are counted per (city, instant) and value first, so the join meets
    distinct values with their multiplicities instead of every pair of copies.
    """
    rows = df.where(F.col("parameter").isin("pm25", "pm10"))
    counted = rows.groupBy("city", F.col(time).alias("_t"), "parameter", "value").agg(F.count(F.lit(1)).alias("n"))
    pm10 = counted.where(F.col("parameter") == "pm10")
    sorted_keys = ["city", "_t"]
    # above(v): how many pm10 rows at the key lie strictly below a pm25 value
    from aqspark.operators.series import running

    kind = F.when(F.col("parameter") == "pm25", F.lit(0)).otherwise(F.lit(1))
    placed = running(
        with_position(counted, sorted_keys, ["value", kind]),
        sorted_keys,
        sums={"_below": F.when(F.col("parameter") == "pm10", F.col("n")).otherwise(F.lit(0))},
    )
    per_key = pm10.groupBy(*sorted_keys).agg(F.sum("n").alias("_pm10"))
    joined = placed.where(F.col("parameter") == "pm25").join(per_key, sorted_keys, "inner")
    return joined.agg(
        F.coalesce(F.sum(F.col("n") * F.col("_pm10")), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.col("n") * F.col("_below")), F.lit(0)).alias("pm25_gt_pm10"),
    )


def outside_india(df: DataFrame) -> DataFrame:
    (la, lb), (oa, ob) = dims.INDIA_LATITUDES, dims.INDIA_LONGITUDES
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.agg(F.count_if((lat < la) | (lat > lb) | (lon < oa) | (lon > ob)).alias("geographic_bounds"))


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness from the population value."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis from the population value."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def distribution(df: DataFrame, min_rows: int = 10) -> DataFrame:
    v = F.col("value")
    stats = df.groupBy("parameter").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        sample_skewness("value").alias("skewness"),
        sample_kurtosis("value").alias("kurtosis"),
        (F.count_if(v == 0) / F.count("value") * 100).alias("zero_pct"),
    ).where(F.col("n") >= min_rows)
    medians = exact_quantiles(df, ["parameter"], "value", {"median": 0.5})
    return null_safe_join(stats, medians, ["parameter"])


def expected_cities(df: DataFrame, cities: list[str] | None = None) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in cities or dims.EXPECTED_CITIES], "city string")


def present_cities(df: DataFrame) -> DataFrame:
    return df.where(F.col("city").isNotNull()).select("city").distinct()


def missing_cities(df: DataFrame, cities: list[str] | None = None) -> DataFrame:
    return expected_cities(df, cities).join(present_cities(df), "city", "left_anti")


def coverage(df: DataFrame, cities: list[str] | None = None) -> DataFrame:
    cities = cities or dims.EXPECTED_CITIES
    n = float(len(cities))
    # at most one row per expected city
    found = present_cities(df).where(F.col("city").isin(list(cities)))
    expected = F.array(*[F.lit(c) for c in cities])
    return found.agg(
        F.count(F.lit(1)).alias("present_cities"),
        F.array_sort(F.array_except(expected, F.collect_set("city"))).alias("missing_cities"),
    ).withColumn("coverage_pct", F.col("present_cities") / F.lit(n) * 100)


def reading_gaps(df: DataFrame, tiebreak: str = "reading_id", min_block: int = 4096) -> DataFrame:
    """Per reading the seconds since the city's previous one."""
    placed = with_position(df.where(F.col("timestamp_utc").isNotNull()), ["city"], ["timestamp_utc", tiebreak])
    now = F.unix_micros("timestamp_utc")
    return series_window(
        placed,
        ["city"],
        lambda w: {"gap_seconds": (now - F.unix_micros(F.lag("timestamp_utc", 1).over(w))) / F.lit(1_000_000.0)},
        before=1,
        min_block=min_block,
    ).drop("_pos", "_n")


def continuity(df: DataFrame, hours: float = 3, tiebreak: str = "reading_id") -> DataFrame:
    """Cities with gaps over ``hours``: how many, the longest, and the median interval."""
    gaps = reading_gaps(df.select("city", "timestamp_utc", tiebreak), tiebreak).where(F.col("gap_seconds").isNotNull())
    g = F.col("gap_seconds")
    large = g > hours * 3600
    stats = gaps.groupBy("city").agg(
        F.count_if(large).alias("gap_count"), F.max(F.when(large, g / 3600)).alias("max_gap_hours")
    )
    medians = exact_quantiles(gaps, ["city"], g / 60, {"median_interval_minutes": 0.5})
    return null_safe_join(stats, medians, ["city"]).where(F.col("gap_count") > 0)


# --- checks -------------------------------------------------------------------


def check_completeness(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    m = completeness(df)
    return check_row(m, "completeness", F.col("overall_completeness") >= threshold, m.columns, "critical")


def check_freshness(df: DataFrame, as_of: Column, hours: float = 2) -> DataFrame:
    m = freshness(df, as_of)
    return check_row(m, "freshness", F.col("age_hours") <= hours, m.columns, "critical")


def check_ranges(df: DataFrame) -> DataFrame:
    m = range_violations(df).agg(F.sum("records").alias("total_records"), F.sum("violations").alias("total_violations"))
    m = m.withColumn("violation_pct", F.coalesce(F.try_divide("total_violations", "total_records"), F.lit(0.0)) * 100)
    return check_row(m, "value_ranges", F.col("violation_pct") < 1.0, m.columns, "warning")


def check_uniqueness(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    m = duplicates(df)
    return check_row(m, "uniqueness", F.col("duplicate_pct") <= threshold, m.columns, "warning")


def check_consistency(df: DataFrame) -> DataFrame:
    both = outside_india(df).select(
        "geographic_bounds", pm_pairs(df).select("pm25_gt_pm10").scalar().alias("pm25_gt_pm10")
    )
    fine = (F.col("geographic_bounds") == 0) & (F.col("pm25_gt_pm10") == 0)
    return check_row(both, "consistency", fine, both.columns, "warning")


def check_distribution(df: DataFrame) -> DataFrame:
    d = distribution(df)
    odd = F.when(F.col("std") == 0, F.lit("zero variance")).when(
        F.abs("skewness") > 5, F.lit("highly skewed")).when(F.col("zero_pct") > 50, F.lit("mostly zero"))
    # one row per parameter
    m = d.withColumn("_odd", odd).agg(
        F.count("_odd").alias("anomaly_count"),
        F.array_sort(F.collect_list(F.when(odd.isNotNull(), F.concat_ws(": ", "parameter", odd)))).alias("anomalies"),
    )
    return check_row(m, "distribution", F.col("anomaly_count") == 0, m.columns, "warning")


def check_coverage(df: DataFrame, threshold: float = 80) -> DataFrame:
    m = coverage(df)
    return check_row(m, "geographic_coverage", F.col("coverage_pct") >= threshold, m.columns, "warning")


def check_continuity(df: DataFrame, tiebreak: str = "reading_id") -> DataFrame:
    m = continuity(df, tiebreak=tiebreak).agg(
        F.count(F.lit(1)).alias("cities_with_gaps"), F.max("max_gap_hours").alias("max_gap_hours")
    )
    return check_row(m, "temporal_continuity", F.col("cities_with_gaps") == 0, m.columns, "warning")


def check_not_empty(df: DataFrame) -> DataFrame:
    m = df.agg(F.count(F.lit(1)).alias("rows"))
    return check_row(m, "data_empty", F.col("rows") > 0, m.columns, "critical")


def expectations(
    df: DataFrame, rules: list[tuple[str, Column, float]] | None = None, min_rows: int = 1, max_rows: int | None = None
) -> DataFrame:
    """Rules (name, condition, share of rows that must meet it), all in one pass.

    Pass own rules to extend the suite. An unknown condition counts as unmet.
    The number of rows has no upper bound unless ``max_rows`` gives one.
    """
    rules = rules or [
        ("city_not_null", F.col("city").isNotNull(), 0.99),
        ("value_not_null", F.col("value").isNotNull(), 0.95),
        ("parameter_in_set", F.col("parameter").isNull() | F.col("parameter").isin(dims.PARAMETERS), 0.99),
    ]
    shares = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.avg(flag(c)).alias(n) for n, c, _ in rules]
    )
    in_bounds = F.col("_rows") >= min_rows
    rows = F.struct(
        F.lit("row_count").alias("name"),
        F.col("_rows").cast("double").alias("observed"),
        (in_bounds if max_rows is None else in_bounds & (F.col("_rows") <= max_rows)).alias("passed"),
    )
    structs = [rows] + [
        F.struct(F.lit(n).alias("name"), F.col(n).alias("observed"), (F.col(n) >= share).alias("passed"))
        for n, _, share in rules
    ]
    return shares.select(F.inline(F.array(*structs))).withColumn(
        "severity", F.when(F.col("passed"), F.lit("info")).otherwise(F.lit("warning"))
    )


def run_all_checks(df: DataFrame, as_of: Column, tiebreak: str = "reading_id") -> DataFrame:
    checks: list[Callable[[], DataFrame]] = [
        lambda: check_completeness(df),
        lambda: check_freshness(df, as_of),
        lambda: check_ranges(df),
        lambda: check_uniqueness(df),
        lambda: check_consistency(df),
        lambda: check_distribution(df),
        lambda: check_coverage(df),
        lambda: check_continuity(df, tiebreak),
    ]
    rows = reduce(lambda a, b: a.unionByName(b), [c() for c in checks])
    empty = check_not_empty(df)
    return rows.unionByName(empty.where(~F.col("passed")))


def report(checks: DataFrame) -> DataFrame:
    """Roll-up of check rows; only a failed critical check fails the report."""
    critical = ~F.col("passed") & (F.col("severity") == "critical")
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if("passed").alias("checks_passed"),
        F.count_if(critical).alias("critical_failures"),
        (~F.coalesce(F.bool_or(critical), F.lit(False))).alias("passed"),
        F.round(F.coalesce(F.avg(flag(F.col("passed"))), F.lit(0.0)) * 100, 6).alias("pass_rate"),
    )


def quality_score(df: DataFrame, out_of_range_col: str, outlier: str, spike: str, neighbour: str) -> DataFrame:
    """Score per reading from its flags, with the training and display gates.

    Weights: range .6, outlier .2, spike .1, neighbour difference .1; a source
    other than the primary one costs .05.
    """
    lost = (
        flag(F.col(out_of_range_col)) * 0.6
        + flag(F.col(outlier)) * 0.2
        + flag(F.col(spike)) * 0.1
        + flag(F.col(neighbour)) * 0.1
        + flag(~F.col("source").eqNullSafe(F.lit("cpcb"))) * 0.05
    )
    return df.withColumn("quality_score", F.greatest(F.lit(0.0), F.lit(1.0) - lost)).withColumns({
        "use_for_training": F.col("quality_score") >= 0.5,
        "use_for_display": F.col("quality_score") >= 0.8,
    })


def spikes(df: DataFrame, order: list, window: int = 24, sigmas: float = 3.0, min_block: int = 4096) -> DataFrame:
    """Add ``is_spike``: beyond ``sigmas`` deviations of the mean of the rows before it."""
    keys = ["city", "parameter"]

    def build(w):
        frame = w.rowsBetween(-window, -1)
        mean, std = F.avg("value").over(frame), F.stddev_samp("value").over(frame)
        return {"is_spike": F.coalesce(F.abs(F.col("value") - mean) > F.lit(sigmas) * std, F.lit(False))}

    return series_window(with_position(df, keys, order), keys, build, before=window, min_block=min_block).drop("_pos", "_n")
