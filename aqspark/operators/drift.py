"""Distribution drift between a reference and a current table, all features at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.operators.series import null_safe_join, running, series_window, with_position

PSI_BINS = 10
EPS = 1e-6


def feature_rows(df: DataFrame, features: list[str], side: str) -> DataFrame:
    """(feature, value, side) rows; one scan for all features."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    return df.select(F.inline(entries)).where(F.col("v").isNotNull()).withColumn("side", F.lit(side))


def paired_histogram(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Distinct values per feature with their count on each side."""
    rows = feature_rows(reference, features, "r").unionByName(feature_rows(current, features, "c"))
    return rows.groupBy("feature", "v").agg(
        F.count_if(F.col("side") == "r").alias("n_ref"), F.count_if(F.col("side") == "c").alias("n_cur")
    )


def totals(hist: DataFrame) -> DataFrame:
    return hist.groupBy("feature").agg(
        F.sum("n_ref").alias("total_ref"),
        F.sum("n_cur").alias("total_cur"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    )


def ks_pvalue(stat: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value: 2 * sum (-1)^(k-1) exp(-2 k^2 x^2), x = D sqrt(nm/(n+m))."""
    x = stat * F.sqrt(n * m / (n + m))

    def add_term(total: Column, k: Column) -> Column:
        sign = F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        return total + sign * F.exp(F.lit(-2.0) * k * k * x * x)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), add_term)
    # below this the alternating series has not converged, and the p-value is 1
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def ecdf_distances(hist: DataFrame, min_block: int = 4096) -> DataFrame:
    """KS statistic and Wasserstein-1 distance per feature from running counts.

    Values are range-sorted over all tasks, so a feature with very many distinct
    values is not ranked in one task.
    """
    placed = with_position(hist, ["feature"], ["v"])
    cum = running(placed, ["feature"], sums={"c_ref": F.col("n_ref"), "c_cur": F.col("n_cur")}, min_block=min_block)
    nxt = series_window(cum, ["feature"], lambda w: {"_next": F.lead("v", 1).over(w)}, after=1, min_block=min_block)
    joined = null_safe_join(nxt, totals(hist), ["feature"])
    gap = F.abs(F.try_divide("c_ref", "total_ref") - F.try_divide("c_cur", "total_cur"))
    return joined.groupBy("feature").agg(
        F.max("total_ref").alias("n_ref"),
        F.max("total_cur").alias("n_cur"),
        F.max(gap).alias("ks_statistic"),
        F.sum(gap * (F.col("_next") - F.col("v"))).alias("wasserstein_distance"),
    )


def psi(hist: DataFrame) -> DataFrame:
    """Population stability index over ten equal bins of the joint range."""
    bounds = totals(hist)
    width = (F.col("high") + EPS - F.col("low")) / PSI_BINS
    binned = null_safe_join(hist, bounds, ["feature"]).withColumn(
        "bin", F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(PSI_BINS - 1)).cast("int")
    )
    counts = binned.groupBy("feature", "bin").agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c"))
    # every feature gets all ten bins, from a fixed array
    grid = bounds.select("feature", "total_ref", "total_cur", F.explode(F.sequence(F.lit(0), F.lit(PSI_BINS - 1))).alias("bin"))
    full = grid.join(counts, ["feature", "bin"], "left")
    e = F.coalesce(F.col("r"), F.lit(0)) / F.col("total_ref") + F.lit(EPS)
    a = F.coalesce(F.col("c"), F.lit(0)) / F.col("total_cur") + F.lit(EPS)
    return full.groupBy("feature").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    features: list[str],
    significance: float = 0.05,
    psi_threshold: float = 0.2,
    wasserstein_threshold: float = 0.5,
    min_rows: int = 10,
) -> DataFrame:
    """All three tests per feature, the number that fired, and the severity."""
    hist = paired_histogram(reference, current, features)
    out = null_safe_join(ecdf_distances(hist), psi(hist), ["feature"])
    enough = (F.col("n_ref") >= min_rows) & (F.col("n_cur") >= min_rows)
    out = out.withColumn("ks_pvalue", ks_pvalue(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"))).withColumns({
        "ks_drift_detected": F.col("ks_pvalue") < significance,
        "wasserstein_drift_detected": F.col("wasserstein_distance") > wasserstein_threshold,
        "psi_drift_detected": F.col("psi") > psi_threshold,
    })
    fired = sum(
        (F.col(f"{t}_drift_detected").cast("int") for t in ("ks", "wasserstein", "psi")), F.lit(0)
    )
    return out.withColumn("tests_failed", fired).withColumns({
        "drift_detected": F.col("tests_failed") > 0,
        "status": F.when(enough, F.lit("ok")).otherwise(F.lit("insufficient_data")),
        "severity": F.when(~enough, F.lit("none")).otherwise(severity("tests_failed")),
    })


def severity(tests_failed) -> Column:
    n = F.col(tests_failed)
    return F.when(n == 0, F.lit("none")).when(n == 1, F.lit("low")).when(n == 2, F.lit("medium")).otherwise(F.lit("high"))


def retrain_decision(drift: DataFrame) -> DataFrame:
    """Retrain on any high severity or at least three medium ones."""
    high, medium = F.count_if(F.col("severity") == "high"), F.count_if(F.col("severity") == "medium")
    return drift.agg(
        F.count(F.lit(1)).alias("features_checked"),
        F.count_if("drift_detected").alias("features_drifted"),
        ((high > 0) | (medium >= 3)).alias("should_retrain"),
    )


def prediction_drift(reference: DataFrame, current: DataFrame, column: str, significance: float = 0.05) -> DataFrame:
    hist = paired_histogram(reference, current, [column])
    d = ecdf_distances(hist)
    moments = lambda df, tag: df.agg(
        F.lit(column).alias("feature"),
        F.avg(column).alias(f"prediction_mean_{tag}"),
        F.stddev_pop(column).alias(f"prediction_std_{tag}"),
    )
    out = d.join(moments(reference, "ref"), "feature").join(moments(current, "cur"), "feature")
    p = ks_pvalue(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"))
    return out.withColumn("ks_pvalue", p).withColumn("drift_detected", F.col("ks_pvalue") < significance)


def drift_summary(history: DataFrame) -> DataFrame:
    """Roll-up of a table of checks (checked_at, n_features_drifted)."""
    return history.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.max("checked_at").alias("last_check"),
        F.max_by("n_features_drifted", "checked_at").alias("last_drift_count"),
        F.sum("n_features_drifted").alias("total_drifts_detected"),
    )
