"""Exact percentiles (linear interpolation) for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.operators.series import running, with_position


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float]) -> DataFrame:
    """One row per key with the named percentiles of ``value``.

    Equal values are counted before the first shuffle. The distinct values are
    then range-sorted over all tasks and ranked with running counts, so no task
    holds a whole group.
    """
    v = F.col(value) if isinstance(value, str) else value
    keyed = df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        keyed = keyed.withColumn("_all", F.lit(1))
    group = keys or ["_all"]
    hist = keyed.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_w"))
    placed = with_position(hist, group, ["_v"])
    ranked = running(placed, group, sums={"_cum": F.col("_w")}, totals=True).withColumnRenamed("_cum_total", "_total")
    picks = []
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("_total") - 1)
        for tag, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            inside = (F.col("_cum") - F.col("_w") <= r) & (r < F.col("_cum"))
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{tag}_{name}"))
    out = ranked.groupBy(*group).agg(F.max("_total").alias("_total"), *picks)
    cols = []
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return out.select(*keys, *cols)
