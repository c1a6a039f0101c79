"""Ordered computations over series of any length.

A window partitioned by a series key puts the whole series into one task. A
series may hold a third of all rows, so these helpers cut it by position:

* ``with_position`` range-sorts all rows and numbers them within their series;
  the sort splits a long series over many tasks.
* ``series_window`` runs bounded frames over blocks of a series, each block
  with the few rows its frames need from its neighbours.
* ``running`` adds running sums and last-known values: within blocks first,
  then over one row per block.

A block of a series of n rows has max(min_block, sqrt(n)) rows, so neither the
rows in a block nor the blocks in a series can grow out of hand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aqspark.session import settle

MIN_BLOCK = 4096
EWM_BLOCK = 256


def _sort_columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _series_id(keys: list[str]) -> Column:
    """Exact, never-null text of a series key.

    Windows and joins that use it, with a block number, share one partitioning;
    a null-safe comparison of the key columns would force another shuffle.
    """
    # each value follows its length, so no value can pass for several
    text = lambda k: F.col(k).cast("string")
    parts = [F.coalesce(F.concat(F.length(text(k)).cast("string"), F.lit(":"), text(k)), F.lit("-")) for k in keys]
    return F.concat(*parts) if parts else F.lit("")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join on ``keys`` in which null matches null; key columns come from the left."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def with_position(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Add ``_pos`` (0-based position in the series) and ``_n`` (its length).

    The rows are range-partitioned on key, order and a tie-breaking number, so
    a long series, or many copies of one row, is spread over tasks. The sorted
    rows are stored once: sampled range bounds may differ when recomputed.
    """
    by = [F.col(k) for k in keys] + _sort_columns(order) + [F.col("_tie")]
    ordered = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
        .drop("_tie")
    )
    stored = settle(ordered.withColumn("_sid", _series_id(keys)))
    runs = stored.groupBy("_sid", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_len"))
    # one row per series and sort partition it touches
    per_key = Window.partitionBy("_sid")
    before = per_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_sid",
        "_part",
        (F.coalesce(F.sum("_len").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_len").over(per_key).alias("_n"),
    )
    return (
        stored.join(runs, ["_sid", "_part"])
        .withColumn("_pos", F.col("_row") + F.col("_shift"))
        .drop("_sid", "_part", "_row", "_shift")
    )


def _block_length(min_block: int) -> Column:
    return F.greatest(F.lit(min_block), F.ceil(F.sqrt(F.col("_n")))).cast("long")


def series_window(
    positioned: DataFrame,
    keys: list[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    min_block: int = MIN_BLOCK,
) -> DataFrame:
    """Add columns computed over frames of at most ``before``/``after`` rows.

    ``build`` gets a window ordered by position and returns named expressions.
    Rows near a block's edge are copied into the neighbouring block, where they
    only feed the frames, and are dropped afterwards.
    """
    block_rows = max(min_block, before, after)
    length = _block_length(block_rows)
    block = F.floor(F.col("_pos") / length)
    offset = F.col("_pos") - block * length
    places = [F.struct(block.alias("_blk"), F.lit(True).alias("_own"))]
    if before:
        places.append(F.when(offset >= length - before, F.struct((block + 1).alias("_blk"), F.lit(False).alias("_own"))))
    if after:
        places.append(
            F.when((offset < after) & (block > 0), F.struct((block - 1).alias("_blk"), F.lit(False).alias("_own")))
        )
    placed = positioned.withColumn("_place", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())))
    placed = placed.select("*", "_place._blk", "_place._own").drop("_place")
    w = Window.partitionBy("_sid", "_blk").orderBy("_pos")
    return placed.withColumn("_sid", _series_id(keys)).withColumns(build(w)).where("_own").drop("_sid", "_blk", "_own")


def running(
    positioned: DataFrame,
    keys: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    min_block: int = MIN_BLOCK,
    totals: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add running sums, last and next non-null values, each including the row itself.

    With ``totals`` every sum also gets its total over the series as ``<name>_total``.
    ``source`` has the same rows as ``positioned`` before it was widened: the
    blocks are summed up from it, so that what widened it runs once.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    named = {**sums, **lasts, **nexts}
    columns = {
        "_sid": _series_id(keys), "_blk": F.floor(F.col("_pos") / _block_length(min_block)),
        **{f"_x_{n}": c for n, c in named.items()},
    }
    blocked = positioned.withColumns(columns)
    summed = blocked if source is None else source.withColumns(columns)

    def where_set(n: str) -> Column:
        return F.when(F.col(f"_x_{n}").isNotNull(), F.col("_pos"))

    per_block = [F.sum(f"_x_{n}").alias(f"_b_{n}") for n in sums]
    per_block += [F.max_by(f"_x_{n}", where_set(n)).alias(f"_b_{n}") for n in lasts]
    per_block += [F.min_by(f"_x_{n}", where_set(n)).alias(f"_b_{n}") for n in nexts]
    # a frame that reaches forward is written as one reaching back in descending
    # order: Spark grows such a frame row by row instead of rebuilding it
    back = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_sid").orderBy("_blk").rowsBetween(*back)
    later = Window.partitionBy("_sid").orderBy(F.col("_blk").desc()).rowsBetween(*back)
    carried = summed.groupBy("_sid", "_blk").agg(*per_block).select(
        "_sid",
        "_blk",
        *[F.sum(f"_b_{n}").over(Window.partitionBy("_sid")).alias(f"{n}_total") for n in sums if totals],
        *[F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_b_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts],
        *[F.last(f"_b_{n}", ignorenulls=True).over(later).alias(f"_c_{n}") for n in nexts],
    )
    rows = Window.partitionBy("_sid", "_blk")
    to_here = rows.orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    from_here = rows.orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({
        **{f"_l_{n}": F.coalesce(F.sum(f"_x_{n}").over(to_here), F.lit(0)) for n in sums},
        **{f"_l_{n}": F.last(f"_x_{n}", ignorenulls=True).over(to_here) for n in lasts},
        **{f"_l_{n}": F.last(f"_x_{n}", ignorenulls=True).over(from_here) for n in nexts},
    })
    joined = local.join(carried, ["_sid", "_blk"])
    out = joined.withColumns({
        **{n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in sums},
        **{n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in [*lasts, *nexts]},
    })
    extra = [f"_{p}_{n}" for p in "xlc" for n in named]
    return out.drop("_sid", "_blk", *extra)


def ewm_mean(positioned: DataFrame, keys: list[str], value: str, spans: dict[str, int], source: DataFrame | None = None) -> DataFrame:
    """Add exponentially weighted means (adjusted weights, nulls skipped) per span.

    Decayed sums are taken inside blocks of 256 rows; a block's sum then reaches
    as many later blocks as its weight stays above double precision. ``source``
    is as in ``running``.
    """
    b = EWM_BLOCK
    decay = {name: 1.0 - 2.0 / (span + 1.0) for name, span in spans.items()}
    columns = {
        "_sid": _series_id(keys), "_blk": F.floor(F.col("_pos") / b), "_off": (F.col("_pos") % b).cast("double"),
    }
    blocked = positioned.withColumns(columns)
    summed = blocked if source is None else source.withColumns(columns)
    x = F.coalesce(F.col(value), F.lit(0.0))
    seen = F.when(F.col(value).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))

    def power(d: float, exponent) -> Column:
        return F.pow(F.lit(d), exponent)

    sums = []
    for name, d in decay.items():
        weight = power(d, F.lit(float(b - 1)) - F.col("_off"))
        sums += [F.sum(x * weight).alias(f"_s_{name}"), F.sum(seen * weight).alias(f"_t_{name}")]
    per_block = summed.groupBy("_sid", "_blk").agg(*sums)
    reach = max(_reach(d) for d in decay.values())
    spread = per_block.withColumn("_ahead", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    carry = []
    for name, d in decay.items():
        fade = power(d, (F.col("_ahead") - 1).cast("double") * F.lit(float(b)))
        carry += [F.sum(F.col(f"_s_{name}") * fade).alias(f"_cs_{name}"), F.sum(F.col(f"_t_{name}") * fade).alias(f"_ct_{name}")]
    carried = spread.groupBy("_sid", (F.col("_blk") + F.col("_ahead")).alias("_blk")).agg(*carry)

    inside = Window.partitionBy("_sid", "_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = blocked
    for name, d in decay.items():
        grow = power(d, -F.col("_off"))
        local = local.withColumns({
            f"_ls_{name}": F.sum(x * grow).over(inside) * power(d, F.col("_off")),
            f"_lt_{name}": F.sum(seen * grow).over(inside) * power(d, F.col("_off")),
        })
    joined = local.join(carried, ["_sid", "_blk"], "left")
    out = {}
    for name, d in decay.items():
        fade = power(d, F.col("_off") + 1)
        num = F.col(f"_ls_{name}") + F.coalesce(F.col(f"_cs_{name}"), F.lit(0.0)) * fade
        den = F.col(f"_lt_{name}") + F.coalesce(F.col(f"_ct_{name}"), F.lit(0.0)) * fade
        out[name] = F.when(den > 0, num / den)
    extra = [f"_{p}_{n}" for p in ("ls", "lt", "cs", "ct") for n in decay]
    return joined.withColumns(out).drop("_sid", "_blk", "_off", *extra)


def _reach(decay: float) -> int:
    """Blocks until a weight falls below double precision."""
    import math

    return math.ceil(36.8 / (-math.log(decay)) / EWM_BLOCK) + 1
