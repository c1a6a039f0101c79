"""Band, cut and lookup expressions generated from fixed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def closed_bands(value, bands, default=None, above=None) -> Column:
    """First (low, high, label) with low <= value <= high.

    ``above`` is the result past the highest band; anything else, a gap
    between integer bands for one, gives ``default``. Null gives ``default``.
    """
    v = col(value)
    expr = reduce(
        lambda acc, b: acc.when((v >= b[0]) & (v <= b[1]), F.lit(b[2])),
        bands[1:],
        F.when((v >= bands[0][0]) & (v <= bands[0][1]), F.lit(bands[0][2])),
    )
    if above is not None:
        expr = expr.when(v > bands[-1][1], F.lit(above))
    return expr.otherwise(F.lit(default))


def upper_cuts(value, cuts, top, null_label=None) -> Column:
    """First (bound, label) with value <= bound, else ``top``; null is its own case."""
    v = col(value)
    expr = F.when(v.isNull(), F.lit(null_label if null_label is not None else top))
    for bound, label in cuts:
        expr = expr.when(v <= bound, F.lit(label))
    return expr.otherwise(F.lit(top))


def right_closed(value, bins) -> Column:
    """Label of the (low, high] bin holding ``value``; outside all bins null."""
    v = col(value)
    expr = None
    for low, high, label in bins:
        cond = (v > low) if high is None else (v > low) & (v <= high)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def lookup(mapping: dict, key, default=None) -> Column:
    """Value of a fixed mapping; the map is a literal inside the plan."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def piecewise(value, breakpoints, above=None, otherwise=None) -> Column:
    """Linear index within (c_low, c_high, i_low, i_high) segments."""
    v = col(value)
    expr = None
    for c_lo, c_hi, i_lo, i_hi in breakpoints:
        inside = F.lit((i_hi - i_lo) / (c_hi - c_lo)) * (v - F.lit(float(c_lo))) + F.lit(float(i_lo))
        cond = (v >= c_lo) & (v <= c_hi)
        expr = F.when(cond, inside) if expr is None else expr.when(cond, inside)
    if above is not None:
        expr = expr.when(v > breakpoints[-1][1], above)
    return expr.otherwise(otherwise)
