"""Time bins, seasons and cyclical encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions.bins import col, flag


def local_time(ts, zone: str = "Asia/Kolkata") -> Column:
    """UTC instant as wall-clock time in ``zone``."""
    return F.from_utc_timestamp(col(ts), zone)


def season(ts, late_label: str = "autumn") -> Column:
    """Season by month; ``late_label`` names October and November."""
    month = F.month(col(ts))
    expr = None
    for name, months in dims.SEASON_MONTHS.items():
        label = late_label if name == "autumn" else name
        hit = month.isin(months)
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr


def day_period(hour) -> Column:
    h = col(hour)
    expr = None
    for low, high, label in dims.TIME_PERIODS:
        hit = h.between(low, high)
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr.otherwise(F.lit(dims.TIME_PERIOD_REST))


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: str, rush_hours=None, year_days: float = 365) -> dict[str, Column]:
    """Hour, weekday, month and day-of-year features of a timestamp column."""
    t = F.col(ts)
    hour, dow = F.hour(t), F.weekday(t)
    month, doy = F.month(t), F.dayofyear(t)
    out = {"hour_of_day": hour, "day_of_week": dow, "month": month, "day_of_year": doy}
    for name, value, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12), ("doy", doy, year_days)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cycle(value, period)
    out["is_weekend"] = flag(dow >= 5)
    out["is_rush_hour"] = flag(hour.isin(rush_hours or dims.RUSH_HOURS))
    return out


def season_columns(ts: str, late_label: str = "post_monsoon") -> dict[str, Column]:
    names = [late_label if n == "autumn" else n for n in dims.SEASON_MONTHS]
    s = season(ts, late_label)
    return {"season": s, **{f"season_{n}": flag(s == n) for n in names}}


def is_holiday(ts) -> Column:
    return flag(F.date_format(col(ts), "yyyy-MM-dd").isin(dims.HOLIDAYS))


def is_daytime(ts) -> Column:
    return flag(F.hour(col(ts)).between(6, 18))
