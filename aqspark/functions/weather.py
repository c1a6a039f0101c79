"""Weather-derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions.bins import flag, right_closed


def derived(columns: list[str], ts: str = "timestamp_utc") -> dict[str, Column]:
    """Columns derived from whichever weather columns the frame has."""
    from aqspark.functions.calendar import season

    have = set(columns)
    out: dict[str, Column] = {}
    t, rh = F.col("temperature_2m"), F.col("relative_humidity_2m")
    if {"temperature_2m", "relative_humidity_2m"} <= have:
        out["heat_index"] = 0.5 * (t + 61.0 + ((t - 68.0) * 1.2) + (rh * 0.094))
        out["temp_humidity_index"] = t * rh / 100
    if "wind_speed_10m" in have:
        out["wind_category"] = wind_category("wind_speed_10m")
    if "precipitation" in have:
        out["is_raining"] = flag(F.col("precipitation") > 0)
    if "visibility" in have:
        out["low_visibility"] = flag(F.col("visibility") < 2000)
    if ts in have:
        out["hour_of_day"] = F.hour(ts)
        out["is_weekend"] = flag(F.weekday(ts).isin(5, 6))
        out["season"] = season(ts)
    return out


def wind_category(speed) -> Column:
    return right_closed(speed, dims.WIND_BINS)


def wind_components(speed: str, direction: str) -> tuple[Column, Column]:
    rad = F.radians(F.col(direction))
    return F.col(speed) * F.cos(rad), F.col(speed) * F.sin(rad)


def interactions(value: str) -> dict[str, Column]:
    t, rh = F.col("temperature_2m"), F.col("relative_humidity_2m")
    w, p, v = F.col("wind_speed_10m"), F.col("precipitation"), F.col(value)
    still = F.lit(1.0) / (w + 0.1)
    # a null temperature must stay null, and greatest() would skip it
    cold = F.when(t.isNotNull(), F.greatest(F.lit(0.0), F.lit(20.0) - t))
    return {
        "temp_x_humidity": t * rh / 100,
        "wind_x_aqi": w * v,
        "stagnation_index": still,
        "inversion_proxy": still * rh / 100 * cold,
        "rain_cleanup": p * v,
    }
