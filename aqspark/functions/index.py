"""Air-quality index formulas and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions.bins import closed_bands, col, lookup, piecewise, upper_cuts


def cpcb_category(aqi) -> Column:
    return closed_bands(aqi, dims.CPCB_BANDS, default="Unknown", above="Severe")


def portal_category(aqi) -> Column:
    return closed_bands(aqi, dims.PORTAL_BANDS, default="Unknown", above="Severe")


def cpcb_pm25_index(pm25) -> Column:
    v = col(pm25)
    inside = piecewise(v, dims.CPCB_PM25_BREAKPOINTS, otherwise=F.lit(None).cast("double"))
    return F.coalesce(inside, F.when(v > 500, F.lit(500.0)).otherwise(F.lit(0.0)))


def aqi_cut_category(aqi, null_label: str = "Unknown") -> Column:
    return upper_cuts(aqi, dims.AQI_CUTS, dims.TOP_LABEL, null_label)


def pm25_cut_category(pm25, null_label: str = "Unknown") -> Column:
    return upper_cuts(pm25, dims.PM25_CUTS, dims.TOP_LABEL, null_label)


def training_pm25_index(pm25) -> Column:
    v = col(pm25)
    inside = piecewise(v, dims.EPA_TRAINING_PM25_BREAKPOINTS, otherwise=F.lit(None).cast("double"))
    return F.coalesce(inside, F.when(v > 500, F.lit(500.0)))


def epa_sub_index(value, pollutant: str) -> Column:
    """Rounded sub-index; above the last segment its line is extended."""
    v = col(value)
    points = dims.EPA_BREAKPOINTS[pollutant]
    c_lo, c_hi, i_lo, i_hi = points[-1]
    beyond = F.lit((i_hi - i_lo) / (c_hi - c_lo)) * (v - F.lit(float(c_lo))) + F.lit(float(i_lo))
    raw = piecewise(v, points, above=beyond, otherwise=F.lit(None).cast("double"))
    return F.floor(raw + F.lit(0.5)).cast("int")


def overall_index(values: dict[str, Column]) -> Column:
    """Largest sub-index over the pollutants given; nulls are skipped."""
    subs = [epa_sub_index(v, p) for p, v in values.items()]
    return subs[0] if len(subs) == 1 else F.greatest(*subs)


def dominant_pollutant(values: dict[str, Column]) -> Column:
    """Name of the largest sub-index; zero or absent input is skipped, first wins ties."""
    subs = [(p, F.when(v != 0, epa_sub_index(v, p))) for p, v in values.items()]
    best = F.greatest(*[s for _, s in subs])
    return F.coalesce(*[F.when(s == best, F.lit(p)) for p, s in subs])


def epa_category(aqi) -> Column:
    return closed_bands(aqi, dims.EPA_BANDS, default="Hazardous")


def risk_score(aqi) -> Column:
    return upper_cuts(aqi, dims.RISK_SCORE_CUTS, dims.RISK_SCORE_TOP)


def risk_score_label(score) -> Column:
    return lookup(dims.RISK_SCORE_LABELS, score, "Unknown")


def impact_score(aqi) -> Column:
    return closed_bands(aqi, dims.IMPACT_SCORE_BANDS, default=0, above=5)


def relative_risk(aqi) -> Column:
    return closed_bands(aqi, dims.RELATIVE_RISK_BANDS, default=1.0, above=5.0)


def zone(aqi) -> Column:
    return closed_bands(aqi, dims.ZONE_BANDS, default="unknown_zone", above="maroon_zone")


def class_index(aqi) -> Column:
    """Ordinal of the integer band, 0 in gaps and for null, 5 above 500."""
    bands = [(lo, hi, i) for i, (lo, hi, _) in enumerate(dims.CPCB_BANDS)]
    return closed_bands(aqi, bands, default=0, above=5)


def adjusted_risk(aqi, group, activity) -> Column:
    base = F.least(col(aqi) / F.lit(500.0) * F.lit(100.0), F.lit(100.0))
    adjusted = (
        base
        * lookup(dims.GROUP_SENSITIVITY, group, 1.0)
        * lookup(dims.ACTIVITY_EXPOSURE, activity, 1.0)
    )
    return F.least(adjusted, F.lit(100.0))


def risk_level(score) -> Column:
    return upper_cuts(score, dims.PERSONAL_RISK_CUTS, dims.PERSONAL_RISK_TOP)


def _collected(value, steps) -> Column:
    """Entries of every step whose bound the value exceeds, in step order."""
    v = col(value)
    none = F.array().cast("array<string>")
    return F.concat(*[
        F.when(v > bound, F.array(*[F.lit(x) for x in entries])).otherwise(none) for bound, entries in steps
    ])


def sensitive_groups(aqi) -> Column:
    return _collected(aqi, dims.SENSITIVE_GROUPS)


def group_warnings(aqi) -> Column:
    return _collected(aqi, dims.WARNINGS)


def _first_at_most(value, steps, build) -> Column:
    v = col(value)
    expr = None
    for step in steps:
        if step[0] is None:
            return expr.otherwise(build(step))
        expr = F.when(v <= step[0], build(step)) if expr is None else expr.when(v <= step[0], build(step))
    return expr


def recommendations(aqi, group) -> Column:
    def structs(rows):
        return F.array(*[
            F.struct(F.lit(c).alias("category"), F.lit(m).alias("message"), F.lit(p).alias("priority"))
            for c, m, p in rows
        ])

    g = col(group)
    base = _first_at_most(aqi, dims.RECOMMENDATIONS, lambda s: structs(s[1]))
    extra = F.array(F.struct(
        F.lit("precaution").alias("category"),
        F.concat(F.lit("Extra caution recommended for "), g, F.lit(" group.")).alias("message"),
        F.lit("high").alias("priority"),
    ))
    return F.when(g.isin(dims.PRECAUTION_GROUPS) & (col(aqi) > 50), F.concat(base, extra)).otherwise(base)


def activities(aqi, where: str) -> Column:
    i = 1 if where == "outdoor" else 2
    return _first_at_most(aqi, dims.ACTIVITIES, lambda s: F.array(*[F.lit(x) for x in s[i]]))


def impact_text(aqi, audience: str = "general") -> Column:
    i = 2 if audience == "general" else 3
    return closed_bands(aqi, [(row[0], row[1], row[i]) for row in dims.IMPACT_TEXT])


def limit_ratio(value, parameter, standard: str = "who") -> Column:
    i = 0 if standard == "who" else 1
    return F.try_divide(col(value), lookup({p: lim[i] for p, lim in dims.POLLUTANT_LIMITS.items()}, parameter))
