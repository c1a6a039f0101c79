"""Index formulas, health impact and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import calendar, geo, index
from aqspark.operators import cohort, health
from aqspark.plans.marts import rounded
from aqspark.plans.registry import query
from aqspark.plans.tables import CITIES, nth, sql_band_case, sql_cut_case, sql_piecewise, sql_right_closed, sql_season

ORDER = ["timestamp_utc", "reading_id"]


def sql_numeric_bands(column: str, bands, default, above) -> str:
    arms = " ".join(f"WHEN {column} BETWEEN {lo} AND {hi} THEN {v}" for lo, hi, v in bands)
    return f"(CASE {arms} WHEN {column} > {bands[-1][1]} THEN {above} ELSE {default} END)"


def sql_epa(column: str, pollutant: str) -> str:
    points = dims.EPA_BREAKPOINTS[pollutant]
    a, b, lo, hi = points[-1]
    beyond = f"CAST({(hi - lo) / (b - a)!r} AS DOUBLE) * ({column} - {float(a)}e0) + {float(lo)}e0"
    return f"CAST(floor({sql_piecewise(column, points, beyond)} + 5e-1) AS INTEGER)"


# four concentrations per event, each null for some rows
MIX = """mix AS (SELECT reading_id, CASE WHEN k % 10 <> 1 THEN value END AS pm25, CASE WHEN k % 10 <> 2 THEN value * 15e-1 END AS pm10,
  CASE WHEN k % 10 NOT IN (2, 3) THEN CASE WHEN k = 50 THEN 0e0 ELSE value * 2 END END AS no2, CASE WHEN k % 10 <> 4 THEN value / 3 END AS o3 FROM readings)"""


def mix(t):
    d, v = F.col("k") % 10, F.col("value")
    return t.readings.select(
        "reading_id",
        F.when(d != 1, v).alias("pm25"),
        F.when(d != 2, v * 1.5).alias("pm10"),
        F.when(~d.isin(2, 3), F.when(F.col("k") == 50, F.lit(0.0)).otherwise(v * 2)).alias("no2"),
        F.when(d != 4, v / 3).alias("o3"),
    )


POLLUTANTS = ["pm25", "pm10", "no2", "o3"]


@query("p12_epa_sub_index", MIX + " SELECT reading_id, " + ", ".join(f"{sql_epa(p, p)} AS {p}_aqi" for p in POLLUTANTS) + " FROM mix")
def epa(t):
    return mix(t).select("reading_id", *[index.epa_sub_index(p, p).alias(f"{p}_aqi") for p in POLLUTANTS])


_SUBS = ", ".join(f"{sql_epa(p, p)} AS s_{p}, CASE WHEN {p} <> 0 THEN {sql_epa(p, p)} END AS d_{p}" for p in POLLUTANTS)


@query("p13_overall_and_dominant", MIX + f""",
s AS (SELECT reading_id, {_SUBS} FROM mix)
SELECT reading_id, greatest(s_pm25, s_pm10, s_no2, s_o3) AS overall_aqi,
  CASE greatest(d_pm25, d_pm10, d_no2, d_o3) WHEN d_pm25 THEN 'pm25' WHEN d_pm10 THEN 'pm10' WHEN d_no2 THEN 'no2' WHEN d_o3 THEN 'o3' END AS dominant FROM s""")
def overall(t):
    values = {p: F.col(p) for p in POLLUTANTS}
    return mix(t).select(
        "reading_id", index.overall_index(values).alias("overall_aqi"), index.dominant_pollutant(values).alias("dominant")
    )


_SCORE = sql_cut_case("value", [(b, s) for b, s in dims.RISK_SCORE_CUTS], 6)
_LABEL = "(CASE " + " ".join(f"WHEN {_SCORE} = {s} THEN '{lab}'" for s, lab in dims.RISK_SCORE_LABELS.items()) + " END)"


@query("p14_epa_category_and_risk", f"""
SELECT reading_id, {sql_band_case('value', dims.EPA_BANDS, 'Hazardous', 'Hazardous')} AS category, {_SCORE} AS risk_score, {_LABEL} AS risk_label FROM readings""")
def epa_category(t):
    return t.readings.select(
        "reading_id", index.epa_category("value").alias("category"), index.risk_score("value").alias("risk_score"),
        index.risk_score_label(index.risk_score("value")).alias("risk_label"),
    )


@query("p15_training_pm25_index", f"""
SELECT reading_id, round({sql_piecewise('value', dims.EPA_TRAINING_PM25_BREAKPOINTS, 'CASE WHEN value > 500 THEN 5e2 END')}, 6) AS aqi FROM readings""")
def training_index(t):
    return t.readings.select("reading_id", F.round(index.training_pm25_index("value"), 6).alias("aqi"))


GROUPS = [*dims.GROUP_SENSITIVITY, "visitors"]
ACTIVITIES = list(dims.ACTIVITY_EXPOSURE)
_G = f"([{', '.join(repr(g) for g in GROUPS)}])[reading_id % {len(GROUPS)} + 1]"
_A = f"([{', '.join(repr(a) for a in ACTIVITIES)}])[reading_id % {len(ACTIVITIES)} + 1]"
_GM = "coalesce(CASE grp " + " ".join(f"WHEN '{g}' THEN {m}e0" for g, m in dims.GROUP_SENSITIVITY.items()) + " END, 1e0)"
_AM = "coalesce(CASE act " + " ".join(f"WHEN '{a}' THEN {m}e0" for a, m in dims.ACTIVITY_EXPOSURE.items()) + " END, 1e0)"


def people(t):
    rid = F.col("reading_id")
    return t.readings.select("reading_id", "value", nth(GROUPS, rid % len(GROUPS)).alias("grp"), nth(ACTIVITIES, rid % len(ACTIVITIES)).alias("act"))


@query("p17_personal_risk", f"""
g AS (SELECT reading_id, value, {_G} AS grp, {_A} AS act FROM readings),
r AS (SELECT *, least(least(value / 500 * 100, 1e2) * {_GM} * {_AM}, 1e2) AS s FROM g)
SELECT reading_id, grp, act, round(s, 6) AS score, {sql_cut_case('s', dims.PERSONAL_RISK_CUTS, 'Extreme')} AS level,
  concat_ws(';', CASE WHEN value > 50 THEN 'People with respiratory conditions' END, CASE WHEN value > 100 THEN 'Children;Elderly' END,
    CASE WHEN value > 150 THEN 'Outdoor workers;Athletes' END, CASE WHEN value > 200 THEN 'General population' END) AS sensitive_groups FROM r""")
def personal(t):
    out = health.personal_risk(people(t), "value", "grp", "act", digits=6)
    return out.withColumn("sensitive_groups", F.array_join("sensitive_groups", ";")).drop("value")


@query("p18_advisories")
def advisories(t):
    return health.advisories(people(t), "value", "grp").drop("value")


@query("p18_warnings", "SELECT reading_id, concat_ws(';', " + ", ".join(
    f"CASE WHEN value > {b} THEN '{';'.join(w)}' END" for b, w in dims.WARNINGS) + ") AS warnings FROM readings")
def warnings(t):
    return t.readings.select("reading_id", F.array_join(index.group_warnings("value"), ";").alias("warnings"))


@query("p28_time_period", """
SELECT reading_id, CASE WHEN hour(timestamp_utc) BETWEEN 7 AND 10 THEN 'morning_rush' WHEN hour(timestamp_utc) BETWEEN 11 AND 16 THEN 'midday'
  WHEN hour(timestamp_utc) BETWEEN 17 AND 20 THEN 'evening_rush' ELSE 'night' END AS time_period FROM readings""")
def time_period(t):
    return t.readings.select("reading_id", calendar.day_period(F.hour("timestamp_utc")).alias("time_period"))


@query("p30_coordinates_and_city_names", """
SELECT s_suppkey, s_acctbal / 100 BETWEEN -90 AND 90 AND s_acctbal / 40 BETWEEN -180 AND 180 AS valid,
  replace(lower(trim('  New ' || s_name || ' City ')), ' ', '_') AS city FROM supplier""")
def coordinates(t):
    s = t.raw("supplier")
    return s.select(
        "s_suppkey", geo.valid_coordinates(F.col("s_acctbal") / 100, F.col("s_acctbal") / 40).alias("valid"),
        geo.normalised_city(F.concat(F.lit("  New "), "s_name", F.lit(" City "))).alias("city"),
    )


def _limit(i: int) -> str:
    return "CASE parameter " + " ".join(f"WHEN '{p}' THEN {lim[i]}e0" for p, lim in dims.POLLUTANT_LIMITS.items()) + " END"


@query("p31_limit_ratios", f"""
SELECT reading_id, round(value / ({_limit(0)}), 6) AS who_ratio, round(value / ({_limit(1)}), 6) AS national_ratio FROM readings""")
def limits(t):
    return t.readings.select(
        "reading_id", F.round(index.limit_ratio("value", "parameter"), 6).alias("who_ratio"),
        F.round(index.limit_ratio("value", "parameter", "national"), 6).alias("national_ratio"),
    )


def profiles(t):
    key = F.col("c_custkey")
    conditions = F.array_compact(F.array(F.when(key % 3 == 0, F.lit("asthma")), F.when(key % 7 == 0, F.lit("copd"))))
    return t.raw("customer").select(
        key.alias("user_id"),
        nth(["child", "teen", "adult", "senior"], key % 4).alias("age_group"),
        conditions.alias("conditions"),
        (key % 11 == 0).alias("is_pregnant"),
        nth(["low", "moderate", "high"], key % 3).alias("activity_level"),
        (key % 2 == 0).alias("uses_mask"),
        (key % 5 == 0).alias("has_air_purifier"),
    )


@query("p32_personal_factors", """
SELECT c_custkey AS user_id, concat_ws('|', CASE c_custkey % 4 WHEN 0 THEN 'Child — Higher sensitivity:warning' WHEN 3 THEN 'Senior — Higher sensitivity:warning' END,
  CASE WHEN c_custkey % 21 = 0 THEN 'Has asthma, copd — Extra caution needed:danger' WHEN c_custkey % 3 = 0 THEN 'Has asthma — Extra caution needed:danger'
    WHEN c_custkey % 7 = 0 THEN 'Has copd — Extra caution needed:danger' END,
  CASE WHEN c_custkey % 11 = 0 THEN 'Pregnancy — Avoid polluted areas:danger' END,
  CASE WHEN c_custkey % 3 = 2 THEN 'High outdoor activity — Increased exposure risk:warning' END,
  CASE WHEN c_custkey % 2 = 0 THEN 'Uses mask — Partial protection:good' END,
  CASE WHEN c_custkey % 5 = 0 THEN 'Has air purifier — Better indoor protection:good' END) AS factors FROM customer""")
def factors(t):
    text = F.transform("factors", lambda f: F.concat(f["label"], F.lit(":"), f["severity"]))
    return health.personal_factors(profiles(t)).select("user_id", F.array_join(text, "|").alias("factors"))


# --- health impact ---

IX = "ix AS (SELECT * FROM readings WHERE parameter IN ('aqi', 'pm25')), cm AS (SELECT city, avg(value) AS avg_aqi FROM ix GROUP BY 1)"
_POP1 = "coalesce(CASE city " + " ".join(f"WHEN '{c}' THEN {p}e0" for c, p in dims.CITY_POPULATION_MILLIONS.items()) + " END, 1e0)"
_CAT = sql_band_case("avg_aqi", dims.CPCB_BANDS, "Unknown", "Severe")
_IMPACT = sql_numeric_bands("avg_aqi", dims.IMPACT_SCORE_BANDS, 0, 5)
_RR = sql_numeric_bands("avg_aqi", [(a, b, f"CAST({r} AS DOUBLE)") for a, b, r in dims.RELATIVE_RISK_BANDS], "1e0", "5e0")
_DEMO = ", ".join(f"('{n}', CAST({m} AS DOUBLE), CAST({s} AS DOUBLE))" for n, (m, s) in dims.DEMOGRAPHICS.items())
_OUTCOMES = ", ".join(f"('{n}', {float(r)}e0)" for n, r in dims.BASELINE_RATES_PER_100K.items())
EXPOSURE = IX + f""", ex AS (SELECT {_CAT} AS health_category, count(*) AS cities_affected, sum({_POP1}) AS total_population_millions,
  round(avg(avg_aqi), 6) AS avg_aqi, round(max(avg_aqi), 6) AS max_aqi FROM cm GROUP BY 1)"""
DEMOGRAPHIC = f"""demo(demographic, vulnerability_multiplier, sh) AS (VALUES {_DEMO}),
dr AS (SELECT demographic, city, round(avg_aqi, 6) AS avg_aqi, {_IMPACT} AS impact_score, vulnerability_multiplier,
  round({_IMPACT} * vulnerability_multiplier, 6) AS risk_score, CAST(floor({_POP1} * 1000000 * sh) AS BIGINT) AS exposed_population,
  round({_IMPACT} * vulnerability_multiplier * ({_POP1} * 1000000 * sh) / 1000000, 6) AS risk_weighted_exposure FROM cm CROSS JOIN demo)"""
VULNERABILITY = f"""vs AS (SELECT city, avg(value) AS a, max(value) AS m, stddev_samp(value) AS s FROM ix GROUP BY 1),
vi AS (SELECT *, {_POP1} AS p, round(least(a / 500 * 100, 1e2) * 4e-1 + least(m / 500 * 100, 1e2) * 25e-2
  + coalesce(least(s / 100 * 100, 1e2), 0e0) * 15e-2 + least({_POP1} / 30 * 100, 1e2) * 2e-1, 6) AS vulnerability_index FROM vs),
vul AS (SELECT city, round(a, 6) AS avg_aqi, round(m, 6) AS max_aqi, round(s, 6) AS aqi_std, p AS population_millions, vulnerability_index,
  {sql_right_closed('vulnerability_index', dims.VULNERABILITY_BINS)} AS vulnerability_level FROM vi)"""
OUTCOMES = f"""oc(health_outcome, rate) AS (VALUES {_OUTCOMES}),
ho AS (SELECT city, round(avg_aqi, 6) AS avg_aqi, {_RR} AS relative_risk, health_outcome,
  CAST(floor(rate * {_RR} * ({_POP1} * 1000000 / 100000)) AS BIGINT) AS estimated_annual_cases,
  CAST(floor(rate * {_RR} * ({_POP1} * 1000000 / 100000) - rate * ({_POP1} * 1000000 / 100000)) AS BIGINT) AS pollution_attributable_cases,
  CAST(floor({_POP1} * 1000000) AS BIGINT) AS population FROM cm CROSS JOIN oc)"""
TEMPORAL = f"""tp AS (SELECT city, CASE WHEN hour(timestamp_utc) BETWEEN 7 AND 10 THEN 'morning_rush' WHEN hour(timestamp_utc) BETWEEN 11 AND 16 THEN 'midday'
  WHEN hour(timestamp_utc) BETWEEN 17 AND 20 THEN 'evening_rush' ELSE 'night' END AS time_period, avg(value) AS avg_aqi, max(value) AS max_aqi,
  count(*) AS reading_count FROM ix GROUP BY 1, 2),
tr AS (SELECT city, time_period, round(avg_aqi, 6) AS avg_aqi, round(max_aqi, 6) AS max_aqi, reading_count, {_CAT} AS health_category FROM tp)"""


def ix(t):
    return health.index_readings(t.readings)


@query("p04_index_readings", IX + " SELECT reading_id, parameter, value FROM ix")
def index_rows(t):
    return ix(t).select("reading_id", "parameter", "value")


@query("p04_fallback_to_all", "SELECT reading_id, parameter || '_raw' AS parameter, value FROM readings")
def fallback_rows(t):
    # a feed that names its parameters otherwise has no index rows, so all of its rows serve
    others = t.readings.withColumn("parameter", F.concat("parameter", F.lit("_raw")))
    return health.index_readings(others).select("reading_id", "parameter", "value")


@query("a13_exposure_by_category", EXPOSURE + " SELECT * FROM ex")
def exposure(t):
    return rounded(health.exposure_by_category(ix(t)))


@query("j10_population_join", IX + f" SELECT city, {_POP1} AS population_millions, round(avg_aqi, 6) AS avg_aqi FROM cm")
def population(t):
    return rounded(health.city_means(ix(t)).withColumn("population_millions", health.population()))


@query("a16_demographic_risk", IX + ", " + DEMOGRAPHIC + " SELECT * FROM dr")
def demographic(t):
    return health.risk_by_demographic(ix(t), digits=6)


@query("j11_city_by_demographic", IX + f", demo(demographic, m, sh) AS (VALUES {_DEMO}) SELECT city, demographic, CAST(floor({_POP1} * 1000000 * sh) AS BIGINT) AS exposed_population FROM cm CROSS JOIN demo")
def city_by_demographic(t):
    return health.risk_by_demographic(ix(t)).select("city", "demographic", "exposed_population")


@query("a14_city_vulnerability", IX + ", " + VULNERABILITY + " SELECT * FROM vul")
def vulnerability(t):
    return rounded(health.city_vulnerability(ix(t), digits=6))


@query("a17_health_outcomes", IX + ", " + OUTCOMES + " SELECT * FROM ho")
def outcomes(t):
    return health.health_outcomes(ix(t), digits=6)


_BANDS = ", ".join(f"({a}, {b}, CAST({r} AS DOUBLE))" for a, b, r in dims.RELATIVE_RISK_BANDS)


@query("j12_relative_risk_band", IX + f""", rr(lo, hi, r) AS (VALUES {_BANDS}), oc(health_outcome, rate) AS (VALUES {_OUTCOMES})
SELECT city, health_outcome, coalesce(r, CASE WHEN avg_aqi > 500 THEN 5e0 ELSE 1e0 END) AS relative_risk
FROM cm CROSS JOIN oc LEFT JOIN rr ON avg_aqi BETWEEN lo AND hi""")
def risk_band(t):
    return health.health_outcomes(ix(t)).select("city", "health_outcome", "relative_risk")


@query("a15_temporal_risk", IX + ", " + TEMPORAL + " SELECT * FROM tr")
def temporal(t):
    return rounded(health.temporal_risk(ix(t)))


# --- cohorts ---

_ZONE = sql_band_case("avg_aqi", dims.ZONE_BANDS, "unknown_zone", "maroon_zone")
_ORD = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{n}' THEN {i}" for i, (_, _, n) in enumerate(dims.ZONE_BANDS)) + " END"


def _zone_sql(unit: str) -> str:
    return f"""zc AS (SELECT city, CAST(date_trunc('{unit}', timestamp_utc) AS DATE) AS period, avg(value) AS avg_aqi, max(value) AS max_aqi, min(value) AS min_aqi,
  stddev_samp(value) AS std_aqi, count(*) AS reading_count FROM readings GROUP BY 1, 2),
zz AS (SELECT *, {_ZONE} AS zone FROM zc), zp AS (SELECT *, lag(zone) OVER (PARTITION BY city ORDER BY period) AS prev_zone FROM zz)
SELECT city, period, round(avg_aqi, 6) AS avg_aqi, round(max_aqi, 6) AS max_aqi, round(min_aqi, 6) AS min_aqi, round(std_aqi, 6) AS std_aqi,
  reading_count, zone, prev_zone, CASE WHEN prev_zone IS NULL THEN 'new' WHEN {_ORD('prev_zone')} IS NULL OR {_ORD('zone')} IS NULL THEN 'unknown'
  WHEN {_ORD('zone')} < {_ORD('prev_zone')} THEN 'improved' WHEN {_ORD('zone')} > {_ORD('prev_zone')} THEN 'degraded' ELSE 'stable' END AS zone_change FROM zp"""


@query("a18_zone_cohort_weekly", _zone_sql("week"))
def zones_weekly(t):
    return rounded(cohort.zone_cohorts(t.readings, "weekly"))


@query("a18_zone_cohort_monthly", _zone_sql("month"))
def zones_monthly(t):
    return rounded(cohort.zone_cohorts(t.readings, "monthly"))


@query("w12_zone_transitions_daily", _zone_sql("day"))
def zones_daily(t):
    return rounded(cohort.zone_cohorts(t.readings, "daily"))


@query("a19_trends", """
td AS (SELECT city, CAST(timestamp_utc AS DATE) AS day, avg(value) AS y, count(*) AS n FROM readings GROUP BY 1, 2),
ti AS (SELECT *, CAST(row_number() OVER (PARTITION BY city ORDER BY day) - 1 AS DOUBLE) AS x FROM td),
tf AS (SELECT city, regr_slope(y, x) AS s, coalesce(regr_r2(y, x), 0e0) AS r2, min(day) AS period_start, max(day) AS period_end, count(*) AS data_points,
  avg(y) AS a, sum(n) AS n FROM ti GROUP BY 1 HAVING sum(n) >= 10 AND count(*) >= 7)
SELECT city, round(s, 6) AS trend_slope, CASE WHEN s < -5e-1 THEN 'improving' WHEN s > 5e-1 THEN 'degrading' ELSE 'stable' END AS trend_direction,
  round(abs(s) * 30, 6) AS monthly_aqi_change, round(r2, 6) AS r_squared, period_start, period_end, data_points, round(a, 6) AS avg_aqi FROM tf""")
def trends(t):
    return cohort.trends(t.readings, digits=(6, 6))


# order dates span years, so all seasons occur
_SEASONS = f"""ss AS (SELECT ([{', '.join(repr(c) for c in CITIES)}])[o_custkey % 10 + 1] AS city, o_totalprice / 1000 * CAST(1.0471975511965976 AS DOUBLE) AS value, o_orderdate AS ts FROM orders),
sa AS (SELECT city, {sql_season('ts', 'post_monsoon')} AS season, avg(value) AS a, max(value) AS mx, min(value) AS mn, stddev_samp(value) AS sd, count(*) AS n FROM ss GROUP BY 1, 2)"""


def priced(t):
    return t.raw("orders").select(
        nth(CITIES, F.col("o_custkey") % 10).alias("city"),
        (F.col("o_totalprice") / 1000 * F.lit(1.0471975511965976)).alias("value"),
        F.col("o_orderdate").alias("timestamp_utc"),
    )


@query("a20_seasonal_statistics", _SEASONS + """
SELECT city, season, round(a, 6) AS avg_aqi, round(mx, 6) AS max_aqi, round(mn, 6) AS min_aqi, round(sd, 6) AS std_aqi, n AS reading_count FROM sa""")
def seasons(t):
    return rounded(cohort.seasonal(priced(t)))


_EXTREMES = _SEASONS + """, wr AS (SELECT city, season, a FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY a DESC, season) AS rn FROM sa) WHERE rn = 1),
br AS (SELECT city, season, a FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY a, season) AS rn FROM sa) WHERE rn = 1)
SELECT coalesce(wr.city, br.city) AS city, wr.season AS worst_season, round(wr.a, 6) AS worst_season_avg_aqi, br.season AS best_season,
  round(br.a, 6) AS best_season_avg_aqi, round(wr.a - br.a, 6) AS seasonal_variation FROM wr FULL OUTER JOIN br ON wr.city = br.city"""


@query("a20_worst_and_best_season", _EXTREMES)
def extremes(t):
    return rounded(cohort.season_extremes(cohort.seasonal(priced(t)), digits=6))


@query("j09_season_outer_join", _EXTREMES)
def extremes_join(t):
    return rounded(cohort.season_extremes_by_join(cohort.seasonal(priced(t)), digits=6))


_RK = lambda c, o: f"CAST(floor(rank() OVER (ORDER BY {c} {o}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) AS BIGINT)"


@query("a21_city_rankings", f"""
rc AS (SELECT city, avg(value) AS a, max(value) AS m, stddev_samp(value) AS s, count(*) AS reading_count, count(*) FILTER (WHERE value > 200) AS unhealthy_hours FROM readings GROUP BY 1),
rr AS (SELECT *, {_RK('a', 'DESC')} AS rank_avg, {_RK('m', 'DESC')} AS rank_peak, {_RK('unhealthy_hours', 'DESC')} AS rank_unhealthy FROM rc),
rs AS (SELECT *, rank_avg * 4e-1 + rank_peak * 3e-1 + rank_unhealthy * 3e-1 AS sc FROM rr)
SELECT city, round(a, 6) AS avg_aqi, round(m, 6) AS max_aqi, round(s, 6) AS std_aqi, reading_count, unhealthy_hours, rank_avg, rank_peak, rank_unhealthy,
  {_RK('sc', 'ASC')} AS composite_rank FROM rs""")
def rankings(t):
    return rounded(cohort.rankings(t.readings))


@query("j08_unhealthy_hours_or_zero", """
c AS (SELECT DISTINCT city FROM readings), u AS (SELECT city, count(*) AS n FROM readings WHERE value > 400 GROUP BY 1)
SELECT city, coalesce(n, 0) AS unhealthy_hours FROM c LEFT JOIN u USING (city)""")
def unhealthy_or_zero(t):
    return cohort.rankings(t.readings, threshold=400).select("city", "unhealthy_hours")


_RUNS = """ep AS (SELECT reading_id, city, timestamp_utc, value > 200 AS poor, lag(value > 200) OVER w AS p0 FROM readings WINDOW w AS (PARTITION BY city ORDER BY timestamp_utc, reading_id)),
er AS (SELECT *, CAST(sum(CASE WHEN p0 IS NOT DISTINCT FROM poor THEN 0 ELSE 1 END) OVER (PARTITION BY city ORDER BY timestamp_utc, reading_id) AS BIGINT) AS run_id FROM ep),
el AS (SELECT city, run_id, poor, count(*) AS n FROM er GROUP BY 1, 2, 3)"""


@query("w14_episodes", _RUNS + " SELECT city, run_id, n AS length FROM el WHERE poor")
def episodes(t):
    return cohort.episodes(cohort.episode_rows(t.readings.select("city", "value", *ORDER), ORDER))


@query("a22_persistence", _RUNS + """
SELECT city, 200 AS poor_threshold, CAST(sum(n) FILTER (WHERE poor) AS BIGINT) AS total_poor_hours, round(sum(n) FILTER (WHERE poor) / sum(n) * 100, 6) AS poor_pct,
  count(*) FILTER (WHERE poor) AS num_episodes, round(coalesce(avg(n) FILTER (WHERE poor), 0e0), 6) AS avg_episode_length_hours,
  coalesce(max(n) FILTER (WHERE poor), 0) AS max_episode_length_hours FROM el GROUP BY 1 HAVING sum(n) >= 10""")
def persistence(t):
    return cohort.persistence(t.readings.select("city", "value", *ORDER), ORDER, digits=(6, 6))
