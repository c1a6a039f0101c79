"""Quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.operators import clean, hotspot
from aqspark.operators import quality as ql
from aqspark.plans.cleaning import IQR, IQR_MARK, RAW_TYPED, TWO_FEEDS, raw_text, two_feeds
from aqspark.plans.hotspots import NB
from aqspark.plans.hotspots import stations as station_means
from aqspark.plans.marts import rounded
from aqspark.plans.registry import query
from aqspark.plans.tables import AS_OF, as_of


def typed(t):
    return clean.coerce_types(raw_text(t))


def _share(c: str) -> str:
    return f"round(count({c}) / count(*), 4)"


@query("q01_completeness", RAW_TYPED + f""",
s AS (SELECT {", ".join(f"{_share(c)} AS {c}" for c in ql.REQUIRED)} FROM typed)
SELECT *, round((city + parameter + value + timestamp_utc) / 4, 6) AS overall_completeness,
  (city + parameter + value + timestamp_utc) / 4 >= 95e-2 AS passed FROM s""")
def completeness(t):
    m = ql.completeness(typed(t))
    return m.withColumn("passed", F.col("overall_completeness") >= 0.95).withColumn(
        "overall_completeness", F.round("overall_completeness", 6)
    )


@query("q02_freshness", f"""
SELECT max(timestamp_utc) AS max_timestamp, min(timestamp_utc) AS min_timestamp,
  round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(timestamp_utc))) / 36e8, 6) AS age_hours,
  round((epoch_us(max(timestamp_utc)) - epoch_us(min(timestamp_utc))) / 864e8, 6) AS time_range_days FROM readings""")
def freshness(t):
    return rounded(ql.freshness(t.readings, as_of()))


_BAD = " OR ".join(f"(parameter = '{p}' AND (value < {a} OR value > {b}))" for p, (a, b) in dims.CHECK_RANGES.items())
_CHECKED = ", ".join(f"'{p}'" for p in dims.CHECK_RANGES)


@query("q03_range_violations", f"""
SELECT parameter, count(*) AS records, count(*) FILTER (WHERE {_BAD}) AS violations, round(min(value), 6) AS min_found,
  round(max(value), 6) AS max_found, round(count(*) FILTER (WHERE {_BAD}) / count(*) * 100, 6) AS violation_pct
FROM readings WHERE parameter IN ({_CHECKED}) GROUP BY 1""")
def violations(t):
    return rounded(ql.range_violations(t.readings))


@query("q04_duplicates", TWO_FEEDS + """
SELECT CAST(sum(n) AS BIGINT) AS total_records, CAST(sum(n - 1) AS BIGINT) AS duplicate_count, round(sum(n - 1) / sum(n), 6) AS duplicate_pct
FROM (SELECT count(*) AS n FROM feeds GROUP BY city, location, parameter, timestamp_utc)""")
def duplicates(t):
    return rounded(ql.duplicates(two_feeds(t)))


PM_PAIRS = """h AS (SELECT city, date_trunc('hour', timestamp_utc) AS ts, parameter, value FROM readings),
pp AS (SELECT a.value AS a, b.value AS b FROM h a JOIN h b ON a.city = b.city AND a.ts = b.ts AND a.parameter = 'pm25' AND b.parameter = 'pm10')"""


@query("q05_consistency", PM_PAIRS + """
SELECT (SELECT count(*) FROM readings WHERE latitude < 6 OR latitude > 37 OR longitude < 68 OR longitude > 97) AS geographic_bounds,
  (SELECT count(*) FILTER (WHERE a > b) FROM pp) AS pm25_gt_pm10""")
def consistency(t):
    pairs = ql.pm_pairs(t.readings.withColumn("hour", F.date_trunc("hour", "timestamp_utc")), "hour")
    return ql.outside_india(t.readings).select(
        "geographic_bounds", pairs.select("pm25_gt_pm10").scalar().alias("pm25_gt_pm10")
    )


@query("j05_pm25_pm10_pairs", PM_PAIRS + " SELECT count(*) AS pairs, count(*) FILTER (WHERE a > b) AS pm25_gt_pm10 FROM pp")
def pm_pairs(t):
    return ql.pm_pairs(t.readings.withColumn("hour", F.date_trunc("hour", "timestamp_utc")), "hour")


@query("q06_distribution", """
SELECT parameter, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median,
  round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis,
  round(count(*) FILTER (WHERE value = 0) / count(*) * 100, 6) AS zero_pct FROM readings GROUP BY 1 HAVING count(*) >= 10""")
def distribution(t):
    return rounded(ql.distribution(t.readings))


_EXPECTED = ", ".join(f"('{c}')" for c in dims.EXPECTED_CITIES)
# two of the cities asked for never report, so that something is missing
ASKED = [*dims.EXPECTED_CITIES, "Shimla", "Kochi"]
PARTIAL = "ex(city) AS (VALUES " + _EXPECTED + ", ('Shimla'), ('Kochi'))"


@query("q07_geographic_coverage", PARTIAL + """
SELECT count(*) FILTER (WHERE p.city IS NOT NULL) AS present_cities,
  array_to_string(list_sort(list(ex.city) FILTER (WHERE p.city IS NULL)), ',') AS missing_cities,
  count(*) FILTER (WHERE p.city IS NOT NULL) / 10 * 100 AS coverage_pct, count(*) FILTER (WHERE p.city IS NOT NULL) / 10 * 100 >= 80 AS passed
FROM ex LEFT JOIN (SELECT DISTINCT city FROM readings) p USING (city)""")
def coverage(t):
    m = ql.coverage(t.readings, ASKED)
    return m.withColumn("missing_cities", F.array_join("missing_cities", ",")).withColumn("passed", F.col("coverage_pct") >= 80)


@query("q07_rows_per_city", "SELECT city, count(*) AS n FROM readings GROUP BY 1")
def rows_per_city(t):
    return t.readings.groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@query("j18_missing_cities", PARTIAL + " SELECT city FROM ex ANTI JOIN readings USING (city)")
def missing(t):
    return ql.missing_cities(t.readings, ASKED)


@query("u03_present_and_extra_cities", PARTIAL + """
SELECT 'both' AS kind, city FROM (SELECT city FROM ex INTERSECT SELECT city FROM readings)
UNION ALL SELECT 'unexpected' AS kind, city FROM (SELECT DISTINCT city FROM readings EXCEPT SELECT city FROM ex)""")
def set_operations(t):
    present, expected = ql.present_cities(t.readings), ql.expected_cities(t.readings, ASKED)
    both = expected.intersect(present).select(F.lit("both").alias("kind"), "city")
    return both.unionByName(present.exceptAll(expected).select(F.lit("unexpected").alias("kind"), "city"))


GAPS = """gp AS (SELECT reading_id, city, (epoch_us(timestamp_utc) - epoch_us(lag(timestamp_utc) OVER (
  PARTITION BY city ORDER BY timestamp_utc, reading_id))) / 1e6 AS gap_seconds FROM readings)"""


@query("w17_reading_gaps", GAPS + " SELECT reading_id, city, round(gap_seconds, 6) AS gap_seconds FROM gp")
def gaps(t):
    return rounded(ql.reading_gaps(t.readings.select("reading_id", "city", "timestamp_utc")).drop("timestamp_utc"))


@query("q08_temporal_continuity", GAPS + """
SELECT city, count(*) FILTER (WHERE gap_seconds > 10800) AS gap_count, round(max(gap_seconds) FILTER (WHERE gap_seconds > 10800) / 3600, 6) AS max_gap_hours,
  round(median(gap_seconds / 60), 6) AS median_interval_minutes FROM gp WHERE gap_seconds IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (WHERE gap_seconds > 10800) > 0""")
def continuity(t):
    return rounded(ql.continuity(t.readings))


_SET = ", ".join(f"'{p}'" for p in dims.PARAMETERS)


@query("q09_expectations", RAW_TYPED + f""",
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(city) / count(*) AS c, count(value) / count(*) AS v,
  count(*) FILTER (WHERE parameter IS NULL OR parameter IN ({_SET})) / count(*) AS p FROM typed),
e AS (SELECT 'row_count' AS name, n AS observed, n >= 1 AS passed FROM m UNION ALL SELECT 'city_not_null', c, c >= 99e-2 FROM m
  UNION ALL SELECT 'value_not_null', v, v >= 95e-2 FROM m UNION ALL SELECT 'parameter_in_set', p, p >= 99e-2 FROM m)
SELECT name, round(observed, 6) AS observed, passed, CASE WHEN passed THEN 'info' ELSE 'warning' END AS severity FROM e""")
def expectations(t):
    return rounded(ql.expectations(typed(t)))


CHECKS = GAPS + f""",
c AS (SELECT (round(count(city) / count(*), 4) + round(count(parameter) / count(*), 4) + round(count(value) / count(*), 4)
    + round(count(timestamp_utc) / count(*), 4)) / 4 >= 95e-2 AS ok FROM readings),
k(name, ok, sev) AS (SELECT 'completeness', ok, 'critical' FROM c
  UNION ALL SELECT 'freshness', (SELECT (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(timestamp_utc))) / 36e8 <= 2 FROM readings), 'critical'
  UNION ALL SELECT 'value_ranges', (SELECT count(*) FILTER (WHERE {_BAD}) / count(*) * 100 < 1 FROM readings WHERE parameter IN ({_CHECKED})), 'warning'
  UNION ALL SELECT 'uniqueness', (SELECT sum(n - 1) / sum(n) <= 1e-2 FROM (SELECT count(*) AS n FROM readings GROUP BY city, location, parameter, timestamp_utc)), 'warning'
  UNION ALL SELECT 'consistency', (SELECT count(*) = 0 FROM readings WHERE latitude < 6 OR latitude > 37 OR longitude < 68 OR longitude > 97) AND
    (SELECT count(*) = 0 FROM readings a JOIN readings b ON a.city = b.city AND a.timestamp_utc = b.timestamp_utc AND a.parameter = 'pm25' AND b.parameter = 'pm10' AND a.value > b.value), 'warning'
  UNION ALL SELECT 'distribution', (SELECT count(*) = 0 FROM (SELECT 1 FROM readings GROUP BY parameter HAVING count(*) >= 10 AND (stddev_samp(value) = 0 OR abs(skewness(value)) > 5 OR count(*) FILTER (WHERE value = 0) / count(*) > 5e-1))), 'warning'
  UNION ALL SELECT 'geographic_coverage', (SELECT count(DISTINCT city) / 8 * 100 >= 80 FROM readings WHERE city IN ({", ".join(f"'{c}'" for c in dims.EXPECTED_CITIES)})), 'warning'
  UNION ALL SELECT 'temporal_continuity', (SELECT count(*) = 0 FROM gp WHERE gap_seconds > 10800), 'warning'),
checks AS (SELECT name, ok AS passed, CASE WHEN ok THEN 'info' ELSE sev END AS severity FROM k)"""


@query("q10_all_checks", CHECKS + " SELECT * FROM checks")
def all_checks(t):
    return ql.run_all_checks(t.readings, as_of()).drop("details")


@query("q10_report", CHECKS + """
SELECT count(*) AS checks, count(*) FILTER (WHERE passed) AS checks_passed, count(*) FILTER (WHERE NOT passed AND severity = 'critical') AS critical_failures,
  NOT bool_or(NOT passed AND severity = 'critical') AS passed, round(avg(CAST(passed AS INTEGER)) * 100, 6) AS pass_rate FROM checks""")
def report(t):
    return ql.report(ql.run_all_checks(t.readings, as_of()))


_SPIKE = """sp AS (SELECT *, coalesce(abs(value - avg(value) OVER f) > 3 * stddev_samp(value) OVER f, false) AS is_spike FROM readings
  WINDOW f AS (PARTITION BY city, parameter ORDER BY timestamp_utc, reading_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))"""


@query("w25_spikes", _SPIKE + " SELECT reading_id, city, parameter, value, is_spike FROM sp")
def spikes(t):
    rows = t.readings.select("reading_id", "city", "parameter", "value", "timestamp_utc")
    return ql.spikes(rows, ["timestamp_utc", "reading_id"]).drop("timestamp_utc")


_OUT = " OR ".join(f"(parameter = '{p}' AND (value < {a} OR value > {b}))" for p, (a, b) in dims.PARAMETER_RANGES.items())


@query("q13_quality_score", _SPIKE + ", " + IQR.format(src="readings") + ", " + NB + f""",
fl AS (SELECT sp.reading_id, ({_OUT}) AS bad, {IQR_MARK} AS outl, is_spike, coalesce(abs(av - nm) > 3e-1 * nm, false) AS apart, source
  FROM sp JOIN q USING (city, parameter) LEFT JOIN nb USING (location)),
sc AS (SELECT reading_id, greatest(0e0, 1e0 - (CASE WHEN bad THEN 6e-1 ELSE 0e0 END + CASE WHEN outl THEN 2e-1 ELSE 0e0 END + CASE WHEN is_spike THEN 1e-1 ELSE 0e0 END
  + CASE WHEN apart THEN 1e-1 ELSE 0e0 END + CASE WHEN source IS DISTINCT FROM 'cpcb' THEN 5e-2 ELSE 0e0 END)) AS s FROM fl)
SELECT reading_id, round(s, 6) AS quality_score, s >= 5e-1 AS use_for_training, s >= 8e-1 AS use_for_display FROM sc""")
def score(t):
    rows = t.readings.select("reading_id", "city", "location", "parameter", "value", "timestamp_utc", "source")
    flagged = clean.flag_outliers(ql.spikes(rows, ["timestamp_utc", "reading_id"])).withColumn("is_bad", clean.out_of_range())
    apart = hotspot.inconsistent_stations(station_means(t)).select("location", "differs_from_neighbours")
    joined = flagged.join(apart, "location", "left")
    scored = ql.quality_score(joined, "is_bad", "is_outlier", "is_spike", "differs_from_neighbours")
    return scored.select("reading_id", F.round("quality_score", 6).alias("quality_score"), "use_for_training", "use_for_display")
