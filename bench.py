"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS set data and cores.
Every query runs in full into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "a10_daily_kpi",
    "a01_hourly_rollup",
    "a02_daily_rollup",
    "a05_city_daily_summary",
    "a11_exposure_score",
    "a12_unhealthy_days",
    "w18_latest_reading",
    "w19_deduplicate",
    "w20_iqr_outliers",
    "q11_cleaning_stats",
    "q10_report",
    "j01_weather_by_hour",
    "j02_weather_nearest_time",
    "w01_lag_features",
    "w02_rolling_statistics",
    "w04_exponential_mean",
    "w24_training_table",
    "a22_persistence",
    "a23_forecast_metrics",
    "m20_drift_severity",
    "m14_backtest_folds",
    "g02_density_clusters",
    "j16_threshold_matches",
    "j03_weather_nearest_place",
    "t02_hourly_rollup_stream",
]


def main() -> None:
    from aqspark.plans.registry import load_all, runner
    from aqspark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = local_session(cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock runs
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        runner(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
