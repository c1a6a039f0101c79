"""Threshold alerts with a cooldown, kept as state per alert rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from aqspark.operators.alerts import cooldown_seconds, parse_conditions
from aqspark.session import settle

RULE = ["location", "condition", "frequency"]
PART_ROWS = 2_000_000  # alerts of subscribers that a task joins
OUTPUT = "location string, condition string, frequency string, triggered_at timestamp, current_value double, threshold double"


def alert_rules(subscriptions: DataFrame) -> DataFrame:
    """Distinct (place, condition, frequency) of active subscriptions.

    Subscriptions that share these fire at the same moments, so state and work
    follow the rules, of which there are few, and not the subscribers.
    """
    return parse_conditions(subscriptions.where("active").select(*RULE).distinct()).where("is_valid").withColumn(
        "cooldown", cooldown_seconds()
    )


def exceeding(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """Readings over the threshold of a rule of their city and parameter."""
    r = readings.select(F.col("city").alias("location"), F.col("parameter").alias("alert_parameter"), "value", "timestamp_utc")
    return r.join(rules, ["location", "alert_parameter"]).where(F.col("value") > F.col("threshold")).select(
        *RULE, "timestamp_utc", F.col("value").alias("current_value"), "threshold", "cooldown"
    )


class Cooldown(StatefulProcessor):
    """Fires when the last alert of the rule is at least its cooldown ago, in event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self._last.get()[0] if self._last.exists() else None
        times, values, wait, threshold = [], [], 0, 0.0
        for p in rows:
            wait, threshold = int(p["cooldown"].iloc[0]) * 1_000_000, p["threshold"].iloc[0]
            p = p[p["timestamp_utc"].notna()]
            at = p["timestamp_utc"].astype("datetime64[us]").astype("int64").to_numpy()
            # rows within the running cooldown can never fire
            open_ = slice(None) if last is None else at - last >= wait
            times.append(at[open_])
            values.append(p["current_value"].to_numpy()[open_])
        at, value = np.concatenate(times), np.concatenate(values)
        # copies at one instant fire at most once, with the smallest value
        order = np.lexsort((value, at))
        at, value = at[order], value[order]
        picked, i = [], 0
        while i < len(at):
            picked.append(i)
            last = int(at[i])
            i = int(np.searchsorted(at, last + max(wait, 1)))
        if last is not None:
            self._last.update((last,))
        yield pd.DataFrame({
            "location": key[0], "condition": key[1], "frequency": key[2], "triggered_at": pd.to_datetime(at[picked], unit="us"),
            "current_value": value[picked], "threshold": threshold,
        })

    def close(self) -> None:
        pass


def triggers(matches: DataFrame) -> DataFrame:
    """Alerts per rule from a stream (or batch) of exceeding readings. Needs the RocksDB state store when streaming."""
    return matches.groupBy(*RULE).transformWithStateInPandas(
        statefulProcessor=Cooldown(), outputStructType=OUTPUT, outputMode="append", timeMode="None"
    )


def to_subscribers(alerts: DataFrame, subscriptions: DataFrame, users: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per alert and active subscription whose user is not suspended.

    A subscription gets the alerts from its creation on. The cooldown belongs to
    the rule, so one created inside it first hears of the next alert.

    The result has far more rows than either side and few rules, so the
    subscribers of a rule are cut into as many parts as its pairs need, and
    parts, not rules or files, are spread over the tasks.
    """
    spark = alerts.sparkSession
    active = subscriptions.where("active").join(users.where(~F.col("is_suspended")), "user_id", "left_semi")
    active = active.select("subscription_id", "user_id", "channel", "created_at", *RULE)
    count = F.count(F.lit(1))
    pairs = active.groupBy(*RULE).agg(count.alias("_s")).join(alerts.groupBy(*RULE).agg(count.alias("_a")), RULE)
    pairs = settle(pairs.select(*RULE, (F.col("_s") * F.col("_a")).alias("_pairs")))
    total = pairs.agg(F.sum("_pairs")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_rows))
    cut = pairs.select(*RULE, F.ceil(F.col("_pairs") / part_rows).alias("_parts"))
    part = F.pmod(F.xxhash64("subscription_id", "user_id", "channel", "created_at"), F.col("_parts"))
    mine = active.join(cut, RULE).withColumn("_part", part).drop("_parts").repartition(tasks, *RULE, "_part")
    copies = alerts.join(cut, RULE).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    joined = copies.hint("merge").join(mine, [*RULE, "_part"])
    return joined.where("created_at <= triggered_at").drop("created_at", "_part")
