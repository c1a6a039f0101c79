"""Alert subscriptions: parsing, threshold checks, schedules, counts and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions.bins import lookup
from aqspark.session import settle

DAY_NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def parse_conditions(df: DataFrame, condition: str = "condition") -> DataFrame:
    """Add parameter, threshold and whether the condition is on the list of valid ones."""
    c = F.col(condition)
    name = F.nullif(F.regexp_extract(c, dims.ALERT_PATTERN, 1), F.lit(""))
    number = F.nullif(F.regexp_extract(c, dims.ALERT_PATTERN, 2), F.lit(""))
    return df.withColumns({
        "alert_parameter": F.lower(name),
        "threshold": number.try_cast("double"),
        "is_valid": F.coalesce(c.isin(dims.ALERT_CONDITIONS), F.lit(False)),
    })


def cooldown_seconds(frequency: str = "frequency") -> Column:
    return lookup(dims.COOLDOWN_SECONDS, frequency, dims.DEFAULT_COOLDOWN_SECONDS)


def within_schedule(ts: Column, quiet_start: Column, quiet_end: Column, days: Column, pollutants: Column, parameter: Column) -> Column:
    """True when an alert may be delivered: outside quiet hours, on an active day, for a listed pollutant.

    Quiet hours given as 'HH:mm' may run over midnight; an absent list or
    absent quiet hours put no limit.
    """
    now = F.date_format(ts, "HH:mm")
    same_day = (now >= quiet_start) & (now < quiet_end)
    over_night = (now >= quiet_start) | (now < quiet_end)
    quiet = F.coalesce(F.when(quiet_start <= quiet_end, same_day).otherwise(over_night), F.lit(False))
    today = F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.weekday(ts) + 1)
    on_day = F.coalesce(F.size(days) == 0, F.lit(True)) | F.array_contains(days, today)
    wanted = F.coalesce(F.size(pollutants) == 0, F.lit(True)) | F.array_contains(pollutants, parameter)
    return ~quiet & F.coalesce(on_day, F.lit(True)) & F.coalesce(wanted, F.lit(True))


def threshold_matches(subscriptions: DataFrame, current: DataFrame, users: DataFrame) -> DataFrame:
    """Active subscriptions of users in good standing whose threshold the city's current value exceeds.

    ``current`` has one row per (city, parameter), so subscriptions are joined
    once on that key.
    """
    active = parse_conditions(subscriptions.where("active"))
    standing = active.join(users.where(~F.col("is_suspended")), "user_id", "left_semi")
    now = current.select(F.col("city").alias("location"), F.col("parameter").alias("alert_parameter"), F.col("value").alias("current_value"), "timestamp_utc")
    return standing.join(now, ["location", "alert_parameter"]).where(F.col("current_value") > F.col("threshold"))


def system_stats(users: DataFrame, subscriptions: DataFrame, locations: DataFrame, notifications: DataFrame, as_of: Column) -> DataFrame:
    """Totals over all tables as one row, one pass per table."""
    recent = F.col("created_at") >= as_of - F.expr("INTERVAL 7 DAYS")
    one = F.count(F.lit(1))
    u = users.agg(F.struct(
        one.alias("total_users"),
        F.count_if(~F.col("is_suspended")).alias("active_users"),
        F.count_if("is_suspended").alias("suspended_users"),
        F.count_if(F.col("role") == "admin").alias("admin_users"),
        F.count_if(recent).alias("recent_signups"),
    ).alias("u"))
    s = subscriptions.agg(F.struct(one.alias("total_alerts"), F.count_if("active").alias("active_alerts")))
    n = notifications.agg(F.struct(one.alias("total_notifications"), F.count_if(~F.col("read")).alias("unread_notifications")))
    out = u.select("u", s.scalar().alias("s"), n.scalar().alias("n"), locations.agg(one).scalar().alias("total_locations"))
    return out.select("u.*", "s.*", "n.*", "total_locations")


def user_stats(users: DataFrame, subscriptions: DataFrame, locations: DataFrame, notifications: DataFrame) -> DataFrame:
    """Per user counts; each table is reduced to one row per user before the join."""
    one = F.count(F.lit(1))
    s = subscriptions.groupBy("user_id").agg(one.alias("alerts"), F.count_if("active").alias("active_alerts"))
    loc = locations.groupBy("user_id").agg(one.alias("saved_locations"))
    n = notifications.groupBy("user_id").agg(one.alias("notifications"), F.count_if(~F.col("read")).alias("unread"))
    out = users.select("user_id")
    for part in (s, loc, n):
        out = out.join(part, "user_id", "left")
    return out.na.fill(0)


def popular(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), column).limit(n)


def page(df: DataFrame, order: list, page_number: int = 1, size: int = 20) -> DataFrame:
    """One page of the ordered rows, each with the total; page and size are clamped.

    Rows are stored in ranges of the order. Counts per range tell which ranges
    hold the page; only their rows are sorted, so a deep page costs no more than the
    first. Rows that ``order`` cannot tell apart come in any order, but each has
    one place. Storing the ranges runs a job while this is being built.
    """
    page_number, size = max(1, page_number), min(100, max(1, size))
    start, end = (page_number - 1) * size, page_number * size
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    stored = settle(spread.repartitionByRange(*by, "_tie").withColumn("_range", F.spark_partition_id()))
    ranges = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per range
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    holding = ranges.where((F.col("_first") < end) & (F.col("_first") + F.col("_rows") > start)).select("_range", "_first")
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_range").orderBy(*by, "_tie")) - 1
    total = stored.agg(F.count(F.lit(1))).scalar()
    rows = stored.join(holding, "_range").withColumn("_place", place).where((F.col("_place") >= start) & (F.col("_place") < end))
    return rows.orderBy("_place").select(*[rows[c] for c in df.columns], total.alias("total"))


def search_users(users: DataFrame, text: str | None = None, role: str | None = None) -> DataFrame:
    """Users whose name or e-mail contains the text, ignoring case."""
    out = users
    if text:
        pattern = f"%{text}%"
        out = out.where(F.col("name").ilike(pattern) | F.col("email").ilike(pattern))
    return out.where(F.col("role") == role) if role else out


def drop_read_notifications(notifications: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Keep unread notifications and those not older than ``days``."""
    old = F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))
    return notifications.where(~F.coalesce(F.col("read") & old, F.lit(False)))
