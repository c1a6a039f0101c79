"""Weather attached to readings, gaps filled, derived columns added."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions import weather as wx
from aqspark.operators.series import running, series_window, with_position
from aqspark.session import settle

COORDINATES = ["latitude", "longitude"]


def weather_columns(weather: DataFrame) -> list[str]:
    return [c for c in [*dims.WEATHER_COLUMNS, *COORDINATES] if c in weather.columns]


def output_name(column: str, reading_columns: list[str]) -> str:
    return f"{column}_weather" if column in reading_columns else column


def hourly_first(weather: DataFrame, order: list[str]) -> DataFrame:
    """First weather row per city and hour, as an aggregate."""
    cols = weather_columns(weather)
    first = F.min_by(F.struct(*cols), F.struct(*order))
    return weather.groupBy("city", F.date_trunc("hour", "timestamp_utc").alias("_hour")).agg(first.alias("_w"))


def join_on_hour(readings: DataFrame, weather: DataFrame, order: list[str]) -> DataFrame:
    """Left join on city and floored hour; clashing names get a _weather suffix."""
    names = [F.col(f"_w.{c}").alias(output_name(c, readings.columns)) for c in weather_columns(weather)]
    keyed = readings.withColumn("_hour", F.date_trunc("hour", "timestamp_utc"))
    return keyed.join(hourly_first(weather, order), ["city", "_hour"], "left").select(*readings.columns, *names)


def _in_time_order(
    probes: DataFrame, marks: DataFrame, keys: list[str], payload: str, at: str, marks_first: bool, before: bool = True
) -> DataFrame:
    """Both sides in one time order per key, each row with the marks just before (if wanted) and after it.

    ``probes`` and ``marks`` share the key columns and the time ``at``; only marks
    carry ``payload``. Costs one sort of both sides and forms no pairs.
    """
    none = F.lit(None).cast(marks.schema[payload].dataType)
    only_probe = [c for c in probes.columns if c not in (*keys, at)]
    left = probes.withColumn(payload, none)
    right = marks.select(*keys, at, *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in only_probe], payload)
    merged = left.unionByName(right)
    is_mark = F.col(payload).isNotNull()
    rank = F.when(is_mark, F.lit(0 if marks_first else 1)).otherwise(F.lit(1 if marks_first else 0))
    mark = F.when(is_mark, F.struct(F.col(at).alias("t"), F.col(payload).alias("w")))
    placed = running(
        with_position(merged, keys, [at, rank]), keys, lasts={"_before": mark} if before else {}, nexts={"_after": mark}
    )
    return placed.where(~is_mark).drop(payload, "_pos", "_n")


def nearest_weather(
    readings: DataFrame, weather: DataFrame, reading_id: str, order: list[str], tolerance_minutes: int = 30
) -> DataFrame:
    """Per reading the weather row of its city nearest in time, within the tolerance.

    The nearest row is the last one before or the first one after the reading;
    the earlier one wins a tie. Holds for any tolerance and any number of rows.
    """
    cols = weather_columns(weather)
    per_time = weather.groupBy("city", "timestamp_utc").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_w"))
    probes = readings.select("city", "timestamp_utc", reading_id)
    around = _in_time_order(probes, per_time, ["city"], "_w", "timestamp_utc", marks_first=True)
    now = F.unix_micros("timestamp_utc")
    before = now - F.unix_micros("_before.t")
    after = F.unix_micros("_after.t") - now
    limit = F.lit(tolerance_minutes * 60_000_000)
    near_before, near_after = F.coalesce(before <= limit, F.lit(False)), F.coalesce(after <= limit, F.lit(False))
    pick = F.when(near_before & (~near_after | (before <= after)), F.col("_before.w")).when(near_after, F.col("_after.w"))
    return around.select(reading_id, pick.alias("_near"))


def join_weather(
    readings: DataFrame, weather: DataFrame, reading_id: str, order: list[str], tolerance_minutes: int = 30
) -> DataFrame:
    """Hour match first; rows it leaves without any weather take the nearest row in tolerance."""
    names = {c: output_name(c, readings.columns) for c in weather_columns(weather)}
    merged = join_on_hour(readings, weather, order)
    missing = reduce(lambda a, b: a & b, [F.col(n).isNull() for n in names.values()])
    near = nearest_weather(merged.where(missing), weather, reading_id, order, tolerance_minutes)
    found = near.where(F.col("_near").isNotNull()).withColumnRenamed(reading_id, "_near_id")
    out = merged.join(found, merged[reading_id] == F.col("_near_id"), "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.col(f"_near.{c}")) for c, n in names.items()}).drop(
        "_near", "_near_id"
    )


# --- nearest place: rings of cells around distinct coordinates -------------------

RING_LEVELS = 17
FIRST_PLACES = 16
MARKS_PER_BUCKET = 64
SPOT = ["_lat", "_lon"]
MOMENT = [*SPOT, "_t"]


def _has_coordinates(df: DataFrame) -> DataFrame:
    """Rows with a time and finite coordinates."""
    finite = [F.col(c).between(-1e300, 1e300) for c in COORDINATES]
    return df.where(finite[0] & finite[1] & F.col("timestamp_utc").isNotNull())


def _side(level: Column, span: float) -> Column:
    """Cell side of a level in degrees: doubles with the level, the last one is twice the whole extent."""
    return F.lit(2.0 * span) * F.pow(F.lit(2.0), level - (RING_LEVELS - 1))


def _ring_cell(level: Column, lat: Column, lon: Column, span: float, north: int = 0, east: int = 0) -> Column:
    side = _side(level, span)
    return F.struct(level.alias("l"), (F.floor(lat / side) + north).alias("b"), (F.floor(lon / side) + east).alias("c"))


def _block_of_cells(level: Column, span: float) -> Column:
    """The cell of a spot and its eight neighbours; they hold all that is within one side."""
    steps = (-1, 0, 1)
    return F.array(*[_ring_cell(level, F.col("_lat"), F.col("_lon"), span, n, e) for n in steps for e in steps])


def _grid(places: DataFrame, span: float) -> DataFrame:
    """Places with their cell of every level."""
    return places.select("lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(RING_LEVELS - 1))).alias("_l")).select(
        "lat", "lon", _ring_cell(F.col("_l"), F.col("lat"), F.col("lon"), span).alias("_cell")
    )


def _search_levels(spots: DataFrame, grid: DataFrame, span: float) -> DataFrame:
    """Per spot the levels worth a look, finest first.

    Where a coarser block holds the same places as a finer one, only the
    coarser is kept, as more of them are within its radius; blocks with fewer
    places than the first step takes are left to the coarser ones. So a search neither
    visits empty rings nor starts with cells that hold too much.
    """
    held = grid.groupBy("_cell").agg(F.count(F.lit(1)).alias("_held"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(RING_LEVELS - 1)))
    around = spots.select(*SPOT, levels.alias("_l")).select(
        *SPOT, "_l", F.explode(_block_of_cells(F.col("_l"), span)).alias("_cell")
    )
    counts = around.join(held, "_cell").groupBy(*SPOT, "_l").agg(F.sum("_held").alias("_held"))
    enough = (F.col("_held") >= FIRST_PLACES) | (F.col("_l") == RING_LEVELS - 1)
    return counts.groupBy(*SPOT, "_held").agg(F.max("_l").alias("_l")).where(enough).groupBy(*SPOT).agg(
        F.array_sort(F.collect_list("_l")).alias("_levels")
    )


def _radius(span: float) -> Column:
    """Radius of a spot's present level; a little less than the side, so rounding cannot pass a cell by."""
    return F.lit(0.999) * _side(F.get("_levels", F.col("_step")), span)


def _next_places(spots: DataFrame, grid: DataFrame, span: float) -> DataFrame:
    """Per spot its next ``_wanted`` places beyond its reach and within its level's radius.

    Places equally far from a spot come together. ``_more`` tells whether the
    ring holds others.
    """
    looking = spots.select(
        *SPOT, "_reach", "_wanted", _radius(span).alias("_radius"),
        F.explode(_block_of_cells(F.get("_levels", F.col("_step")), span)).alias("_cell"),
    )
    dx, dy = F.col("_lat") - F.col("lat"), F.col("_lon") - F.col("lon")
    ring = looking.join(grid, "_cell").withColumn("_d", F.sqrt(dx * dx + dy * dy)).where(
        (F.col("_d") > F.col("_reach")) & (F.col("_d") <= F.col("_radius"))
    )
    per_spot = Window.partitionBy(*SPOT)
    rank = F.rank().over(per_spot.orderBy("_d"))
    ranked = ring.withColumns({"_rank": rank, "_last": F.max("_d").over(per_spot)})
    near = ranked.where(F.col("_rank") <= F.col("_wanted"))
    furthest = F.max("_d").over(per_spot)
    place = F.struct("lat", "lon").alias("_place")
    return near.select(*SPOT, place, "_d", "_rank", (F.col("_last") > furthest).alias("_more"))


def _advance(spots: DataFrame, near: DataFrame, waiting: DataFrame, span: float) -> DataFrame:
    """Search state of the spots that still have moments without weather and levels to look at."""
    seen = near.groupBy(*SPOT).agg(F.max("_d").alias("_seen"), F.max("_more").alias("_more"))
    more = F.coalesce(F.col("_more"), F.lit(False))
    on = spots.join(waiting.select(*SPOT).distinct(), SPOT, "left_semi").join(seen, SPOT, "left").select(
        *SPOT,
        "_levels",
        F.when(more, F.col("_step")).otherwise(F.col("_step") + 1).alias("_step"),
        F.when(more, F.col("_seen")).otherwise(_radius(span)).alias("_reach"),
        F.when(F.col("_seen").isNull(), F.col("_wanted")).otherwise(F.col("_wanted") * 4).alias("_wanted"),
    )
    return on.where(F.col("_step") < F.size("_levels"))


def _bucket(micros: Column, tolerance_minutes: int) -> Column:
    """Number of the time bucket; a bucket is as long as a band, so a band touches two at most."""
    return F.floor(micros / F.lit(max(1, tolerance_minutes * 120_000_000)).cast("long"))


def _first_in_band(probes: DataFrame, marks: DataFrame, tolerance_minutes: int, few: bool) -> DataFrame:
    """Per moment the weather of the nearest of its probed places that has some in the moment's band.

    With ``few`` rows per place and bucket a moment is joined with those of the
    two buckets of its band. Otherwise both sides are put into one time order.
    """
    band = F.expr(f"INTERVAL {tolerance_minutes} MINUTES")
    timed = probes.select(*MOMENT, "_place", "_d", (F.col("_t") - band).alias("_at"))
    if few:
        start = _bucket(F.unix_micros("_at"), tolerance_minutes)
        at = marks.select("_place", "_b", F.struct(F.col("_at").alias("t"), F.col("_w").alias("w")).alias("_after"))
        around = timed.withColumn("_b", F.explode(F.array(start, start + 1))).join(at, ["_place", "_b"])
        around = around.where(F.col("_after.t") >= F.col("_at"))
    else:
        around = _in_time_order(timed, marks.drop("_b"), ["_place"], "_w", "_at", marks_first=False, before=False)
    hit = around.where(F.col("_after.t") <= F.col("_t") + band)
    nearest = F.min_by("_after.w", F.struct("_d", F.col("_after.t"), F.col("_after.w.o")))
    return hit.groupBy(*MOMENT).agg(nearest.alias("_hit"))


def _with_any_weather(moments: DataFrame, marks: DataFrame, tolerance_minutes: int) -> DataFrame:
    """Moments in whose band some place has weather.

    The last time of the band's first bucket and the first time of its second decide.
    """
    half = F.lit(tolerance_minutes * 60_000_000).cast("long")
    at, t = F.unix_micros("_at"), F.unix_micros("_t")
    buckets = marks.groupBy("_b").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    lower, upper = buckets.select("_b", "_hi"), buckets.select((F.col("_b") - 1).alias("_b"), "_lo")
    placed = moments.withColumn("_b", _bucket(t - half, tolerance_minutes))
    known = placed.join(lower, "_b", "left").join(upper, "_b", "left")
    return known.where((F.col("_hi") >= t - half) | (F.col("_lo") <= t + half)).select(*MOMENT)


def join_on_coordinates(
    readings: DataFrame, weather: DataFrame, reading_id: str, order: list[str], tolerance_minutes: int = 30
) -> DataFrame:
    """Within the time tolerance, the weather row closest in degrees; unmatched rows stay.

    All rows of one weather place are equally far from a reading, so per place
    only the first row in the reading's time band matters; ties of places go to
    the earlier row, then by ``order``. Distinct coordinates of readings look
    for their nearest 16 places ring by ring, in cells whose side doubles. Readings
    are matched in time with the nearest place; those that it has no
    weather for, with the other 15, then with the next 64, and so on. Readings
    in whose band no place has weather leave after the first place.

    Readings and weather rows without a time or with null or non-finite
    coordinates match nothing. This runs jobs while it is being built: each
    step is stored, as the next one depends on what it left over.
    """
    cols = [c for c in dims.WEATHER_COLUMNS if c in weather.columns]
    names = {c: output_name(c, readings.columns) for c in cols}
    place = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("_place")
    first = F.min_by(F.struct(F.struct(*order).alias("o"), *cols), F.struct(*order))
    bucket = _bucket(F.unix_micros("_at"), tolerance_minutes).alias("_b")
    marks = _has_coordinates(weather).groupBy(place, F.col("timestamp_utc").alias("_at")).agg(first.alias("_w"))
    marks = settle(marks.select("*", bucket))
    held = marks.groupBy("_place", "_b").agg(F.count(F.lit(1)).alias("n"))
    few = (held.agg(F.max("n")).first()[0] or 0) <= MARKS_PER_BUCKET
    places = settle(held.select("_place.*").distinct())
    at = [F.col(c).alias(n) for c, n in zip([*COORDINATES, "timestamp_utc"], MOMENT)]
    waiting = settle(_has_coordinates(readings).select(*at).distinct())
    both = waiting.select(*SPOT).unionByName(places.toDF(*SPOT))
    lat, lon = [F.max(c) - F.min(c) for c in SPOT]
    span = both.agg(F.greatest(lat, lon, F.lit(1e-9)).alias("span")).first()["span"]
    grid = _grid(places, span)
    spots = settle(_search_levels(waiting.select(*SPOT).distinct(), grid, span).withColumns(
        {"_step": F.lit(0), "_reach": F.lit(-1.0), "_wanted": F.lit(FIRST_PLACES).cast("long")}
    ))
    found = []
    while not spots.isEmpty():
        near = settle(_next_places(spots, grid, span))
        # most readings need their nearest place only
        for part in [F.col("_rank") > 0] if found else [F.col("_rank") == 1, F.col("_rank") > 1]:
            hits = settle(_first_in_band(waiting.join(near.where(part), SPOT), marks, tolerance_minutes, few))
            waiting = waiting.join(hits, MOMENT, "left_anti")
            if not found:
                waiting = _with_any_weather(waiting, marks, tolerance_minutes)
            waiting = settle(waiting)
            found.append(hits)
        spots = settle(_advance(spots, near, waiting, span))
    if not found:
        return readings.select("*", *[F.lit(None).cast(weather.schema[c].dataType).alias(n) for c, n in names.items()])
    best = reduce(DataFrame.unionByName, found)
    keys = [readings[c] == best[n] for c, n in zip([*COORDINATES, "timestamp_utc"], MOMENT)]
    out = readings.join(best, reduce(lambda a, b: a & b, keys), "left")
    return out.select(*[readings[c] for c in readings.columns], *[F.col(f"_hit.{c}").alias(n) for c, n in names.items()])


def fill_weather(
    df: DataFrame, columns: list[str], order: list[str], method: str = "ffill", limit: int = 3, min_block: int = 4096
) -> DataFrame:
    """Fill gaps per city in row order, at most ``limit`` rows into a gap.

    'interpolate' draws a line between the known neighbours and holds the last
    known value after the final one.
    """
    placed = with_position(df, ["city"], order)
    if method in ("ffill", "bfill"):
        back, ahead = (-limit, 0) if method == "ffill" else (0, limit)
        pick = F.last if method == "ffill" else F.first
        out = series_window(
            placed,
            ["city"],
            lambda w: {c: pick(c, ignorenulls=True).over(w.rowsBetween(back, ahead)) for c in columns},
            before=-back,
            after=ahead,
            min_block=min_block,
        )
    elif method == "interpolate":
        def known(c: str) -> Column:
            return F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).alias("v")))

        spans = running(
            placed,
            ["city"],
            lasts={f"_prev_{c}": known(c) for c in columns},
            nexts={f"_next_{c}": known(c) for c in columns},
            min_block=min_block,
        )
        filled = {}
        for c in columns:
            prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
            step = F.col("_pos") - prev["p"]
            line = prev["v"] + (nxt["v"] - prev["v"]) * step / (nxt["p"] - prev["p"])
            within = step <= limit
            filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(
                within, F.when(nxt.isNotNull(), line).otherwise(prev["v"])
            )
        out = spans.withColumns(filled).drop(*[f"_{s}_{c}" for s in ("prev", "next") for c in columns])
    else:
        raise ValueError(f"unknown fill method {method}")
    return out.drop("_pos", "_n")


def add_derived(df: DataFrame) -> DataFrame:
    return df.withColumns(wx.derived(df.columns))


def join_stats(merged: DataFrame, column: str = "temperature_2m") -> DataFrame:
    """Records in and out; the output keeps every reading, so all count as matched."""
    n = F.count(F.lit(1))
    return merged.agg(
        n.alias("aqi_records"),
        n.alias("matched_records"),
        F.lit(0).cast("long").alias("unmatched_records"),
        F.count(column).alias("with_weather"),
        F.round(F.try_divide(n, n) * 100, 6).alias("fill_rate"),
        F.round(F.try_divide(F.count(column), n) * 100, 6).alias("weather_rate"),
    )
