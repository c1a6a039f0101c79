"""Pollution hotspots: neighbourhoods, density clusters, zones, grid cells, statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aqspark.functions.geo import EARTH_RADIUS_KM, haversine_km
from aqspark.session import settle

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180
EPS_KM = 15.0
MIN_SAMPLES = 3
HOT, SEVERE = 200.0, 300.0


# --- cells: latitude bands, each cut into cells of its own width in longitude ---


def _band(lat: Column, side_km: float) -> Column:
    return F.floor(lat / F.lit(side_km / KM_PER_DEGREE))


def _cell_degrees(band: Column, side_km: float) -> Column:
    """Longitude width of a band's cells; never more than ``side_km`` on the ground."""
    height = side_km / KM_PER_DEGREE
    nearest = F.least(F.abs(band * height), F.abs((band + 1) * height))
    nearest = F.when(band * (band + 1) <= 0, F.lit(0.0)).otherwise(nearest)
    return F.lit(side_km / KM_PER_DEGREE) / F.greatest(F.cos(F.radians(nearest)), F.lit(0.01))


def _east(lon: Column) -> Column:
    """Degrees east of the 180° meridian, 0 to 360."""
    return F.pmod(lon + 180, F.lit(360.0))


def _cell(lat: Column, lon: Column, side_km: float) -> Column:
    band = _band(lat, side_km)
    return F.struct(band.alias("b"), F.floor(_east(lon) / _cell_degrees(band, side_km)).alias("c"))


def cells_within(lat: Column, lon: Column, radius_km: float, side_km: float) -> Column:
    """All cells that can hold a point within ``radius_km``; a handful whatever the data."""
    reach = math.ceil(radius_km / side_km)
    angle = radius_km / EARTH_RADIUS_KM
    edge = F.least(F.abs(lat) + F.lit(radius_km / KM_PER_DEGREE), F.lit(90.0))
    ratio = F.lit(math.sin(angle)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    # around a pole any longitude can be near
    span = F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0))))) + 1e-9

    def in_band(d: Column) -> Column:
        band = _band(lat, side_km) + d
        width = _cell_degrees(band, side_km)
        n, x = F.ceil(F.lit(360.0) / width), _east(lon)
        # past the meridian cells count on; the last one there may be narrower than the others
        lo = F.when(x < span, -2 - F.floor((span - x) / width)).otherwise(F.floor((x - span) / width))
        hi = F.when(x + span >= 360, n + F.floor((x + span - 360) / width)).otherwise(F.floor((x + span) / width))
        return F.transform(F.sequence(F.greatest(lo, hi - n + 1), hi), lambda c: F.struct(band.alias("b"), F.pmod(c, n).alias("c")))

    return F.flatten(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), in_band))


def points(stations: DataFrame) -> DataFrame:
    """Stations merged by exact coordinates, with how many there are and their sum of means."""
    return stations.groupBy("latitude", "longitude").agg(
        F.count(F.lit(1)).alias("weight"), F.sum("avg_value").alias("value_sum")
    )


def near_points(
    left: DataFrame, right: DataFrame, radius_km: float, side_km: float, own_cell: bool = True
) -> DataFrame:
    """Points of ``right`` within the radius of each point of ``left``, met on shared cells.

    Both sides hold distinct coordinates, so stations at one spot make no pairs.
    Without ``own_cell`` points of one cell are not compared with each other.
    """
    cells = cells_within(F.col("latitude"), F.col("longitude"), radius_km, side_km)
    if not own_cell:
        cells = F.array_except(cells, F.array("cell"))
    probe = left.withColumn("_at", F.explode(cells))
    other = right.select(*[F.col(c).alias(f"n_{c}") for c in right.columns]).withColumn(
        "_at", _cell(F.col("n_latitude"), F.col("n_longitude"), side_km)
    )
    km = haversine_km("latitude", "longitude", "n_latitude", "n_longitude")
    return probe.join(other, "_at").where(km <= radius_km).drop("_at")


def neighbour_statistics(stations: DataFrame, radius_km: float = EPS_KM) -> DataFrame:
    """Per station the number of other stations within the radius and their mean."""
    spots = settle(points(stations))
    around = near_points(spots.select("latitude", "longitude"), spots, radius_km, radius_km).groupBy(
        "latitude", "longitude"
    ).agg(F.sum("n_weight").alias("_n"), F.sum("n_value_sum").alias("_sum"))
    joined = stations.join(around, ["latitude", "longitude"])
    others = F.col("_n") - 1
    return joined.withColumns({
        "neighbours": others,
        "neighbour_mean": F.try_divide(F.col("_sum") - F.col("avg_value"), others),
    }).drop("_n", "_sum")


def inconsistent_stations(stations: DataFrame, radius_km: float = EPS_KM, share: float = 0.30) -> DataFrame:
    """Flag stations whose mean differs from their neighbours' by more than ``share``."""
    out = neighbour_statistics(stations, radius_km)
    apart = F.abs(F.col("avg_value") - F.col("neighbour_mean")) > F.lit(share) * F.col("neighbour_mean")
    return out.withColumn("differs_from_neighbours", F.coalesce(apart, F.lit(False)))


# --- density clusters -----------------------------------------------------------


def dbscan(stations: DataFrame, eps_km: float = EPS_KM, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Density clusters of stations; noise is left out.

    Points are put in cells so small that all points of a cell are neighbours.
    A full cell is thus core as a whole without looking at its pairs, and
    clusters are connected components of cells, found by passing the smallest
    label along and jumping pointers until nothing changes. Each round is
    stored in the checkpoint folder.
    """
    side = 0.999 * eps_km / math.sqrt(2)
    spots = points(stations).withColumn("cell", _cell(F.col("latitude"), F.col("longitude"), side))
    spots = settle(spots.select("latitude", "longitude", "weight", "cell"))
    cell_weight = spots.groupBy("cell").agg(F.sum("weight").alias("cell_weight"))
    placed = spots.join(cell_weight, "cell")
    full = F.col("cell_weight") >= min_samples
    sparse = placed.where(~full).select("latitude", "longitude", "cell", "cell_weight")
    beyond = (
        near_points(sparse, spots, eps_km, side, own_cell=False)
        .groupBy("latitude", "longitude")
        .agg(F.sum("n_weight").alias("_beyond"))
    )
    marked = placed.join(beyond, ["latitude", "longitude"], "left").select(
        "latitude",
        "longitude",
        "cell",
        (F.col("cell_weight") + F.coalesce(F.col("_beyond"), F.lit(0)) >= min_samples).alias("core"),
    )
    marked = settle(marked)
    core = marked.where("core").drop("core")
    edges = (
        near_points(core, core, eps_km, side, own_cell=False)
        .select(F.col("cell").alias("a"), F.col("n_cell").alias("b"))
        .distinct()
    )
    labels = connected_components(core.select("cell").distinct(), settle(edges))
    core_points = core.join(labels, "cell")
    border = (
        near_points(marked.where(~F.col("core")).drop("core"), core_points, eps_km, side)
        .groupBy("latitude", "longitude")
        .agg(F.collect_set("n_label").alias("_labels"))
    )
    # a border spot has few clusters in reach: each needs a core point within eps
    named = cluster_numbers(stations.join(core_points.select("latitude", "longitude", "label"), ["latitude", "longitude"]))
    inner = stations.join(core_points.select("latitude", "longitude", "label"), ["latitude", "longitude"]).join(named, "label")
    outer = (
        stations.join(border, ["latitude", "longitude"])
        .withColumn("label", F.explode("_labels"))
        .drop("_labels")
        .join(named, "label")
    )
    keys = [c for c in stations.columns]
    lowest = outer.groupBy(*keys).agg(F.min("cluster").alias("cluster"))
    return inner.select(*keys, "cluster", F.lit(True).alias("is_core")).unionByName(
        lowest.withColumn("is_core", F.lit(False))
    )


def cluster_numbers(core_stations: DataFrame) -> DataFrame:
    """Clusters numbered by their first core station in (city, location) order."""
    first = core_stations.groupBy("label").agg(F.min(F.struct("city", "location", "latitude", "longitude")).alias("_first"))
    return first.select("label", (F.row_number().over(Window.orderBy("_first")) - 1).alias("cluster"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label per node: the smallest node of its component (edges go both ways)."""
    labels = settle(nodes.select("cell", F.col("cell").alias("label")))
    while True:
        heard = edges.join(labels, edges["b"] == labels["cell"]).groupBy("a").agg(F.min("label").alias("_near"))
        passed = labels.join(heard, labels["cell"] == heard["a"], "left").select(
            "cell", F.least("label", F.coalesce("_near", "label")).alias("label"), F.col("label").alias("_old")
        )
        passed = settle(passed)
        jump = passed.select(F.col("cell").alias("_via"), F.col("label").alias("_via_label"))
        jumped = settle(
            passed.join(jump, passed["label"] == jump["_via"]).select(
                "cell", F.least("label", "_via_label").alias("label"), "_old"
            )
        )
        if jumped.where(F.col("label") != F.col("_old")).isEmpty():
            return jumped.select("cell", "label")
        labels = jumped.select("cell", "label")


# --- zones and grid -------------------------------------------------------------


def kmeans_zones(stations: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    n = min(k, stations.select("latitude", "longitude").distinct().limit(k).count())
    vectors = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="_at").transform(stations)
    model = KMeans(k=n, seed=seed, featuresCol="_at", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("_at")


def grid_cells(stations: DataFrame, size: float = 0.5) -> DataFrame:
    """Cell of each station (round half to even) and its number in (lat, lon) order.

    Cells are numbered on the list of cells, which the globe bounds.
    """
    snapped = stations.withColumns({
        "grid_lat": F.bround(F.col("latitude") / size, 0) * size,
        "grid_lon": F.bround(F.col("longitude") / size, 0) * size,
    })
    cells = snapped.select("grid_lat", "grid_lon").distinct()
    numbered = cells.withColumn("cluster", F.row_number().over(Window.orderBy("grid_lat", "grid_lon")) - 1)
    return snapped.join(numbered, ["grid_lat", "grid_lon"])


# --- statistics -----------------------------------------------------------------


def hotspot_stats(clustered: DataFrame, hot: float = HOT, severe: float = SEVERE, digits=(4, 2)) -> DataFrame:
    """Centre, radius, levels, severity and cities per cluster."""
    centre = clustered.groupBy("cluster").agg(
        F.avg("latitude").alias("_lat"),
        F.avg("longitude").alias("_lon"),
        F.avg("avg_value").alias("_avg"),
        F.max("max_value").alias("_max"),
        F.count(F.lit(1)).alias("station_count"),
        F.array_join(F.array_sort(F.collect_set("city")), ", ").alias("affected_cities"),
    )
    spread = clustered.join(centre.select("cluster", "_lat", "_lon"), "cluster").groupBy("cluster").agg(
        F.max(haversine_km("_lat", "_lon", "latitude", "longitude")).alias("_radius")
    )
    a = F.col("_avg")
    level = F.when(a >= severe, F.lit("severe")).when(a >= hot, F.lit("high")).when(a >= 100, F.lit("moderate")).otherwise(F.lit("low"))
    return centre.join(spread, "cluster").select(
        F.format_string("HS-%03d", "cluster").alias("hotspot_id"),
        F.bround("_lat", digits[0]).alias("center_lat"),
        F.bround("_lon", digits[0]).alias("center_lon"),
        F.bround("_radius", digits[1]).alias("radius_km"),
        F.bround("_avg", digits[1]).alias("avg_aqi"),
        F.bround("_max", digits[1]).alias("max_aqi"),
        "station_count",
        level.alias("severity"),
        "affected_cities",
    )


def enrich(hotspots: DataFrame, digits: int = 2) -> DataFrame:
    """Exposed people (10,000 per square kilometre) and a risk score up to 100."""
    people = F.floor(F.lit(math.pi) * F.col("radius_km") * F.col("radius_km") * 10_000)
    out = hotspots.withColumn("estimated_exposed_pop", people)
    score = (
        F.least(F.col("avg_aqi") / 500 * 50, F.lit(50.0))
        + F.least(F.col("estimated_exposed_pop") / 5_000_000 * 30, F.lit(30.0))
        + F.least(F.col("station_count") / 10 * 20, F.lit(20.0))
    )
    return out.withColumn("risk_score", F.bround(score, digits))
