"""Spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqspark import dims
from aqspark.functions.geo import haversine_km
from aqspark.operators import hotspot as hs
from aqspark.operators import rollup
from aqspark.plans.marts import rounded
from aqspark.plans.registry import query
from aqspark.plans.tables import CITIES

ST = """st AS (SELECT city, location, latitude, longitude, avg(value) AS avg_value, max(value) AS max_value, count(*) AS reading_count
  FROM readings WHERE parameter IN ('aqi', 'pm25') GROUP BY 1, 2, 3, 4)"""
KM = lambda a, b: (
    f"(2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude))"
    f" * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)))))"
)


def stations(t):
    return rollup.station_aggregate(t.readings.where(F.col("parameter").isin("aqi", "pm25")))


def hot_stations(t):
    return stations(t).where(F.col("avg_value") >= hs.HOT)


_DELHI = dims.CITY_COORDINATES["Delhi"]


@query("g01_haversine", f"""
SELECT s.location, round({KM('d', 's')}, 6) AS km_from_delhi FROM stations s, (SELECT CAST({_DELHI[0]} AS DOUBLE) AS latitude, CAST({_DELHI[1]} AS DOUBLE) AS longitude) d""")
def haversine(t):
    km = haversine_km(F.lit(_DELHI[0]), F.lit(_DELHI[1]), "latitude", "longitude")
    return t.stations.select("location", F.round(km, 6).alias("km_from_delhi"))


NB = ST + f""", nb AS (SELECT a.location, count(*) - 1 AS neighbours, (sum(b.avg_value) - max(a.avg_value)) / nullif(count(*) - 1, 0) AS nm, max(a.avg_value) AS av
  FROM st a JOIN st b ON {KM('a', 'b')} <= 15 GROUP BY 1)"""


@query("j19_neighbours_within_15km", NB + " SELECT location, neighbours, round(nm, 6) AS neighbour_mean FROM nb")
def neighbours(t):
    return rounded(hs.neighbour_statistics(stations(t)).select("location", "neighbours", "neighbour_mean"))


@query("w26_stations_unlike_neighbours", NB + """
SELECT location, round(av, 6) AS avg_value, coalesce(abs(av - nm) > 3e-1 * nm, false) AS differs_from_neighbours FROM nb""")
def unlike(t):
    return rounded(hs.inconsistent_stations(stations(t)).select("location", "avg_value", "differs_from_neighbours"))


GRID = ST + """, gs AS (SELECT *, round_even(latitude / 5e-1, 0) * 5e-1 AS gla, round_even(longitude / 5e-1, 0) * 5e-1 AS glo FROM st WHERE avg_value >= 200),
gn AS (SELECT *, dense_rank() OVER (ORDER BY gla, glo) - 1 AS cluster FROM gs)"""


@query("g04_grid_cells", GRID + " SELECT location, gla AS grid_lat, glo AS grid_lon, CAST(cluster AS INTEGER) AS cluster FROM gn")
def grid(t):
    return hs.grid_cells(hot_stations(t)).select("location", "grid_lat", "grid_lon", "cluster")


HOTSPOTS = GRID + f""",
hc AS (SELECT cluster, avg(latitude) AS latitude, avg(longitude) AS longitude, avg(avg_value) AS a, max(max_value) AS m, count(*) AS station_count,
  array_to_string(list_sort(list(DISTINCT city)), ', ') AS affected_cities FROM gn GROUP BY 1),
hr AS (SELECT c.cluster, max({KM('c', 'g')}) AS r FROM gn g JOIN hc c USING (cluster) GROUP BY 1),
hp AS (SELECT printf('HS-%03d', cluster) AS hotspot_id, round(latitude, 6) AS center_lat, round(longitude, 6) AS center_lon, round(r, 6) AS radius_km,
  round(a, 6) AS avg_aqi, round(m, 6) AS max_aqi, station_count, CASE WHEN a >= 300 THEN 'severe' WHEN a >= 200 THEN 'high' WHEN a >= 100 THEN 'moderate' ELSE 'low' END AS severity,
  affected_cities FROM hc JOIN hr USING (cluster)),
he AS (SELECT *, CAST(floor(pi() * radius_km * radius_km * 10000) AS BIGINT) AS estimated_exposed_pop FROM hp),
hotspots AS (SELECT *, round(least(avg_aqi / 500 * 50, 5e1) + least(estimated_exposed_pop / 5000000 * 30, 3e1) + least(station_count / 10 * 20, 2e1), 8) AS risk_score FROM he)"""
_STAT_COLS = "hotspot_id, center_lat, center_lon, radius_km, avg_aqi, max_aqi, station_count, severity, affected_cities"


def grid_hotspots(t):
    return hs.enrich(hs.hotspot_stats(hs.grid_cells(hot_stations(t)), digits=(6, 6)), digits=8)


@query("g05_hotspot_statistics", HOTSPOTS + f" SELECT {_STAT_COLS} FROM hotspots")
def statistics(t):
    return hs.hotspot_stats(hs.grid_cells(hot_stations(t)), digits=(6, 6))


@query("g06_exposure_and_risk", HOTSPOTS + " SELECT hotspot_id, estimated_exposed_pop, risk_score FROM hotspots")
def risk(t):
    return grid_hotspots(t).select("hotspot_id", "estimated_exposed_pop", "risk_score")


# with one density cluster per group of cells the twin closes the neighbour relation
DB = ST + f""",
dh AS (SELECT *, row_number() OVER (ORDER BY city, location, latitude, longitude) AS id FROM st WHERE avg_value >= 200),
dn AS (SELECT a.id AS a, b.id AS b FROM dh a JOIN dh b ON {KM('a', 'b')} <= 15),
dcore AS (SELECT a AS id FROM dn GROUP BY 1 HAVING count(*) >= 3)"""


@query("g02_density_clusters", DB + """,
dreach(root, id) AS (SELECT id, id FROM dcore UNION SELECT r.root, e.b FROM dreach r JOIN dn e ON e.a = r.id JOIN dcore c ON c.id = e.b),
dlab AS (SELECT id, min(root) AS lab FROM dreach GROUP BY 1),
dnum AS (SELECT lab, row_number() OVER (ORDER BY lab) - 1 AS cluster FROM (SELECT DISTINCT lab FROM dlab)),
dall AS (SELECT id, cluster, true AS is_core FROM dlab JOIN dnum USING (lab)
  UNION ALL SELECT n.a, min(m.cluster), false FROM dn n JOIN dlab l ON l.id = n.b JOIN dnum m USING (lab)
    WHERE n.a NOT IN (SELECT id FROM dcore) GROUP BY n.a)
SELECT location, CAST(cluster AS INTEGER) AS cluster, is_core FROM dall JOIN dh USING (id)""")
def dbscan(t):
    return hs.dbscan(hot_stations(t)).select("location", "cluster", "is_core")


@query("g02_density_hotspots")
def dbscan_hotspots(t):
    return hs.enrich(hs.hotspot_stats(hs.dbscan(hot_stations(t))))


@query("g03_kmeans_zones")
def kmeans(t):
    return hs.enrich(hs.hotspot_stats(hs.kmeans_zones(hot_stations(t))))
