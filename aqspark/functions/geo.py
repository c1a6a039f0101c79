"""Distances and coordinate checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aqspark.functions.bins import col

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def valid_coordinates(lat, lon) -> Column:
    return F.coalesce(col(lat).between(-90, 90) & col(lon).between(-180, 180), F.lit(False))


def normalised_city(city) -> Column:
    return F.replace(F.lower(F.trim(col(city))), F.lit(" "), F.lit("_"))
