"""Distances on the sphere."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), F.lit(2.0))
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def metres_fix(d: Column) -> Column:
    """Distances over 1000 were given in metres."""
    return F.when(d > 1000.0, d / 1000.0).otherwise(d)


def distance_bucket(d: Column, method: Column | None = None) -> Column:
    point = d.isNull()
    if method is not None:
        point = point | F.coalesce(method == "point", F.lit(False))
    return (
        F.when(point, "point")
        .when(d <= 75.0, "near_station")
        .when(d <= 150.0, "medium_distance_station")
        .when(d <= 200.0, "far_station")
        .otherwise("too_far_station")
    )
