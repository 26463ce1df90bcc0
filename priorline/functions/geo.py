"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.7613


def great_circle_miles(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance of two places in degrees."""
    dlat, dlon = F.radians(lat_b - lat_a), F.radians(lon_b - lon_a)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return 2 * EARTH_MILES * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
