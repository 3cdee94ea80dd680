"""Distances on the sphere and neighbourhood cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (a2 - a1) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(half_lon), F.lit(2.0))
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
