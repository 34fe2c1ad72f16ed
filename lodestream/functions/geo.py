"""Distances and grids on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = F.radians
    a = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def grid(x: Column, cell: float) -> Column:
    """The nearest multiple of ``cell``, halves to even."""
    return F.rint(x / cell) * cell


def from_dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)
