"""Coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_even

Dms = tuple[Column, Column, Column, Column]


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    value = degrees.cast("double") + minutes.cast("double") / 60.0 + seconds.cast("double") / 3600.0
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def dms_point(lat: Dms, lon: Dms) -> Column:
    """(lat, lon) with six decimals, null when a part is missing or out of range."""
    la, lo = dms_to_decimal(*lat), dms_to_decimal(*lon)
    valid = la.between(-90, 90) & lo.between(-180, 180)
    return F.struct(
        F.when(valid, half_even(la, 6)).alias("lat"), F.when(valid, half_even(lo, 6)).alias("lon")
    )
