"""Numeric helpers, all evaluated inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at_least(x: Column, low: float) -> Column:
    """``F.greatest`` skips nulls; a missing value stays missing here."""
    return F.when(x.isNotNull(), F.greatest(x.cast("double"), F.lit(float(low))))


def at_most(x: Column, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(x.cast("double"), F.lit(float(high))))


def clamp(x: Column, low: float, high: float) -> Column:
    return at_least(at_most(x, high), low)


def half_even(x: Column, digits: int = 0) -> Column:
    """Round half to even on the binary value (``F.round`` rounds half up on the decimal text)."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def saturate(x: Column, full: float) -> Column:
    """Share of ``full``, at most 1."""
    return at_most(x / F.lit(float(full)), 1.0)


def positive(x: Column) -> Column:
    return at_least(x, 0.0)


def sigmoid(z: Column, clip: float = 10.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(z, -clip, clip)))


def megapixels(width: Column, height: Column) -> Column:
    return width.cast("double") * height / 1_000_000.0
