"""Joins on group columns that may be null: null is a group like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(names: list[str], prefix: str) -> Column:
    """Null-safe equality of columns with their prefixed counterparts."""
    out = F.lit(True)
    for n in names:
        out &= F.col(n).eqNullSafe(F.col(f"{prefix}{n}"))
    return out


def join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on the columns of ``by``, null equal to null; they appear once in the result."""
    marked = right.select(*[F.col(c).alias(f"_by_{c}" if c in by else c) for c in right.columns])
    out = left.join(marked, same(by, "_by_"), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_by_{c}" for c in by])
