"""Hooks for models that live outside: the caller brings a pandas UDF, the library filters, thresholds and joins."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import as_list


def score_with(df: DataFrame, scorer, inputs: list[str], name: str, only: Column | None = None) -> DataFrame:
    """Add the scorer's column. Rows outside ``only`` are split off first, so the model never sees them."""
    if only is None:
        return df.withColumn(name, scorer(*inputs))
    wanted = F.coalesce(only, F.lit(False))
    todo = df.filter(wanted).withColumn(name, scorer(*inputs))
    return todo.unionByName(df.filter(~wanted), allowMissingColumns=True)


def unsafe(detections: Column | str, classes: Iterable[str], minimum: float = 0.6) -> Column:
    """True when some detection (class, score) of a listed class reaches the minimum."""
    listed = as_list(classes)
    column = F.col(detections) if isinstance(detections, str) else detections
    return F.exists(
        F.coalesce(column, F.array().cast("array<struct<class:string,score:double>>")),
        lambda x: x.getField("class").isin(*listed) & (x.getField("score") >= minimum),
    )


def mark_unsafe(df: DataFrame, detections: str, classes: Iterable[str], minimum: float = 0.6) -> DataFrame:
    """Write ``nsfw`` and reject the rows it holds for."""
    flag = unsafe(detections, classes, minimum)
    return df.withColumn("nsfw", flag).withColumns(
        {
            "reject_reason": F.when(flag, "nsfw").otherwise(F.col("reject_reason")),
            "status": F.when(flag, "rejected").otherwise(F.col("status")),
        }
    )
