"""Ranks and running totals that do not gather a group in one task.

A plain window sends all rows of its partition key to one task. Here rows are range-partitioned by
(group, order), so a hot group spreads over many tasks; positions come from per-partition counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
BLOCK_ROWS = 50_000


def _plain(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def positions(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """Dense zero-based position of every row in the total order."""
    keys = _plain(order)
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    tagged = cut_lineage(ordered.withColumn("_row", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_part", F.shiftright("_row", _ROW_BITS))
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition, so this window stays tiny whatever the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return tagged.join(starts, "_part").withColumn(name, F.col("_start") + inside).drop("_row", "_part", "_start")


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """One-based rank inside each group; ``order`` must be total. Works for groups of any size."""
    placed = positions(df, [*by, *order], "_position")
    if not by:
        return placed.withColumn(name, F.col("_position") + 1).drop("_position")
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    firsts = placed.groupBy(*keys).agg(F.min("_position").alias("_first"))
    condition = F.lit(True)
    for i, c in enumerate(by):
        condition &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    joined = placed.join(firsts, condition).drop(*[f"_by{i}" for i in range(len(by))])
    return joined.withColumn(name, F.col("_position") - F.col("_first") + 1).drop("_position", "_first")


def running_sum(df: DataFrame, position: str, value: Column, name: str) -> DataFrame:
    """Inclusive running sum over dense positions, in blocks of bounded size."""
    cut = df.withColumn("_block", F.floor(F.col(position) / BLOCK_ROWS)).withColumn("_value", value)
    inside = Window.partitionBy("_block").orderBy(position)
    cut = cut.withColumn("_inside", F.sum("_value").over(inside))
    totals = cut.groupBy("_block").agg(F.sum("_value").alias("_total"))
    # one row per block of BLOCK_ROWS rows
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    return (
        cut.join(starts, "_block")
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_block", "_value", "_inside", "_base")
    )
