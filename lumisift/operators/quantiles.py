"""Exact order statistics by distributed selection: no sort, no window, no group in one task.

Every value has a 64-bit key whose order is the order of the values. A pass counts the values of each group by the next
16 bits of their key, among those that share the bits settled so far, and descends into the digit that holds the wanted
rank; four passes settle the key. Only counts move, and a group's counts are at most 2^16 numbers whatever its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .keys import join_by

DIGIT = 16
_LOW = -(1 << 63)


@F.pandas_udf(T.LongType())
def _key_of_double(v: pd.Series) -> pd.Series:
    x = v.to_numpy("float64") + 0.0  # one zero
    bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64((1 << 63) - 1)))


@F.pandas_udf(T.DoubleType())
def _double_of_key(k: pd.Series) -> pd.Series:
    bits = k.to_numpy("int64")
    return pd.Series((bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.float64))


def nth_value(df: DataFrame, by: list[str], value: str, index, name: str) -> DataFrame:
    """(by, name): element ``index(n)`` (zero-based, a column of the group's count n) of the sorted values of each group.

    Null values do not count; NaN is the largest value, as in Spark's order. Numbers of any type but decimals with a
    fraction are exact. Groups without values have no row; null is a group like any other.
    """
    kind = df.schema[value].dataType
    whole = isinstance(kind, T.IntegralType)
    groups = by or ["_all"]
    rows = df.filter(F.col(value).isNotNull())
    if not by:
        rows = rows.withColumn("_all", F.lit(1))
    counts = rows.groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    key = F.col("_v").cast("long") if whole else _key_of_double(F.col("_v").cast("double"))
    # unsigned order, so that digits ascend
    counts = cut_lineage(counts.select(*groups, key.bitwiseXOR(F.lit(_LOW)).alias("_k"), "_n"))
    state = counts.groupBy(*groups).agg(F.sum("_n").alias("_n")).select(
        *groups, index(F.col("_n")).cast("long").alias("_need"), F.lit(0).cast("long").alias("_prefix"))
    mask = F.lit((1 << DIGIT) - 1).cast("long")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        state = cut_lineage(state)
        part = join_by(counts, state, groups)
        if shift < 64 - DIGIT:
            part = part.filter(F.shiftrightunsigned("_k", shift + DIGIT) == F.col("_prefix"))
        digit = F.shiftrightunsigned("_k", shift).bitwiseAND(mask)
        sums = part.groupBy(*groups, "_need", "_prefix", digit.alias("_d")).agg(F.sum("_n").alias("_n"))
        listed = sums.groupBy(*groups, "_need", "_prefix").agg(F.array_sort(F.collect_list(F.struct("_d", "_n"))).alias("_s"))
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(-1).cast("long").alias("digit"))
        found = F.aggregate(
            "_s", start,
            lambda acc, x: F.when(acc["digit"] >= 0, acc).when(acc["before"] + x["_n"] > F.col("_need"), F.struct(
                acc["before"].alias("before"), x["_d"].alias("digit"))).otherwise(
                F.struct((acc["before"] + x["_n"]).alias("before"), acc["digit"].alias("digit"))))
        state = listed.withColumn("_f", found).select(
            *groups, (F.col("_need") - F.col("_f.before")).alias("_need"),
            F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_f.digit")).alias("_prefix"))
    key = F.col("_prefix").bitwiseXOR(F.lit(_LOW))
    # a pandas function gives NaN back as null
    out = key if whole else F.coalesce(_double_of_key(key), F.lit(float("nan")))
    return state.select(*by, out.cast(kind).alias(name))


def upper_median(df: DataFrame, by: list[str], value: str, name: str = "median", accuracy: int | None = None) -> DataFrame:
    """Element n div 2 (zero-based) of the sorted values of each group.

    With ``accuracy`` a mergeable sketch answers in one aggregate: the value returned has a rank within n / accuracy of
    the wanted one.
    """
    if accuracy is None:
        return nth_value(df, by, value, lambda n: F.floor(n / 2), name)
    rows = df.filter(F.col(value).isNotNull())
    return rows.groupBy(*by).agg(F.percentile_approx(value, 0.5, accuracy).alias(name))
