"""Distributed selection against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumisift.operators import aggregates as g
from lumisift.operators import quantiles as q


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    kinds = [lambda: rng.gauss(0, 1), lambda: rng.choice([0.0, -0.0, 1.5, -2.25]), lambda: rng.uniform(-1e300, 1e300),
             lambda: math.ldexp(rng.random(), rng.randrange(-1070, 1000)), lambda: float("inf"), lambda: float("-inf")]
    out = [(rng.choice(["a", "b", None]), rng.choice(kinds)(), rng.randrange(-(1 << 62), 1 << 62)) for _ in range(1500)]
    out += [("hot", 7.25, 1 << 60)] * 600 + [("one", 3.0, -5), ("none", None, None), ("nan", float("nan"), 1), ("nan", 1.0, 2)]
    return out


def expected(values, index):
    ordered = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    return ordered[index(len(ordered))] if ordered else None


@pytest.mark.parametrize("index", [lambda n: n // 2, lambda n: 0, lambda n: n - 1])
def test_selection(spark, rows, index):
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(5)
    on_column = {0: lambda n: F.floor(n / 2)}.get(0) if index(10) == 5 else (lambda n: n - 1) if index(10) == 9 else (lambda n: n * 0)
    for column, at in (("v", 1), ("i", 2)):
        got = {r.k: r.m for r in q.nth_value(df, ["k"], column, on_column, "m").collect()}
        want = {k: expected([r[at] for r in rows if r[0] == k], index) for k in {r[0] for r in rows}}
        want = {k: v for k, v in want.items() if v is not None}
        assert {k: repr(v + 0) for k, v in got.items()} == {k: repr(v + 0) for k, v in want.items()}
        whole = q.nth_value(df, [], column, on_column, "m").collect()
        assert [repr(r.m + 0) for r in whole] == [repr(expected([r[at] for r in rows], index) + 0)]
    assert q.nth_value(df.limit(0), ["k"], "v", on_column, "m").count() == 0


def test_no_window_in_the_plan(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double, i long")
    plan = q.upper_median(df, [], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_sketches_keep_their_bounds(spark):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 3) for _ in range(20_000)]
    df = spark.createDataFrame([(v, f"s{int(v * 1000) % 3000}") for v in values], "v double, source_label string").repartition(7)
    ordered = sorted(values)
    for accuracy in (50, 1000):
        m = q.upper_median(df, [], "v", accuracy=accuracy).first()[0]
        low = sum(v < m for v in ordered)
        assert abs(low - len(ordered) // 2) <= len(ordered) / accuracy + 1
    media = df.withColumns({"media_type": F.lit("image"), "composite": F.col("v")})
    for c in ("status", "category", "preference", "location"):
        media = media.withColumn(c, F.lit("x"))
    exact = df.select("source_label").distinct().count()
    estimate = df.agg(F.approx_count_distinct("source_label", 0.02)).first()[0]
    assert abs(estimate - exact) <= 5 * 0.02 * exact
    assert "rsd" in g.dashboard_stats.__code__.co_varnames
