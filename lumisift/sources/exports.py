"""Export plans, manifests, feeds and outlines. Files are never copied here; plans say what to copy where."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Category, lookup
from ..functions.names import extension, stem
from ..operators.ranges import ranked


def _suffixed(name: Column, n: Column) -> Column:
    ext = F.regexp_extract(name, r"(\.[^./\\]+)$", 1)
    return F.when(n > 0, F.concat(stem(name), F.lit("_"), n.cast("string"), ext)).otherwise(name)


def export_plan(df: DataFrame, status: str = "selected", key: str = "hash") -> DataFrame:
    """One row per exported file: source and ``category/filename``; equal names get _1, _2, ... in key order."""
    chosen = df.filter(F.col("status") == status).withColumn("folder", F.coalesce(F.col("category"), F.lit("uncategorized")))
    placed = ranked(chosen, ["folder", "filename"], [F.col(key).asc()], "_n")
    name = _suffixed(F.col("filename"), F.col("_n") - 1)
    return placed.select(key, F.col("path").alias("source"), F.concat_ws("/", "folder", name).alias("dest"))


def write_export_plan(plan: DataFrame, target: str) -> None:
    """One JSON folder per category."""
    parts = plan.withColumn("category", F.substring_index("dest", "/", 1))
    parts.write.mode("overwrite").partitionBy("category").json(target)


def ranked_export_names(df: DataFrame, rank: str = "rank") -> DataFrame:
    """``001_g87__name.jpg``: rank, rounded grade and the original name."""
    grade = F.rint(F.coalesce(F.col("composite"), F.lit(0.0))).cast("int")
    return df.withColumn("export_name", F.format_string("%03d_g%d__%s", F.col(rank), grade, F.col("filename")))


def selection_manifest(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Selected rows with the filters that led to them."""
    used = F.struct(*[F.lit(v).alias(k) for k, v in filters.items()])
    return df.select("hash", F.col("path").alias("source"), "filename", "date", "category", "score", used.alias("filters"))


def write_manifest(df: DataFrame, target: str) -> None:
    df.write.mode("overwrite").json(target)


def gallery_feed(df: DataFrame) -> DataFrame:
    """Short-named projection for a report."""
    zero, false = F.lit(0), F.lit(False)
    return df.select(
        F.col("hash").alias("id"), "path", F.col("filename").alias("fn"), F.col("source_label").alias("src"),
        F.col("device").alias("dev"), "date", F.col("category").alias("cat"),
        F.coalesce("face_count", zero).alias("fc"), F.coalesce("has_target_face", false).alias("target"),
        F.coalesce("width", zero).alias("w"), F.coalesce("height", zero).alias("h"),
        F.coalesce("size_kb", zero).alias("kb"), F.coalesce("is_screenshot", false).alias("ss"),
        F.col("blur_score").alias("blur"), F.col("composite").alias("grade"),
        F.coalesce("status", F.lit("pool")).alias("st"), F.col("reject_reason").alias("rr"),
        F.col("location").alias("loc"), F.col("preference").alias("pref"),
    )


def feed_json(feed: DataFrame) -> DataFrame:
    return feed.select("id", F.to_json(F.struct(*feed.columns)).alias("json"))


def write_analysis(reports: dict[str, DataFrame], target: str) -> None:
    """One JSON folder per report table."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{target.rstrip('/')}/{name}")


def deck_outline(
    df: DataFrame, categories: Iterable[Category], sort: str = "score", per_page: int = 1, key: str = "hash"
) -> DataFrame:
    """Selected images in deck order: configured categories first, others after by name, then score or date."""
    ords = {c.id: i for i, c in enumerate(categories)}
    chosen = df.filter((F.col("status") == "selected") & (F.coalesce(F.col("media_type"), F.lit("image")) != "video"))
    place = F.coalesce(lookup(F.col("category"), ords, "categories").cast("int"), F.lit(len(ords)))
    inner = (
        F.coalesce(F.col("composite"), F.lit(0.0)).desc() if sort == "score" else F.col("date").asc_nulls_first()
    )
    keyed = chosen.withColumn("_ord", place)
    seated = ranked(keyed, [], [F.col("_ord").asc(), F.col("category").asc_nulls_last(), inner, F.col(key).asc()], "slide")
    return seated.withColumn("page", F.floor((F.col("slide") - 1) / per_page) + 1).drop("_ord")
