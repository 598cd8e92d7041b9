"""Deduplication, top-k, interleaving, sessions and spreading."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Category, lookup
from ..functions.names import stem
from ..functions.numbers import col
from .keys import join_by
from .ranges import positions, ranked, running_sum


def dedup_exact(df: DataFrame, key: str = "hash", order: Iterable[str] = ("source_ord", "path")) -> DataFrame:
    """First row per content key in source, then path order, with the number of copies dropped.

    An aggregate rather than a window: copies collapse before the shuffle, so a key that holds a third of all
    rows sends at most one row per input partition.
    """
    first = F.struct(*order)
    payload = F.struct(*df.columns)
    kept = df.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(payload, first).alias("_row"), (F.count("*") - 1).alias("duplicates")
    )
    return kept.select("_row.*", "duplicates")


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int | Column, max_k: int | None = None,
                    name: str = "rank") -> DataFrame:
    """Best k rows per group with their rank.

    The constant bound lets Spark cut each input partition to k rows per group before the shuffle. With k as a
    column, ``max_k`` is its largest value.
    """
    bound = k if isinstance(k, int) else max_k
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn(name, rank)
    if bound is not None:
        out = out.filter(F.col(name) <= bound)
    return out if isinstance(k, int) else out.filter(F.col(name) <= k)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Best n rows over all groups."""
    return df.orderBy(*order).limit(n)


def pick_score() -> Column:
    """Sort key of the face-first pick: faces, grade, closeness, feedback."""
    target = F.coalesce(F.col("has_target_face"), F.lit(False))
    faces = F.coalesce(F.col("face_count"), F.lit(0))
    distance = F.coalesce(F.nullif(F.col("face_distance"), F.lit(0.0)), F.lit(0.6))
    return (
        F.when(target, 20.0).when(faces > 0, 10.0).otherwise(0.0)
        + F.coalesce(F.col("composite"), F.lit(0.0)) * 10.0
        + F.greatest(F.lit(0.0), (0.6 - distance) * 20.0)
        + F.when(F.col("preference") == "like", 8.0).when(F.col("preference") == "dislike", -6.0).otherwise(0.0)
    )


def pick_representative(members: DataFrame, cluster: str = "cluster", key: str = "hash") -> DataFrame:
    """Best member of each cluster and the fields it leaves on the others.

    The best member comes from an aggregate that is joined back, not from a window over the cluster, because one
    cluster may hold a large part of the catalog.
    """
    grade = F.coalesce(F.col("composite"), F.lit(0.0))
    size = F.coalesce(F.col("size_kb"), F.lit(0))
    # the smallest (-grade, -size, key) is the best row
    best = members.groupBy(cluster).agg(
        F.min(F.struct((-grade).alias("g"), (-size).alias("s"), F.col(key).alias("k"))).alias("_best"),
        F.count("*").alias("_size"),
    ).select(cluster, F.col("_best.k").alias("_rep"), "_size")
    is_rep = F.col(key) == F.col("_rep")
    return members.join(best, cluster).select(
        *[c for c in members.columns if c != cluster],
        F.concat(F.lit("c_"), F.substring(F.col("_rep").cast("string"), 1, 12)).alias("cluster_id"),
        is_rep.alias("is_representative"),
        F.when(~is_rep, F.col("_rep")).alias("suppressed_by"),
        F.when(is_rep, F.col("_size")).cast("int").alias("cluster_size"),
    )


def round_robin(
    df: DataFrame,
    bucket: Column,
    score: str,
    targets: dict[str, int],
    default_target: int = 75,
    category: str = "category",
    key: str = "hash",
    name: str = "pick_order",
) -> DataFrame:
    """Order inside each category: by score, or interleaved over time buckets when the pool is large enough.

    Interleaving applies to a category with more than twice its target in rows and more dated rows than its
    target; rows without a bucket then come last. Only sort keys are produced here: a rank inside the bucket.
    """
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(category).agg(
        F.count("*").alias("_pool"), F.count("_bucket").alias("_dated")
    )
    target = F.coalesce(lookup(F.col(category), targets, "targets").cast("int"), F.lit(default_target))
    sizes = sizes.withColumn("_mix", (F.col("_pool") > 2 * target) & (F.col("_dated") > target))
    order = [F.col(score).desc(), F.col(key).asc()]
    inner = join_by(ranked(keyed, [category, "_bucket"], order, "_inner"), sizes.select(category, "_mix"), [category])
    turn = F.when(F.col("_mix") & F.col("_bucket").isNotNull(), F.col("_inner"))
    group = F.when(F.col("_mix") & F.col("_bucket").isNotNull(), F.col("_bucket"))
    tail = F.when(F.col("_mix") & F.col("_bucket").isNull(), 1).otherwise(0)
    keys = inner.withColumns({"_tail": tail, "_turn": turn, "_group": group})
    full = [F.col("_tail").asc(), F.col("_turn").asc(), F.col("_group").asc(), *order]
    return ranked(keys, [category], full, name).drop("_bucket", "_inner", "_mix", "_tail", "_turn", "_group")


def burst_sessions(
    df: DataFrame,
    folder: str,
    name: str,
    histogram: str | None = None,
    max_seconds: int = 10,
    max_gap: int = 3,
    min_similarity: float = 0.95,
) -> DataFrame:
    """Group files in name order; a file joins the group of the previous one when it was taken within seconds of it,
    or is numbered closely after it and looks the same.

    Positions and running group numbers are computed over range partitions, so one folder may be of any size.
    """
    from ..functions.vectors import cosine

    base = stem(name)
    day = F.regexp_extract(base, r"(\d{8})[_-](\d{6})", 1)
    clock = F.regexp_extract(base, r"(\d{8})[_-](\d{6})", 2)
    number = F.regexp_extract(base, r"(\d{3,5})$", 1)
    placed = positions(df, [folder, name], "_position").withColumns(
        {
            "_taken": F.when(F.length(day) > 0, F.try_to_timestamp(F.concat(day, clock), F.lit("yyyyMMddHHmmss"))),
            "_day": day,
            "_prefix": F.when(F.length(number) > 0, F.regexp_replace(base, r"\d{3,5}$", "")),
            "_number": F.when(F.length(number) > 0, number.cast("int")),
        }
    )
    carried = [folder, "_taken", "_day", "_prefix", "_number"] + ([histogram] if histogram else [])
    previous = placed.select(
        (F.col("_position") + 1).alias("_position"), *[F.col(c).alias(f"_before_{c}") for c in carried]
    )
    pairs = placed.join(previous, "_position", "left")
    seconds = F.abs(F.unix_timestamp("_taken") - F.unix_timestamp("_before__taken"))
    close_time = (F.col("_day") == F.col("_before__day")) & (seconds <= max_seconds)
    close_name = (F.col("_prefix") == F.col("_before__prefix")) & (
        F.abs(F.col("_number") - F.col("_before__number")) <= max_gap
    )
    if histogram:
        close_name &= cosine(histogram, f"_before_{histogram}") > min_similarity
    joins = (F.col(folder) == F.col(f"_before_{folder}")) & (
        F.coalesce(close_time, F.lit(False)) | F.coalesce(close_name, F.lit(False))
    )
    flagged = pairs.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    grouped = running_sum(flagged, "_position", F.col("_new"), "burst_id")
    helpers = ["_position", "_new", "_taken", "_day", "_prefix", "_number"]
    return grouped.drop(*helpers, *[f"_before_{c}" for c in carried])


def keep_best_of_bursts(df: DataFrame, weight: Column, name: str, burst: str = "burst_id") -> DataFrame:
    """Bursts of two or more files with the file to keep: largest weight, then the larger name."""
    best = df.groupBy(burst).agg(
        F.max(F.struct(weight.alias("w"), F.col(name).alias("n"))).alias("_best"), F.count("*").alias("burst_size")
    )
    return best.filter(F.col("burst_size") >= 2).select(burst, F.col("_best.n").alias("keep"), "burst_size")


def evenly_spaced(df: DataFrame, by: list[str], order: list[Column | str], n: int, name: str = "slot") -> DataFrame:
    """n rows spread evenly over the ordered group: zero-based index floor(i * N / n); all rows when N <= n."""
    placed = ranked(df, by, order, "_rank")
    sizes = placed.groupBy(*by).agg(F.count("*").alias("_total"))
    slots = sizes.select(
        *by,
        F.explode(
            F.when(
                F.col("_total") > n,
                F.transform(
                    F.sequence(F.lit(0), F.lit(n - 1)),
                    lambda i: F.struct(
                        i.alias("slot"), (F.floor(i * (F.col("_total") / F.lit(n))) + 1).alias("rank")
                    ),
                ),
            )
        ).alias("_s"),
    ).select(*by, F.col("_s.slot").alias(name), F.col("_s.rank").alias("_rank"))
    spread = join_by(placed, slots, [*by, "_rank"]).drop("_rank")
    small = join_by(placed, sizes.filter(F.col("_total") <= n).drop("_total"), by, "left_semi")
    whole = small.withColumn(name, (F.col("_rank") - 1).cast("int")).drop("_rank")
    return spread.unionByName(whole)


def fill_remaining(
    candidates: DataFrame, selected: DataFrame, categories: Iterable[Category], order: list[Column],
    category: str = "category",
) -> DataFrame:
    """Best candidates up to what each category still lacks."""
    wanted = {c.id: c.target for c in categories}
    have = selected.groupBy(category).agg(F.count("*").alias("_have"))
    open_slots = F.greatest(
        F.lit(0), lookup(F.col(category), wanted, "targets").cast("int") - F.coalesce(F.col("_have"), F.lit(0))
    )
    known = candidates.filter(F.col(category).isin(*wanted))
    best = top_k_per_group(known, [category], order, max(wanted.values(), default=0))
    return best.join(have, category, "left").filter(F.col("rank") <= open_slots).drop("_have")


def sort_keys(mode: str, confidence: Column | None = None) -> list[Column]:
    """Sort keys of the selection view."""
    preference = F.coalesce(F.col("preference"), F.lit(""))
    if mode == "grade_desc":
        return [F.coalesce(F.col("composite"), F.lit(0.0)).desc()]
    if mode == "grade_asc":
        return [F.coalesce(F.col("composite"), F.lit(0.0)).asc()]
    if mode == "preference":
        return [F.when(preference == "like", 0).when(preference == "dislike", 2).otherwise(1).asc()]
    if mode == "predicted":
        explicit = F.when(preference == "like", 2).when(preference == "dislike", -2).otherwise(0)
        return [explicit.desc(), (confidence if confidence is not None else F.lit(0)).desc()]
    return [F.col("date").asc_nulls_first()]


def substitutes(
    df: DataFrame,
    categories: Iterable[Category],
    limit: int = 200,
    names_given: bool = True,
    category: str = "category",
    key: str = "asset_id",
) -> DataFrame:
    """Best unselected rows for every category below its target, with the size of the gap."""
    wanted = {c.id: c.target for c in categories}
    chosen = df.filter(F.col("status") == "selected").groupBy(category).agg(F.count("*").alias("_chosen"))
    pool = df.filter(F.col("status").isin("qualified", "pool") & F.col(category).isin(*wanted))
    if names_given:
        pool = pool.filter(F.col("has_target_face"))
    order = [F.coalesce(F.col("composite"), F.lit(0.0)).desc(), F.col(key).asc()]
    best = top_k_per_group(pool, [category], order, limit)
    gap = lookup(F.col(category), wanted, "targets").cast("long") - F.coalesce(F.col("_chosen"), F.lit(0))
    return best.join(chosen, category, "left").withColumn("gap", gap).filter(F.col("gap") > 0).drop("_chosen")


def frame_positions(total: Column | str, n_frames: int) -> Column:
    """Frames to sample from a clip: even steps between 5 % and 95 % of its length."""
    total = col(total)
    start = F.greatest(F.lit(1), F.floor(total * 0.05).cast("int"))
    end = F.greatest(start + 1, F.floor(total * 0.95).cast("int"))
    step = F.greatest(F.lit(1), F.floor((end - start) / n_frames).cast("int"))
    return F.when(total >= 1, F.slice(F.sequence(start, end - 1, step), 1, n_frames))
