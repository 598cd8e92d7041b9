"""Gates, status rules and list filters. All are plain expressions, so they push down to the scan."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import as_list
from ..functions.names import normalize_path
from ..functions.numbers import col


def exclude_paths(df: DataFrame, substrings: Iterable[str] = (), folders: Iterable[str] = ()) -> DataFrame:
    """Drop files whose path contains a substring or lies below one of the named folders."""
    path = normalize_path("path")
    keep = F.lit(True)
    texts = as_list(substrings)
    if texts:
        # one test over a constant array, however many there are
        keep &= ~F.exists(F.array(*[F.lit(t) for t in texts]), lambda t: F.contains(path, t))
    names = as_list(folders)
    if names:
        keep &= ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))
    return df.filter(keep)


def quality_gate(min_kb: float = 80, min_dim: int = 600, mode: str = "both", images_only: bool = True) -> Column:
    """Reason to skip a file, or null.

    ``both``: low resolution when both sides are short; ``either``: when one side is; ``keep_large``: the row is
    kept when one side reaches ``min_dim`` and no size test is made.
    """
    w, h = F.col("width"), F.col("height")
    small = F.col("size_kb") < min_kb
    low = (w < min_dim) | (h < min_dim) if mode == "either" else (w < min_dim) & (h < min_dim)
    reason = F.when(low, "low_res") if mode == "keep_large" else F.when(small, "too_small").when(low, "low_res")
    return F.when(F.col("media_type") != "video", reason) if images_only else reason


def first_reason(*tests: tuple[str, Column]) -> Column:
    """Name of the first test that holds, in the given order; null when none does."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests])


def skip_accounting(df: DataFrame, reason: Column | str) -> DataFrame:
    """Rows per skip reason; kept rows are counted as ``kept``."""
    return df.groupBy(F.coalesce(col(reason), F.lit("kept")).alias("skip_reason")).agg(F.count("*").alias("n"))


def _status(status: str, reason: str | None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reject_reason"))


def initial_status(blur_threshold: float = 50.0) -> Column:
    """Status of a freshly scanned row: screenshot, blur, category tests in this order."""
    return (
        F.when(F.col("is_screenshot"), _status("rejected", "screenshot"))
        .when(F.col("blur_score") < blur_threshold, _status("rejected", "blurry"))
        .when(F.col("category").isNull(), _status("pool", "no_date"))
        .otherwise(_status("qualified", None))
    )


def initial_status_faces(names_given: bool = True) -> Column:
    """Command-line form: faces are tested before the category, blur is not tested."""
    wanted = F.lit(names_given) & ~F.coalesce(F.col("has_target_face"), F.lit(False))
    return (
        F.when(F.col("is_screenshot"), _status("rejected", "screenshot"))
        .when(wanted & (F.coalesce(F.col("face_count"), F.lit(0)) == 0), _status("pool", "no_faces"))
        .when(wanted, _status("pool", "wrong_person"))
        .when(F.col("category").isNull(), _status("pool", "no_date"))
        .otherwise(_status("qualified", None))
    )


def face_status_update(names_given: bool = True, checked: Column | None = None) -> Column:
    """Status after the face pass; ``checked`` is false for rows the pass left out."""
    status, reason = F.col("status"), F.col("reject_reason")
    keep = F.struct(status.alias("status"), reason.alias("reject_reason"))
    checked = F.lit(True) if checked is None else checked
    target = F.coalesce(F.col("has_target_face"), F.lit(False))
    misses = F.lit(names_given) & ~target
    demote = (
        F.when(F.coalesce(F.col("face_count"), F.lit(0)) == 0, _status("pool", "no_faces"))
        .otherwise(_status("pool", "wrong_person"))
    )
    promote = (status == "pool") & reason.isin("no_faces", "wrong_person") & F.col("category").isNotNull()
    unchecked = ~checked & (F.col("media_type") != "video") & (status != "rejected")
    return (
        F.when(unchecked & F.lit(names_given), _status("pool", "no_faces"))
        .when(~checked, keep)
        .when(misses & status.isin("qualified", "selected"), demote)
        .when(misses, keep)
        .when(promote, _status("qualified", None))
        .otherwise(keep)
    )


def with_status(df: DataFrame, decision: Column) -> DataFrame:
    """Write a (status, reject_reason) decision into the row."""
    return (
        df.withColumn("_decision", decision)
        .withColumn("status", F.col("_decision.status"))
        .withColumn("reject_reason", F.col("_decision.reject_reason"))
        .drop("_decision")
    )


def blur_gate(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Keep rows that are sharp enough or were never measured."""
    return df.filter(F.col("blur_score").isNull() | (F.col("blur_score") >= threshold))


def skip_face_check() -> Column:
    """Rows whose faces would be useless; missing sizes count as zero."""
    w, h, kb = (F.coalesce(F.col(c), F.lit(0)) for c in ("width", "height", "size_kb"))
    return (w < 200) | (h < 200) | F.coalesce(F.col("is_screenshot"), F.lit(False)) | (kb < 50)


def gallery_filter(
    df: DataFrame,
    source: str | None = None,
    faces: str | None = None,
    status: str | None = None,
    search: str | None = None,
    location: str | None = None,
    preference: str | None = None,
    grade: str | None = None,
) -> DataFrame:
    """Conjunction of the gallery's filters; an empty filter keeps everything."""
    target = F.coalesce(F.col("has_target_face"), F.lit(False))
    count = F.coalesce(F.col("face_count"), F.lit(0))
    composite = F.col("composite")
    rated = F.coalesce(F.col("preference").isin("like", "dislike"), F.lit(False))
    tests = {
        "faces": {"has_target": target, "has_any": count != 0, "no_face": count <= 0},
        "preference": {
            "like": F.col("preference") == "like",
            "dislike": F.col("preference") == "dislike",
            "unrated": ~rated,
        },
        "grade": {
            "high": composite >= 70,
            "medium": (composite >= 40) & (composite < 70),
            "low": (composite >= 0) & (composite < 40),
        },
    }
    for name, value in (("faces", faces), ("preference", preference), ("grade", grade)):
        if value:
            df = df.filter(tests[name][value])
    if source:
        df = df.filter(F.col("source_label") == source)
    if status:
        df = df.filter(F.col("status") == status)
    if search:
        df = df.filter(F.contains(F.lower("filename"), F.lit(search.lower())))
    if location:
        df = df.filter(F.col("location") == location)
    return df


def list_assets(
    df: DataFrame,
    category: str | None = None,
    status: str | None = None,
    source: str | None = None,
    offset: int = 0,
    limit: int = 100,
    show_duplicates: bool = False,
    compact: bool = True,
    key: str = "hash",
) -> DataFrame:
    """One page of the catalog in key order; suppressed rows stay hidden unless asked for."""
    for column, value in (("category", category), ("status", status), ("source_label", source)):
        if value:
            df = df.filter(F.col(column) == value)
    if not show_duplicates and "suppressed_by" in df.columns:
        df = df.filter(F.col("suppressed_by").isNull())
    if compact:
        df = df.drop("thumb")
    return df.orderBy(key).offset(offset).limit(limit)


def cleanup_list(
    df: DataFrame,
    trash: bool | None = None,
    status: str | None = None,
    category: str | None = None,
    media_type: str | None = None,
    location: str | None = None,
) -> DataFrame:
    """Rows offered for clean-up; a missing media type means image."""
    if trash is not None:
        df = df.filter(F.coalesce(F.col("trash"), F.lit(False)) == trash)
    if media_type:
        df = df.filter(F.coalesce(F.col("media_type"), F.lit("image")) == media_type)
    for column, value in (("status", status), ("category", category), ("location", location)):
        if value:
            df = df.filter(F.col(column) == value)
    return df


def date_bounds(
    date_from: str | None = None,
    date_to: str | None = None,
    age_from: int | None = None,
    age_to: int | None = None,
    birthday: str | None = None,
) -> tuple[Column, Column]:
    """Inclusive bounds; ages become dates and the tighter bound wins (null: open)."""
    born = F.to_date(F.lit(birthday))
    low = [F.to_date(F.lit(date_from)), F.date_add(born, age_from) if age_from is not None else F.lit(None)]
    high = [F.to_date(F.lit(date_to)), F.date_add(born, age_to) if age_to is not None else F.lit(None)]
    return F.greatest(*[c.cast("date") for c in low]), F.least(*[c.cast("date") for c in high])


def date_age_filter(date: Column | str, low: Column, high: Column) -> Column:
    """Reason why a date falls outside the bounds, or null."""
    date = col(date)
    bounded = low.isNotNull() | high.isNotNull()
    return first_reason(
        ("no_date", bounded & date.isNull()), ("before_date", date < low), ("after_date", date > high)
    )


def score_range(df: DataFrame, score: str, below: float | None = None, above: float | None = None) -> DataFrame:
    """Keep scores < below and >= above."""
    if below is not None:
        df = df.filter(F.col(score) < below)
    if above is not None:
        df = df.filter(F.col(score) >= above)
    return df


def selection_reason(fallback_categories: Iterable[str] = (), blur_threshold: float = 50.0) -> Column:
    """Why a row is no selection candidate, or null; fallback categories also take rows without the target."""
    fallback = F.col("category").isin(*as_list(fallback_categories))
    target = F.coalesce(F.col("has_target_face"), F.lit(False))
    return first_reason(
        ("video", F.col("media_type") == "video"),
        ("screenshot", F.col("is_screenshot")),
        ("blurry", F.col("blur_score") < blur_threshold),
        ("nsfw", F.col("nsfw")),
        ("no_category", F.col("category").isNull()),
        ("no_target", ~target & ~fallback),
    )


# Largest face distance by the upper age of a category.
FACE_LIMITS = {"infant": 0.45, "toddler": 0.50, "default": 0.55}
FACE_LIMITS_QUICK = {"infant": 0.45, "toddler": 0.50, "default": 0.50}


def face_limit(age_days_to: Column | str, limits: dict[str, float] = FACE_LIMITS) -> Column:
    upper = F.coalesce(col(age_days_to), F.lit(99999))
    return (
        F.when(upper <= 365, limits["infant"]).when(upper <= 1095, limits["toddler"]).otherwise(limits["default"])
    )


def face_distance_gate(df: DataFrame, age_days_to: Column | str, limits: dict[str, float] = FACE_LIMITS) -> DataFrame:
    """Keep measured distances within the limit of the row's category; an unmeasured distance is dropped."""
    return df.filter(F.col("face_distance") <= face_limit(age_days_to, limits))


def select_eligibility(
    df: DataFrame, names_given: bool, videos_exempt: bool = True, manual: bool = False
) -> DataFrame:
    """Rows that may be selected, with the penalty flag used by manual templates."""
    df = df.filter((F.col("status") != "rejected") & F.col("category").isNotNull())
    if "suppressed_by" in df.columns:
        df = df.filter(F.col("suppressed_by").isNull())
    missing = F.lit(names_given) & ~F.coalesce(F.col("has_target_face"), F.lit(False))
    if videos_exempt:
        missing &= F.coalesce(F.col("media_type"), F.lit("image")) != "video"
    if not manual:
        df = df.filter(~missing)
    return df.withColumn("no_face_penalty", missing)


def is_flat_image(pixels: Column | str, threshold: float = 0.08) -> Column:
    """Few distinct colours per pixel."""
    px = col(pixels)
    return F.size(F.array_distinct(px)) / F.size(px) < threshold


def is_flat_extended(
    color_share: Column, edge_share: Column, std: Column, name: Column | str
) -> Column:
    """Screenshot test of the clean-up job on measured columns and the file name."""
    n = F.lower(col(name))
    return (
        F.contains(n, F.lit("screenshot"))
        | (color_share < 0.08)
        | ((edge_share > 0.15) & (color_share < 0.15))
        | (F.endswith(n, F.lit(".png")) & (std < 40) & (color_share < 0.12))
    )


def backfill_plan(
    assets: DataFrame, vectors: DataFrame, embed_version: str, tagger_version: str, key: str = "hash"
) -> DataFrame:
    """State of the semantic data of every live row and the work it needs."""
    present = vectors.select(key).distinct().withColumn("_present", F.lit(True))
    live = assets.filter(F.coalesce(F.col("status"), F.lit("pool")) != "rejected").join(present, key, "left")
    never = ~F.coalesce(F.col("has_semantic"), F.lit(False))
    stale_embed = ~F.col("embed_version").eqNullSafe(F.lit(embed_version))
    stale_tags = ~F.col("tagger_version").eqNullSafe(F.lit(tagger_version))
    state = F.coalesce(
        first_reason(
            ("never_processed", never),
            ("outdated_embed", stale_embed),
            ("vector_missing", F.col("_present").isNull()),
            ("outdated_tagger", stale_tags),
        ),
        F.lit("current"),
    )
    needs_embed = F.col("state").isin("never_processed", "outdated_embed", "vector_missing")
    return (
        live.withColumn("state", state)
        .withColumn("needs_embed", needs_embed)
        .withColumn("needs_tags", F.col("state") != "current")
        .drop("_present")
    )


def regrade_plan(
    assets: DataFrame, grades: DataFrame, key: str, force: bool = False, have_references: bool = False
) -> DataFrame:
    """Rows to grade: never graded, forced, or references exist now and none were matched before."""
    known = grades.select(key, F.col("recognition").alias("_recognition"), F.lit(True).alias("_graded"))
    empty = F.coalesce(F.size(F.map_keys("_recognition")), F.lit(0)) <= 0
    needed = F.lit(force) | F.col("_graded").isNull() | (F.lit(have_references) & empty)
    return assets.join(known, key, "left").filter(needed).drop("_recognition", "_graded")


def age_results(df: DataFrame, person: str | None = None, sort: str = "age_asc") -> DataFrame:
    """Estimated ages, filtered by person, in the chosen order."""
    if person:
        df = df.filter(F.array_contains("faces_found", person))
    orders = {
        "age_asc": [F.col("estimated_age").asc()],
        "age_desc": [F.col("estimated_age").desc()],
        "name": [F.col("filename").asc()],
        "date": [F.col("date").asc_nulls_first()],
    }
    return df.orderBy(*orders[sort], "asset_id")
