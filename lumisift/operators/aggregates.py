"""Reports: counts, coverage bands, summaries. Every grouping collapses before its shuffle."""

from __future__ import annotations

from typing import Iterable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Category, category_table
from ..functions.numbers import col, half_even
from ..functions.vectors import unit_normalize
from .quantiles import upper_median


def _with_all(counts: DataFrame, categories: Iterable[Category], key: str = "category") -> DataFrame:
    """Configured categories in their order, zeros included."""
    dim = category_table(counts.sparkSession, categories)
    filled = dim.join(counts, dim["id"] == counts[key], "left").drop(key)
    numbers = [c for c in counts.columns if c != key]
    return filled.fillna(0, subset=numbers)


def scan_summary(df: DataFrame, categories: Iterable[Category]) -> DataFrame:
    """Rows by status, and qualified rows by configured category."""
    by_status = df.groupBy("status").agg(F.count("*").alias("n")).select(
        F.lit("status").alias("section"), F.lit(None).cast("int").alias("ord"), F.col("status").alias("name"), "n"
    )
    qualified = df.filter(F.col("status") == "qualified").groupBy("category").agg(F.count("*").alias("n"))
    by_category = _with_all(qualified, categories).select(
        F.lit("category").alias("section"), "ord", F.col("id").alias("name"), "n"
    )
    return by_status.unionByName(by_category)


def coverage_band(count: Column, target: Column) -> Column:
    ratio = F.when(target > 0, count / target).otherwise(0.0)
    return (
        F.when(count == 0, "empty").when(ratio < 0.3, "critical").when(ratio < 0.7, "low")
        .when(ratio < 1.0, "close").when(ratio > 3.0, "overflow").otherwise("ok")
    )


def analyze_categories(df: DataFrame, categories: Iterable[Category]) -> DataFrame:
    """Qualified count against target, with band, surplus, deficit and the pool that could fill it."""
    qualified = F.coalesce(F.col("status"), F.lit("pool")) == "qualified"
    counts = df.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.count_if(qualified).alias("count"), F.count_if(~qualified).alias("pool_available")
    )
    n, t = F.col("count"), F.col("target")
    return _with_all(counts, categories).select(
        "ord", "id", "display", "count", "target",
        F.when(t > 0, n / t).otherwise(0.0).alias("ratio"),
        coverage_band(n, t).alias("band"),
        "pool_available",
        F.greatest(F.lit(0), n - t).alias("surplus"),
        F.greatest(F.lit(0), t - n).alias("deficit"),
    )


def analyze_totals(df: DataFrame, categories: Iterable[Category]) -> DataFrame:
    """One row: totals, target sum and exclusive face statistics."""
    cats = list(categories)
    known = F.coalesce(F.col("category").isin(*[c.id for c in cats]), F.lit(False))
    qualified = (F.coalesce(F.col("status"), F.lit("pool")) == "qualified") & known
    target = F.coalesce(F.col("has_target_face"), F.lit(False))
    faces = F.coalesce(F.col("face_count"), F.lit(0)) > 0
    return df.agg(
        F.count("*").alias("total_images"),
        F.count_if(qualified).alias("total_qualified"),
        F.count_if(~qualified).alias("total_pool"),
        F.lit(sum(c.target for c in cats)).cast("long").alias("total_target"),
        F.count_if(target).alias("with_target"),
        F.count_if(~target & faces).alias("with_any"),
        F.count_if(~target & ~faces).alias("no_face"),
        F.count_distinct(F.coalesce(F.col("source_label"), F.lit("unknown"))).alias("sources"),
    )


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce(F.col("source_label"), F.lit("unknown")).alias("source_label")).agg(
        F.count("*").alias("n")
    )


def recommendations(
    per_category: DataFrame, totals: DataFrame, total_range: tuple[int, int], event_type: str,
    advice: dict[str, str] | None = None,
) -> DataFrame:
    """Advice rows (type, title, detail) derived from the two analysis tables."""
    low, high = total_range
    q, t = F.col("total_qualified"), F.col("total_target")

    def rows(df: DataFrame, test: Column, kind: str, title: Column, detail: Column) -> DataFrame:
        return df.filter(test).select(F.lit(kind).alias("type"), title.alias("title"), detail.alias("detail"))

    # Texts of the recommendations.
    empties = per_category.filter(F.col("band") == "empty").agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "display"))), lambda s: s.display), ", ").alias("names"),
    )
    out = [
        rows(totals, q < low, "warning", F.lit("Collection too small"), F.format_string(
            f"You have %d qualified images but {event_type} typically needs {low}-{high}. Add more sources or relax filters.", q)),
        rows(totals, q > high * 2, "info", F.lit("Very large pool to choose from"), F.format_string(
            "You have %d qualified images. Use auto-select to pick the best %d with diversity.", q, t)),
        rows(empties, F.col("n") > 0, "critical", F.format_string("%d empty categories", "n"), F.format_string(
            "No images in: %s. Check if your sources cover these periods, or manually assign from pool.", "names")),
        rows(per_category, F.col("band") == "critical", "warning", F.format_string("'%s' critically low", "display"),
             F.format_string("Only %d/%d images. %d pool candidates available.", "count", "target", "pool_available")),
        rows(per_category, F.col("band") == "overflow", "info", F.format_string("'%s' has excess images", "display"),
             F.format_string("%d images vs target %d (%d surplus). Auto-select will pick the best %d.", "count", "target", "surplus", "target")),
        rows(totals, F.col("sources") == 1, "warning", F.lit("Single source"), F.lit(
            "All images from one source. Adding more sources (cloud, USB, shared albums) improves coverage and variety.")),
        rows(totals, F.col("no_face") > q * 0.5, "info", F.lit("Many images without detected faces"), F.format_string(
            "%d/%d images have no faces. Consider enabling face detection to prioritize people shots.", "no_face", "total_images")),
    ]
    if advice:
        tips = [("tip", name.replace("_", " ").title(), text) for name, text in advice.items()]
        out.append(totals.sparkSession.createDataFrame(tips, "type string, title string, detail string"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def dashboard_stats(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """One row for the start page; images whose media type is missing count as images. With ``rsd`` sources are counted
    by a mergeable sketch of that relative standard deviation."""
    label = F.coalesce(F.col("source_label"), F.lit(""))
    video = F.coalesce(F.col("media_type"), F.lit("image")) == "video"
    g = F.col("composite")
    return df.agg(
        F.count("*").alias("total_media"),
        F.count_if(~video).alias("total_images"),
        F.count_if(video).alias("total_videos"),
        F.count_if(F.col("status") == "qualified").alias("qualified"),
        F.count_if(F.col("status") == "selected").alias("selected"),
        F.count_if((F.col("status") == "selected") & video).alias("selected_videos"),
        F.count_if(F.col("status") == "pool").alias("pool"),
        F.count_if(F.col("reject_reason") == "blurry").alias("rejected_blurry"),
        half_even(F.avg(g), 1).alias("grade_avg"),
        F.count_if(g >= 70).alias("grade_high"),
        F.count_if((g >= 40) & (g < 70)).alias("grade_medium"),
        F.count_if(g < 40).alias("grade_low"),
        (F.count_distinct(label) if rsd is None else F.approx_count_distinct(label, rsd)).alias("sources"),
    )


def category_summary(df: DataFrame, categories: Iterable[Category]) -> DataFrame:
    counts = df.groupBy("category").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "selected").alias("selected"),
        F.count_if(F.col("status") == "qualified").alias("qualified"),
    )
    return _with_all(counts, categories).select("ord", "id", "display", "target", "total", "selected", "qualified")


def location_summary(df: DataFrame) -> DataFrame:
    return df.filter(F.col("location").isNotNull()).groupBy("location").agg(F.count("*").alias("n")).orderBy("location")


def preference_summary(df: DataFrame) -> DataFrame:
    liked = F.count_if(F.col("preference") == "like")
    disliked = F.count_if(F.col("preference") == "dislike")
    return df.agg(
        liked.alias("liked"), disliked.alias("disliked"), (F.count("*") - liked - disliked).alias("unrated"),
        F.count("*").alias("total"),
    )


def rated_rows(df: DataFrame) -> DataFrame:
    """Rows with any feedback, reduced to the fields a model can use."""
    return df.filter(F.col("preference").isNotNull()).select(
        "hash", "preference", "category", "face_count", "has_target_face", "size_kb", "width", "height", "device",
        "source_label",
    )


def trash_summary(df: DataFrame) -> DataFrame:
    mine = df.filter(F.col("trash"))
    return mine.agg(F.count("*").alias("n"), half_even(F.coalesce(F.sum("size_kb"), F.lit(0)) / 1024.0, 1).alias("mb"))


# Grade bands.
GRADE_BANDS = ((0, 20, "Very Low"), (20, 40, "Low"), (40, 60, "Medium"), (60, 80, "Good"), (80, 100.1, "Excellent"))


def grade_band(value: Column | str) -> Column:
    v = col(value)
    return F.coalesce(*[F.when((v >= lo) & (v < hi), F.lit(label)) for lo, hi, label in GRADE_BANDS])


def grade_summary(df: DataFrame, value: str = "overall", accuracy: int | None = None) -> DataFrame:
    """One row: count, min, max, average, upper median (``accuracy``: see ``upper_median``) and the five bands."""
    bands = grade_band(value)
    base = df.agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"),
        *[F.count_if(bands == label).alias("band_" + label.lower().replace(" ", "_")) for _, _, label in GRADE_BANDS],
    )
    # both sides have one row
    one = F.lit(1).alias("_one")
    return base.select("*", one).join(upper_median(df, [], value, accuracy=accuracy).select("*", one), "_one", "left").drop("_one")


def grade_by_group(df: DataFrame, group: str, value: str = "overall") -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"))


def recognition_summary(df: DataFrame, scores: str = "recognition", matched_over: float = 25.0) -> DataFrame:
    """Per person: matched rows and the average score of all rows."""
    rows = df.select(F.explode(scores).alias("person", "score"))
    return rows.groupBy("person").agg(
        F.count_if(F.col("score") > matched_over).alias("matched"), F.avg("score").alias("avg_score")
    )


def before_after(before: DataFrame, removed: DataFrame, added: DataFrame, target: int, category: str = "category") -> DataFrame:
    """Rows per category before, removed, added and final, with a mark and a total row."""
    tagged = None
    for name, part in (("before", before), ("removed", removed), ("added", added)):
        counts = part.groupBy(category).agg(F.count("*").alias("n")).withColumn("step", F.lit(name))
        tagged = counts if tagged is None else tagged.unionByName(counts)

    def total(step: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("step") == step, F.col("n"))), F.lit(0))

    final = total("before") - total("removed") + total("added")
    per = tagged.rollup(category).agg(
        F.grouping(category).alias("_all"),
        total("before").alias("before"), total("removed").alias("removed"), total("added").alias("added"),
        final.alias("final"),
    )
    mark = F.when(F.col("_all") == 1, F.lit(None)).when(F.col("final") < target, "LOW").otherwise("OK")
    label = F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(category))
    return per.select(label.alias(category), "before", "removed", "added", "final", mark.alias("mark"))


def coverage_deficit(df: DataFrame, categories: Iterable[Category], target: int, low: int = 50) -> DataFrame:
    counts = df.groupBy("category").agg(F.count("*").alias("count"))
    n = F.col("count")
    mark = F.when(n == 0, "MISSING").when(n < low, "LOW").otherwise("OK")
    return _with_all(counts, categories).select(
        "ord", "id", n, F.greatest(F.lit(0), F.lit(target) - n).alias("needed"), mark.alias("mark")
    )


def video_rollup(frames: DataFrame, key: str = "hash") -> DataFrame:
    """One row per clip: most faces, all persons, smallest distance, fields of the sharpest frame (first on ties)."""
    sharpest = F.struct(F.col("sharpness"), -F.col("frame_no"))
    return frames.groupBy(key).agg(
        F.max("face_count").alias("face_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("persons")))).alias("faces_found"),
        F.min("face_distance").alias("face_distance"),
        F.max_by("frame_no", sharpest).alias("best_frame"),
        F.max_by("grade", sharpest).alias("grade"),
        F.max("sharpness").alias("sharpness"),
        F.count("*").alias("n_frames"),
    )


def centroid(vectors: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Mean vector per group, scaled to length one. ``Summarizer`` merges partial sums before the shuffle."""
    mean = vectors.groupBy(*by).agg(
        Summarizer.mean(array_to_vector(F.col(v).cast("array<double>"))).alias("_mean"), F.count("*").alias("n")
    )
    return mean.withColumn("centroid", unit_normalize(vector_to_array("_mean"))).drop("_mean")


def reference_diversity(encodings: DataFrame, person: str = "person", photo: str = "photo", enc: str = "enc") -> DataFrame:
    """Spread of a person's reference encodings, with issues and tips.

    Distances are summed up inside bounded blocks, so no pair leaves its task.
    """
    from .similarity import distance_statistics

    dist = distance_statistics(encodings, photo, enc, by=[person])
    counts = encodings.groupBy(person).agg(F.count(enc).alias("encodings"))
    n, m = F.col("encodings"), F.coalesce(F.col("mean_dist"), F.lit(0.0))
    measured = n >= 3

    def texts(*pairs_: tuple[Column, Column]) -> Column:
        listed = F.array(*[F.when(test, text) for test, text in pairs_])
        return F.filter(listed, lambda x: x.isNotNull())

    # Issue and tip texts.
    issues = texts(
        (n == 0, F.lit("No faces could be encoded from any photo")),
        (n.between(1, 2), F.format_string("Only %d encoding(s). Need at least 3-5 for reliable recognition", n)),
        (measured & (m < 0.3), F.lit("Photos are very similar — all seem to be the same angle/age")),
    )
    tips = texts(
        (n.between(1, 2), F.lit("Add more photos with clear, front-facing views")),
        (measured & (m < 0.3), F.lit("Add photos from different ages and angles for better multi-age recognition")),
        (measured & (m >= 0.3) & (m < 0.45), F.lit("Consider adding photos from more diverse ages/angles")),
        (measured & (n < 5), F.format_string("You have %d good encodings. 5-10 is ideal for multi-age recognition", n)),
        (measured, F.lit("For best results across ages: include baby, toddler, child, and recent photos")),
    )
    return (
        counts.join(dist, person, "left")
        .withColumn("diversity_score", F.when(measured, half_even(F.least(m / 0.6, F.lit(1.0)), 2)).otherwise(0.0))
        .withColumn("saved_score", F.when(measured, F.least(m / 0.6, F.lit(1.0))).when(n >= 1, 0.3).otherwise(0.0))
        .withColumn("issues", issues)
        .withColumn("tips", tips)
        .withColumn("ready", measured & (F.size("issues") == 0))
    )


def reference_check(boxes: DataFrame, person: str = "person", photo: str = "photo") -> DataFrame:
    """Status of each reference photo; with several faces the one with the largest box counts.

    ``boxes`` has one row per face: top, right, bottom, left, enc; a photo without a face has null boxes.
    """
    area = (F.col("bottom") - F.col("top")) * (F.col("right") - F.col("left"))
    faces = F.count("top")
    # the first of equally large faces counts
    best = F.max_by(F.struct(F.col("enc")), F.when(F.col("top").isNotNull(), F.struct(area, -F.col("face_no"))))
    agg = boxes.groupBy(person, photo).agg(faces.alias("faces"), best.alias("_best"))
    encoded = F.col("_best.enc").isNotNull()
    status = (
        F.when(F.col("faces") == 0, "no_face").when(~encoded, "encode_fail")
        .when(F.col("faces") > 1, "ok_multi").otherwise("ok")
    )
    return agg.select(person, photo, "faces", status.alias("state"), F.col("_best.enc").alias("enc"))


def source_mix(df: DataFrame, category: str = "category", device: str = "device") -> DataFrame:
    """Share of each device inside a category; the window sees one row per (category, device)."""
    counts = df.groupBy(category, device).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(category)))


def date_range(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count(date).alias("dated"))


def value_counts(df: DataFrame, value: Column | str, name: str) -> DataFrame:
    return df.groupBy(col(value).alias(name)).agg(F.count("*").alias("n"))


def persons_histogram(df: DataFrame, persons: str = "faces_found") -> DataFrame:
    return value_counts(df.select(F.explode(persons).alias("person")), "person", "person")


def adaptive_periods(df: DataFrame, date: str = "date", cap: int = 100, existing: DataFrame | None = None,
                     existing_by_name: dict[str, int] | None = None) -> DataFrame:
    """Period label of every row: the coarsest of year, half, quarter, month whose fullest bucket fits the cap.

    ``existing_by_name`` are counts of folders already there: each counts towards its year; a whole-year folder is
    also spread over the buckets of a finer split.
    """
    dated = df.filter(F.col(date).isNotNull())
    monthly = dated.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.count("*").alias("n"))
    years_have: dict[int, int] = {}
    whole_have: dict[int, int] = {}
    for folder, n in (existing_by_name or {}).items():
        if folder[:4].isdigit():
            years_have[int(folder[:4])] = years_have.get(int(folder[:4]), 0) + n
            if folder[4:5] != "_":
                whole_have[int(folder[:4])] = whole_have.get(int(folder[:4]), 0) + n
    from ..config import lookup

    def have(table: dict[int, int]) -> Column:
        return F.coalesce(lookup(F.col("year"), table, "existing folders").cast("long"), F.lit(0)) if table else F.lit(0)

    def fullest(months: int) -> Column:
        """Largest bucket of that many months, from the year's twelve sums."""
        slots = [
            F.coalesce(F.sum(F.when(F.col("month").between(s, s + months - 1), F.col("n"))), F.lit(0))
            for s in range(1, 13, months)
        ]
        return F.greatest(*slots) if len(slots) > 1 else slots[0]

    per_year = monthly.groupBy("year").agg(
        fullest(12).alias("_y"), fullest(6).alias("_h"), fullest(3).alias("_q")
    ).withColumns(
        {
            "_y": F.col("_y") + have(years_have),
            "_h": F.col("_h") + F.floor(have(whole_have) / 2),
            "_q": F.col("_q") + F.floor(have(whole_have) / 4),
        }
    )
    level = (
        F.when(F.col("_y") <= cap, "year").when(F.col("_h") <= cap, "half")
        .when(F.col("_q") <= cap, "quarter").otherwise("month")
    )
    rules = per_year.select(F.col("year").alias("_year"), level.alias("_level"))
    y, m = F.year(date).cast("string"), F.month(date)
    label = (
        F.when(F.col("_level") == "year", y)
        .when(F.col("_level") == "half", F.concat(y, F.when(m <= 6, "_H1").otherwise("_H2")))
        .when(F.col("_level") == "quarter", F.concat(y, F.lit("_Q"), F.quarter(date).cast("string")))
        .otherwise(F.concat(y, F.lit("_"), F.lpad(m.cast("string"), 2, "0")))
    )
    return dated.join(rules, F.year(date) == F.col("_year")).withColumn("period", label).drop("_year", "_level")


def selection_report(
    selected: DataFrame, available: DataFrame, categories: Iterable[Category], order: str, score: str,
    category: str = "category",
) -> DataFrame:
    """Per category: target, selected, available, score of the first and of the last picked row."""
    picks = selected.groupBy(category).agg(
        F.count("*").alias("selected"),
        half_even(F.min_by(score, order), 2).alias("top_score"),
        half_even(F.max_by(score, order), 2).alias("min_score"),
    )
    pool = available.groupBy(F.col(category).alias("_c")).agg(F.count("*").alias("available"))
    dim = category_table(selected.sparkSession, categories)
    return (
        dim.join(pool, dim["id"] == pool["_c"], "left").join(picks, dim["id"] == picks[category], "left")
        .select("ord", "id", "display", "target", F.coalesce("selected", F.lit(0)).alias("selected"),
                F.coalesce("available", F.lit(0)).alias("available"),
                F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
                F.coalesce("min_score", F.lit(0.0)).alias("min_score"))
    )


def cluster_diagnostics(clusters: DataFrame) -> DataFrame:
    return clusters.agg(
        F.count_if("is_representative").alias("clusters"),
        F.count("suppressed_by").alias("suppressed"),
        F.coalesce(F.max("cluster_size"), F.lit(0)).alias("largest"),
    )


def category_people_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.col("has_target_face"), F.lit(False))).alias("with_target"),
        F.count_if(F.coalesce(F.col("face_count"), F.lit(0)) > 0).alias("with_faces"),
    )


def infer_categories(df: DataFrame, target: int = 75) -> DataFrame:
    """Categories found in the data, sorted, all with the default target."""
    names = df.filter(F.col("category").isNotNull()).select(F.col("category").alias("id")).distinct()
    return names.select("id", F.col("id").alias("display"), F.lit(target).alias("target")).orderBy("id")


def resolve_categories(configured: list[Category], template: list[Category], df: DataFrame, target: int = 75) -> list[Category]:
    """Configured list, else the template's, else the ones in the data, all of which pass the driver; see
    ``resolve_category_table`` for any number."""
    if configured or template:
        return list(configured or template)
    return [Category(r["id"], r["id"], target) for r in infer_categories(df, target).collect()]


def resolve_category_table(configured: list[Category], template: list[Category], df: DataFrame, target: int = 75) -> DataFrame:
    """(id, display, target) by the same precedence, as a table: categories in the data stay on the cluster."""
    if configured or template:
        return category_table(df.sparkSession, configured or template).select("id", "display", "target")
    return infer_categories(df, target)


def fingerprint(df: DataFrame, name: str, size: str, changed: str, by: list[str] | None = None) -> DataFrame:
    """Fingerprint of the file set of each folder: count, sum and xor of digests of ``name:size:time``.

    It does not depend on the order of the files, so partial results merge and no folder is gathered as a list.
    """
    entry = F.concat_ws(":", F.col(name), F.col(size).cast("string"), F.col(changed).cast("string"))
    digest = F.conv(F.substring(F.md5(entry), 1, 15), 16, 10).cast("long")
    return df.groupBy(*(by or [])).agg(
        F.concat_ws(
            "-", F.count("*").cast("string"),
            F.sum(digest.cast("decimal(28,0)")).cast("string"), F.bit_xor(digest).cast("string"),
        ).alias("fingerprint")
    )


def short_digest(text: Column | str) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, 12)
