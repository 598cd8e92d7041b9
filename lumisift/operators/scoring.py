"""Quality and ranking scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QualityWeights, Quiz, RankingWeights
from ..functions.numbers import clamp, megapixels, positive, saturate


def _faces() -> tuple[Column, Column]:
    return F.coalesce(F.col("has_target_face"), F.lit(False)), F.coalesce(F.col("face_count"), F.lit(0))


def _points(test: Column, value: float) -> Column:
    return F.when(test, float(value)).otherwise(0.0)


# Limits and points of the quality score.
def quality_score(weights: QualityWeights = QualityWeights()) -> Column:
    """Event quality: grade (or size without a grade), faces, feedback, questionnaire."""
    target, faces = _faces()
    graded = F.col("composite") / 100.0 * 5.0
    plain = (
        saturate(megapixels(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))), 12.0) * weights.resolution
        + saturate(F.coalesce("size_kb", F.lit(0)), 3000.0) * weights.file_size
    )
    score = F.coalesce(graded, plain)
    score = score + F.when(target, weights.has_target_face).when(faces > 0, weights.has_any_face).otherwise(0.0)
    score = score + _points(faces >= 3, 0.5)
    score = score + F.when(F.col("preference") == "like", 8.0).when(F.col("preference") == "dislike", -6.0).otherwise(0.0)
    q = weights.quiz
    if "no_face" in q.avoid:
        score = score - _points(faces == 0, 2.0)
    if "dark" in q.avoid:
        score = score - _points(F.col("exposure") < 30, 1.5)
    if q.faces == "many":
        score = score + _points(faces >= 3, 1.0)
    elif q.faces == "few":
        score = score + _points(faces.between(1, 2), 0.5)
    if q.closeups == "yes":
        score = score + _points(F.col("face_distance") < 0.4, 0.5)
    if q.colorful == "yes":
        score = score + _points(F.col("color") > 70, 0.5)
    if q.sharpness == "high":
        score = score - _points(F.col("sharpness") < 40, 1.0)
    return score


def closeness_bonus(factor: float = 5.0) -> Column:
    """Bonus of auto-select for a close face match."""
    return F.when(F.col("face_distance").isNotNull(), positive(0.6 - F.col("face_distance")) * factor).otherwise(0.0)


def preference_component(
    like_centroid: Column, dislike_centroid: Column, like_max: Column, dislike_max: Column,
    probability: Column, names_given: bool = True,
) -> Column:
    """0-100, 50 is neutral. Similarities are null where there is no vector or no rated row."""
    target, _ = _faces()
    visual = (
        F.coalesce(like_centroid * 20.0, F.lit(0.0))
        - F.coalesce(positive(dislike_centroid) * 15.0, F.lit(0.0))
        + F.coalesce(positive(like_max - 0.85) * 60.0, F.lit(0.0))
        - F.coalesce(positive(dislike_max - 0.80) * 50.0, F.lit(0.0))
    )
    learned = F.coalesce((probability - 0.5) * 20.0, F.lit(0.0))
    distance = F.col("face_distance")
    face = (
        F.when(target & distance.isNotNull(), positive(0.55 - distance) * 18.0).when(target, 5.0).otherwise(0.0)
        if names_given else F.lit(0.0)
    )
    return (
        F.when(F.col("preference") == "like", 95.0).when(F.col("preference") == "dislike", 5.0)
        .otherwise(clamp(50.0 + visual + learned + face, 0, 100))
    )


def quality_component(quiz: Quiz = Quiz()) -> Column:
    """0-100 technical quality."""
    target, faces = _faces()
    plain = (
        saturate(megapixels(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))), 12.0) * 60.0
        + saturate(F.coalesce("size_kb", F.lit(0)), 3000.0) * 40.0
    )
    base = F.coalesce(F.col("composite"), plain)
    # the cap applies only where a bonus is given
    score = F.when(target, F.least(base + 10, F.lit(100.0))).when(faces > 0, F.least(base + 5, F.lit(100.0))).otherwise(base)
    if "no_face" in quiz.avoid:
        score = positive(score - _points(faces == 0, 10))
    if "dark" in quiz.avoid:
        score = positive(score - _points(F.col("exposure") < 30, 8))
    if quiz.sharpness == "high":
        score = positive(score - _points(F.col("sharpness") < 40, 10))
    return clamp(score, 0, 100)


def diversity_component(
    visual_max: Column, semantic_max: Column, same_date: Column, same_place: Column, any_selected: Column
) -> Column:
    """-100..100; 50 while nothing is selected."""
    def crowd(n: Column, free: int, step: int, cap: int) -> Column:
        return F.least(positive((F.coalesce(n, F.lit(0)) - free) * float(step)), F.lit(float(cap)))

    penalty = (
        F.coalesce(positive(visual_max - 0.75) * 200.0, F.lit(0.0))
        + F.coalesce(positive(semantic_max - 0.90) * 200.0, F.lit(0.0))
        + crowd(same_date, 3, 5, 30) + crowd(same_place, 5, 4, 20)
    )
    return F.when(any_selected, clamp(50.0 - penalty, -100, 100)).otherwise(50.0)


def exploration_component(probability: Column, key: str = "hash") -> Column:
    """0-100; highest for uncertain rows, 0 for rated ones, with a reproducible share from the key."""
    uncertain = F.coalesce((1.0 - F.abs(probability - 0.5) * 2.0) * 70.0, F.lit(40.0))
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    variety = F.coalesce((digest % 100) / 100.0 * 30.0, F.lit(0.0))
    rated = F.coalesce(F.col("preference").isin("like", "dislike"), F.lit(False))
    return F.when(rated, 0.0).otherwise(F.least(uncertain + variety, F.lit(100.0)))


def duplicate_penalty(burst: Column, min_distance: Column, max_similarity: Column) -> Column:
    """0-100 against the selected rows; inputs are null where nothing comes near."""
    bits = F.when(min_distance <= 5, 100.0).when(min_distance <= 10, (10 - min_distance) * 15.0)
    close = F.when(max_similarity > 0.95, 100.0).when(
        max_similarity > 0.88, (max_similarity - 0.88) * (100.0 / 0.07)
    )
    zero = F.lit(0.0)
    return F.least(
        F.greatest(F.when(F.coalesce(burst, F.lit(False)), 100.0).otherwise(0.0), F.coalesce(bits, zero), F.coalesce(close, zero)),
        F.lit(100.0),
    )


def final_score(
    preference: Column, quality: Column, diversity: Column, exploration: Column, duplicate: Column,
    no_face: Column | None = None, weights: RankingWeights = RankingWeights(),
) -> Column:
    """Weighted sum minus penalties, with its breakdown."""
    face_penalty = F.when(F.coalesce(no_face, F.lit(False)), 40.0).otherwise(0.0) if no_face is not None else F.lit(0.0)
    total = (
        preference * weights.preference + quality * weights.quality + diversity * weights.diversity
        + exploration * weights.exploration - duplicate - face_penalty
    )
    return F.struct(
        total.alias("final"), preference.alias("preference"), quality.alias("quality"), diversity.alias("diversity"),
        exploration.alias("exploration"), duplicate.alias("duplicate_penalty"), face_penalty.alias("no_face_penalty"),
    )


def crowding(df: DataFrame, selected: DataFrame, column: str, name: str) -> DataFrame:
    """Number of selected rows that share the row's value; null values share nothing."""
    counts = selected.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))
    return df.join(counts, column, "left").fillna(0, subset=[name])
