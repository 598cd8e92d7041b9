"""Category rules: scored matching of tags, path words, faces and measures."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Category, Rule, as_list
from ..functions.names import STOP_WORDS, folder_of, normalize_path
from ..functions.numbers import col
from .joins import keyword_match

# Points of the rule score.
TAG_POINTS, TAG_OVERFLOW_POINTS, TAG_FULL_PER_FAMILY = 10, 3, 2
PATH_POINTS_WITH_TAGS, PATH_POINTS_WITHOUT_TAGS = 2, 10
EXCLUSION_POINTS = -20
FACE_POINTS_WITH_KEYWORD, FACE_POINTS_ALONE, FACE_POINTS_OUTSIDE = 5, 2, -8
BONUS_POINTS, DEFAULT_POINTS, GATED_SCORE = 3, 3, -999


def _matches(tag: str, words: Iterable[str]) -> bool:
    return any(w == tag or w in tag.split() for w in words)


def _known_hits(tags: Column, family: Iterable[str], words: Iterable[str]) -> Column | None:
    """Number of the row's tags that belong to the given vocabulary tags and match a word; which of them match is
    settled while the plan is built. None when no tag of the vocabulary can match."""
    matching = [t for t in family if _matches(t, words)]
    if not matching:
        return None
    return F.size(F.filter(tags, lambda t: t.isin(*matching)))


def _other_hits(tags: Column, vocabulary: Iterable[str], words: Iterable[str]) -> Column | None:
    """Number of matching tags outside the vocabulary."""
    listed, known = list(words), list(vocabulary)
    if not listed:
        return None
    wanted = F.array(*[F.lit(w) for w in listed])

    def hit(t: Column) -> Column:
        return F.arrays_overlap(F.array_append(F.split(t, " "), t), wanted)

    return F.size(F.filter(tags, (lambda t: ~t.isin(*known) & hit(t)) if known else hit))


def _tag_hits(tags: Column, words: Iterable[str], families: dict[str, str]) -> tuple[Column, Column]:
    """(number of matching tags, their points): ten for the first two of a family, three for each further one."""
    words = list(words)
    groups: dict[str, list[str]] = {}
    for tag, family in families.items():
        groups.setdefault(family, []).append(tag)
    counts = [_known_hits(tags, g, words) for g in groups.values()] + [_other_hits(tags, families, words)]
    hits, points = F.lit(0), F.lit(0)
    for n in counts:
        if n is not None:
            full = F.least(n, F.lit(TAG_FULL_PER_FAMILY))
            hits, points = hits + n, points + full * TAG_POINTS + (n - full) * TAG_OVERFLOW_POINTS
    return hits, points


def _text_hits(text: Column, words: Iterable[str]) -> Column:
    tests = [F.contains(text, F.lit(w)).cast("int") for w in words]
    return reduce(lambda a, b: a + b, tests) if tests else F.lit(0)


def rule_scores(
    rules: Iterable[Rule],
    families: dict[str, str],
    categories: Iterable[Category] | None = None,
    tags: str = "tags",
    path: str = "path",
    filename: str = "filename",
    sharpness: str = "sharpness",
) -> Column:
    """Array of (category, score, ord, tag_hits, path_hits, excluded, face_points, bonus), one entry per rule.

    The rules are literals of the expression, so scoring is one projection over the catalog without any shuffle.
    """
    known = None if categories is None else {c.id for c in categories}
    listed = [r for r in as_list(rules) if known is None or r.category in known]
    tag_list = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    has_tags = F.size(tag_list) > 0
    text = F.concat_ws(" ", F.lower(normalize_path(F.coalesce(F.col(path), F.lit("")))),
                       F.lower(F.coalesce(F.col(filename), F.lit(""))))
    faces = F.coalesce(F.col("face_count"), F.lit(0))
    sharp = F.coalesce(F.col(sharpness), F.lit(50.0))
    w, h = (F.coalesce(F.col(c), F.lit(0)) for c in ("width", "height"))
    sized = (w > 0) & (h > 0)
    wide = sized & (w > h * 1.2)
    path_points = F.when(has_tags, PATH_POINTS_WITH_TAGS).otherwise(PATH_POINTS_WITHOUT_TAGS)

    entries = []
    for i, r in enumerate(listed):
        n_tags, tag_points = _tag_hits(tag_list, r.keywords, families)
        n_path = _text_hits(text, r.keywords)
        any_hit = n_tags + n_path > 0
        excluded = _tag_hits(tag_list, r.excludes, families)[0] + _text_hits(text, r.excludes)
        face_points = F.lit(0)
        if r.face_min is not None and r.face_max is not None:
            inside = F.when(any_hit, FACE_POINTS_WITH_KEYWORD).otherwise(FACE_POINTS_ALONE)
            face_points = F.when(faces.between(r.face_min, r.face_max), inside).otherwise(FACE_POINTS_OUTSIDE)
        bonus = F.lit(r.priority)
        if r.orientation == "landscape":
            bonus = bonus + F.when(wide, BONUS_POINTS).otherwise(0)
        elif r.orientation == "portrait":
            bonus = bonus + F.when(sized & ~wide, BONUS_POINTS).otherwise(0)
        if r.min_sharpness is not None:
            bonus = bonus + F.when(sharp >= r.min_sharpness, BONUS_POINTS).otherwise(0)
        if r.max_sharpness is not None:
            bonus = bonus + F.when(sharp <= r.max_sharpness, BONUS_POINTS).otherwise(0)
        bonus = F.when(any_hit, bonus).otherwise(0)
        score = (
            tag_points + n_path * path_points + excluded * EXCLUSION_POINTS + face_points + bonus
            + (DEFAULT_POINTS if r.is_default else 0)
        )
        if r.min_tag_hits:
            score = F.when(has_tags & (n_tags < r.min_tag_hits), GATED_SCORE).otherwise(score)
        entries.append(
            F.struct(
                score.cast("int").alias("score"), F.lit(-i).alias("ord"), F.lit(r.category).alias("category"),
                n_tags.alias("tag_hits"), n_path.alias("path_hits"), excluded.alias("excluded"),
                face_points.alias("face_points"), bonus.alias("bonus"),
            )
        )
    return F.array(*entries)


def rule_winner(scores: Column) -> Column:
    """(score, category) of the best rule; the first rule wins ties, gated rules never win."""
    best = F.array_max(scores)
    open_ = best.getField("score") > GATED_SCORE
    return F.struct(
        F.when(open_, best.getField("score")).alias("score"), F.when(open_, best.getField("category")).alias("category")
    )


def rule_top(scores: Column, n: int = 3) -> Column:
    """The n best entries, gated ones last."""
    return F.slice(F.sort_array(scores, asc=False), 1, n)


def _title_choice(categories: list[Category], words: tuple[str, ...]) -> Column:
    """First category whose title contains one of the words."""
    for c in categories:
        if any(w in c.label.lower() for w in words):
            return F.lit(c.id)
    return F.lit(None).cast("string")


# Title words per number of faces.
FEW_FACES_WORDS = ("portrait", "couple")
MANY_FACES_WORDS = ("family", "group", "team", "colleague", "friend")
NO_FACES_WORDS = ("landscape", "scenery", "detail", "action", "game", "career")
REFINE_MANY_FACES_WORDS = ("family", "group", "colleague")
REFINE_NO_FACES_WORDS = ("landscape", "scenery", "detail", "career", "milestone")


def _face_choice(categories, few, many, none, sharp: Column | None) -> list[Column]:
    faces = F.coalesce(F.col("face_count"), F.lit(0))
    small_group = faces.between(1, 2) if sharp is None else faces.between(1, 2) & (sharp > 40)
    return [
        F.when(small_group, _title_choice(categories, few)),
        F.when(faces >= 3, _title_choice(categories, many)),
        F.when(faces == 0, _title_choice(categories, none)),
    ]


def categorize_heuristic(
    rules: Iterable[Rule], families: dict[str, str], categories: Iterable[Category],
    tags: str = "tags", path: str = "path", filename: str = "filename", sharpness: str = "sharpness",
) -> Column:
    """Rules first; without rules: keywords and title words, then the number of faces, then the first category."""
    cats = as_list(categories)
    listed = list(rules)
    if listed:
        scores = rule_scores(listed, families, cats, tags, path, filename, sharpness)
        tiers = [rule_winner(scores).getField("category")]
    else:
        tiers = []
    tag_list = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    name = F.lower(F.coalesce(F.col(filename), F.lit("")))
    text = F.concat_ws(" ", F.lower(folder_of(F.col(path))), name)
    points = F.when(F.size(tag_list) > 0, PATH_POINTS_WITH_TAGS).otherwise(PATH_POINTS_WITHOUT_TAGS)
    scored = []
    for i, c in enumerate(cats):
        title = [w for w in c.label.lower().split() if len(w) > 3 and w not in STOP_WORDS]
        words = [*c.keywords, *title]
        if words:
            value = _tag_hits(tag_list, words, families)[0] * TAG_POINTS + _text_hits(text, words) * points
            scored.append(F.struct(value.alias("score"), F.lit(-i).alias("ord"), F.lit(c.id).alias("id")))
    if scored:
        best = F.array_max(F.array(*scored))
        tiers.append(F.when(best.getField("score") > 0, best.getField("id")))
    sharp = F.coalesce(F.col(sharpness), F.lit(50.0))
    tiers += _face_choice(cats, FEW_FACES_WORDS, MANY_FACES_WORDS, NO_FACES_WORDS, sharp)
    if cats:
        tiers.append(F.lit(cats[0].id))
    return F.coalesce(*tiers)


def needs_refinement(category: Column | str, categories: Iterable[Category]) -> Column:
    """Rows that hold a thematic or whole-year category and may be refined after the face pass."""
    loose = [c.id for c in categories if c.day_offset == -1 or (c.month_from, c.month_to) == (1, 12)]
    return F.coalesce(col(category).isin(*loose), F.lit(False))


def refine_thematic(text: Column | str, categories: Iterable[Category]) -> Column:
    """Better thematic category by keywords, then by the number of faces; null when there is none."""
    cats = as_list(categories)
    if len(cats) <= 1:
        return F.lit(None).cast("string")
    return F.coalesce(
        keyword_match(text, cats),
        *_face_choice(cats, FEW_FACES_WORDS, REFINE_MANY_FACES_WORDS, REFINE_NO_FACES_WORDS, None),
    )
