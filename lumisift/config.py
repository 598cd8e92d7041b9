"""Caller-supplied dimensions as lists. They are folded into column expressions, so they never cause a shuffle; work per
row and planning time grow with them. For dimensions of many thousand rows ``operators/table_match.py`` has the same
matches as joins with tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Category:
    """One category of an event template; the position in the list is part of the meaning."""

    id: str
    display: str | None = None
    target: int = 75
    video_target: int = 0
    age_days_from: int | None = None
    age_days_to: int | None = None
    day_offset: int = 0
    time_from: str = "00:00"
    time_to: str = "23:59"
    month_from: int | None = None
    month_to: int | None = None
    keywords: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        return self.display or self.id


@dataclass(frozen=True)
class Rule:
    """Scoring rule of one category."""

    category: str
    keywords: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    face_min: int | None = None
    face_max: int | None = None
    min_sharpness: float | None = None
    max_sharpness: float | None = None
    orientation: str | None = None
    priority: int = 0
    is_default: bool = False
    min_tag_hits: int | None = None


@dataclass(frozen=True)
class Quiz:
    """Answers of the taste questionnaire; every answer is optional."""

    avoid: tuple[str, ...] = ()
    faces: str | None = None
    closeups: str | None = None
    colorful: str | None = None
    sharpness: str | None = None
    resolution: str | None = None
    style: str | None = None


@dataclass(frozen=True)
class QualityWeights:
    """Event weights of the quality score."""

    resolution: float = 1.0
    file_size: float = 0.5
    has_target_face: float = 2.0
    has_any_face: float = 1.0
    quiz: Quiz = field(default_factory=Quiz)


@dataclass(frozen=True)
class RankingWeights:
    """Weights of the four ranking components."""

    preference: float = 0.60
    quality: float = 0.20
    diversity: float = 0.10
    exploration: float = 0.10


CATEGORY_SCHEMA = T.StructType(
    [
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("display", T.StringType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("video_target", T.IntegerType()),
    ]
)


def as_list(items: Iterable) -> list:
    return list(items)


def category_table(spark, categories: Iterable[Category]) -> DataFrame:
    """Categories as a local relation with their order; Spark knows its exact size and broadcasts it by itself."""
    rows = [
        (i, c.id, c.label, c.target, c.video_target)
        for i, c in enumerate(as_list(categories))
    ]
    return spark.createDataFrame(rows, CATEGORY_SCHEMA)


def lookup(column: Column, pairs: dict, what: str = "lookup") -> Column:
    """Map literal lookup; null when the key is unknown."""
    if not pairs:
        return F.lit(None)
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), column)


def categories_from_rows(df: DataFrame) -> list[Category]:
    """Read a category table (columns as in ``Category`` plus ``ord``) into the list form; all of it passes the driver, so
    match a large one as a table instead."""
    rows = df.orderBy("ord").collect()
    names = set(Category.__dataclass_fields__)
    found = []
    for row in as_list(rows):
        values = {k: v for k, v in row.asDict().items() if k in names and v is not None}
        if "keywords" in values:
            values["keywords"] = tuple(values["keywords"])
        found.append(Category(**values))
    return found
