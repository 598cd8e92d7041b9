"""Dates from names, folders and metadata; ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# Fixed value: metadata timestamps use this format.
EXIF_FORMAT = "yyyy:MM:dd HH:mm:ss"
# Accepted container timestamp formats, in order.
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def _first_date(text: Column, pattern: str) -> Column:
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    joined = F.concat_ws("-", *parts)
    return F.when(F.length(parts[0]) > 0, F.try_to_date(joined, "yyyy-MM-dd"))


def date_from_name(name: Column | str, year_from: int = 2013, year_to: int = 2027, strict: bool = False) -> Column:
    """Date in a file name: dashed form with any year, then compact form inside the year bounds.

    ``strict`` accepts only years 2010-2029 with possible months and days, compact form first.
    """
    name = col(name)
    if strict:
        tail = ("(20[12][0-9])", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])")
        return F.coalesce(_first_date(name, "".join(tail)), _first_date(name, "-".join(tail)))
    dashed = _first_date(name, r"(\d{4})-(\d{2})-(\d{2})")
    compact = _first_date(name, r"(\d{4})(\d{2})(\d{2})")
    return F.coalesce(dashed, F.when(F.year(compact).between(year_from, year_to), compact))


def exif_timestamp(*tags: Column) -> Column:
    """First metadata tag that parses."""
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(EXIF_FORMAT)) for t in tags])


def iso_timestamp(text: Column | str) -> Column:
    """ISO timestamp (a trailing Z is dropped, wall clock kept), then the fallback formats."""
    bare = F.regexp_replace(col(text), r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ISO_FORMATS])


def resolve_date(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """First non-null date in the given order and the name of its source."""
    value = F.coalesce(*[c for _, c in sources])
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in sources])
    return value, origin


def resolve_bracket(dates: list[Column], bracket_of) -> Column:
    """Bracket of the first date that has one; a date outside all brackets falls through to the next signal."""
    return F.coalesce(*[bracket_of(d) for d in dates])


def age_days(date: Column | str, birthday: Column | str) -> Column:
    birthday = F.to_date(F.lit(birthday)) if isinstance(birthday, str) else birthday
    return F.datediff(col(date), birthday)


def age_label(days: Column | str, before: str = "prenatal", missing: str | None = None) -> Column:
    """Readable age: newborn, 5mo, 2y3m, 4y (30-day months, 365-day years)."""
    days = col(days)
    months = F.floor(days / 30)
    years = F.floor(days / 365)
    rest = F.floor((days % 365) / 30)
    return (
        F.when(days.isNull(), F.lit(missing))
        .when(days < 0, before)
        .when(days < 30, "newborn")
        .when(months < 12, F.concat(months.cast("string"), F.lit("mo")))
        .when(rest > 0, F.concat(years.cast("string"), F.lit("y"), rest.cast("string"), F.lit("m")))
        .otherwise(F.concat(years.cast("string"), F.lit("y")))
    )


def folder_hint_date(folder: Column | str, birthday: str, intervals: dict[str, tuple[int, int]] | None = None) -> Column:
    """Date suggested by a folder: known age interval (midpoint), "5 years" / "age 5", then a bare year (1 June)."""
    folder = col(folder)
    born = F.to_date(F.lit(birthday))
    known = [
        F.when(F.contains(folder, F.lit(part)), F.date_add(born, (first + last) // 2))
        for part, (first, last) in (intervals or {}).items()
    ]
    spoken = [
        F.regexp_extract(folder, pattern, 1)
        for pattern in (r"(?i)(\d+)\s*(?:year|age)", r"(?i)age\s*(\d+)")
    ]
    # numbers of more than four digits are no ages
    aged = [F.when((F.length(y) > 0) & (F.length(y) <= 4), F.date_add(born, y.try_cast("int") * 365)) for y in spoken]
    year = F.regexp_extract(folder, r"(20[0-9]{2})", 1)
    june = F.when(F.length(year) > 0, F.make_date(year.cast("int"), F.lit(6), F.lit(1)))
    return F.coalesce(*known, *aged, june)
