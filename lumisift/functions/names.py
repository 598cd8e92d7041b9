"""Paths, file names, devices, burst keys, content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# Accepted extensions.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".heic", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp")


def normalize_path(path: Column | str) -> Column:
    return F.translate(col(path), "\\", "/")


def basename(path: Column | str) -> Column:
    return F.substring_index(normalize_path(path), "/", -1)


def folder_of(path: Column | str) -> Column:
    return F.regexp_replace(normalize_path(path), "/[^/]*$", "")


def extension(name: Column | str) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(col(name), r"(\.[^./\\]+)$", 1))


def stem(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"\.[^./\\]+$", "")


def is_video(name: Column | str) -> Column:
    return extension(name).isin(*VIDEO_EXTENSIONS)


def guess_device(name: Column | str) -> Column:
    """Origin of a file by its name; the first matching form wins."""
    n = F.lower(col(name))
    # Name forms and labels, in the order of their precedence.
    return (
        F.when(F.contains(n, F.lit("fb_img")) | F.contains(n, F.lit("_n.jpg")), "facebook")
        .when(F.startswith(n, F.lit("img_")), "iphone")
        .when((F.length(n) >= 15) & n.rlike(r"^\d{8}_"), "android")
        .when(F.contains(n, F.lit("collage")), "collage")
        .when(F.startswith(n, F.lit("screenshot")), "screenshot")
        .otherwise("other")
    )


LONG_DIGITS = 18


def burst_key(path: Column | str) -> Column:
    """(folder, prefix, seq) of a camera file name with at least three digits before the extension, else null."""
    path = col(path)

    # arrays of one element name a value, so that each pattern runs once for a row
    def parts(body: Column, digits: Column) -> Column:
        # a long holds 18 digits; what is before them goes to the prefix, so neighbours still share it
        tail = F.least(F.length(digits), F.lit(LONG_DIGITS))
        return F.when(
            F.length(digits) >= 3,
            F.struct(
                folder_of(path).alias("folder"),
                F.substring(body, F.lit(1), F.length(body) - tail).alias("prefix"),
                F.right(digits, tail).cast("long").alias("seq"),
            ),
        )

    def with_digits(body: Column) -> Column:
        return F.get(F.transform(F.array(F.regexp_extract(body, r"(\d+)$", 1)), lambda digits: parts(body, digits)), 0)

    # without an extension the body is empty, and so are its digits
    body = F.regexp_extract(basename(path), r"(?s)^(.*)\.[a-zA-Z]+$", 1)
    return F.get(F.transform(F.array(body), with_digits), 0)


def trailing_number(name: Column | str) -> tuple[Column, Column]:
    """Prefix and number of 2-5 digits at the end of the stem; (stem, 0) when there is none."""
    base = stem(name)
    pattern = r"^(.+?)(\d{2,5})$"
    digits = F.regexp_extract(base, pattern, 2)
    found = F.length(digits) > 0
    prefix = F.when(found, F.regexp_extract(base, pattern, 1)).otherwise(base)
    return prefix, F.when(found, digits.cast("long")).otherwise(F.lit(0).cast("long"))


def last_number(name: Column | str) -> Column:
    """Last run of digits in the stem (its last 18 digits), null when there is none."""
    digits = F.regexp_extract(stem(name), r"(\d+)\D*$", 1)
    return F.when(F.length(digits) > 0, F.right(digits, F.lit(LONG_DIGITS)).cast("long"))


def exported_parts(name: Column | str) -> tuple[Column, Column]:
    """(prefix, original) of an exported ``prefix__original`` name; prefix null when there is no separator."""
    name = col(name)
    has = F.contains(name, F.lit("__"))
    prefix = F.when(has, F.regexp_extract(name, r"^(.*?)__", 1))
    original = F.when(has, F.regexp_replace(name, r"^.*?__", "")).otherwise(name)
    return prefix, original


def file_key(length: Column | str, content: Column | str, head: int | None = 65536) -> Column:
    """md5 over the decimal file size followed by the first ``head`` bytes, 64 KiB by default; None takes them all."""
    head = col(content) if head is None else F.substring(col(content), 1, head)
    return F.md5(F.concat(col(length).cast("string").cast("binary"), head))


def light_key(name: Column | str, size: Column | str) -> Column:
    return F.concat_ws("|", col(name), col(size).cast("string"))


def prompt(tag: Column | str, family: Column | str) -> Column:
    """Sentence used to embed a tag, by family."""
    tag, family = col(tag), col(family)
    # Sentence forms.
    return (
        F.when(family == "activity", F.format_string("a photo of a person %s", tag))
        .when(family == "mood", F.format_string("a %s photograph", tag))
        .otherwise(F.format_string("a photo of a %s", tag))
    )


# Words of a display name that carry no meaning.
STOP_WORDS = ("over", "with", "from", "years", "best")


def display_words(display: Column | str) -> Column:
    """Words of a category title that can serve as keywords."""
    return F.filter(
        F.split(F.lower(col(display)), " "),
        lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS),
    )
