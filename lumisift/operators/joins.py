"""Lookups, range matching and updates."""

from __future__ import annotations

import json
from functools import reduce
from typing import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Category, as_list, lookup
from ..functions.names import normalize_path, stem
from ..functions.numbers import col, half_even
from ..session import cut_lineage
from .keys import join_by
from .places import nearest_place  # noqa: F401

# lists beyond this length travel as one constant array
LONG_LIST = 200
MAX_EPOCH = 9_000_000_000_000  # seconds that a timestamp can hold


def anti_existing(candidates: DataFrame, known: DataFrame, key: str = "hash") -> DataFrame:
    """Candidates whose key is not known yet."""
    return candidates.join(known.select(key), key, "left_anti")


def join_sidecar(assets: DataFrame, sidecars: DataFrame, path: str = "path") -> DataFrame:
    """Attach the metadata file beside each asset: ``X.jpg.json`` first, then ``X.json``.

    A time that is no number, or beyond the range of timestamps, counts as missing, so the next candidate is tried.
    ``sidecars`` has ``path`` and the raw JSON text ``body``.
    """
    epoch = [
        F.get_json_object("body", f"$.{name}.timestamp").try_cast("long") for name in ("photoTakenTime", "creationTime")
    ]
    side = sidecars.select(F.col("path").alias("_side"), F.timestamp_seconds(F.coalesce(*[F.when(F.abs(e) < MAX_EPOCH, e) for e in epoch])).alias("_at"))
    full = side.select(F.col("_side").alias("_full"), F.col("_at").alias("_full_at"))
    short = side.select(F.col("_side").alias("_short"), F.col("_at").alias("_short_at"))
    return (
        assets.join(full, F.concat(F.col(path), F.lit(".json")) == F.col("_full"), "left")
        .join(short, F.concat(stem(path), F.lit(".json")) == F.col("_short"), "left")
        .withColumn("sidecar_at", F.coalesce("_full_at", "_short_at"))
        .drop("_full", "_full_at", "_short", "_short_at")
    )


def config_equal(old: DataFrame | None, sources: list[str], names: list[str]) -> bool:
    """A stored catalog may be reused only when sources and wanted names are the same sets."""
    if old is None:
        return False
    row = old.select("sources", "names").limit(1).collect()
    return bool(row) and set(row[0]["sources"]) == set(sources) and set(row[0]["names"]) == set(names)


def same_set(a: Column, b: Column) -> Column:
    """Equality of two arrays as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def reuse_catalog(scan: DataFrame, old: DataFrame, key: str = "hash", refreshed: Iterable[str] = ("path", "source_label")) -> DataFrame:
    """Keep the stored row of a known key, with path and label refreshed; other rows are new."""
    fresh = [c for c in refreshed if c in scan.columns]
    renamed = scan.select(*[F.col(c).alias(c if c == key else f"_new_{c}") for c in scan.columns])
    joined = renamed.join(old.withColumn("_known", F.lit(True)), key, "left")
    known = F.col("_known").isNotNull()
    columns = [F.col(key)]
    for c in scan.columns:
        if c == key:
            continue
        if c in fresh or c not in old.columns:
            columns.append(F.col(f"_new_{c}").alias(c))
        else:
            columns.append(F.when(known, F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
    extra = [F.col(c) for c in old.columns if c not in scan.columns]
    return joined.select(*columns, *extra, known.alias("reused"))


def attach_vectors(
    assets: DataFrame, vectors: DataFrame, key: str = "hash", embedded: str | None = None, embedded_first: bool = True
) -> DataFrame:
    """Vector of each asset from the vector table and, optionally, a column of the asset itself."""
    joined = assets.join(vectors.select(key, F.col("v").alias("_v")), key, "left")
    side = F.col("_v")
    if embedded is None:
        value = side
    else:
        own = F.col(embedded)
        value = F.coalesce(own, side) if embedded_first else F.coalesce(side, own)
    return joined.withColumn("vector", value).drop("_v")


def upsert_vectors(old: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """Merge two vector tables; the new value wins and nothing is lost."""
    renamed = new.select(key, F.col("v").alias("_new"))
    return old.select(key, "v").join(renamed, key, "full_outer").select(key, F.coalesce("_new", "v").alias("v"))


def bracket_of(days: Column | str, categories: Iterable[Category], mode: str = "half_open") -> Column:
    """Category of an age in days; the first match in list order wins.

    ``half_open``: [from, to), null or negative gives null. ``closed_clamped``: [from, to], clamped to the first and
    last bracket. ``ladder``: first bracket whose upper end is not below the age, else the last one.
    """
    days = col(days)
    cats = [c for c in as_list(categories) if c.age_days_to is not None]
    if mode == "half_open":
        cats = [c for c in cats if c.age_days_from is not None]
    if not cats:
        return F.lit(None).cast("string")
    age = F.greatest(days, F.lit(0)) if mode == "closed_clamped" else days

    def inside(low, high) -> Column:
        if mode == "half_open":
            return (age >= low) & (age < high)
        return (age >= low) & (age <= high) if mode == "closed_clamped" else age <= high

    if len(cats) <= LONG_LIST:
        hit = F.coalesce(*[F.when(inside(F.lit(c.age_days_from), F.lit(c.age_days_to)), F.lit(c.id)) for c in cats])
    else:  # one constant array instead of as many branches
        rows = json.dumps([[c.age_days_from, c.age_days_to, c.id] for c in cats])
        table = F.transform(F.from_json(F.lit(rows), "array<array<string>>"), lambda t: F.struct(
            F.get(t, 0).cast("int").alias("low"), F.get(t, 1).cast("int").alias("high"), F.get(t, 2).alias("id")))
        hit = F.get(F.filter(table, lambda t: inside(t["low"], t["high"])), 0)["id"]
    if mode == "half_open":
        return F.when(days >= 0, hit)
    if mode == "closed_clamped":
        past = F.when(age > cats[-1].age_days_to, F.lit(cats[-1].id)).otherwise(F.lit(cats[0].id))
        return F.when(days.isNotNull(), F.coalesce(hit, past))
    return F.when(days >= 0, F.coalesce(hit, F.lit(cats[-1].id)))


def keyword_match(text: Column | str, categories: Iterable[Category]) -> Column:
    """Category with the most keywords contained in the text; ties go to the first, no hit gives null."""
    text = F.lower(normalize_path(text))
    scored = []
    for i, c in enumerate(as_list(categories)):
        if not c.keywords:
            continue
        if len(c.keywords) <= 50:
            hits = reduce(lambda a, b: a + b, [F.contains(text, F.lit(k.lower())).cast("int") for k in c.keywords])
        else:  # a long sum is a deep expression; a null text still has no hits to count
            words = F.array(*[F.lit(k.lower()) for k in c.keywords])
            hits = F.when(text.isNotNull(), F.size(F.filter(words, lambda w: F.contains(text, w))))
        scored.append(F.struct(hits.alias("hits"), F.lit(-i).alias("ord"), F.lit(c.id).alias("id")))
    if not scored:
        return F.lit(None).cast("string")
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return F.when(best.getField("hits") > 0, best.getField("id"))


def thematic_match(text: Column | str, categories: list[Category]) -> Column:
    """Keyword match, else the first category."""
    if not categories:
        return F.lit(None).cast("string")
    return F.coalesce(keyword_match(text, categories), F.lit(categories[0].id))


def _clock(text: str) -> int:
    hours, minutes = text.split(":")
    return int(hours) * 3600 + int(minutes) * 60


def day_time_match(at: Column | str, text: Column | str, categories: Iterable[Category], event_date: str) -> Column:
    """Category by day offset and time window (both ends included, wrapping past midnight), first in list order;
    then the thematic categories (offset -1)."""
    at = col(at)
    cats = as_list(categories)
    day = F.datediff(F.to_date(at), F.to_date(F.lit(event_date)))
    second = (
        F.hour(at) * 3600 + F.minute(at) * 60 + F.extract(F.lit("SECOND"), at).cast("double")
    )
    hits = []
    for c in cats:
        if c.day_offset == -1:
            continue
        low, high = _clock(c.time_from), _clock(c.time_to)
        inside = (second >= low) | (second <= high) if high < low else (second >= low) & (second <= high)
        hits.append(F.when((day == c.day_offset) & inside, F.lit(c.id)))
    thematic = thematic_match(text, [c for c in cats if c.day_offset == -1])
    return F.when(at.isNotNull(), F.coalesce(*hits, thematic))


def month_match(date: Column | str, text: Column | str, categories: Iterable[Category], year: int | None = None) -> Column:
    """Category by month: keyword categories of the whole year first, then month ranges, then the whole-year rest."""
    date = col(date)
    cats = [c for c in as_list(categories) if c.month_from is not None and c.month_to is not None]
    full = [c for c in cats if (c.month_from, c.month_to) == (1, 12)]
    month = F.month(date)
    ranges = [
        F.when(month.between(c.month_from, c.month_to), F.lit(c.id)) for c in cats if c not in full
    ]
    rest = [F.lit(c.id) for c in full if not c.keywords][:1]
    tiers = [keyword_match(text, [c for c in full if c.keywords]), *ranges, *rest]
    known = date.isNotNull() if year is None else F.year(date) == year
    return F.when(known, F.coalesce(*tiers))


def dictionary_lookup(text: Column | str, entries: dict[str, object], per_part: bool = False) -> Column:
    """Value of the first entry contained in the text; ``per_part`` walks the path parts first."""
    text = normalize_path(text)
    pairs = [(k, v) for k, v in entries.items() if v is not None]

    def first_hit(part: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(part, F.lit(k)), F.lit(v)) for k, v in pairs])

    if not per_part:
        return first_hit(text)
    hits = F.filter(F.transform(F.split(text, "/"), first_hit), lambda h: h.isNotNull())
    return F.get(hits, 0)


def apply_changes(
    assets: DataFrame, changes: DataFrame, key: str = "hash", order: str = "ts", unique: str | None = None,
) -> DataFrame:
    """Apply a change log field by field: each field takes the last change that names it.

    ``changes`` may carry to_category, new_status, new_reason, preference, clear_preference, trash, and ``action``. The
    action says what a new status does to the reason: ``move`` (also when null) sets manual_reject for pool and clears it
    otherwise; ``save`` keeps an existing reason for pool, else sets manual_reject, clears it for qualified and leaves it
    for others; ``select`` and ``deselect`` leave it. A given new_reason is set as it is. Untrash changes only marked rows.
    Changes of one key are ordered by ``order``, then ``unique``, then by their other fields. With a ``request`` column,
    only the last item of a key inside one request counts. One aggregate that merges before the shuffle.
    """
    have = set(changes.columns)

    def field(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind)

    log = changes.select(
        F.col(key).alias("_key"), F.col(order).alias("_ts"), (F.col(unique) if unique else F.lit(0)).alias("_u"),
        field("request", "string").alias("_request"), field("action", "string").alias("_action"),
        field("to_category", "string").alias("_cat"), field("new_status", "string").alias("_status"),
        field("new_reason", "string").alias("_reason"), field("preference", "string").alias("_pref"),
        F.coalesce(field("clear_preference", "boolean"), F.lit(False)).alias("_clear"), field("trash", "boolean").alias("_trash"),
    )
    rest = ["_action", "_cat", "_status", "_reason", "_pref", "_clear", "_trash"]
    if "request" in have:
        single = log.filter(F.col("_request").isNull())
        bulk = log.filter(F.col("_request").isNotNull()).groupBy("_key", "_request").agg(
            F.max(F.struct("_ts", "_u", *rest)).alias("_c")).select("_key", "_c._ts", "_c._u", "_request", *[f"_c.{c}" for c in rest])
        log = single.select("_key", "_ts", "_u", "_request", *rest).unionByName(bulk)
    place = F.struct("_ts", "_u", *rest)
    pool, moved = F.col("_status") == "pool", F.coalesce(F.col("_action"), F.lit("move")) == "move"
    saved = F.col("_action") == "save"
    sets = F.col("_status").isNotNull() & (F.col("_reason").isNotNull() | moved | (saved & (F.col("_status") == "qualified")))
    value = F.coalesce("_reason", F.when(moved & pool, F.lit("manual_reject")))
    keeps = F.col("_status").isNotNull() & F.col("_reason").isNull() & saved & pool

    def last(test: Column, result: Column) -> Column:
        return F.max(F.when(test, F.struct(place.alias("at"), result.alias("value"))))

    found = log.groupBy("_key").agg(
        last(F.col("_cat").isNotNull(), F.col("_cat")).alias("_c"), last(F.col("_status").isNotNull(), F.col("_status")).alias("_s"),
        last(sets, value).alias("_set"), last(keeps, F.lit(True)).alias("_keep"),
        last(F.col("_clear") | F.col("_pref").isNotNull(), F.when(~F.col("_clear"), F.col("_pref"))).alias("_p"),
        last(F.col("_trash").isNotNull(), F.col("_trash")).alias("_t"), F.max("_trash").alias("_ever"),
    )
    out = assets.join(found, F.col(key) == F.col("_key"), "left")
    if "to_category" in have:
        out = out.withColumn("category", F.coalesce("_c.value", "category"))
    if "new_status" in have:
        reason = F.when(F.col("_set").isNotNull(), F.col("_set.value")).otherwise(F.col("reject_reason"))
        after = F.col("_keep").isNotNull() & (F.col("_set").isNull() | (F.col("_keep.at") > F.col("_set.at")))
        out = out.withColumn("reject_reason", F.when(after, F.coalesce(reason, F.lit("manual_reject"))).otherwise(reason))
        out = out.withColumn("status", F.coalesce("_s.value", "status"))
    if "preference" in have or "clear_preference" in have:
        out = out.withColumn("preference", F.when(F.col("_p").isNotNull(), F.col("_p.value")).otherwise(F.col("preference")))
    if "trash" in have:
        marked = F.coalesce(F.col("_ever"), F.lit(False)) | F.coalesce(F.col("trash"), F.lit(False))
        out = out.withColumn("trash", F.when(F.col("_t.value"), True).when(~F.col("_t.value") & marked, False).otherwise(F.col("trash")))
    return out.withColumn("changed", F.col("_key").isNotNull()).drop("_key", "_c", "_s", "_set", "_keep", "_p", "_t", "_ever")


def reset_selected(assets: DataFrame) -> DataFrame:
    """Every selected row goes back to qualified."""
    return assets.withColumn(
        "status", F.when(F.col("status") == "selected", F.lit("qualified")).otherwise(F.col("status"))
    )


def fill_missing(assets: DataFrame, results: DataFrame, column: str, key: str = "hash") -> DataFrame:
    """Write a result only where the column is null."""
    fresh = results.select(key, F.col(column).alias("_fresh"))
    return assets.join(fresh, key, "left").withColumn(column, F.coalesce(column, "_fresh")).drop("_fresh")


def vector_coverage(assets: DataFrame, vectors: DataFrame, key: str = "hash") -> DataFrame:
    """One row: assets with and without a vector, and vectors without an asset. One shuffle for both directions."""
    left = assets.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("_rows"), F.count_if(F.col("media_type") == "video").alias("_videos")
    )
    right = vectors.select(key).distinct().withColumn("_has", F.lit(True))
    both = left.join(right, key, "full_outer")
    rows, videos = F.coalesce(F.col("_rows"), F.lit(0)), F.coalesce(F.col("_videos"), F.lit(0))
    missing = F.col("_has").isNull()
    return both.agg(
        F.sum(rows).alias("total_entries"),
        F.sum(F.when(~missing, rows).otherwise(0)).alias("covered"),
        F.sum(F.when(missing, rows - videos).otherwise(0)).alias("missing_images"),
        F.sum(F.when(missing, videos).otherwise(0)).alias("missing_videos"),
        F.count_if(F.col("_rows").isNull()).alias("orphan_vectors"),
    ).withColumn("consistent", (F.col("missing_images") == 0) & (F.col("missing_videos") == 0))


def match_faces(
    faces: DataFrame,
    references: DataFrame,
    tolerance: float = 0.6,
    wanted: Iterable[str] = (),
    mode: str = "any",
    key: str = "hash",
    block_rows: int = 20_000,
) -> DataFrame:
    """Per asset: number of faces, persons within tolerance, smallest distance, and whether the wanted persons are in.

    References go into the Arrow batches as matrices of at most ``block_rows`` rows, one pass over the faces for each
    block; a handful of photos per person is one block. Only one small row per face and block is shuffled. A face
    without a usable encoding still counts as a face; without references no person is found.
    """
    known = references.select("person", "enc").filter(F.col("enc").isNotNull() & ~F.exists("enc", lambda x: x.isNull()))
    blocks = max(1, -(-known.count() // block_rows))
    scored = None
    for b in range(blocks):
        part = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("person", "enc"), F.lit(blocks)) == b)
        rows = part.collect()
        one = faces.select(key, _compare(rows, tolerance)(F.col("enc")).alias("m"), F.lit(b).alias("_block"))
        scored = one if scored is None else scored.unionByName(one)
    names = [F.lit(w) for w in wanted]
    out = scored.groupBy(key).agg(
        F.count_if(F.col("_block") == 0).cast("int").alias("face_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("m.persons")))).alias("faces_found"),
        half_even(F.min("m.near"), 3).alias("face_distance"),
    )
    if not names:
        return out.withColumn("has_target_face", F.col("face_count") > 0)
    asked = F.array(*names)
    test = F.size(F.array_except(asked, "faces_found")) == 0 if mode == "all" else F.arrays_overlap("faces_found", asked)
    return out.withColumn("has_target_face", test)


def _compare(rows: list, tolerance: float):
    """Arrow function: nearest distance of an encoding to the references, and the persons within tolerance."""
    persons = [r["person"] for r in rows]
    matrix = [np.array(r["enc"], dtype="float64") for r in rows]

    @F.pandas_udf("struct<near: double, persons: array<string>>")
    def compare(enc: pd.Series) -> pd.DataFrame:
        near, found = np.full(len(enc), np.nan), [[] for _ in range(len(enc))]
        usable = [i for i, e in enumerate(enc) if e is not None and not any(x is None or x != x for x in e)]
        by_length: dict[int, list[int]] = {}
        for i in usable:
            by_length.setdefault(len(enc.iloc[i]), []).append(i)
        for length, at in by_length.items():
            refs = [j for j, m in enumerate(matrix) if len(m) == length]
            if not refs:
                continue
            data = np.stack([np.asarray(enc.iloc[i], dtype="float64") for i in at])
            # one reference at a time keeps the batch at rows x dimension
            dist = np.stack([np.sqrt(((data - matrix[j]) ** 2).sum(axis=1)) for j in refs], axis=1)
            near[at] = dist.min(axis=1)
            for i, row in zip(at, dist <= tolerance):
                found[i] = sorted({persons[refs[j]] for j in np.flatnonzero(row)})
        return pd.DataFrame({"near": pd.Series(near).astype(object).where(~np.isnan(near), None), "persons": found})

    return compare


def burst_pairs(df: DataFrame, by: list[str], number: str, key: str, gap: int = 3) -> DataFrame:
    """Pairs in the same group whose numbers differ by at most ``gap``.

    Rows with one number form a point; its members are tied to its smallest key instead of to each other, and pairs
    between points are pairs of these smallest keys. Numbers are cut into stretches of gap + 1; each point is sent to
    its own stretch and the one before, so a stretch holds at most 2 * (gap + 1) points whatever the data.
    """
    # keys are usually parsed from names; parse them once
    rows = cut_lineage(df.select(*by, number, key)).filter(F.col(number).isNotNull())
    points = rows.groupBy(*by, number).agg(F.min(key).alias("_id"), F.count("*").alias("_n"))
    stretch = F.floor(F.col(number) / (gap + 1))
    placed = points.select(
        *by, F.struct(F.col(number).alias("n"), F.col("_id").alias("id")).alias("_p"), stretch.alias("_own"),
        F.explode(F.array(stretch, stretch - 1)).alias("_cell"),
    )
    cells = placed.groupBy(*by, "_cell").agg(
        F.collect_list(F.when(F.col("_own") == F.col("_cell"), F.col("_p"))).alias("_mine"),
        F.collect_list("_p").alias("_all"),
    )
    between = (
        cells.select(*by, F.explode("_mine").alias("_a"), "_all").select(*by, "_a", F.explode("_all").alias("_b"))
        .filter((F.col("_b.n") > F.col("_a.n")) & (F.col("_b.n") - F.col("_a.n") <= gap))
        .select(*by, F.least("_a.id", "_b.id").alias("a_id"), F.greatest("_a.id", "_b.id").alias("b_id"),
                (F.col("_b.n") - F.col("_a.n")).alias("distance"))
    )
    same = (
        rows.select(*by, number, F.col(key).alias("_k"))
        .transform(lambda r: join_by(r, points.filter(F.col("_n") > 1).drop("_n"), [*by, number]))
        .filter(F.col("_k") != F.col("_id"))
        .select(*by, F.col("_id").alias("a_id"), F.col("_k").alias("b_id"), F.lit(0).cast("long").alias("distance"))
    )
    return between.unionByName(same)


def category_from_export(name: Column | str, prefixes: dict[str, str], old_prefixes: dict[str, str] | None = None) -> Column:
    """Category of an exported ``prefix__file`` name, through the current and then the former prefix table."""
    from ..functions.names import exported_parts

    prefix, _ = exported_parts(name)
    current = lookup(prefix, prefixes, "prefixes")
    return F.coalesce(current, lookup(prefix, old_prefixes, "old prefixes")) if old_prefixes else current
