"""Brackets, time windows, keywords and dictionaries as tables of any size, matched by joins.

Intervals: every interval is cut into its dyadic pieces, at most two for each power of two, whatever its length. A value
lies in exactly one piece of each size, so "which intervals hold this value" is an equality join on (size, piece); a
piece keeps only the first of its intervals. Values are looked up once each.

Texts: keywords and dictionary entries travel with the tasks in blocks (``needles``), and each text is counted where it
is read: no text is shuffled, and no pair of text and needle leaves a task.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_path
from ..functions.numbers import col
from ..session import cut_lineage
from .keys import join_by
from .needles import DIRECT, Block, needle_blocks, scan
from .ranges import positions

# values of days are clamped to this many bits
DAY_BITS = 31


def _pieces(bits: int):
    """Dyadic pieces (level, index) that make up low..high, both included, inside 0..2^bits - 1."""

    @F.pandas_udf("array<struct<level:int,piece:long>>")
    def cut(low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(low, high):
            found = []
            if a == a and b == b and a is not None and b is not None:
                left, right, level = max(0, int(a)), min((1 << bits) - 1, int(b)) + 1, 0
                while left < right:
                    if left & 1:
                        found.append({"level": level, "piece": left})
                        left += 1
                    if right & 1:
                        right -= 1
                        found.append({"level": level, "piece": right})
                    left, right, level = left >> 1, right >> 1, level + 1
            out.append(found)
        return pd.Series(out)

    return cut


def first_covering(
    points: DataFrame, intervals: DataFrame, point: str, by: list[str] | None = None, bits: int = DAY_BITS, name: str = "ord",
) -> DataFrame:
    """(by, point, name): the smallest ``ord`` of the intervals (by, ord, low, high; both ends included) that hold each
    point, for the points that some interval holds. Points and ends are integers; points outside 0..2^bits - 1 match
    nothing, and ends are clamped. Nulls match nothing."""
    by = by or []
    pieces = intervals.withColumn("_p", F.explode(_pieces(bits)(F.col("low").cast("double"), F.col("high").cast("double"))))
    index = pieces.groupBy(*by, F.col("_p.level").alias("_level"), F.col("_p.piece").alias("_piece")).agg(F.min("ord").alias(name))
    asked = points.select(*by, F.col(point).cast("long").alias(point)).filter(F.col(point).between(0, (1 << bits) - 1)).distinct()
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("_level")
    probes = asked.select("*", levels).withColumn("_piece", F.expr(f"shiftright(`{point}`, _level)"))
    return probes.join(index, [*by, "_level", "_piece"]).groupBy(*by, point).agg(F.min(name).alias(name))


def _attach(df: DataFrame, found: DataFrame, on: dict[str, Column], name: str) -> DataFrame:
    """Left join of the looked-up column ``_found`` as ``name`` by the values that were looked up; it replaces a column
    of that name.

    Helper columns carry ``name`` in theirs, so joins on top of each other do not clash.
    """
    marked = df
    for c, e in on.items():
        marked = marked.withColumn(f"{name}__{c}", e)
    right = found.select(*[F.col(c).alias(f"{name}__{c}") for c in on], F.col("_found").alias(name))
    return marked.drop(name).join(right, [f"{name}__{c}" for c in on], "left").drop(*[f"{name}__{c}" for c in on])


def _beside(df: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """The columns of a table of one row beside every row, as ``name__column``."""
    key = f"{name}__one"
    row = one.select(F.lit(1).alias(key), *[F.col(c).alias(f"{name}__{c}") for c in one.columns])
    return df.withColumn(key, F.lit(1)).join(F.broadcast(row), key, "left").drop(key)


def bracket_join(df: DataFrame, days: Column | str, categories: DataFrame, mode: str = "half_open", name: str = "category") -> DataFrame:
    """``bracket_of`` for a table of brackets (ord, id, age_days_from, age_days_to): the same three modes, any number.

    Overlapping brackets are settled by the smallest ``ord``; a table without brackets gives null. Rows keep their other
    columns; a column called ``name`` is replaced.
    """
    days = col(days).cast("long")
    named = categories.filter(F.col("age_days_to").isNotNull()).select("ord", "id", "age_days_from", "age_days_to")
    low, high = F.col("age_days_from"), F.col("age_days_to")
    if mode == "half_open":
        spans, value = named.filter(low.isNotNull()).select("ord", low.alias("low"), (high - 1).alias("high")), days
    elif mode == "closed_clamped":
        spans, value = named.filter(low.isNotNull()).select("ord", low.alias("low"), high.alias("high")), F.greatest(days, F.lit(0))
        value = F.when(days.isNotNull(), value)
    else:
        spans, value = named.select("ord", F.lit(0).alias("low"), high.alias("high")), days
    points = df.select(value.alias("day")).distinct()
    hit = first_covering(points, spans, "day", name="_ord").join(named.select(F.col("ord").alias("_ord"), F.col("id").alias("_found")), "_ord")
    out = _attach(df.withColumn(f"{name}__value", value), hit, {"day": F.col(f"{name}__value")}, name)
    if mode == "half_open":
        return out.drop(f"{name}__value")
    ends = named.agg(F.max_by("id", "ord").alias("last"), F.max_by("age_days_to", "ord").alias("top"), F.min_by("id", "ord").alias("first"))
    out = _beside(out, ends, name)
    value, last = F.col(f"{name}__value"), F.col(f"{name}__last")
    if mode == "closed_clamped":
        rest = F.when(value.isNotNull(), F.when(value > F.col(f"{name}__top"), last).otherwise(F.col(f"{name}__first")))
    else:
        rest = F.when(value >= 0, last)
    return out.withColumn(name, F.coalesce(name, rest)).drop(*[f"{name}__{c}" for c in ("value", "last", "top", "first")])


def needle_hits(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text_id, needle_id): which of ``needles`` (needle_id, needle) each of ``texts`` (text_id, text) contains.

    Both ids are unique. Empty needles and nulls are left out.
    """
    blocks = needle_blocks(needles.select(F.col("needle").alias("k"), F.col("needle_id").cast("long")))

    @F.arrow_udf("array<long>")
    def contained(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found: list = []

        def add(number, table, block, first, text, needle):
            text, row = block.listed(text, needle)
            found.append((text + first, np.asarray(table.column("needle_id"))[row]))

        def finish(count):
            text, ids = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *found))
            order = np.argsort(text, kind="stable")
            ends = np.searchsorted(text[order], np.arange(count + 1))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[order], pa.int64()))

        yield from scan(batches, blocks, add, finish, lambda count: found.clear())

    return texts.select("text_id", F.explode(contained("text")).alias("needle_id"))


def _sums(keys: np.ndarray, weights: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sum of their weights."""
    if places <= DIRECT:
        total = np.bincount(keys, weights, places)
        found = np.flatnonzero(total)
        return found, total[found].astype(np.int64)
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights, len(found)).astype(np.int64)


class _Weights:
    """How often each category lists the needles of a block.

    Needles of many categories are a dense matrix, so the texts that hold them are one product; the others are listed.
    """

    def __init__(self, table: pa.Table, block: Block, categories: int):
        self.times, self.category = (np.asarray(table.column(c)).astype(np.int64) for c in ("times", "category"))
        self.block, self.categories = block, categories
        size = np.diff(block.start)
        many = np.argsort(-size, kind="stable")[: DIRECT // max(categories, 1)]
        many = many[size[many] > 16]
        self.place = np.full(len(size), -1, dtype=np.int64)
        self.place[many] = np.arange(len(many))
        self.matrix = np.zeros((len(many), categories))
        if len(many):
            needle, row = block.listed(np.arange(len(many)), many)
            self.matrix[needle, self.category[row]] = self.times[row]

    def counts(self, text: np.ndarray, needle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, category, keywords) of the categories with a keyword in a text."""
        place = self.place[needle]
        few = place < 0
        own, row = self.block.listed(text[few], needle[few])
        keys, hits = [own * self.categories + self.category[row]], [self.times[row]]
        texts = int(text.max(initial=-1)) + 1
        text, place = text[~few], place[~few]
        order = np.argsort(text, kind="stable")
        text, place = text[order], place[order]
        step = max(1, DIRECT // max(1, len(self.matrix)))
        for first in range(0, texts if len(text) else 0, step):
            a, b = np.searchsorted(text, (first, first + step))
            held = np.zeros((min(step, texts - first), len(self.matrix)))
            held[text[a:b] - first, place[a:b]] = 1
            score = (held @ self.matrix).ravel()
            found = np.flatnonzero(score)
            keys.append(found + first * self.categories)
            hits.append(score[found])
        keys, hits = _sums(np.concatenate(keys), np.concatenate(hits), texts * self.categories)
        return *np.divmod(keys, self.categories), hits


def keyword_join(
    df: DataFrame, text: Column | str, categories: DataFrame, name: str = "category", fallback: bool = False,
    thematic: str | None = None,
) -> DataFrame:
    """``keyword_match`` for a table of categories (ord, id, keywords) of any size: the category with the most keywords
    contained in the text, the smallest ``ord`` on ties, null without a hit; with ``fallback`` then the first category.

    A keyword listed twice counts twice, an empty one is contained in every text, a null one in none. Null texts match
    nothing. A column called ``name`` is replaced. ``thematic`` names a second column, with the fallback, from the same
    pass over the texts.
    """
    text = F.lower(normalize_path(col(text)))
    listed = categories.select("ord", "id", F.explode("keywords").alias("k")).filter(F.col("k").isNotNull()).withColumn("k", F.lower("k"))
    listed = cut_lineage(listed.groupBy("ord", "id", "k").agg(F.count("*").alias("times")))
    # the smaller number wins a tie
    numbered = positions(listed.select("ord", "id").distinct(), [F.col("ord").asc_nulls_last(), F.col("id").desc_nulls_last()], "category")
    numbered = cut_lineage(numbered)
    listed = cut_lineage(join_by(listed, numbered, ["ord", "id"]))
    always = listed.filter(F.col("k") == "").groupBy("category").agg(F.sum("times").alias("times"))
    blocks = needle_blocks(listed.select("k", "category", "times"))
    shared = df.sparkSession.sparkContext.broadcast((numbered.orderBy("category").select("id").toArrow(), always.toArrow()))

    @F.arrow_udf(categories.schema["id"].dataType)
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, empty = shared.value
        size = max(1, ids.num_rows)
        base = np.zeros(size, dtype=np.int64)
        base[np.asarray(empty.column("category"))] = np.asarray(empty.column("times"))
        free = int(np.argmax(base)) if base.any() else -1
        found: list = []
        weights: dict = {}

        def add(number, table, block, first, text, needle):
            if number not in weights:
                weights.clear()
                weights[number] = _Weights(table, block, size)
            text, category, hits = weights[number].counts(text, needle)
            if len(blocks) == 1:
                text, category, hits = _first_best(text, category, hits + base[category])
            found.append((text + first, category, hits))

        def finish(count):
            text, category, hits = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *found))
            if len(blocks) > 1:
                keys, hits = _sums(text * size + category, hits, count * size)
                text, category = np.divmod(keys, size)
                text, category, hits = _first_best(text, category, hits + base[category])
            chosen = np.full(count, free, dtype=np.int64)
            if free >= 0:
                won = (hits > base[free]) | ((hits == base[free]) & (category < free))
                text, category = text[won], category[won]
            chosen[text] = category
            return ids.column("id").combine_chunks().take(pa.array(chosen, mask=chosen < 0))

        yield from scan(batches, blocks, add, finish, lambda count: found.clear(), max(1, DIRECT // size) if size <= 4096 else 1 << 16)

    out = df.withColumn(name, best(text))
    if fallback or thematic:
        out = _beside(out, categories.agg(F.min_by("id", "ord").alias("first")), name)
        filled = F.coalesce(name, f"{name}__first")
        out = out.withColumns({**({thematic: filled} if thematic else {}), **({name: filled} if fallback else {})}).drop(f"{name}__first")
    return out


def _first_best(text: np.ndarray, category: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best category of each text, the smallest number on ties."""
    order = np.lexsort((category, -hits, text))
    text, category, hits = text[order], category[order], hits[order]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    return text[first], category[first], hits[first]


def dictionary_join(df: DataFrame, text: Column | str, entries: DataFrame, name: str = "value", per_part: bool = False) -> DataFrame:
    """``dictionary_lookup`` for a table of entries (ord, k, v) of any size: the value of the first entry contained in
    the text; ``per_part`` walks the path parts first. Entries without key or value are skipped; an empty key is contained
    in every text. A column called ``name`` is replaced."""
    text = normalize_path(col(text))
    listed = entries.filter(F.col("k").isNotNull() & F.col("v").isNotNull())
    first = listed.groupBy("k").agg(F.min("ord").alias("ord"), F.min_by("v", "ord").alias("v"))
    first = cut_lineage(positions(first, ["ord", "v"], "place").select("place", "k", "v"))
    blocks = needle_blocks(first)
    shared = df.sparkSession.sparkContext.broadcast(first.filter(F.col("k") == "").select("place", "v").toArrow())

    @F.arrow_udf(entries.schema["v"].dataType)
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        free = shared.value
        none = np.iinfo(np.int64).max
        # all values, the one of the empty key last
        values = pa.concat_arrays([c for t in [*(b.value for b in blocks), free] for c in t.column("v").chunks] or [free.column("v").combine_chunks()])
        starts = np.cumsum([0, *[b.value.num_rows for b in blocks]])
        places: list = []

        def begin(count):
            # the first entry of each text, and where its value is
            places[:] = [np.full(count, none), np.full(count, -1, dtype=np.int64)]
            if free.num_rows:
                places[0][:], places[1][:] = free.column("place")[0].as_py(), len(values) - 1

        def add(number, table, block, first, text, needle):
            text, row = block.listed(text, needle)
            place = np.asarray(table.column("place"))[row]
            order = np.lexsort((place, text))
            text, place, row = text[order], place[order], row[order]
            best = np.flatnonzero(np.diff(text, prepend=-1))
            text, place, row = text[best] + first, place[best], row[best] + starts[number]
            better = place < places[0][text]
            places[0][text[better]], places[1][text[better]] = place[better], row[better]

        def finish(count):
            return values.take(pa.array(places[1], mask=places[1] < 0))

        if not per_part:
            yield from scan(batches, blocks, add, finish, begin)
            return
        for batch in batches:
            parts = pc.split_pattern(batch, "/")
            at = np.asarray(pc.list_parent_indices(parts))
            flat = parts.flatten()
            found = pa.concat_arrays(list(scan(iter([flat]), blocks, add, lambda count: pa.array(places[1], mask=places[1] < 0), begin)))
            held = np.flatnonzero(np.asarray(found.is_valid()))
            chosen = np.full(len(batch), -1, dtype=np.int64)
            chosen[at[held][::-1]] = np.asarray(found.take(pa.array(held)))[::-1]
            yield values.take(pa.array(chosen, mask=chosen < 0))

    return df.withColumn(name, value(text))


def _half_seconds(clock: Column) -> Column:
    part = F.split(clock, ":")
    return (F.get(part, 0).cast("int") * 3600 + F.get(part, 1).cast("int") * 60) * 2


def day_time_join(
    df: DataFrame, at: Column | str, text: Column | str, categories: DataFrame, event_date: str, name: str = "category",
) -> DataFrame:
    """``day_time_match`` for a table of categories (ord, id, day_offset, time_from, time_to, keywords) of any size."""
    at = col(at)
    timed = categories.filter(F.col("day_offset") != -1)
    low, high = _half_seconds(F.col("time_from")), _half_seconds(F.col("time_to"))
    end = F.lit(2 * 86400 - 1)
    # a window past midnight is two
    spans = timed.select("ord", F.col("day_offset").alias("_day"), F.explode(
        F.when(high < low, F.array(F.struct(low.alias("low"), end.alias("high")), F.struct(F.lit(0).alias("low"), high.alias("high"))))
        .otherwise(F.array(F.struct(low.alias("low"), high.alias("high"))))).alias("_w")).select("ord", "_day", "_w.low", "_w.high")
    day = F.datediff(F.to_date(at), F.to_date(F.lit(event_date)))
    second = F.extract(F.lit("SECOND"), at).cast("double")
    # window ends are whole seconds, so a moment is its second and whether something is left of it
    moment = ((F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(second)) * 2 + (second > F.floor(second)).cast("int")).cast("long")
    points = df.select(day.alias("_day"), moment.alias("_moment")).filter(F.col("_moment").isNotNull()).distinct()
    theme = f"{name}__theme"
    # the texts first: their column may be the one that is replaced
    out = keyword_join(df, text, categories.filter(F.col("day_offset") == -1), theme, fallback=True)
    hit = first_covering(points, spans, "_moment", ["_day"], 18, "_ord").join(
        timed.select(F.col("ord").alias("_ord"), F.col("id").alias("_found")), "_ord")
    out = _attach(out.withColumn(theme, F.when(at.isNotNull(), F.col(theme))), hit, {"_day": day, "_moment": moment}, name)
    return out.withColumn(name, F.coalesce(name, theme)).drop(theme)


def month_join(
    df: DataFrame, date: Column | str, text: Column | str, categories: DataFrame, year: int | None = None, name: str = "category",
) -> DataFrame:
    """``month_match`` for a table of categories (ord, id, month_from, month_to, keywords) of any size."""
    date = col(date)
    dated = categories.filter(F.col("month_from").isNotNull() & F.col("month_to").isNotNull())
    whole = (F.col("month_from") == 1) & (F.col("month_to") == 12)
    some = F.coalesce(F.size("keywords"), F.lit(0)) > 0
    span = F.explode(F.when(F.col("month_from") <= F.col("month_to"), F.sequence("month_from", "month_to"))).alias("_month")
    span_name, theme, known = f"{name}__span", f"{name}__theme", f"{name}__known"
    months = dated.filter(~whole).select("ord", "id", span).groupBy("_month").agg(F.min_by("id", "ord").alias("_found"))
    out = df.withColumn(known, F.coalesce(date.isNotNull() if year is None else F.year(date) == year, F.lit(False)))
    out = _attach(out, months, {"_month": F.month(date)}, span_name)
    out = keyword_join(out, text, dated.filter(whole & some), theme)
    out = _beside(out, dated.filter(whole & ~some).agg(F.min_by("id", "ord").alias("rest")), name)
    return out.withColumn(name, F.when(F.col(known), F.coalesce(theme, span_name, f"{name}__rest"))).drop(theme, span_name, known, f"{name}__rest")
