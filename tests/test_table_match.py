"""Brackets, windows, keywords and dictionaries as tables: against the expression forms, and far beyond their size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.config import Category
from lumisift.operators import joins as j
from lumisift.operators import table_match as m

CATEGORY = ("ord int, id string, day_offset int, time_from string, time_to string, age_days_from int, age_days_to int, "
            "month_from int, month_to int, keywords array<string>")


def as_table(spark, cats):
    return spark.createDataFrame([
        (i, c.id, c.day_offset, c.time_from, c.time_to, c.age_days_from, c.age_days_to, c.month_from, c.month_to, list(c.keywords))
        for i, c in enumerate(cats)], CATEGORY)


def compare(df, name, expression, table):
    left = sorted(map(tuple, df.select("id", expression.alias(name)).collect()), key=repr)
    assert sorted(map(tuple, table.select("id", name).collect()), key=repr) == left
    return left


@pytest.mark.parametrize("mode", ["half_open", "closed_clamped", "ladder"])
def test_brackets_as_expression(spark, mode):
    rng = random.Random(3)
    cats = [Category(f"b{i}", age_days_from=lo, age_days_to=lo + rng.randrange(0, 90)) for i, lo in enumerate(rng.choices(range(0, 900), k=30))]
    cats += [Category("open", age_days_from=None, age_days_to=40), Category("endless", age_days_from=7, age_days_to=None),
             Category("turned", age_days_from=50, age_days_to=10), Category("whole", age_days_from=0, age_days_to=2**31 - 1)][: 3 if mode != "half_open" else 4]
    days = [None, -5, -1, 0, 1, 39, 40, 41, 10**6, *range(2, 1000, 7)]
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(days * 2)], "id int, days int, ord string")
    compare(df, "c", j.bracket_of("days", cats, mode), m.bracket_join(df, "days", as_table(spark, cats), mode, "c"))
    none = m.bracket_join(df, "days", as_table(spark, cats).limit(0), mode, "c")
    assert {r.c for r in none.collect()} == {None} and none.count() == len(days) * 2
    assert m.bracket_join(df, "days", as_table(spark, cats), mode, "ord").columns.count("ord") == 1


def test_twenty_thousand_brackets(spark):
    rng = np.random.default_rng(1)
    low = rng.integers(0, 100_000, 20_000)
    high = low + rng.integers(1, 30_000, 20_000) * (rng.random(20_000) < 0.1) + rng.integers(0, 5, 20_000)
    table = spark.createDataFrame([(i, f"b{i}", int(a), int(b)) for i, (a, b) in enumerate(zip(low, high))],
                                  "ord int, id string, age_days_from int, age_days_to int")
    days = rng.integers(-10, 140_000, 3_000).tolist()
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, days int")
    got = {r.id: r.category for r in m.bracket_join(df, "days", table).collect()}
    for i, d in enumerate(days):
        hit = np.flatnonzero((low <= d) & (d < high))
        assert got[i] == (f"b{hit[0]}" if len(hit) and d >= 0 else None)


TEXTS = [None, "", "a", "IMG beach", "C:\\Pics\\Beach Day", "the quick brown fox", "ÄÖ tschüß 日本語 🎉🎉", "aaaa", "beachbeach day", "x/y/Paris/z", "%_.*[("]
WORDS = [Category("one", keywords=("beach", "a")), Category("two", keywords=("BEACH", "day", "day")), Category("none"),
         Category("odd", keywords=("🎉", "日本", "ß 日", "aa")), Category("regex", keywords=("%_", ".*[", "(")), Category("long", keywords=("quick brown fox and more",))]


def test_keywords_as_expression(spark):
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS * 2)], "id int, text string, keywords string")
    for cats in (WORDS, [*WORDS, Category("every", keywords=("",))], [Category("every", keywords=("", "", ""))], [Category("none")], []):
        compare(df, "c", j.keyword_match("text", cats), m.keyword_join(df, "text", as_table(spark, cats), "c"))
        compare(df, "c", j.thematic_match("text", cats), m.keyword_join(df, "text", as_table(spark, cats), "c", fallback=True))
    replaced = m.keyword_join(df, "text", as_table(spark, WORDS), "text")
    assert replaced.columns.count("text") == 1 and replaced.count() == len(TEXTS) * 2


def test_fifty_thousand_keywords(spark):
    rng = random.Random(9)
    letters = "abcdefghij"
    words = ["".join(rng.choices(letters, k=rng.randrange(4, 9))) for _ in range(50_000)]
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 300))) for _ in range(120)]
    table = spark.createDataFrame([(i, f"c{i}", words[i::200]) for i in range(200)], "ord int, id string, keywords array<string>")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.category for r in m.keyword_join(df, "text", table).collect()}
    for i, t in enumerate(texts):
        counts = [sum(w in t for w in words[c::200]) for c in range(200)]
        best = max(counts)
        assert got[i] == (f"c{counts.index(best)}" if best else None)


def test_dictionary_as_expression(spark):
    entries = {"Pics": "p", "each": "e", "x/y": "slash", "Paris": "paris", "z": "z", "skip": None, "日本": "j", "C:": "c", "a": "a"}
    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(entries.items())] + [(99, "a", "later"), (98, None, "n")], "ord int, k string, v string")
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate([*TEXTS, "q/z/Paris", "Paris//a"])], "id int, text string, v string")
    for per_part in (False, True):
        compare(df, "d", j.dictionary_lookup("text", entries, per_part), m.dictionary_join(df, "text", table, "d", per_part))
    always = table.unionByName(spark.createDataFrame([(2, "", "empty")], table.schema))
    with_empty = {"Pics": "p", "each": "e", "": "empty"}
    compare(df, "d", j.dictionary_lookup("text", with_empty), m.dictionary_join(df, "text", always, "d"))


def test_day_time_and_month_as_expressions(spark):
    cats = [
        Category("morning", day_offset=2, time_from="06:00", time_to="11:59"), Category("noon", day_offset=2, time_from="11:00", time_to="15:00"),
        Category("night", day_offset=2, time_from="21:30", time_to="03:15"), Category("whole", day_offset=3),
        Category("before", day_offset=-2, time_from="10:00", time_to="10:00"), Category("clicks", day_offset=-1, keywords=("beach",)),
        Category("rest", day_offset=-1, keywords=("fox",)),
    ]
    moments = [None, "2024-01-03 05:59:59.999", "2024-01-03 06:00:00", "2024-01-03 11:59:00", "2024-01-03 11:59:00.001", "2024-01-03 15:00:00.5",
               "2024-01-03 03:15:00", "2024-01-03 03:15:00.000001", "2024-01-03 23:59:59.9", "2024-01-04 23:58:59", "2024-01-04 23:59:59", "2023-12-30 10:00:00", "2023-12-30 10:00:01"]
    rows = [(i * 100 + k, t, x) for i, t in enumerate(moments) for k, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, at string, text string").withColumn("at", F.col("at").cast("timestamp"))
    found = compare(df, "c", j.day_time_match("at", "text", cats, "2024-01-01"), m.day_time_join(df, "at", "text", as_table(spark, cats), "2024-01-01", "c"))
    assert {r[1] for r in found} >= {"morning", "noon", "night", "whole", "before", "clicks", "rest", None}
    months = [Category("low", month_from=1, month_to=12, keywords=("beach",)), Category("q1", month_from=1, month_to=3),
              Category("turned", month_from=9, month_to=2), Category("summer", month_from=6, month_to=8), Category("june", month_from=6, month_to=6),
              Category("any", month_from=1, month_to=12), Category("undated")]
    dates = [None, "2023-02-01", "2024-02-01", "2024-06-15", "2024-10-31"]
    df = spark.createDataFrame([(i * 100 + k, t, x) for i, t in enumerate(dates) for k, x in enumerate(TEXTS)], "id int, date string, text string")
    df = df.withColumn("date", F.col("date").cast("date"))
    for year in (None, 2024):
        for chosen in (months, [c for c in months if c.id != "any"]):
            compare(df, "c", j.month_match("date", "text", chosen, year), m.month_join(df, "date", "text", as_table(spark, chosen), year, "c"))


def test_needles(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t is not None], "text_id long, text string")
    needles = ["a", "ea", "beach", "日", "🎉🎉", "", None, "absent", "%", "quick brown fox", "aaaaa", "aaaa"]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "needle_id long, needle string")
    got = {tuple(r) for r in m.needle_hits(texts, table).collect()}
    assert got == {(i, k) for i, t in enumerate(TEXTS) if t is not None for k, n in enumerate(needles) if n and n in t}
    assert m.needle_hits(texts, table.limit(0)).count() == 0 and m.needle_hits(texts.limit(0), table).count() == 0


def no_text_shuffled(df):
    """The joins on texts are one pass: neither a join nor an exchange carries them."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("block_rows", [1 << 20, 500])
def test_keywords_of_many_categories(spark, monkeypatch, block_rows):
    from lumisift.operators import needles

    monkeypatch.setattr(needles, "BLOCK_ROWS", block_rows)
    rng = random.Random(4)
    # short words in nearly all of 60 categories, longer ones in one or two; several blocks where these are small
    words = [["".join(rng.choices("abcd", k=rng.choice([1, 2, 2, 3, 5]))) for _ in range(25)] + ["ab", "ab"] * (c % 2) for c in range(60)]
    words[7].append("")
    texts = ["".join(rng.choices("abcde ", k=rng.randrange(0, 40))) for _ in range(150)] + ["é", "a" * 3000, None]
    table = spark.createDataFrame([(i, f"c{i}", w) for i, w in enumerate(words)], "ord int, id string, keywords array<string>")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "id int, text string")
    joined = m.keyword_join(df, "text", table, "c")
    assert no_text_shuffled(joined)
    got = {r.id: r.c for r in joined.collect()}
    for i, t in enumerate(texts * 2):
        counts = [sum(w in t for w in ws) if t is not None else 0 for ws in words]
        best = max(counts)
        assert got[i] == (f"c{counts.index(best)}" if best else None)


@pytest.mark.parametrize("block_rows", [1 << 20, 40])
def test_dictionary_in_blocks(spark, monkeypatch, block_rows):
    from lumisift.operators import needles

    monkeypatch.setattr(needles, "BLOCK_ROWS", block_rows)
    rng = random.Random(5)
    keys = list({"".join(rng.choices("abcd/", k=rng.randrange(1, 6))): None for _ in range(300)})
    long = "abcd" * 80
    keys += [long, long[:-1] + "x", long + "/"]  # filed by their first bytes
    texts = ["".join(rng.choices("abcde/", k=rng.randrange(0, 12))) for _ in range(200)] + ["ee" + long[1:] + "x", long + "y", None]
    rng.shuffle(keys)
    table = spark.createDataFrame([(i, k, i * 3) for i, k in enumerate(keys)], "ord int, k string, v int")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    joined = m.dictionary_join(df, "text", table, "v")
    assert no_text_shuffled(joined)
    first = lambda t: next((i for i, k in enumerate(keys) if t is not None and k in t), None)
    assert {r.id: r.v for r in joined.collect()} == {i: None if first(t) is None else first(t) * 3 for i, t in enumerate(texts)}
    parts = {r.id: r.v for r in m.dictionary_join(df, "text", table, "v", per_part=True).collect()}
    for i, t in enumerate(texts):
        hit = next((first(p) for p in (t or "").split("/") if t is not None and first(p) is not None), None)
        assert parts[i] == (None if hit is None else hit * 3)
