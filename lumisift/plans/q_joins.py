"""Lookups, range matches and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Category
from ..operators import joins as j
from . import adapters as a
from .registry import query

WORDS = [
    Category("w_tion", keywords=("tion", "ing")), Category("w_the", keywords=("the", "and")),
    Category("w_der", keywords=("der", "ung", "ein")), Category("w_none", keywords=()),
    Category("w_eau", keywords=("eau", "ción")),
]
_WORD_HITS = """
, hits AS (SELECT asset_id,
  CAST(contains(text, 'tion') AS INT) + CAST(contains(text, 'ing') AS INT) AS h0, CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'and') AS INT) AS h1,
  CAST(contains(text, 'der') AS INT) + CAST(contains(text, 'ung') AS INT) + CAST(contains(text, 'ein') AS INT) AS h2,
  CAST(contains(text, 'eau') AS INT) + CAST(contains(text, 'ción') AS INT) AS h4 FROM assets)
"""
_WORD_BEST = """CASE WHEN greatest(h0, h1, h2, h4) = 0 THEN NULL WHEN h0 = greatest(h0, h1, h2, h4) THEN 'w_tion' WHEN h1 = greatest(h0, h1, h2, h4) THEN 'w_the'
  WHEN h2 = greatest(h0, h1, h2, h4) THEN 'w_der' ELSE 'w_eau' END"""


@query("j1_anti_existing", """
SELECT asset_id FROM assets WHERE hash NOT IN (SELECT hash FROM assets WHERE status = 'selected')""", uses=("assets",))
def j1(spark, d):
    df = a.assets_doc(spark, d)
    return j.anti_existing(df, df.filter(F.col("status") == "selected")).select("asset_id")


@query("j2_reuse_catalog", """
SELECT asset_id, concat('/new', path) AS path, CASE WHEN asset_id % 3 = 0 THEN 'old' ELSE status END AS status, asset_id % 3 = 0 AS reused FROM assets""", uses=("assets",))
def j2(spark, d):
    df = a.assets_doc(spark, d).select("asset_id", "path", "source_label", "status")
    old = df.filter(F.col("asset_id") % 3 == 0).withColumn("status", F.lit("old"))
    scan = df.withColumn("path", F.concat(F.lit("/new"), "path"))
    return j.reuse_catalog(scan, old, "asset_id").select("asset_id", "path", "status", "reused")


@query("j3_attach_vectors", """
, j AS (SELECT asset_id, v, CASE WHEN asset_id % 2 = 0 THEN [1e0] END AS own FROM assets LEFT JOIN raw ON asset_id = vec_id),
r AS (SELECT asset_id, 'embedded' AS first, coalesce(own, CAST(v AS DOUBLE[])) AS x FROM j UNION ALL SELECT asset_id, 'sidecar', coalesce(CAST(v AS DOUBLE[]), own) FROM j)
SELECT asset_id, first, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT asset_id, first, unnest(range(0, len(x))) AS i, unnest(x) AS x FROM r WHERE x IS NOT NULL)
UNION ALL SELECT asset_id, first, -1, NULL FROM r WHERE x IS NULL""", uses=("assets", "raw"))
def j3(spark, d):
    """Every coordinate of every row, by both orders; rows without a vector once."""
    df = a.assets_doc(spark, d).select("asset_id").withColumn(
        "own", F.when(F.col("asset_id") % 2 == 0, F.array(F.lit(1.0).cast("float")))
    )
    raw = a.raw_vectors(spark, d).withColumnRenamed("vec_id", "asset_id")
    parts = []
    for first, embedded in (("embedded", True), ("sidecar", False)):
        one = j.attach_vectors(df, raw, "asset_id", "own", embedded).select("asset_id", F.lit(first).alias("first"), "vector")
        parts.append(one.filter(F.col("vector").isNotNull()).select("asset_id", "first", F.posexplode("vector").alias("i", "x")))
        parts.append(one.filter(F.col("vector").isNull()).select("asset_id", "first", F.lit(-1).alias("i"), F.lit(None).cast("float").alias("x")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("x", F.round(F.col("x").cast("double"), 6))


BRACKETS = [
    Category(f"b{i}", age_days_from=lo, age_days_to=hi)
    for i, (lo, hi) in enumerate(
        [(0, 14), (14, 60), (60, 120), (120, 210), (210, 300), (300, 365), (365, 730), (730, 1095), (1095, 1825), (1825, 2100)]
    )
]
_BOUNDS = "VALUES (0,0,14),(1,14,60),(2,60,120),(3,120,210),(4,210,300),(5,300,365),(6,365,730),(7,730,1095),(8,1095,1825),(9,1825,2100)"


@query("j9_bracket_join", f"""
SELECT asset_id, (SELECT concat('b', CAST(min(o) AS STRING)) FROM ({_BOUNDS}) t(o, lo, hi) WHERE age >= lo AND age < hi AND age >= 0 HAVING count(*) > 0) AS half_open,
  CASE WHEN age > 2100 THEN 'b9' ELSE (SELECT concat('b', CAST(min(o) AS STRING)) FROM ({_BOUNDS}) t(o, lo, hi) WHERE greatest(age, 0) BETWEEN lo AND hi) END AS closed,
  CASE WHEN age >= 0 THEN CASE WHEN age > 2100 THEN 'b9' ELSE (SELECT concat('b', CAST(min(o) AS STRING)) FROM ({_BOUNDS}) t(o, lo, hi) WHERE age <= hi) END END AS ladder
FROM (SELECT asset_id, date_diff('day', DATE '1995-06-01', date) AS age FROM dated)""", uses=("dated",))
def j9(spark, d):
    age = F.datediff("date", F.to_date(F.lit("1995-06-01")))
    return a.assets_dated(spark, d).select(
        "asset_id", j.bracket_of(age, BRACKETS).alias("half_open"),
        j.bracket_of(age, BRACKETS, "closed_clamped").alias("closed"), j.bracket_of(age, BRACKETS, "ladder").alias("ladder"),
    )


WINDOWS = [
    Category("morning", day_offset=2, time_from="06:00", time_to="11:59"), Category("noon", day_offset=2, time_from="11:00", time_to="15:00"),
    Category("night", day_offset=4, time_from="21:30", time_to="03:15"), Category("whole", day_offset=7),
    Category("clicks", day_offset=-1, keywords=("click",)), Category("rest", day_offset=-1, keywords=("view", "error")),
]


@query("j10_day_time_join", """
SELECT asset_id, CASE WHEN o = 2 AND s BETWEEN 21600 AND 43140 THEN 'morning' WHEN o = 2 AND s BETWEEN 39600 AND 54000 THEN 'noon'
  WHEN o = 4 AND (s >= 77400 OR s <= 11700) THEN 'night' WHEN o = 7 AND s <= 86340 THEN 'whole'
  WHEN contains(category, 'click') THEN 'clicks' WHEN contains(category, 'view') OR contains(category, 'error') THEN 'rest' ELSE 'clicks' END AS slot
FROM (SELECT *, date_diff('day', DATE '2024-01-01', day) AS o, epoch_us(taken_at) % 86400000000 / 1e6 AS s FROM evt)""", uses=("evt",))
def j10(spark, d):
    return a.assets_evt(spark, d).select("asset_id", j.day_time_match("taken_at", "category", WINDOWS, "2024-01-01").alias("slot"))


MONTHS = [
    Category("low", month_from=1, month_to=12, keywords=("5-low",)), Category("q1", month_from=1, month_to=3),
    Category("summer", month_from=6, month_to=8), Category("june", month_from=6, month_to=6),
    Category("any", month_from=1, month_to=12),
]


@query("j11_month_join", """
SELECT asset_id, CASE WHEN year(date) = 1997 THEN CASE WHEN contains(lower(category), '5-low') THEN 'low' WHEN month(date) BETWEEN 1 AND 3 THEN 'q1'
  WHEN month(date) BETWEEN 6 AND 8 THEN 'summer' ELSE 'any' END END AS part FROM dated""", uses=("dated",))
def j11(spark, d):
    return a.assets_dated(spark, d).select("asset_id", j.month_match("date", "category", MONTHS, 1997).alias("part"))


@query("j12_keyword_match", _WORD_HITS + f"""
SELECT asset_id, {_WORD_BEST} AS matched, coalesce({_WORD_BEST}, 'w_tion') AS thematic FROM hits""", uses=("assets",))
def j12(spark, d):
    return a.assets_doc(spark, d).select(
        "asset_id", j.keyword_match("text", WORDS).alias("matched"), j.thematic_match("text", WORDS).alias("thematic")
    )


@query("j13_nearest_place", """
SELECT asset_id, concat(name, ', ', CASE WHEN cc = 'NA' THEN 'XX' ELSE cc END) AS location FROM (
  SELECT p.asset_id, g.name, g.cc, row_number() OVER (PARTITION BY p.asset_id ORDER BY round(
    pow(cos(radians(p.lat)) * cos(radians(p.lon)) - cos(radians(g.lat)) * cos(radians(g.lon)), 2) +
    pow(cos(radians(p.lat)) * sin(radians(p.lon)) - cos(radians(g.lat)) * sin(radians(g.lon)), 2) +
    pow(sin(radians(p.lat)) - sin(radians(g.lat)), 2), 14), g.place_id) AS n FROM points p CROSS JOIN places g) WHERE n = 1
UNION ALL SELECT -1, NULL""", uses=("points", "places"))
def j13(spark, d):
    points = a.geo_points(spark, d)
    nowhere = points.agg((F.count("*") * 0 - 1).alias("asset_id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    named = j.nearest_place(points.unionByName(nowhere), a.gazetteer(spark, d), {"NA": "XX"})
    return named.select("asset_id", "location")


@query("j14_dictionary_lookup", """
SELECT asset_id, CASE WHEN contains(path, '/en/') THEN 'english' WHEN contains(path, 'src1') THEN 'one' WHEN contains(path, '/de/') THEN 'german' END AS place,
  CASE WHEN contains(source_label, 'src2') THEN 20 WHEN contains(source_label, 'c3') THEN 30 WHEN contains(category, 'en') THEN 5
    WHEN contains(category, 'fr') THEN 7 END AS age_days FROM assets""", uses=("assets",))
def j14(spark, d):
    places = {"/en/": "english", "src1": "one", "/de/": "german"}
    ages = {"en": 5, "src2": 20, "c3": 30, "fr": 7, "de": None}
    return a.assets_doc(spark, d).select(
        "asset_id", j.dictionary_lookup("path", places).alias("place"),
        j.dictionary_lookup("path", ages, per_part=True).alias("age_days"),
    )


# one step per request, each on the outcome of the one before
_J15_STEPS = [
    ("asset_id % 5 = 0", {"preference": "NULL"}),
    ("asset_id % 6 = 0", {"category": "'moved'", "status": "'pool'", "reject_reason": "'manual_reject'", "preference": "'like'"}),
    ("asset_id % 4 = 0", {"trash": "TRUE"}),
    ("asset_id % 3 = 0", {"status": "'selected'"}),
    ("asset_id % 7 = 0", {"status": "'pool'", "reject_reason": "coalesce(reject_reason, 'manual_reject')"}),
    ("asset_id % 10 = 0", {"category": "'other'", "status": "'qualified'", "reject_reason": "NULL"}),
    ("asset_id % 8 = 0", {"trash": "CASE WHEN trash THEN FALSE ELSE trash END"}),
    ("asset_id % 14 = 0", {"status": "'pool'", "reject_reason": "coalesce(reject_reason, 'manual_reject')"}),
    ("asset_id % 9 = 0", {"status": "'selected'"}),
]
_J15_FIELDS = ["category", "status", "reject_reason", "preference", "trash"]


def _j15_sql() -> str:
    steps = ["s0 AS (SELECT asset_id, category, status, reject_reason, preference, trash, FALSE AS changed FROM assets)"]
    for i, (test, sets) in enumerate(_J15_STEPS):
        fields = ", ".join(f"CASE WHEN {test} THEN {sets[f]} ELSE {f} END AS {f}" if f in sets else f for f in _J15_FIELDS)
        steps.append(f"s{i + 1} AS (SELECT asset_id, {fields}, changed OR {test} AS changed FROM s{i})")
    return ", " + ",\n".join(steps) + f"\nSELECT * FROM s{len(_J15_STEPS)}"


@query("j15_apply_changes", _j15_sql(), uses=("assets",))
def j15(spark, d):
    df = a.assets_doc(spark, d)
    names = {"action": "string", "to_category": "string", "new_status": "string", "preference": "string",
             "clear_preference": "boolean", "trash": "boolean"}

    def change(every, ts, **fields):
        return df.filter(F.col("asset_id") % every == 0).select(
            "asset_id", F.lit(ts).alias("ts"), *[F.lit(fields.get(k)).cast(t).alias(k) for k, t in names.items()])

    changes = (
        change(5, 1, clear_preference=True)
        .unionByName(change(6, 2, action="move", to_category="moved", new_status="pool", preference="like"))
        .unionByName(change(4, 3, trash=True))
        .unionByName(change(3, 4, action="select", new_status="selected"))
        .unionByName(change(7, 5, action="save", new_status="pool"))
        .unionByName(change(10, 6, action="move", to_category="other", new_status="qualified"))
        .unionByName(change(8, 7, trash=False))
        .unionByName(change(14, 8, action="save", new_status="pool"))
        .unionByName(change(9, 9, action="select", new_status="selected"))
    )
    return j.apply_changes(df, changes, "asset_id").select(
        "asset_id", "category", "status", "reject_reason", "preference", "trash", "changed"
    )


@query("j15_reset_selected", """
SELECT CASE WHEN status = 'selected' THEN 'qualified' ELSE status END AS status, count(*) AS n FROM assets GROUP BY 1""", uses=("assets",))
def j15b(spark, d):
    return j.reset_selected(a.assets_doc(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("j16_fill_missing", """
SELECT asset_id, coalesce(blur_score, CASE WHEN asset_id % 2 = 0 THEN -1e0 END) AS blur_score FROM assets""", uses=("assets",))
def j16(spark, d):
    df = a.assets_doc(spark, d).select("asset_id", "blur_score")
    results = df.filter(F.col("asset_id") % 2 == 0).withColumn("blur_score", F.lit(-1.0))
    return j.fill_missing(df, results, "blur_score", "asset_id")


@query("j17_vector_coverage", """
SELECT count(*) FILTER (asset_id IS NOT NULL) AS total_entries, count(*) FILTER (asset_id IS NOT NULL AND vec_id IS NOT NULL) AS covered,
  count(*) FILTER (vec_id IS NULL AND media_type <> 'video') AS missing_images, count(*) FILTER (vec_id IS NULL AND media_type = 'video') AS missing_videos,
  count(*) FILTER (asset_id IS NULL) AS orphan_vectors, count(*) FILTER (vec_id IS NULL) = 0 AS consistent
FROM assets FULL JOIN vectors ON asset_id = vec_id""", uses=("assets", "vectors"))
def j17(spark, d):
    assets = a.assets_doc(spark, d).select(F.col("asset_id").alias("hash"), "media_type")
    return j.vector_coverage(assets, a.vectors(spark, d).select(F.col("vec_id").alias("hash")))


@query("j19_burst_pairs", """
SELECT a.folder, 'IMG_' AS prefix, a.asset_id AS a_id, b.asset_id AS b_id, b.asset_id - a.asset_id AS distance
FROM names a JOIN names b ON a.folder = b.folder AND b.asset_id > a.asset_id AND b.asset_id - a.asset_id <= 3""", uses=("names",))
def j19(spark, d):
    from ..functions.names import burst_key

    path = F.concat(F.lit("/lib/"), "folder", F.lit("/IMG_"), F.lpad(F.col("asset_id").cast("string"), 9, "0"), F.lit(".jpg"))
    df = a.asset_names(spark, d).withColumn("b", burst_key(path))
    df = df.select("asset_id", "folder", F.col("b.prefix").alias("prefix"), F.col("b.seq").alias("seq"))
    return j.burst_pairs(df, ["folder", "prefix"], "seq", "asset_id", 3)
