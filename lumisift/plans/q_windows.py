"""Windows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Category
from ..operators import windows as w
from ..operators.ranges import ranked
from . import adapters as a
from .q_aggregates import EVENTS
from .q_sources import LANGS
from .registry import query


@query("w1_dedup_exact", """
SELECT asset_id, hash, duplicates FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source_ord, path) AS n, count(*) OVER (PARTITION BY hash) - 1 AS duplicates FROM assets) WHERE n = 1""", uses=("assets",))
def w1(spark, d):
    df = a.assets_doc(spark, d).select("asset_id", "hash", "source_ord", "path")
    return w.dedup_exact(df).select("asset_id", "hash", "duplicates")


@query("w2_top_k", """
SELECT 'group' AS part, category, asset_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY composite DESC, value DESC, asset_id) AS rank FROM evt) WHERE rank <= 25
UNION ALL SELECT 'best', category, asset_id, rank FROM (SELECT *, row_number() OVER (ORDER BY composite DESC, value DESC, asset_id) AS rank FROM evt) WHERE rank <= 40
UNION ALL SELECT 'worst', category, asset_id, rank FROM (SELECT *, row_number() OVER (ORDER BY composite, value, asset_id) AS rank FROM evt) WHERE rank <= 40""", uses=("evt",))
def w2(spark, d):
    df = a.assets_evt(spark, d).select("asset_id", "category", "composite", "value")
    down = [F.col("composite").desc(), F.col("value").desc(), F.col("asset_id").asc()]
    up = [F.col("composite").asc(), F.col("value").asc(), F.col("asset_id").asc()]
    group = w.top_k_per_group(df, ["category"], down, 25).select(F.lit("group").alias("part"), "category", "asset_id", "rank")
    best = ranked(w.top_n(df, down, 40), [], down).select(F.lit("best").alias("part"), "category", "asset_id", "rank")
    worst = ranked(w.top_n(df, up, 40), [], up).select(F.lit("worst").alias("part"), "category", "asset_id", "rank")
    return group.unionByName(best).unionByName(worst)


@query("w3_weighted_pick", """
SELECT category, asset_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, asset_id) AS rank FROM (
  SELECT category, asset_id, CASE WHEN has_target_face THEN 20e0 WHEN face_count > 0 THEN 10e0 ELSE 0e0 END + coalesce(composite, 0) * 10e0
  + greatest(0, (0.6e0 - coalesce(nullif(face_distance, 0), 0.6e0)) * 20e0) + CASE preference WHEN 'like' THEN 8e0 WHEN 'dislike' THEN -6e0 ELSE 0e0 END AS score FROM assets))
WHERE rank <= 75""", uses=("assets",))
def w3(spark, d):
    df = a.assets_doc(spark, d).withColumn("score", w.pick_score())
    best = w.top_k_per_group(df, ["category"], [F.col("score").desc(), F.col("asset_id").asc()], 75)
    return best.select("category", "asset_id", F.round("score", 6).alias("score"), "rank")


@query("w4_pick_representative", """
, p AS (SELECT *, first_value(vec_id) OVER (PARTITION BY cluster ORDER BY quality DESC, vec_id) AS rep, count(*) OVER (PARTITION BY cluster) AS n
  FROM (SELECT vec_id, quality, coalesce(planted_from, vec_id) AS cluster FROM vectors))
SELECT vec_id, concat('c_', substr(CAST(rep AS STRING), 1, 12)) AS cluster_id, vec_id = rep AS is_representative, CASE WHEN vec_id <> rep THEN rep END AS suppressed_by,
  CASE WHEN vec_id = rep THEN n END AS cluster_size FROM p""", uses=("vectors",))
def w4(spark, d):
    members = a.vectors(spark, d).select(
        "vec_id", F.col("quality").alias("composite"), F.lit(0).alias("size_kb"), F.coalesce("planted_from", "vec_id").alias("cluster")
    )
    return w.pick_representative(members, "cluster", "vec_id").drop("composite", "size_kb")


_W5_TARGETS = {"click": 60, "view": 6000, "purchase": 200, "error": 100, "signup": 90}


@query("w5_round_robin", """
, t AS (SELECT *, CASE WHEN asset_id % 10 > 0 THEN day END AS bucket, CASE category WHEN 'click' THEN 60 WHEN 'view' THEN 6000 WHEN 'purchase' THEN 200 WHEN 'error' THEN 100 ELSE 90 END AS target FROM evt),
m AS (SELECT *, count(*) OVER c > 2 * target AND count(bucket) OVER c > target AS mix, row_number() OVER (PARTITION BY category, bucket ORDER BY value DESC, asset_id) AS turn FROM t WINDOW c AS (PARTITION BY category))
SELECT category, asset_id, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN mix AND bucket IS NULL THEN 1 ELSE 0 END, CASE WHEN mix AND bucket IS NOT NULL THEN turn END,
  CASE WHEN mix THEN bucket END, value DESC, asset_id) AS pick_order FROM m""", uses=("evt",))
def w5(spark, d):
    df = a.assets_evt(spark, d).select("asset_id", "category", "day", "value")
    bucket = F.when(F.col("asset_id") % 10 > 0, F.col("day"))
    return w.round_robin(df, bucket, "value", _W5_TARGETS, 90, key="asset_id").select("category", "asset_id", "pick_order")


@query("w6_burst_sessions", """
, f AS (SELECT asset_id, category AS folder, concat('IMG_', strftime(taken_at, '%Y%m%d_%H%M%S'), '_', lpad(CAST(asset_id AS STRING), 9, '0'), '.jpg') AS name, CAST(floor(epoch_us(taken_at) / 1e6) AS BIGINT) AS s, day, CAST(width AS BIGINT) * height * size_kb AS weight FROM evt),
j AS (SELECT *, CASE WHEN lag(day) OVER o = day AND s - lag(s) OVER o <= 300 THEN 0 ELSE 1 END AS fresh FROM f WINDOW o AS (PARTITION BY folder ORDER BY name)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY name) AS grp FROM j)
SELECT folder, max_by(name, (weight, name)) AS keep, count(*) AS burst_size FROM r GROUP BY folder, grp HAVING count(*) >= 2""", uses=("evt",))
def w6(spark, d):
    df = a.assets_evt(spark, d)
    name = F.concat(
        F.lit("IMG_"), F.date_format("taken_at", "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(F.col("asset_id").cast("string"), 9, "0"), F.lit(".jpg")
    )
    df = df.select(F.col("category").alias("folder"), name.alias("name"), (F.col("width").cast("long") * F.col("height") * F.col("size_kb")).alias("weight"))
    groups = w.burst_sessions(df, "folder", "name", max_seconds=300)
    best = w.keep_best_of_bursts(groups.withColumn("burst", F.struct("folder", "burst_id")), F.col("weight"), "name", "burst")
    return best.select("burst.folder", "keep", "burst_size")


@query("w7_evenly_spaced", """
, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date, asset_id) - 1 AS pos, count(*) OVER (PARTITION BY category) AS total FROM dated)
SELECT category, asset_id, i AS slot FROM r JOIN range(0, 30) t(i) ON pos = CAST(floor(i * (total / 30)) AS BIGINT)""", uses=("dated",))
def w7(spark, d):
    df = a.assets_dated(spark, d).select("asset_id", "category", "date")
    return w.evenly_spaced(df, ["category"], ["date", "asset_id"], 30).select("category", "asset_id", "slot")


@query("w9_fill_remaining", """
, sel AS (SELECT category, count(*) AS have FROM evt WHERE status = 'selected' GROUP BY category),
tgt AS (SELECT * FROM (VALUES ('click', 500), ('view', 5000), ('purchase', 1300), ('error', 1400), ('nothing', 10), ('signup', 2000)) t(category, target))
SELECT category, asset_id, rank FROM (SELECT e.*, row_number() OVER (PARTITION BY e.category ORDER BY value DESC, asset_id) AS rank FROM evt e WHERE status = 'qualified') e
JOIN tgt USING (category) LEFT JOIN sel USING (category) WHERE rank <= greatest(0, target - coalesce(have, 0))""", uses=("evt",))
def w9(spark, d):
    df = a.assets_evt(spark, d)
    filled = w.fill_remaining(
        df.filter(F.col("status") == "qualified"), df.filter(F.col("status") == "selected"), EVENTS,
        [F.col("value").desc(), F.col("asset_id").asc()],
    )
    return filled.select("category", "asset_id", "rank")


@query("w10_sort_modes", """
SELECT asset_id, row_number() OVER (ORDER BY date NULLS FIRST, asset_id) AS by_date, row_number() OVER (ORDER BY coalesce(composite, 0) DESC, asset_id) AS by_grade,
  row_number() OVER (ORDER BY coalesce(composite, 0), asset_id) AS by_grade_asc, row_number() OVER (ORDER BY CASE preference WHEN 'like' THEN 0 WHEN 'dislike' THEN 2 ELSE 1 END, asset_id) AS by_preference,
  row_number() OVER (ORDER BY CASE preference WHEN 'like' THEN 2 WHEN 'dislike' THEN -2 ELSE 0 END DESC, size_kb DESC, asset_id) AS by_predicted FROM assets""", uses=("assets",))
def w10(spark, d):
    df = a.assets_doc(spark, d).select("asset_id", "date", "composite", "preference", "size_kb")
    out = df
    modes = {"by_date": "date", "by_grade": "grade_desc", "by_grade_asc": "grade_asc", "by_preference": "preference", "by_predicted": "predicted"}
    for name, mode in modes.items():
        out = ranked(out, [], [*w.sort_keys(mode, F.col("size_kb")), F.col("asset_id").asc()], name)
    return out.select("asset_id", *modes)


@query("w11_substitutes", """
, sel AS (SELECT category, count(*) AS have FROM assets WHERE status = 'selected' GROUP BY category)
SELECT category, asset_id, rank, target - coalesce(have, 0) AS gap FROM (
  SELECT category, asset_id, row_number() OVER (PARTITION BY category ORDER BY coalesce(composite, 0) DESC, asset_id) AS rank FROM assets WHERE status IN ('qualified', 'pool') AND has_target_face)
JOIN (VALUES ('en', 60), ('de', 40), ('fr', 20)) t(category, target) USING (category) LEFT JOIN sel USING (category) WHERE rank <= 15 AND target - coalesce(have, 0) > 0""", uses=("assets",))
def w11(spark, d):
    return w.substitutes(a.assets_doc(spark, d), LANGS, 15).select("category", "asset_id", "rank", "gap")


@query("w12_frame_positions", """
SELECT doc_id, array_to_string(list_slice(range(a, b, greatest(1, (b - a) // 6)), 1, 6), ',') AS frames
FROM (SELECT doc_id, greatest(1, CAST(floor(n_chars * 0.05e0) AS BIGINT)) AS a, greatest(greatest(1, CAST(floor(n_chars * 0.05e0) AS BIGINT)) + 1, CAST(floor(n_chars * 0.95e0) AS BIGINT)) AS b FROM documents)""")
def w12(spark, d):
    docs = a.table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(w.frame_positions("n_chars", 6), ",").alias("frames"))


@query("w13_page", "SELECT asset_id FROM dated ORDER BY date, asset_id LIMIT 50 OFFSET 100", uses=("dated",))
def w13(spark, d):
    return a.assets_dated(spark, d).orderBy("date", "asset_id").offset(100).limit(50).select("asset_id")
