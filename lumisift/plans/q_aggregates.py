"""Reports (G1-G25) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Category
from ..functions.numbers import half_even
from ..operators import aggregates as g
from ..operators.filters import quality_gate
from ..operators.grading import raw_quality
from ..operators.quantiles import upper_median
from ..operators.windows import dedup_exact, top_k_per_group
from . import adapters as a
from .q_sources import LANGS
from .registry import query

EVENTS = [
    Category("click", "Clicks", 500), Category("view", "Views", 5000), Category("purchase", "Purchases", 1300),
    Category("error", "Errors", 1400), Category("nothing", "Nothing", 10), Category("signup", "Sign-ups", 2000),
]
_EVENTS = "(VALUES (0,'click','Clicks',500),(1,'view','Views',5000),(2,'purchase','Purchases',1300),(3,'error','Errors',1400),(4,'nothing','Nothing',10),(5,'signup','Sign-ups',2000)) AS c(ord, id, display, target)"
_LANGS = "(VALUES (0,'en','English',60),(1,'de','German',40),(2,'fr','French',20)) AS c(ord, id, display, target)"
_BAND = """CASE WHEN count = 0 THEN 'empty' WHEN count / target < 0.3 THEN 'critical' WHEN count / target < 0.7 THEN 'low'
  WHEN count / target < 1 THEN 'close' WHEN count / target > 3 THEN 'overflow' ELSE 'ok' END"""


@query("flagship_best_per_category", """
, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source_ord, path) AS n FROM assets) WHERE n = 1),
good AS (SELECT *, CAST(width AS DOUBLE) * height * size_kb AS quality FROM kept
  WHERE media_type = 'video' OR NOT (size_kb < 80 OR (width < 600 AND height < 600))),
totals AS (SELECT category, count(*) AS count FROM good GROUP BY category)
SELECT b.category, b.asset_id, b.quality, b.rank, t.count AS available, CASE WHEN t.count / 300 < 0.3 THEN 'critical' WHEN t.count / 300 < 0.7 THEN 'low'
  WHEN t.count / 300 < 1 THEN 'close' WHEN t.count / 300 > 3 THEN 'overflow' ELSE 'ok' END AS band
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY quality DESC, asset_id) AS rank FROM good) b
JOIN totals t USING (category) WHERE rank <= 20""", uses=("assets",))
def flagship(spark, d):
    df = a.assets_doc(spark, d).select("asset_id", "hash", "path", "source_ord", "category", "width", "height", "size_kb", "media_type")
    kept = dedup_exact(df).filter(quality_gate().isNull())
    sized = kept.withColumn("size_bytes", F.col("size_kb") * 1024).withColumn("quality", raw_quality("pixels_kb"))
    best = top_k_per_group(sized, ["category"], [F.col("quality").desc(), F.col("asset_id").asc()], 20)
    totals = sized.groupBy("category").agg(F.count("*").alias("available"))
    return best.join(totals, "category").select(
        "category", "asset_id", "quality", "rank", "available",
        g.coverage_band(F.col("available"), F.lit(300)).alias("band"),
    )


@query("g1_scan_summary", f"""
SELECT 'status' AS section, NULL::INT AS ord, status AS name, count(*) AS n FROM assets GROUP BY status
UNION ALL SELECT 'category', ord, id, count(asset_id) FROM {_LANGS} LEFT JOIN assets ON category = id AND status = 'qualified' GROUP BY ord, id""", uses=("assets",))
def g1(spark, d):
    return g.scan_summary(a.assets_doc(spark, d), LANGS)


_G2 = f"""
, per AS (SELECT ord, id, display, target, count(asset_id) FILTER (status = 'qualified') AS count, count(asset_id) FILTER (status <> 'qualified') AS pool_available
  FROM {_EVENTS} LEFT JOIN evt ON category = id GROUP BY ALL),
bands AS (SELECT *, count / target AS ratio, {_BAND} AS band, greatest(0, count - target) AS surplus, greatest(0, target - count) AS deficit FROM per)
"""


@query("g2_analyze_categories", _G2 + "SELECT ord, id, display, count, target, round(ratio, 6) AS ratio, band, pool_available, surplus, deficit FROM bands", uses=("evt",))
def g2(spark, d):
    return g.analyze_categories(a.assets_evt(spark, d), EVENTS).withColumn("ratio", F.round("ratio", 6))


@query("g3_analyze_totals", """
SELECT count(*) AS total_images, count(*) FILTER (q) AS total_qualified, count(*) FILTER (NOT q) AS total_pool, 120 AS total_target,
  count(*) FILTER (has_target_face) AS with_target, count(*) FILTER (NOT has_target_face AND face_count > 0) AS with_any,
  count(*) FILTER (NOT has_target_face AND face_count = 0) AS no_face, count(DISTINCT source_label) AS sources
FROM (SELECT *, status = 'qualified' AND category IN ('en', 'de', 'fr') AS q FROM assets)""", uses=("assets",))
def g3(spark, d):
    return g.analyze_totals(a.assets_doc(spark, d), LANGS)


@query("g3_source_counts", "SELECT source_label, count(*) AS n FROM assets GROUP BY source_label", uses=("assets",))
def g3b(spark, d):
    return g.source_counts(a.assets_doc(spark, d))


# Texts of the recommendations.
@query("g4_recommendations", _G2 + """
, tot AS (SELECT count(*) AS total, count(*) FILTER (status = 'qualified' AND category IN (SELECT id FROM per)) AS q, count(*) FILTER (face_count = 0) AS no_face FROM evt)
SELECT 'info' AS type, 'Very large pool to choose from' AS title, printf('You have %d qualified images. Use auto-select to pick the best %d with diversity.', q, 10210) AS detail FROM tot WHERE q > 2000
UNION ALL SELECT 'warning', 'Collection too small', printf('You have %d qualified images but party typically needs 300-1000. Add more sources or relax filters.', q) FROM tot WHERE q < 300
UNION ALL SELECT 'critical', printf('%d empty categories', count(*)), printf('No images in: %s. Check if your sources cover these periods, or manually assign from pool.', string_agg(display, ', ' ORDER BY ord)) FROM bands WHERE band = 'empty' HAVING count(*) > 0
UNION ALL SELECT 'warning', printf('''%s'' critically low', display), printf('Only %d/%d images. %d pool candidates available.', count, target, pool_available) FROM bands WHERE band = 'critical'
UNION ALL SELECT 'info', printf('''%s'' has excess images', display), printf('%d images vs target %d (%d surplus). Auto-select will pick the best %d.', count, target, surplus, target) FROM bands WHERE band = 'overflow'
UNION ALL SELECT 'tip', 'Faces Matter', 'Every image should include somebody.'
UNION ALL SELECT 'warning', 'Single source', 'All images from one source. Adding more sources (cloud, USB, shared albums) improves coverage and variety.'
UNION ALL SELECT 'info', 'Many images without detected faces', printf('%d/%d images have no faces. Consider enabling face detection to prioritize people shots.', no_face, total) FROM tot WHERE no_face > q * 0.5""", uses=("evt",))
def g4(spark, d):
    df = a.assets_evt(spark, d).withColumns({"has_target_face": F.lit(False), "source_label": F.lit("events")})
    per, totals = g.analyze_categories(df, EVENTS), g.analyze_totals(df, EVENTS)
    return g.recommendations(per, totals, (300, 1000), "party", {"faces_matter": "Every image should include somebody."})


@query("g5_dashboard_stats", """
SELECT count(*) AS total_media, count(*) FILTER (media_type <> 'video') AS total_images, count(*) FILTER (media_type = 'video') AS total_videos,
  count(*) FILTER (status = 'qualified') AS qualified, count(*) FILTER (status = 'selected') AS selected,
  count(*) FILTER (status = 'selected' AND media_type = 'video') AS selected_videos, count(*) FILTER (status = 'pool') AS pool,
  count(*) FILTER (reject_reason = 'blurry') AS rejected_blurry, round_even(avg(composite) * 10, 0) / 10 AS grade_avg,
  count(*) FILTER (composite >= 70) AS grade_high, count(*) FILTER (composite >= 40 AND composite < 70) AS grade_medium,
  count(*) FILTER (composite < 40) AS grade_low, count(DISTINCT source_label) AS sources FROM assets""", uses=("assets",))
def g5(spark, d):
    return g.dashboard_stats(a.assets_doc(spark, d))


@query("g6_category_summary", f"""
SELECT ord, id, display, target, count(asset_id) AS total, count(asset_id) FILTER (status = 'selected') AS selected,
  count(asset_id) FILTER (status = 'qualified') AS qualified FROM {_LANGS} LEFT JOIN assets ON category = id GROUP BY ALL""", uses=("assets",))
def g6(spark, d):
    return g.category_summary(a.assets_doc(spark, d), LANGS)


@query("g7_location_summary", "SELECT location, count(*) AS n FROM assets WHERE location IS NOT NULL GROUP BY location", uses=("assets",))
def g7(spark, d):
    return g.location_summary(a.assets_doc(spark, d))


@query("g8_preference_summary", """
SELECT count(*) FILTER (preference = 'like') AS liked, count(*) FILTER (preference = 'dislike') AS disliked,
  count(*) FILTER (preference IS NULL) AS unrated, count(*) AS total FROM assets""", uses=("assets",))
def g8(spark, d):
    return g.preference_summary(a.assets_doc(spark, d))


@query("g8_rated_rows", """
SELECT hash, preference, category, face_count, has_target_face, size_kb, width, height, 'iphone' AS device, source_label FROM assets WHERE preference IS NOT NULL""", uses=("assets",))
def g8b(spark, d):
    return g.rated_rows(a.assets_doc(spark, d).withColumn("device", F.lit("iphone")))


@query("g9_trash_summary", "SELECT count(*) AS n, round_even(coalesce(sum(size_kb), 0) / 1024e0 * 10, 0) / 10 AS mb FROM assets WHERE trash", uses=("assets",))
def g9(spark, d):
    return g.trash_summary(a.assets_doc(spark, d))


@query("g10_grade_summary", """
SELECT count(composite) AS n, min(composite) AS min, max(composite) AS max, round(avg(composite), 6) AS avg, count(*) FILTER (composite < 20) AS band_very_low,
  count(*) FILTER (composite >= 20 AND composite < 40) AS band_low, count(*) FILTER (composite >= 40 AND composite < 60) AS band_medium,
  count(*) FILTER (composite >= 60 AND composite < 80) AS band_good, count(*) FILTER (composite >= 80) AS band_excellent,
  list_sort(list(composite))[CAST(count(*) // 2 AS INT) + 1] AS median FROM evt""", uses=("evt",))
def g10(spark, d):
    return g.grade_summary(a.assets_evt(spark, d), "composite").withColumn("avg", F.round("avg", 6))


@query("g10_grade_by_group", "SELECT category, count(*) AS n, round(avg(composite), 6) AS avg, min(composite) AS min, list_sort(list(composite))[CAST(count(*) // 2 AS INT) + 1] AS median FROM evt GROUP BY category", uses=("evt",))
def g10b(spark, d):
    df = a.assets_evt(spark, d)
    per = g.grade_by_group(df, "category", "composite").withColumn("avg", F.round("avg", 6))
    return per.join(upper_median(df, ["category"], "composite"), "category")


@query("g11_recognition_summary", """
SELECT person, count(*) FILTER (score > 25) AS matched, round(avg(score), 6) AS avg_score FROM (
  SELECT 'ann' AS person, k * 1e0 AS score FROM evt UNION ALL SELECT concat('p', CAST(asset_id % 4 AS STRING)), composite FROM evt) GROUP BY person""", uses=("evt",))
def g11(spark, d):
    other = F.concat(F.lit("p"), (F.col("asset_id") % 4).cast("string"))
    df = a.assets_evt(spark, d).select(F.create_map(F.lit("ann"), F.col("k") * 1.0, other, F.col("composite")).alias("recognition"))
    return g.recognition_summary(df).withColumn("avg_score", F.round("avg_score", 6))


@query("g12_before_after", """
, s AS (SELECT category, count(*) FILTER (status <> 'pool') AS before, count(*) FILTER (status = 'rejected') AS removed, count(*) FILTER (status = 'pool' AND has_target_face) AS added FROM assets GROUP BY category)
SELECT category, before, removed, added, before - removed + added AS final, CASE WHEN before - removed + added < 150 THEN 'LOW' ELSE 'OK' END AS mark FROM s
UNION ALL SELECT 'TOTAL', sum(before), sum(removed), sum(added), sum(before - removed + added), NULL FROM s""", uses=("assets",))
def g12(spark, d):
    df = a.assets_doc(spark, d)
    return g.before_after(
        df.filter(F.col("status") != "pool"), df.filter(F.col("status") == "rejected"),
        df.filter((F.col("status") == "pool") & F.col("has_target_face")), 150,
    )


@query("g13_coverage_deficit", f"""
SELECT ord, id, count(asset_id) AS count, greatest(0, 2000 - count(asset_id)) AS needed, CASE WHEN count(asset_id) = 0 THEN 'MISSING' WHEN count(asset_id) < 1500 THEN 'LOW' ELSE 'OK' END AS mark
FROM {_EVENTS} LEFT JOIN evt ON category = id GROUP BY ALL""", uses=("evt",))
def g13(spark, d):
    return g.coverage_deficit(a.assets_evt(spark, d), EVENTS, 2000, 1500)


@query("g14_video_rollup", """
, f AS (SELECT owner AS hash, row_number() OVER (PARTITION BY owner ORDER BY taken_at, asset_id) AS frame_no, value AS sharpness, face_count, face_distance,
  composite AS grade, category FROM evt)
SELECT hash, max(face_count) AS face_count, string_agg(DISTINCT category, ',' ORDER BY category) FILTER (face_count > 0) AS faces_found, min(face_distance) AS face_distance,
  max_by(frame_no, (sharpness, -frame_no)) AS best_frame, max_by(grade, (sharpness, -frame_no)) AS grade, max(sharpness) AS sharpness, count(*) AS n_frames
FROM f GROUP BY hash""", uses=("evt",))
def g14(spark, d):
    from ..operators.ranges import ranked

    df = ranked(a.assets_evt(spark, d), ["owner"], ["taken_at", "asset_id"], "frame_no")
    persons = F.when(F.col("face_count") > 0, F.array("category")).otherwise(F.array().cast("array<string>"))
    frames = df.select(
        F.col("owner").alias("hash"), "frame_no", F.col("value").alias("sharpness"), "face_count", "face_distance",
        F.col("composite").alias("grade"), persons.alias("persons"),
    )
    return g.video_rollup(frames).withColumn("faces_found", F.nullif(F.array_join("faces_found", ","), F.lit("")))


@query("g15_centroid", """
, m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY label, i)
SELECT label, i - 1 AS pos, n, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""", uses=("vectors",))
def g15(spark, d):
    mid = g.centroid(a.vectors(spark, d), ["label"])
    return mid.select("label", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("g16_reference_diversity", """
, refs AS (SELECT label * 10 + length(CAST(vec_id AS VARCHAR)) AS person, vec_id, CAST(v AS DOUBLE[]) AS v FROM raw),
dist AS (SELECT a.person, avg(list_distance(a.v, b.v)) AS mean_dist, min(list_distance(a.v, b.v)) AS min_dist, max(list_distance(a.v, b.v)) AS max_dist
  FROM refs a JOIN refs b ON a.person = b.person AND a.vec_id < b.vec_id GROUP BY a.person)
SELECT person, count(*) AS encodings, round(any_value(mean_dist), 6) AS mean_dist, round(any_value(min_dist), 6) AS min_dist, round(any_value(max_dist), 6) AS max_dist,
  CASE WHEN count(*) >= 3 THEN 1e0 ELSE 0e0 END AS diversity_score, CASE WHEN count(*) >= 3 THEN 1e0 ELSE 0.3e0 END AS saved_score,
  CASE WHEN count(*) < 3 THEN printf('Only %d encoding(s). Need at least 3-5 for reliable recognition', count(*)) ELSE '' END AS issues,
  CASE WHEN count(*) < 3 THEN 'Add more photos with clear, front-facing views' WHEN count(*) < 5 THEN concat(printf('You have %d good encodings. 5-10 is ideal for multi-age recognition', count(*)), '; For best results across ages: include baby, toddler, child, and recent photos')
    ELSE 'For best results across ages: include baby, toddler, child, and recent photos' END AS tips, count(*) >= 3 AS ready
FROM refs LEFT JOIN dist USING (person) GROUP BY person""", uses=("raw",))
def g16(spark, d):
    # the digits of the id give groups of every size, from one encoding on
    person = F.col("label") * 10 + F.length(F.col("vec_id").cast("string"))
    refs = a.raw_vectors(spark, d).select(person.alias("person"), F.col("vec_id").alias("photo"), F.col("v").alias("enc"))
    out = g.reference_diversity(refs)
    rounded = {c: F.round(c, 6) for c in ("mean_dist", "min_dist", "max_dist")}
    return out.withColumns(rounded).withColumns({"issues": F.array_join("issues", "; "), "tips": F.array_join("tips", "; ")})


@query("g17_source_mix", """
SELECT category, source_label AS device, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY category), 6) AS share FROM assets GROUP BY category, source_label""", uses=("assets",))
def g17(spark, d):
    return g.source_mix(a.assets_doc(spark, d), device="source_label").withColumnRenamed("source_label", "device").withColumn("share", F.round("share", 6))


@query("g18_histograms", """
SELECT 'person' AS part, person AS name, count(*) AS n FROM assets WHERE person IS NOT NULL GROUP BY person
UNION ALL SELECT 'origin', CASE WHEN asset_id % 3 = 0 THEN 'exif' ELSE 'filename' END, count(*) FROM assets GROUP BY 2
UNION ALL SELECT 'range', concat(CAST(min(date) AS STRING), '..', CAST(max(date) AS STRING)), count(date) FROM assets
UNION ALL SELECT 'age', CASE WHEN days < 30 THEN 'newborn' WHEN days // 30 < 12 THEN concat(CAST(days // 30 AS STRING), 'mo')
  WHEN (days % 365) // 30 > 0 THEN concat(CAST(days // 365 AS STRING), 'y', CAST((days % 365) // 30 AS STRING), 'm')
  ELSE concat(CAST(days // 365 AS STRING), 'y') END, count(*) FROM (SELECT date_diff('day', DATE '1995-01-01', date) AS days FROM dated) GROUP BY 2""", uses=("assets", "dated"))
def g18(spark, d):
    from ..functions.dates import age_days, age_label

    df = a.assets_doc(spark, d)
    persons = g.persons_histogram(df).select(F.lit("person").alias("part"), F.col("person").alias("name"), "n")
    origin = g.value_counts(df, F.when(F.col("asset_id") % 3 == 0, "exif").otherwise("filename"), "name")
    span = g.date_range(df).select(
        F.concat(F.col("first").cast("string"), F.lit(".."), F.col("last").cast("string")).alias("name"), F.col("dated").alias("n")
    )
    ages = g.value_counts(a.assets_dated(spark, d), age_label(age_days("date", "1995-01-01")), "name")
    out = persons
    for part, rows in (("origin", origin), ("range", span), ("age", ages)):
        out = out.unionByName(rows.withColumn("part", F.lit(part)))
    return out


@query("g19_adaptive_periods", """
, m AS (SELECT year(date) AS y, month(date) AS mo, count(*) AS n FROM dated GROUP BY ALL),
s AS (SELECT y, sum(n) + CASE WHEN y = 1996 THEN 3000 WHEN y = 1999 THEN 40 ELSE 0 END AS fy,
  greatest(sum(n) FILTER (mo <= 6), sum(n) FILTER (mo > 6)) + CASE WHEN y = 1996 THEN 1500 ELSE 0 END AS fh,
  greatest(sum(n) FILTER (mo <= 3), sum(n) FILTER (mo BETWEEN 4 AND 6), sum(n) FILTER (mo BETWEEN 7 AND 9), sum(n) FILTER (mo > 9)) + CASE WHEN y = 1996 THEN 750 ELSE 0 END AS fq FROM m GROUP BY y)
SELECT CASE WHEN fy <= 2280 THEN CAST(y AS STRING) WHEN fh <= 2280 THEN concat(CAST(y AS STRING), CASE WHEN mo <= 6 THEN '_H1' ELSE '_H2' END)
  WHEN fq <= 2280 THEN concat(CAST(y AS STRING), '_Q', CAST((mo + 2) // 3 AS STRING)) ELSE concat(CAST(y AS STRING), '_', lpad(CAST(mo AS STRING), 2, '0')) END AS period, sum(n) AS n
FROM m JOIN s USING (y) GROUP BY 1""", uses=("dated",))
def g19(spark, d):
    out = g.adaptive_periods(a.assets_dated(spark, d), cap=2280, existing_by_name={"1996": 3000, "1999_H1": 40})
    return out.groupBy("period").agg(F.count("*").alias("n"))


@query("g22_category_people", """
SELECT category, count(*) AS total, count(*) FILTER (has_target_face) AS with_target, count(*) FILTER (face_count > 0) AS with_faces FROM assets GROUP BY category""", uses=("assets",))
def g22(spark, d):
    return g.category_people_counts(a.assets_doc(spark, d))


@query("g24_reference_check", """
, b AS (SELECT label AS person, vec_id // 3 AS photo, vec_id % 3 AS face_no, vec_id, CASE WHEN vec_id % 4 > 0 THEN (vec_id * 7) % 40 + 1 END AS side, vec_id % 5 > 0 AS enc FROM raw)
SELECT person, photo, count(side) AS faces, CASE WHEN count(side) = 0 THEN 'no_face' WHEN NOT max_by(enc, (side * side, -face_no)) FILTER (side IS NOT NULL) THEN 'encode_fail'
  WHEN count(side) > 1 THEN 'ok_multi' ELSE 'ok' END AS state FROM b GROUP BY person, photo""", uses=("raw",))
def g24(spark, d):
    n = F.col("vec_id")
    side = F.when(n % 4 > 0, (n * 7) % 40 + 1)
    boxes = a.raw_vectors(spark, d).select(
        F.col("label").alias("person"), F.floor(n / 3).alias("photo"), (n % 3).alias("face_no"),
        (side * 0).alias("top"), side.alias("right"), side.alias("bottom"), (side * 0).alias("left"),
        F.when(n % 5 > 0, F.col("v")).alias("enc"),
    )
    return g.reference_check(boxes).select("person", "photo", "faces", "state")


@query("g25_resolve_categories", "SELECT category AS id, category AS display, 75 AS target, count(*) AS n FROM assets GROUP BY category", uses=("assets",))
def g25(spark, d):
    df = a.assets_doc(spark, d)
    counts = df.groupBy(F.col("category").alias("id")).agg(F.count("*").alias("n"))
    return g.infer_categories(df).join(counts, "id")
