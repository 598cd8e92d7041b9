"""Gates, status rules and list filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..operators import filters as f
from . import adapters as a
from .registry import query


@query("f1_quality_gate", """
SELECT asset_id, CASE WHEN media_type <> 'video' THEN CASE WHEN size_kb < 80 THEN 'too_small'
  WHEN width < 600 AND height < 600 THEN 'low_res' END END AS both_short,
  CASE WHEN media_type <> 'video' THEN CASE WHEN size_kb < 50 THEN 'too_small'
  WHEN width < 500 OR height < 500 THEN 'low_res' END END AS either_short,
  CASE WHEN media_type <> 'video' AND width < 800 AND height < 800 THEN 'low_res' END AS keep_large
FROM assets""", uses=("assets",))
def f1(spark, d):
    return a.assets_doc(spark, d).select(
        "asset_id", f.quality_gate().alias("both_short"), f.quality_gate(50, 500, "either").alias("either_short"),
        f.quality_gate(min_dim=800, mode="keep_large").alias("keep_large"),
    )


@query("f2_skip_accounting", """
SELECT CASE WHEN is_screenshot THEN 'screenshot' WHEN size_kb < 500 AND media_type <> 'video' THEN 'too_small'
  WHEN width < 600 AND height < 600 AND media_type <> 'video' THEN 'low_res' WHEN date IS NULL THEN 'no_date' ELSE 'kept' END AS skip_reason,
  count(*) AS n FROM assets GROUP BY 1""", uses=("assets",))
def f2(spark, d):
    gate = f.quality_gate(min_kb=500)
    reason = f.first_reason(
        ("screenshot", F.col("is_screenshot")), ("too_small", gate == "too_small"), ("low_res", gate == "low_res"),
        ("no_date", F.col("date").isNull()),
    )
    return f.skip_accounting(a.assets_doc(spark, d), reason)


@query("f3_initial_status", """
SELECT asset_id,
  CASE WHEN is_screenshot OR blur_score < 50 THEN 'rejected' WHEN cat IS NULL THEN 'pool' ELSE 'qualified' END AS status,
  CASE WHEN is_screenshot THEN 'screenshot' WHEN blur_score < 50 THEN 'blurry' WHEN cat IS NULL THEN 'no_date' END AS reject_reason,
  CASE WHEN is_screenshot THEN 'rejected' WHEN NOT has_target_face OR cat IS NULL THEN 'pool' ELSE 'qualified' END AS face_status,
  CASE WHEN is_screenshot THEN 'screenshot' WHEN NOT has_target_face AND face_count = 0 THEN 'no_faces'
       WHEN NOT has_target_face THEN 'wrong_person' WHEN cat IS NULL THEN 'no_date' END AS face_reason
FROM (SELECT *, CASE WHEN date IS NOT NULL THEN category END AS cat FROM assets)""", uses=("assets",))
def f3(spark, d):
    df = a.assets_doc(spark, d).withColumn("category", F.when(F.col("date").isNotNull(), F.col("category")))
    one, two = f.initial_status(), f.initial_status_faces()
    return df.select(
        "asset_id", one.status.alias("status"), one.reject_reason.alias("reject_reason"),
        two.status.alias("face_status"), two.reject_reason.alias("face_reason"),
    )


@query("f4_face_status_update", """
SELECT asset_id,
  CASE WHEN NOT checked THEN CASE WHEN media_type <> 'video' AND status <> 'rejected' THEN 'pool' ELSE status END
    WHEN NOT has_target_face THEN CASE WHEN status IN ('qualified', 'selected') THEN 'pool' ELSE status END
    WHEN status = 'pool' AND reject_reason IN ('no_faces', 'wrong_person') THEN 'qualified' ELSE status END AS status,
  CASE WHEN NOT checked THEN CASE WHEN media_type <> 'video' AND status <> 'rejected' THEN 'no_faces' ELSE reject_reason END
    WHEN NOT has_target_face THEN CASE WHEN status IN ('qualified', 'selected')
      THEN CASE WHEN face_count = 0 THEN 'no_faces' ELSE 'wrong_person' END ELSE reject_reason END
    WHEN status = 'pool' AND reject_reason IN ('no_faces', 'wrong_person') THEN NULL ELSE reject_reason END AS reject_reason
FROM (SELECT *, NOT (width < 600 OR height < 600 OR is_screenshot OR size_kb < 50) AS checked FROM assets)""", uses=("assets",))
def f4(spark, d):
    df = a.assets_doc(spark, d)
    small = (F.col("width") < 600) | (F.col("height") < 600)
    out = f.with_status(df, f.face_status_update(True, ~(small | f.skip_face_check())))
    return out.select("asset_id", "status", "reject_reason")


@query("f5_blur_gate", "SELECT asset_id, value FROM evt WHERE blur_score IS NULL OR blur_score >= 50", uses=("evt",))
def f5(spark, d):
    return f.blur_gate(a.assets_evt(spark, d)).select("asset_id", "value")


@query("f6_skip_face_check", """
SELECT asset_id, (coalesce(width, 0) < 200 OR coalesce(height, 0) < 200 OR is_screenshot OR coalesce(size_kb, 0) < 50) AS skip
FROM (SELECT * REPLACE (CASE WHEN asset_id % 23 > 0 THEN width END AS width) FROM assets)""", uses=("assets",))
def f6(spark, d):
    df = a.assets_doc(spark, d).withColumn("width", F.when(F.col("asset_id") % 23 > 0, F.col("width")))
    return df.select("asset_id", f.skip_face_check().alias("skip"))


@query("f7_gallery_filter", """
SELECT 'faces' AS filter, asset_id FROM assets WHERE source_label = 'src1' AND has_target_face AND status = 'qualified'
UNION ALL SELECT 'search', asset_id FROM assets WHERE contains(lower(filename), 'g_0000') AND face_count <= 0
UNION ALL SELECT 'medium', asset_id FROM assets WHERE composite >= 40 AND composite < 70 AND (preference IS NULL OR preference NOT IN ('like', 'dislike'))
UNION ALL SELECT 'low', asset_id FROM assets WHERE composite < 40 AND location = 'place3'
UNION ALL SELECT 'high', asset_id FROM assets WHERE composite >= 70 AND preference = 'like'""", uses=("assets",))
def f7(spark, d):
    df = a.assets_doc(spark, d)
    views = {
        "faces": dict(source="src1", faces="has_target", status="qualified"),
        "search": dict(search="G_0000", faces="no_face"),
        "medium": dict(grade="medium", preference="unrated"),
        "low": dict(grade="low", location="place3"),
        "high": dict(grade="high", preference="like"),
    }
    out = None
    for name, wanted in views.items():
        part = f.gallery_filter(df, **wanted).select(F.lit(name).alias("filter"), "asset_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("f8_list_assets", """
SELECT asset_id, status FROM assets WHERE status = 'qualified' AND suppressed_by IS NULL
ORDER BY asset_id LIMIT 40 OFFSET 60""", uses=("assets",))
def f8(spark, d):
    page = f.list_assets(a.assets_doc(spark, d), status="qualified", offset=60, limit=40, key="asset_id")
    return page.select("asset_id", "status")


@query("f9_cleanup_list", """
SELECT asset_id FROM assets WHERE trash AND media_type = 'image' AND status = 'qualified' AND category = 'en'""", uses=("assets",))
def f9(spark, d):
    rows = f.cleanup_list(a.assets_doc(spark, d), trash=True, status="qualified", media_type="image", category="en")
    return rows.select("asset_id")


@query("f10_date_age_filter", """
SELECT asset_id, CASE WHEN date IS NULL THEN 'no_date' WHEN date < DATE '1996-06-01' THEN 'before_date'
  WHEN date > DATE '1995-01-01' + 1000 THEN 'after_date' END AS reason
FROM (SELECT asset_id, CASE WHEN asset_id % 50 > 0 THEN date END AS date FROM dated)""", uses=("dated",))
def f10(spark, d):
    low, high = f.date_bounds("1996-06-01", "1999-01-01", 100, 1000, "1995-01-01")
    df = a.assets_dated(spark, d).withColumn("date", F.when(F.col("asset_id") % 50 > 0, F.col("date")))
    return df.select("asset_id", f.date_age_filter("date", low, high).alias("reason"))


@query("f11_score_range", "SELECT asset_id, composite FROM evt WHERE composite < 60 AND composite >= 20", uses=("evt",))
def f11(spark, d):
    return f.score_range(a.assets_evt(spark, d), "composite", below=60, above=20).select("asset_id", "composite")


@query("f12_selection_candidates", """
SELECT asset_id, CASE WHEN media_type = 'video' THEN 'video' WHEN is_screenshot THEN 'screenshot' WHEN blur_score < 50 THEN 'blurry'
  WHEN nsfw THEN 'nsfw' WHEN category IS NULL THEN 'no_category'
  WHEN NOT has_target_face AND category NOT IN ('fr') THEN 'no_target' END AS reason FROM assets""", uses=("assets",))
def f12(spark, d):
    return a.assets_doc(spark, d).select("asset_id", f.selection_reason(["fr"]).alias("reason"))


@query("f13_face_distance_gate", """
SELECT asset_id, face_distance FROM evt WHERE face_distance <=
  CASE category WHEN 'click' THEN 0.45 WHEN 'view' THEN 0.50 ELSE 0.55 END""", uses=("evt",))
def f13(spark, d):
    upper = F.when(F.col("category") == "click", 365).when(F.col("category") == "view", 1095)
    return f.face_distance_gate(a.assets_evt(spark, d), upper).select("asset_id", "face_distance")


@query("f14_select_eligibility", """
SELECT asset_id, NOT has_target_face AND media_type <> 'video' AS no_face_penalty, 'manual' AS form FROM assets
WHERE status <> 'rejected' AND suppressed_by IS NULL
UNION ALL SELECT asset_id, FALSE, 'strict' FROM assets WHERE status <> 'rejected' AND suppressed_by IS NULL AND has_target_face""", uses=("assets",))
def f14(spark, d):
    df = a.assets_doc(spark, d)
    manual = f.select_eligibility(df, True, manual=True).select("asset_id", "no_face_penalty", F.lit("manual").alias("form"))
    strict = f.select_eligibility(df, True, videos_exempt=False).select(
        "asset_id", "no_face_penalty", F.lit("strict").alias("form")
    )
    return manual.unionByName(strict)


@query("f15_flat_image", """
SELECT vec_id, len(list_distinct(px)) / len(px) < 0.2 AS flat,
  (len(list_distinct(px)) / len(px) < 0.08 OR vec_id % 50 = 0) AS flat_extended
FROM (SELECT vec_id, list_transform(v, lambda x: CAST(floor(CAST(x AS DOUBLE) * 12) AS INT)) AS px FROM vectors)""", uses=("vectors",))
def f15(spark, d):
    px = F.transform("v", lambda x: F.floor(x.cast("double") * 12).cast("int"))
    df = a.vectors(spark, d).withColumn("px", px)
    share = F.size(F.array_distinct("px")) / F.size("px")
    name = F.when(F.col("vec_id") % 50 == 0, "Screenshot_1.png").otherwise("a.jpg")
    return df.select(
        "vec_id", f.is_flat_image("px", 0.2).alias("flat"),
        f.is_flat_extended(share, F.lit(0.1), F.lit(50.0), name).alias("flat_extended"),
    )


@query("f16_backfill_plan", """
SELECT asset_id, state, state IN ('never_processed', 'outdated_embed', 'vector_missing') AS needs_embed, state <> 'current' AS needs_tags
FROM (SELECT s.asset_id, CASE WHEN s.asset_id % 4 = 0 THEN 'never_processed' WHEN s.asset_id % 5 = 0 THEN 'outdated_embed'
  WHEN r.vec_id IS NULL THEN 'vector_missing' WHEN s.asset_id % 3 = 0 THEN 'outdated_tagger' ELSE 'current' END AS state
  FROM assets s LEFT JOIN raw r ON r.vec_id = s.asset_id WHERE s.status <> 'rejected')""", uses=("assets", "raw"))
def f16(spark, d):
    n = F.col("asset_id")
    df = a.assets_doc(spark, d).select(
        "asset_id", "status", (n % 4 != 0).alias("has_semantic"),
        F.when(n % 5 == 0, "e1").otherwise("e2").alias("embed_version"),
        F.when(n % 3 == 0, "t1").otherwise("t2").alias("tagger_version"),
    )
    vectors = a.raw_vectors(spark, d).withColumnRenamed("vec_id", "asset_id")
    return f.backfill_plan(df, vectors, "e2", "t2", "asset_id").select("asset_id", "state", "needs_embed", "needs_tags")


@query("f17_regrade_plan", """
SELECT asset_id FROM evt WHERE asset_id % 3 = 0 OR asset_id % 2 = 0""", uses=("evt",))
def f17(spark, d):
    df = a.assets_evt(spark, d)
    matched = F.create_map(F.lit("p"), F.col("composite"))
    grades = df.filter(F.col("asset_id") % 3 != 0).select(
        "asset_id", F.when(F.col("asset_id") % 2 == 1, matched).otherwise(F.create_map().cast("map<string,double>")).alias("recognition")
    )
    return f.regrade_plan(df.select("asset_id"), grades, "asset_id", have_references=True)


@query("f18_age_results", """
SELECT asset_id, estimated_age, row_number() OVER (ORDER BY estimated_age DESC, asset_id) AS place
FROM (SELECT asset_id, asset_id * 11 % 90 AS estimated_age FROM assets WHERE person = 'p1')""", uses=("assets",))
def f18(spark, d):
    from ..operators.ranges import positions

    df = a.assets_doc(spark, d).withColumn("estimated_age", F.col("asset_id") * 11 % 90)
    shown = f.age_results(df, "p1", "age_desc").select("asset_id", "estimated_age")
    return positions(shown, [F.col("estimated_age").desc(), F.col("asset_id").asc()], "_p").select(
        "asset_id", "estimated_age", (F.col("_p") + 1).alias("place")
    )
