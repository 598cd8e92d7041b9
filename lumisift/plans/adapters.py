"""The test tables in the shapes of the data model, for Spark and as SQL views.

Most derived columns are written once, in the part of SQL that both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit_normalize

# Test vocabulary: family, then its tags.
VOCABULARY = {
    "scene": ["indoors", "outdoors", "beach", "park"],
    "people": ["baby", "child", "portrait", "group photo"],
    "activity": ["running", "swimming", "dancing", "eating"],
    "object": ["food", "flowers", "gift", "birthday cake"],
    "mood": ["happy", "formal", "casual", "sunset"],
}
FAMILY_ORDER = list(VOCABULARY)
FAMILY_OF = {tag: family for family, tags in VOCABULARY.items() for tag in tags}
TAGS = list(FAMILY_OF)

# hash, extension, media_type and filename come first because later columns use them
_DOC_BASE = {
    "asset_id": "doc_id",
    "hash": "md5(text)",
    "text": "lower(text)",
    "source_label": "source",
    "source_ord": "CAST(regexp_extract(source, '([0-9]+)', 1) AS INT)",
    "category": "lang",
    "extension": "CASE WHEN doc_id % 5 = 4 THEN '.mp4' WHEN doc_id % 5 = 2 THEN '.png' WHEN doc_id % 5 = 3 THEN '.heic' ELSE '.jpg' END",
    "media_type": "CASE WHEN doc_id % 5 = 4 THEN 'video' ELSE 'image' END",
    "size_kb": "n_chars",
    "width": "CAST(400 + (doc_id * 37) % 4000 AS INT)",
    "height": "CAST(300 + (doc_id * 53) % 3000 AS INT)",
    "face_count": "CAST(doc_id % 5 AS INT)",
    "has_target_face": "(doc_id % 2 = 0 AND doc_id % 5 > 0)",
    "face_distance": "CASE WHEN doc_id % 5 > 0 THEN (doc_id * 7 % 80) / 100e0 END",
    "composite": "CASE WHEN doc_id % 13 < 12 THEN (doc_id * 13 % 1000) / 10e0 END",
    "sharpness": "(doc_id * 17 % 1000) / 10e0",
    "resolution": "(doc_id * 19 % 1000) / 10e0",
    "noise": "(doc_id * 23 % 1000) / 10e0",
    "compression": "(doc_id * 29 % 1000) / 10e0",
    "color": "(doc_id * 31 % 1000) / 10e0",
    "exposure": "(doc_id * 37 % 1000) / 10e0",
    "focus": "(doc_id * 41 % 1000) / 10e0",
    "distortion": "(doc_id * 43 % 1000) / 10e0",
    "blur_score": "CASE WHEN doc_id % 9 < 8 THEN CAST((doc_id * 29) % 400 AS DOUBLE) END",
    "preference": "CASE WHEN quality = 1 THEN 'like' WHEN quality = 0 THEN 'dislike' END",
    "nsfw": "(coalesce(toxic, 0) = 1)",
    "trash": "(doc_id % 11 = 0)",
    "is_screenshot": "(doc_id % 17 = 0)",
    "status": "CASE WHEN doc_id % 7 = 0 THEN 'selected' WHEN doc_id % 7 IN (1, 2) THEN 'pool' WHEN doc_id % 7 = 3 THEN 'rejected' ELSE 'qualified' END",
    "reject_reason": "CASE WHEN doc_id % 7 IN (1, 2) THEN CASE WHEN doc_id % 3 = 0 THEN 'no_faces' WHEN doc_id % 3 = 1 THEN 'wrong_person' ELSE 'no_date' END WHEN doc_id % 7 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'screenshot' ELSE 'blurry' END END",
    "location": "CASE WHEN doc_id % 4 > 0 THEN concat('place', CAST(doc_id % 23 AS STRING)) END",
    "date": "CASE WHEN doc_id % 10 < 9 THEN DATE '2020-01-01' + CAST(doc_id * 7 % 900 AS INT) END",
    "suppressed_by": "CASE WHEN doc_id % 19 = 0 THEN 'x' END",
    "tag_a": "doc_id % 20",
    "tag_b": "(doc_id * 3 + 1) % 20",
    "tag_c": "(doc_id * 7 + 2) % 20",
}
_DOC_NAMES = {
    "filename": "concat('IMG_', lpad(CAST(asset_id AS STRING), 6, '0'), extension)",
    "path": "concat('/lib/', source_label, '/', category, '/IMG_', lpad(CAST(asset_id AS STRING), 6, '0'), extension)",
    "person": "CASE WHEN has_target_face THEN concat('p', CAST(asset_id % 3 AS STRING)) END",
}

_EVT = {
    "asset_id": "event_id",
    "hash": "md5(CAST(event_id AS STRING))",
    "owner": "user_id",
    "category": "event_type",
    "value": "value",
    "composite": "least(100e0, value / 5e0)",
    "sharpness_var": "value * 4e0",
    "width": "CAST(400 + (event_id * 37) % 4000 AS INT)",
    "height": "CAST(300 + (event_id * 53) % 3000 AS INT)",
    "size_kb": "40 + (event_id * 71) % 5000",
    "status": "CASE WHEN event_id % 3 = 0 THEN 'pool' WHEN event_id % 11 = 0 THEN 'selected' ELSE 'qualified' END",
}
_EVT_K = {
    "noise_std": "k / 5e0",
    "mean_brightness": "k * 2.5e0",
    "brightness_std": "k * 1e0",
    "mean_saturation": "k * 2e0",
    "p5": "k * 0.5e0",
    "p95": "k * 2.5e0",
    "center_var": "value * 3e0",
    "edge_var": "value * 1.5e0",
    "face_count": "CAST(k % 5 AS INT)",
    "face_ratio": "k / 400e0",
    "face_sharpness_var": "value * 2e0",
    "face_distance": "CASE WHEN k % 5 > 0 THEN k / 125e0 END",
    "center_x": "CASE WHEN k % 5 > 0 THEN k / 100e0 END",
    "center_y": "CASE WHEN k % 5 > 0 THEN (100 - k) / 100e0 END",
    "blur_score": "CASE WHEN k % 7 > 0 THEN value END",
}

_NAME_PARTS = {
    "asset_id": "o_orderkey",
    "folder": "concat('f', CAST(o_custkey % 20 AS STRING))",
    "status_code": "o_orderstatus",
    "score": "o_totalprice",
    "category": "o_orderpriority",
    "date": "CAST(o_orderdate AS DATE)",
}
_NAME_FORMS = "CASE WHEN asset_id % 5 = 0 THEN concat('IMG_', {compact}, '_', CAST(asset_id AS STRING), '.jpg') " \
    "WHEN asset_id % 5 = 1 THEN concat(CAST(date AS STRING), ' ', CAST(asset_id AS STRING), '.jpg') " \
    "WHEN asset_id % 5 = 2 THEN concat('IMG_', lpad(CAST(asset_id AS STRING), CAST(greatest(4, length(CAST(asset_id AS STRING))) AS INT), '0'), '.JPG') " \
    "WHEN asset_id % 5 = 3 THEN concat('FB_IMG_', CAST(asset_id AS STRING), '.jpg') " \
    "ELSE concat('screenshot_', CAST(asset_id AS STRING), '.png') END"


def _select(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in expressions.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assets, with their feedback."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    base = docs.selectExpr(*[f"{e} AS {n}" for n, e in _DOC_BASE.items()])
    named = base.selectExpr("*", *[f"{e} AS {n}" for n, e in _DOC_NAMES.items()])
    vocabulary = F.array(*[F.lit(t) for t in TAGS])
    picks = [F.get(vocabulary, F.col(c).cast("int")) for c in ("tag_a", "tag_b", "tag_c")]
    return named.withColumns(
        {
            "tags": F.array_distinct(F.array(*picks)),
            "faces_found": F.when(F.col("person").isNotNull(), F.array("person")).otherwise(F.array().cast("array<string>")),
        }
    ).drop("tag_a", "tag_b", "tag_c")


def assets_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assets with measured columns."""
    events = table(spark, sf_dir, "events")
    base = events.selectExpr(
        *[f"{e} AS {n}" for n, e in _EVT.items()], "CAST(ts AS TIMESTAMP) AS taken_at",
        "CAST(get_json_object(props, '$.k') AS INT) AS k", "props",
    )
    return base.selectExpr("*", *[f"{e} AS {n}" for n, e in _EVT_K.items()], "CAST(taken_at AS DATE) AS day")


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings and planted near copies of every fifth one."""
    raw = raw_vectors(spark, sf_dir)
    amplitude = F.when(F.col("vec_id") % 10 == 0, 0.005).when(F.col("vec_id") % 10 == 5, 0.02)
    moved = F.transform(
        "v",
        lambda x, i: x.cast("double") + F.col("_a") * (((F.col("vec_id") * 31 + i * 17) % 7) - 3).cast("double"),
    )
    copies = (
        raw.withColumn("_a", amplitude).filter(F.col("_a").isNotNull())
        .withColumn("_m", moved)
        .select(
            (F.col("vec_id") + 1_000_000).alias("vec_id"), unit_normalize("_m").cast("array<float>").alias("v"), "label",
            F.col("vec_id").alias("planted_from"),
        )
    )
    both = raw.withColumn("planted_from", F.lit(None).cast("long")).unionByName(copies)
    return both.withColumn("quality", (F.col("vec_id") * 13 % 1000) / F.lit(10.0))


def assets_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS asset_id", "CAST(o_orderdate AS DATE) AS date", "o_orderpriority AS category",
        "o_totalprice AS score", "o_custkey AS owner",
    )


def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as file names of five forms."""
    base = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _NAME_PARTS.items()])
    form = _NAME_FORMS.format(compact="date_format(date, 'yyyyMMdd')")
    named = base.selectExpr("*", f"{form} AS filename")
    return named.selectExpr(
        "*", "concat('/lib/', folder, '/', filename) AS path", "concat(status_code, '__', filename) AS exported"
    )


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS asset_id", "(c_custkey * 37 % 16000) / 100e0 - 80 AS lat", "(c_custkey * 91 % 36000) / 100e0 - 180 AS lon"
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_suppkey AS place_id", "s_name AS name", "substring(n_name, 1, 2) AS cc",
        "(s_suppkey * 53 % 16000) / 100e0 - 80 AS lat", "(s_suppkey * 71 % 36000) / 100e0 - 180 AS lon",
    )


_VOCAB_SQL = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"

SQL_VIEWS = {
    "assets": f"""
SELECT * EXCLUDE (tag_a, tag_b, tag_c), {_select(_DOC_NAMES)},
  list_distinct([{_VOCAB_SQL}[tag_a + 1], {_VOCAB_SQL}[tag_b + 1], {_VOCAB_SQL}[tag_c + 1]]) AS tags
FROM (SELECT {_select(_DOC_BASE)} FROM documents LEFT JOIN labels USING (doc_id))""",
    "evt": f"""
SELECT *, {_select(_EVT_K)}, CAST(taken_at AS DATE) AS day
FROM (SELECT {_select(_EVT)}, ts AS taken_at, CAST(json_extract_string(props, '$.k') AS INT) AS k, props FROM events)""",
    "raw": "SELECT vec_id, embedding AS v, label FROM embeddings",
    "vectors": """
SELECT vec_id, v, label, NULL::BIGINT AS planted_from, (vec_id * 13 % 1000) / 10e0 AS quality FROM raw
UNION ALL
SELECT vec_id + 1000000, list_transform(m, lambda x: CAST(x / n AS FLOAT)), label, vec_id,
  ((vec_id + 1000000) * 13 % 1000) / 10e0
FROM (SELECT *, sqrt(list_dot_product(m, m)) AS n FROM (
  SELECT vec_id, label, list_transform(v, lambda x, i:
    CAST(x AS DOUBLE) + (CASE WHEN vec_id % 10 = 0 THEN 0.005e0 ELSE 0.02e0 END) * CAST(((vec_id * 31 + (i - 1) * 17) % 7) - 3 AS DOUBLE)) AS m
  FROM raw WHERE vec_id % 10 IN (0, 5)))""",
    "dated": "SELECT o_orderkey AS asset_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS category, o_totalprice AS score, o_custkey AS owner FROM orders",
    "names": f"""
SELECT *, concat('/lib/', folder, '/', filename) AS path, concat(status_code, '__', filename) AS exported
FROM (SELECT *, {_NAME_FORMS.format(compact="strftime(date, '%Y%m%d')")} AS filename
  FROM (SELECT {_select(_NAME_PARTS)} FROM orders))""",
    "points": "SELECT c_custkey AS asset_id, (c_custkey * 37 % 16000) / 100e0 - 80 AS lat, (c_custkey * 91 % 36000) / 100e0 - 180 AS lon FROM customer",
    "places": "SELECT s_suppkey AS place_id, s_name AS name, substring(n_name, 1, 2) AS cc, (s_suppkey * 53 % 16000) / 100e0 - 80 AS lat, (s_suppkey * 71 % 36000) / 100e0 - 180 AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    # unordered pairs of the vector table with their cosine
    "pairs": """
SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label AS a_label, b.label AS b_label,
  list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS score
FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id""",
    "raw_pairs": """
SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label AS a_label, b.label AS b_label,
  list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS score
FROM raw a JOIN raw b ON a.vec_id < b.vec_id""",
}
SQL_VIEW_NEEDS = {"vectors": ("raw",), "pairs": ("raw", "vectors"), "raw_pairs": ("raw",)}
