"""Ranking components against a selection, and complete selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Category
from ..functions.vectors import dhash
from ..operators import preference, scoring, selection as sel
from ..operators.windows import evenly_spaced
from . import adapters as a
from .q_similarity import _DHASH, _WALK
from .registry import query


def rated_assets(spark, d):
    """Vectors as assets: the fields of the ranking score by formula, feedback on every ninth row."""
    n = F.col("vec_id")
    return a.vectors(spark, d).select(
        "vec_id", F.col("v").alias("vector"), "label", "quality", dhash("v", 8, 8).alias("dhash"),
        F.when(n % 9 == 0, F.when(n % 2 == 0, "like").otherwise("dislike")).alias("preference"),
        F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("category"),
        F.when(n % 12 == 0, "selected").when(n % 7 == 3, "rejected").when(n % 5 == 1, "pool").otherwise("qualified").alias("status"),
        F.when(n % 8 == 7, "video").otherwise("image").alias("media_type"),
        (n % 4).cast("int").alias("face_count"), ((n % 4 > 0) & (n % 3 > 0)).alias("has_target_face"),
        F.when(n % 4 > 0, (n * 7 % 60) / F.lit(100.0)).alias("face_distance"),
        F.col("quality").alias("composite"), F.lit(50.0).alias("exposure"), F.lit(50.0).alias("sharpness"),
        F.col("quality").alias("resolution"), F.lit(50.0).alias("noise"), F.lit(50.0).alias("compression"), F.lit(50.0).alias("color"),
        F.lit(50.0).alias("focus"), F.lit(50.0).alias("distortion"),
        F.lit(1000).cast("int").alias("width"), F.lit(800).cast("int").alias("height"), (n % 4000).alias("size_kb"),
        F.date_add(F.to_date(F.lit("2021-01-01")), (n % 40).cast("int")).alias("date"),
        F.when(n % 3 > 0, F.concat(F.lit("place"), (n % 6).cast("string"))).alias("location"),
        F.concat(F.lit("/lib/f"), (n % 2).cast("string"), F.lit("/IMG_"), F.lpad((n * 3).cast("string"), 9, "0"), F.lit(".jpg")).alias("path"),
    )


_RATED = """
, ra AS (SELECT vec_id, CAST(v AS DOUBLE[]) AS v, label, quality, CASE WHEN vec_id % 9 = 0 THEN CASE WHEN vec_id % 2 = 0 THEN 'like' ELSE 'dislike' END END AS preference,
  concat('c', CAST(label % 3 AS STRING)) AS category, CASE WHEN vec_id % 12 = 0 THEN 'selected' WHEN vec_id % 7 = 3 THEN 'rejected' WHEN vec_id % 5 = 1 THEN 'pool' ELSE 'qualified' END AS status,
  CASE WHEN vec_id % 8 = 7 THEN 'video' ELSE 'image' END AS media_type, vec_id % 4 AS face_count, vec_id % 4 > 0 AND vec_id % 3 > 0 AS has_target_face,
  CASE WHEN vec_id % 4 > 0 THEN (vec_id * 7 % 60) / 100e0 END AS face_distance, DATE '2021-01-01' + CAST(vec_id % 40 AS INT) AS date,
  CASE WHEN vec_id % 3 > 0 THEN concat('place', CAST(vec_id % 6 AS STRING)) END AS location FROM vectors),
sim AS (SELECT a_id AS id, b_id AS other, score FROM pairs UNION ALL SELECT b_id, a_id, score FROM pairs)
"""


@query("r2_preference_component", _RATED + """
, mean AS (SELECT preference, i, avg(x) AS x FROM (SELECT preference, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ra WHERE preference IS NOT NULL) GROUP BY ALL),
unit AS (SELECT preference, list(x / n ORDER BY i) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY preference)) AS n FROM mean) GROUP BY preference),
mx AS (SELECT s.id, max(score) FILTER (r.preference = 'like') AS lk, max(score) FILTER (r.preference = 'dislike') AS dl FROM sim s JOIN ra r ON r.vec_id = s.other GROUP BY s.id),
t AS (SELECT ra.*, list_dot_product(ra.v, l.c) AS lc, list_dot_product(ra.v, k.c) AS dc, lk, dl, (vec_id % 100) / 100e0 AS p FROM ra, unit l, unit k, mx WHERE l.preference = 'like' AND k.preference = 'dislike' AND mx.id = ra.vec_id)
SELECT vec_id, round(CASE preference WHEN 'like' THEN 95 WHEN 'dislike' THEN 5 ELSE greatest(0, least(100, 50 + lc * 20 - greatest(dc, 0) * 15 + greatest(lk - 0.85e0, 0) * 60 - greatest(dl - 0.80e0, 0) * 50
  + (p - 0.5e0) * 20 + CASE WHEN has_target_face THEN greatest(0, 0.55e0 - face_distance) * 18 ELSE 0 END)) END, 5) AS score FROM t""", uses=("pairs",))
def r2(spark, d):
    df = sel.with_preference_signals(rated_assets(spark, d), "vec_id", "vector")
    p = (F.col("vec_id") % 100) / F.lit(100.0)
    score = scoring.preference_component(F.col("like_centroid"), F.col("dislike_centroid"), F.col("like_max"), F.col("dislike_max"), p)
    return df.select("vec_id", F.round(score, 5).alias("score"))


_STATE = _RATED + f"""
, h AS (SELECT vec_id, CAST({_DHASH} AS BIGINT) AS h FROM vectors),
ctx AS (SELECT c.vec_id, max(s.score) AS vm, (SELECT count(*) FROM ra x WHERE x.status = 'selected' AND x.date = c.date) AS same_date,
  (SELECT count(*) FROM ra x WHERE x.status = 'selected' AND x.location = c.location) AS same_place, min(bit_count(xor(hc.h, hs.h))) AS bits,
  count(*) FILTER (s.other % 2 = c.vec_id % 2 AND abs(s.other * 3 - c.vec_id * 3) <= 3) > 0 AS burst
  FROM ra c JOIN sim s ON s.id = c.vec_id JOIN ra r ON r.vec_id = s.other AND r.status = 'selected' JOIN h hc ON hc.vec_id = c.vec_id JOIN h hs ON hs.vec_id = s.other WHERE c.status <> 'selected' GROUP BY c.vec_id, c.date, c.location)
"""


def _context(spark, d):
    df = rated_assets(spark, d)
    chosen = F.col("status") == "selected"
    return sel.selection_context(df.filter(~chosen), df.filter(chosen), "vec_id", "vector", "vector", "dhash", "path")


@query("r4_diversity_component", _STATE + """
SELECT vec_id, round(greatest(-100, least(100, 50 - greatest(vm - 0.75e0, 0) * 200 - greatest(vm - 0.90e0, 0) * 200 - greatest(0, least(30, (same_date - 3) * 5)) - greatest(0, least(20, (same_place - 5) * 4)))), 5) AS score FROM ctx""", uses=("pairs",))
def r4(spark, d):
    score = scoring.diversity_component(F.col("visual_max"), F.col("semantic_max"), F.col("same_date"), F.col("same_place"), F.lit(True))
    return _context(spark, d).select("vec_id", F.round(score, 5).alias("score"))


@query("r6_duplicate_penalty", _STATE + """
SELECT vec_id, round(least(100, greatest(CASE WHEN burst THEN 100 ELSE 0 END, CASE WHEN bits <= 5 THEN 100 WHEN bits <= 10 THEN (10 - bits) * 15 ELSE 0 END,
  CASE WHEN vm > 0.95 THEN 100 WHEN vm > 0.88 THEN (vm - 0.88e0) * (100 / 0.07e0) ELSE 0 END)), 4) AS penalty FROM ctx""", uses=("pairs",))
def r6(spark, d):
    penalty = scoring.duplicate_penalty(F.col("burst"), F.col("min_bits"), F.col("visual_max"))
    return _context(spark, d).select("vec_id", F.round(penalty, 4).alias("penalty"))


GROUPS = [Category("c0", "Zero", 30, 4), Category("c1", "One", 25, 3), Category("c2", "Two", 40, 5)]
_TARGETS = "CASE g WHEN 'c0' THEN 30 WHEN 'c1' THEN 25 ELSE 40 END"

# balanced: interleave by week when the pool is large enough, then walk with the similarity test
_POOL = _RATED + """
, sc AS (SELECT *, CASE category WHEN 'c0' THEN 30 WHEN 'c1' THEN 25 ELSE 40 END AS target, quality / 100 * 5 + CASE WHEN has_target_face THEN 2 WHEN face_count > 0 THEN 1 ELSE 0 END + CASE WHEN face_count >= 3 THEN 0.5e0 ELSE 0 END
  + CASE preference WHEN 'like' THEN 8 WHEN 'dislike' THEN -6 ELSE 0 END AS score, date_trunc('week', date) AS bucket FROM ra WHERE status <> 'rejected'),
turn AS (SELECT *, count(*) OVER (PARTITION BY category) > 2 * target AS mix, row_number() OVER (PARTITION BY category, bucket ORDER BY score DESC, vec_id) AS t FROM sc),
ordered AS (SELECT vec_id, category, score, target, quality, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN mix THEN t END, CASE WHEN mix THEN bucket END, score DESC, vec_id) AS n FROM turn),
near AS (SELECT o.category AS g, o.vec_id, o.n, list(s.other) AS others FROM ordered o LEFT JOIN (SELECT * FROM sim WHERE score >= 0.35) s ON s.id = o.vec_id GROUP BY ALL),
walk AS (SELECT g, 0::BIGINT AS n, []::BIGINT[] AS taken FROM (SELECT DISTINCT g FROM near)
  UNION ALL SELECT w.g, s.n, CASE WHEN len(w.taken) >= CASE w.g WHEN 'c0' THEN 30 WHEN 'c1' THEN 25 ELSE 40 END OR list_has_any(coalesce(s.others, []), w.taken) THEN w.taken ELSE list_append(w.taken, s.vec_id) END FROM walk w JOIN near s ON s.g = w.g AND s.n = w.n + 1),
final AS (SELECT g, taken FROM walk QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC) = 1),
chosen AS (SELECT unnest(taken) AS vec_id FROM final)
"""


def _auto(spark, d):
    week = F.date_trunc("week", "date")
    return sel.auto_select(
        rated_assets(spark, d), GROUPS, "balanced", vec="vector", bucket=week, threshold=0.35, key="vec_id"
    )


@query("e5_auto_select", _POOL + """
SELECT ra.vec_id, CASE WHEN c.vec_id IS NOT NULL THEN 'selected' WHEN o.vec_id IS NOT NULL THEN 'qualified' ELSE ra.status END AS status FROM ra LEFT JOIN chosen c USING (vec_id) LEFT JOIN ordered o USING (vec_id)""", uses=("pairs",), recursive=True)
def e5(spark, d):
    return _auto(spark, d)[0].select("vec_id", "status")


@query("g20_selection_report", _POOL + """
SELECT CAST(substr(o.category, 2) AS INT) AS ord, o.category AS id, CASE o.category WHEN 'c0' THEN 'Zero' WHEN 'c1' THEN 'One' ELSE 'Two' END AS display, any_value(target) AS target, count(c.vec_id) AS selected, count(*) AS available,
  round_even(arg_min(score, n) FILTER (c.vec_id IS NOT NULL) * 100, 0) / 100 AS top_score, round_even(arg_max(score, n) FILTER (c.vec_id IS NOT NULL) * 100, 0) / 100 AS min_score
FROM ordered o LEFT JOIN chosen c USING (vec_id) GROUP BY o.category""", uses=("pairs",), recursive=True)
def g20(spark, d):
    return _auto(spark, d)[1]


@query("e5_auto_select_no_diversity", """
SELECT category, asset_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, asset_id) AS rank FROM (
  SELECT asset_id, category, coalesce(composite / 100 * 5, least(CAST(width AS DOUBLE) * height / 1e6 / 12, 1) + least(size_kb / 3000e0, 1) * 0.5e0) + CASE WHEN has_target_face THEN 2 WHEN face_count > 0 THEN 1 ELSE 0 END
    + CASE WHEN face_count >= 3 THEN 0.5e0 ELSE 0 END + CASE preference WHEN 'like' THEN 8 WHEN 'dislike' THEN -6 ELSE 0 END AS score FROM assets WHERE status <> 'rejected' AND suppressed_by IS NULL)) WHERE rank <= 40""", uses=("assets",))
def e5b(spark, d):
    from ..operators.filters import select_eligibility
    from ..operators.windows import top_k_per_group

    pool = select_eligibility(a.assets_doc(spark, d), False).withColumn("_score", scoring.quality_score())
    best = top_k_per_group(pool, ["category"], [F.col("_score").desc(), F.col("asset_id").asc()], 40)
    return best.select("category", "asset_id", "rank")


@query("e6_quick_fill")
def e6(spark, d):
    df = rated_assets(spark, d)
    model = preference.train_preference(df)
    return sel.quick_fill(df, GROUPS, model, vec="vector", dhash="dhash", key="vec_id").select("vec_id", "category", "status", "picked")


def _walk_sql(name: str, source: str, cap: str, t: float) -> str:
    """Recursive SQL: walk ``source`` (g, vec_id, n) and take rows unlike the taken ones, up to the cap of group g."""
    return f"""
{name}_near AS (SELECT s.g, s.vec_id, s.n, list(p.other) AS others FROM {source} s LEFT JOIN (SELECT * FROM sim WHERE score >= {t}) p ON p.id = s.vec_id GROUP BY ALL),
{name}_walk AS (SELECT g, 0::BIGINT AS n, []::BIGINT[] AS taken FROM (SELECT DISTINCT g FROM {name}_near)
  UNION ALL SELECT w.g, s.n, CASE WHEN len(w.taken) >= {cap} OR list_has_any(coalesce(s.others, []), w.taken) THEN w.taken ELSE list_append(w.taken, s.vec_id) END
  FROM {name}_walk w JOIN {name}_near s ON s.g = w.g AND s.n = w.n + 1),
{name} AS (SELECT g, unnest(taken) AS vec_id, unnest(range(1, len(taken) + 1)) AS pick FROM (SELECT g, taken FROM {name}_walk QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC) = 1))"""


_NEED = "CASE {} WHEN 'c0' THEN 25 WHEN 'c1' THEN 200 ELSE 60 END"


@query("e7_tiered_refill", _RATED + f"""
, offered AS (SELECT *, CASE WHEN vec_id % 5 = 1 THEN 0 ELSE 1 END AS tier FROM ra WHERE vec_id % 5 = 1 OR (vec_id % 5 > 1 AND vec_id % 2 = 0)),
free AS (SELECT category AS g, vec_id, row_number() OVER (PARTITION BY category ORDER BY tier, quality DESC, vec_id) AS n FROM offered o
  WHERE NOT EXISTS (SELECT 1 FROM sim s JOIN ra c ON c.vec_id = s.other WHERE s.id = o.vec_id AND s.score >= 0.35 AND c.vec_id % 5 = 0 AND c.category = o.category)),
{_walk_sql('fill', 'free', _NEED.format('w.g'), 0.35)},
extra AS (SELECT category AS g, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY face_count DESC, quality DESC, vec_id) AS r FROM ra WHERE vec_id % 5 = 3 AND vec_id NOT IN (SELECT vec_id FROM fill))
  LEFT JOIN (SELECT g, count(*) AS have FROM fill GROUP BY g) f ON f.g = category WHERE r <= {_NEED.format('category')} - coalesce(have, 0)),
taken AS (SELECT vec_id, category FROM ra WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id, g FROM fill UNION ALL SELECT vec_id, g FROM extra),
left_over AS (SELECT category AS g, vec_id, row_number() OVER (PARTITION BY category ORDER BY tier, quality DESC, vec_id) AS n FROM offered o
  WHERE vec_id NOT IN (SELECT vec_id FROM taken) AND NOT EXISTS (SELECT 1 FROM sim s JOIN taken c ON c.vec_id = s.other WHERE s.id = o.vec_id AND s.score >= 0.35 AND c.category = o.category)),
{_walk_sql('spare', 'left_over', '10', 0.35)}
SELECT f.g AS category, vec_id, tier, 'diverse' AS pass FROM fill f JOIN offered USING (vec_id)
UNION ALL SELECT g, vec_id, 2, 'relaxed' FROM extra UNION ALL SELECT f.g, vec_id, tier, 'backup' FROM spare f JOIN offered USING (vec_id)""", uses=("pairs",), recursive=True)
def e7(spark, d):
    fill, backup = _refill(spark, d)
    return fill.select("category", "vec_id", "tier", "pass").unionByName(
        backup.select("category", "vec_id", "tier", F.lit("backup").alias("pass"))
    )


REFILL_NEEDS = {"c0": 25, "c1": 200, "c2": 60}


def _refill(spark, d, t=0.35):
    df = rated_assets(spark, d).select("vec_id", F.col("vector").alias("v"), "category", "quality", "face_count")
    n = F.col("vec_id")
    tiers = [df.filter(n % 5 == 1), df.filter((n % 5 > 1) & (n % 2 == 0))]
    relaxed = df.filter(n % 5 == 3)
    return sel.tiered_refill(
        tiers, df.filter(n % 5 == 0), REFILL_NEEDS, t, ["-quality"], "vec_id", "v", relaxed=relaxed,
        relaxed_order=[F.col("face_count").desc(), F.col("quality").desc(), F.col("vec_id").asc()], backup_size=10,
    )


@query("e8_adaptive_even_diverse", _RATED + f"""
, fresh AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY date, vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS total FROM ra c
  WHERE vec_id % 4 > 0 AND NOT EXISTS (SELECT 1 FROM sim s JOIN ra o ON o.vec_id = s.other WHERE s.id = c.vec_id AND s.score >= 0.30 AND o.vec_id % 4 = 0 AND o.label = c.label)),
spread AS (SELECT label AS g, vec_id, i AS slot, row_number() OVER (PARTITION BY label ORDER BY i) AS n FROM fresh JOIN range(0, 12) t(i) ON CASE WHEN total > 12 THEN pos = CAST(floor(i * (total / 12)) AS BIGINT) ELSE pos = i END),
{_walk_sql('kept', 'spread', '12', 0.30)}
SELECT kept.g AS label, vec_id, slot, pick FROM kept JOIN spread USING (vec_id)""", uses=("pairs",), recursive=True)
def e8(spark, d):
    df = rated_assets(spark, d).select("vec_id", F.col("vector").alias("v"), "label", "date")
    n = F.col("vec_id")
    picked = sel.adaptive_even_diverse(df.filter(n % 4 > 0), df.filter(n % 4 == 0), 12, 0.30, "date", "vec_id", "v", ["label"])
    return picked.select("label", "vec_id", "slot", "pick")
