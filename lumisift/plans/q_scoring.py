"""Scores (R1, R3, R5, R7-R14), rules and the preference model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Category, QualityWeights, Quiz, Rule
from ..functions.numbers import half_even
from ..operators import grading, preference, rules as r, scoring
from ..operators.joins import apply_changes
from . import adapters as a
from .q_joins import _WORD_BEST, _WORD_HITS, WORDS
from .registry import query

QUIZ = Quiz(avoid=("no_face", "dark"), faces="many", closeups="yes", colorful="yes", sharpness="high")


@query("r1_quality_score", """
SELECT asset_id, round(base + CASE WHEN has_target_face THEN 3 WHEN face_count > 0 THEN 1.5 ELSE 0 END, 6) AS score,
  round(base + CASE WHEN has_target_face THEN 2 WHEN face_count > 0 THEN 1 ELSE 0 END - CASE WHEN face_count = 0 THEN 2 ELSE 0 END - CASE WHEN exposure < 30 THEN 1.5 ELSE 0 END
    + CASE WHEN face_count >= 3 THEN 1 ELSE 0 END + CASE WHEN face_distance < 0.4 THEN 0.5 ELSE 0 END + CASE WHEN color > 70 THEN 0.5 ELSE 0 END - CASE WHEN sharpness < 40 THEN 1 ELSE 0 END, 6) AS quiz_score
FROM (SELECT *, coalesce(composite / 100 * 5, least(CAST(width AS DOUBLE) * height / 1e6 / 12, 1) + least(size_kb / 3000e0, 1) * 0.5e0)
  + CASE WHEN face_count >= 3 THEN 0.5 ELSE 0 END + CASE preference WHEN 'like' THEN 8 WHEN 'dislike' THEN -6 ELSE 0 END AS base FROM assets)""", uses=("assets",))
def r1(spark, d):
    event = scoring.quality_score(QualityWeights(has_target_face=3.0, has_any_face=1.5))
    quiz = scoring.quality_score(QualityWeights(quiz=QUIZ))
    return a.assets_doc(spark, d).select("asset_id", F.round(event, 6).alias("score"), F.round(quiz, 6).alias("quiz_score"))


@query("r3_quality_component", """
SELECT asset_id, round(score, 6) AS score, round(greatest(0, CASE WHEN sharpness < 40 THEN greatest(0, s2 - 10) ELSE s2 END), 6) AS quiz_score FROM (
  SELECT *, CASE WHEN exposure < 30 THEN greatest(0, s1 - 8) ELSE s1 END AS s2 FROM (
  SELECT *, CASE WHEN face_count = 0 THEN greatest(0, score - 10) ELSE score END AS s1 FROM (
  SELECT *, least(100, base + CASE WHEN has_target_face THEN 10 WHEN face_count > 0 THEN 5 ELSE 0 END) AS score FROM (
  SELECT *, coalesce(composite, least(CAST(width AS DOUBLE) * height / 1e6 / 12, 1) * 60 + least(size_kb / 3000e0, 1) * 40) AS base FROM assets))))""", uses=("assets",))
def r3(spark, d):
    return a.assets_doc(spark, d).select(
        "asset_id", F.round(scoring.quality_component(), 6).alias("score"), F.round(scoring.quality_component(QUIZ), 6).alias("quiz_score")
    )


@query("r5_exploration", """
SELECT asset_id, CASE WHEN preference IN ('like', 'dislike') THEN 0e0 ELSE round(least(100, (1 - abs(p - 0.5e0) * 2) * 70 + share), 6) END AS trained,
  CASE WHEN preference IN ('like', 'dislike') THEN 0e0 ELSE round(40 + share, 6) END AS untrained
FROM (SELECT *, (asset_id % 100) / 100e0 AS p, (CAST('0x' || substr(md5(hash), 1, 8) AS BIGINT) % 100) / 100e0 * 30 AS share FROM assets)""", uses=("assets",))
def r5(spark, d):
    p = (F.col("asset_id") % 100) / F.lit(100.0)
    return a.assets_doc(spark, d).select(
        "asset_id", F.round(scoring.exploration_component(p), 6).alias("trained"),
        F.round(scoring.exploration_component(F.lit(None).cast("double")), 6).alias("untrained"),
    )


@query("r7_final_score", """
SELECT asset_id, round(0.6e0 * p + 0.2e0 * q + 0.1e0 * dv + 0.1e0 * e - dup - CASE WHEN has_target_face THEN 0 ELSE 40 END, 6) AS final FROM (
  SELECT *, composite AS p, sharpness AS q, color - 50 AS dv, exposure AS e, CASE WHEN asset_id % 4 = 0 THEN 30e0 ELSE 0e0 END AS dup FROM assets)""", uses=("assets",))
def r7(spark, d):
    df = a.assets_doc(spark, d)
    score = scoring.final_score(
        F.col("composite"), F.col("sharpness"), F.col("color") - 50, F.col("exposure"),
        F.when(F.col("asset_id") % 4 == 0, 30.0).otherwise(0.0), ~F.col("has_target_face"),
    )
    return df.select("asset_id", F.round(score.final, 6).alias("final"))


RULES = [
    Rule("people", ("portrait", "photo", "baby"), ("food",), 1, 3, priority=2, orientation="landscape"),
    Rule("food", ("food", "eating", "birthday"), (), 0, 0, min_sharpness=40.0, min_tag_hits=1),
    Rule("sports", ("running", "swimming", "src1"), ("formal",), orientation="portrait", max_sharpness=60.0),
    Rule("mood", ("happy", "casual", "sunset", "formal"), (), 0, 2, priority=1),
    Rule("rest", is_default=True),
]
_WORDS = "(VALUES (0,'people','portrait'),(0,'people','photo'),(0,'people','baby'),(1,'food','food'),(1,'food','eating'),(1,'food','birthday'),(2,'sports','running'),(2,'sports','swimming'),(2,'sports','src1'),(3,'mood','happy'),(3,'mood','casual'),(3,'mood','sunset'),(3,'mood','formal')) AS w(ord, rule, word)"
_FAMILIES = "(VALUES " + ", ".join(f"('{t}','{f}')" for t, f in a.FAMILY_OF.items()) + ") AS f(tag, family)"
_RULE_SQL = f"""
, t AS (SELECT asset_id, unnest(tags) AS tag FROM assets),
hit AS (SELECT DISTINCT asset_id, ord, tag FROM t JOIN {_WORDS} ON list_contains(string_split(tag, ' '), word) OR tag = word),
fam AS (SELECT asset_id, ord, family, count(*) AS n FROM hit JOIN {_FAMILIES} USING (tag) GROUP BY ALL),
tagpts AS (SELECT asset_id, ord, sum(10 * least(n, 2) + 3 * greatest(n - 2, 0)) AS pts, sum(n) AS hits FROM fam GROUP BY ALL),
base AS (SELECT *, concat(lower(path), ' ', lower(filename)) AS txt, len(tags) > 0 AS has_tags FROM assets),
pathpts AS (SELECT asset_id, ord, count(*) AS hits FROM base JOIN {_WORDS} ON contains(txt, word) GROUP BY ALL),
excl AS (SELECT asset_id, 0 AS ord, count(*) FILTER (list_contains(string_split(tag, ' '), 'food')) AS n FROM t GROUP BY asset_id
  UNION ALL SELECT asset_id, 2, count(*) FILTER (list_contains(string_split(tag, ' '), 'formal')) FROM t GROUP BY asset_id),
scored AS (SELECT asset_id, r.ord, r.rule, coalesce(tp.hits, 0) AS th, coalesce(pp.hits, 0) AS ph,
  coalesce(tp.pts, 0) + coalesce(pp.hits, 0) * CASE WHEN has_tags THEN 2 ELSE 10 END - 20 * coalesce(e.n, 0)
  + CASE r.ord WHEN 0 THEN CASE WHEN face_count BETWEEN 1 AND 3 THEN CASE WHEN coalesce(tp.hits, 0) + coalesce(pp.hits, 0) > 0 THEN 5 ELSE 2 END ELSE -8 END
      WHEN 1 THEN CASE WHEN face_count = 0 THEN CASE WHEN coalesce(tp.hits, 0) + coalesce(pp.hits, 0) > 0 THEN 5 ELSE 2 END ELSE -8 END
      WHEN 3 THEN CASE WHEN face_count <= 2 THEN CASE WHEN coalesce(tp.hits, 0) + coalesce(pp.hits, 0) > 0 THEN 5 ELSE 2 END ELSE -8 END ELSE 0 END
  + CASE WHEN coalesce(tp.hits, 0) + coalesce(pp.hits, 0) > 0 THEN CASE r.ord WHEN 0 THEN 2 + CASE WHEN width > height * 1.2 THEN 3 ELSE 0 END
      WHEN 1 THEN CASE WHEN sharpness >= 40 THEN 3 ELSE 0 END WHEN 2 THEN CASE WHEN width <= height * 1.2 THEN 3 ELSE 0 END + CASE WHEN sharpness <= 60 THEN 3 ELSE 0 END
      WHEN 3 THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN r.ord = 4 THEN 3 ELSE 0 END AS raw, r.ord = 1 AND has_tags AND coalesce(tp.hits, 0) < 1 AS gated
  FROM base CROSS JOIN (VALUES (0,'people'),(1,'food'),(2,'sports'),(3,'mood'),(4,'rest')) AS r(ord, rule)
  LEFT JOIN tagpts tp USING (asset_id, ord) LEFT JOIN pathpts pp USING (asset_id, ord) LEFT JOIN excl e USING (asset_id, ord)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE WHEN gated THEN -999 ELSE raw END DESC, ord) AS n FROM scored)
"""


@query("r9_rule_score", _RULE_SQL + """
SELECT asset_id, max(rule) FILTER (n = 1) AS winner, max(CASE WHEN gated THEN -999 ELSE raw END) FILTER (n = 1) AS score,
  string_agg(concat(rule, ':', CAST(CASE WHEN gated THEN -999 ELSE raw END AS STRING), ':', CAST(th AS STRING), ':', CAST(ph AS STRING)), ' ' ORDER BY n) FILTER (n <= 3) AS top
FROM ranked GROUP BY asset_id""", uses=("assets",))
def r9(spark, d):
    df = a.assets_doc(spark, d).withColumn("_s", r.rule_scores(RULES, a.FAMILY_OF))
    best = r.rule_winner(F.col("_s"))
    shown = F.transform(
        r.rule_top(F.col("_s")),
        lambda e: F.concat_ws(":", e.category, e.score.cast("string"), e.tag_hits.cast("string"), e.path_hits.cast("string")),
    )
    return df.select("asset_id", best.category.alias("winner"), best.score.alias("score"), F.array_join(shown, " ").alias("top"))


@query("j22_rule_matrix", _RULE_SQL + "SELECT asset_id, rule AS category, CASE WHEN gated THEN -999 ELSE raw END AS score FROM scored", uses=("assets",))
def j22(spark, d):
    df = a.assets_doc(spark, d).withColumn("_s", r.rule_scores(RULES, a.FAMILY_OF))
    return df.select("asset_id", F.explode("_s").alias("e")).select("asset_id", F.col("e.category").alias("category"), F.col("e.score").alias("score"))


TITLES = [
    Category("c0", "Beach Sunset", keywords=("beach",)), Category("c1", "Couple Portrait Session"),
    Category("c2", "Family and Friends"), Category("c3", "Scenery"), Category("c4", "Years with Park", keywords=("gift",)),
]
_TITLE_WORDS = "(VALUES (0,'beach'),(0,'beach'),(0,'sunset'),(1,'couple'),(1,'portrait'),(1,'session'),(2,'family'),(2,'friends'),(3,'scenery'),(4,'gift'),(4,'park')) AS w(ord, word)"


@query("r10_categorize_heuristic", f"""
, t AS (SELECT asset_id, unnest(tags) AS tag FROM assets),
th AS (SELECT asset_id, ord, count(DISTINCT tag) AS n FROM t JOIN {_TITLE_WORDS} ON list_contains(string_split(tag, ' '), word) GROUP BY ALL),
best AS (SELECT asset_id, arg_min(ord, (-n, ord)) AS ord FROM th GROUP BY asset_id)
SELECT asset_id, CASE WHEN b.ord IS NOT NULL THEN concat('c', CAST(b.ord AS STRING)) WHEN face_count IN (1, 2) AND sharpness > 40 THEN 'c1' WHEN face_count >= 3 THEN 'c2'
  WHEN face_count = 0 THEN 'c3' ELSE 'c0' END AS category,
  CASE WHEN face_count IN (1, 2) THEN 'c1' WHEN face_count >= 3 THEN 'c2' WHEN face_count = 0 THEN 'c3' END AS refined
FROM assets LEFT JOIN best b USING (asset_id)""", uses=("assets",))
def r10(spark, d):
    df = a.assets_doc(spark, d)
    return df.select(
        "asset_id", r.categorize_heuristic([], a.FAMILY_OF, TITLES).alias("category"),
        r.refine_thematic("path", TITLES).alias("refined"),
    )


_EXPOSURE = """CASE WHEN mean_brightness BETWEEN 80 AND 180 THEN 100e0 WHEN mean_brightness < 40 OR mean_brightness > 230 THEN 20e0
  WHEN mean_brightness < 80 THEN 20 + (mean_brightness - 40) * 2 ELSE 20 + (230 - mean_brightness) * 1.6e0 END"""
_R1 = "round_even({} * 10, 0) / 10"


def _r1(x: str) -> str:
    return f"CAST(round_even(({x}) * 10e0, 0) / 10e0 AS DOUBLE)"


_GRADE_SQL = f"""
, m AS (SELECT *, CAST(width AS DOUBLE) * height / 1e6 AS mp, {_EXPOSURE} AS ex, CASE WHEN width / height BETWEEN 0.6 AND 1.8 THEN 100e0 WHEN width / height < 0.4 OR width / height > 3 THEN 30e0 ELSE 65e0 END AS aspect FROM evt),
p AS (SELECT *, least(100, greatest(0, 20 + mp * 10)) AS s_res, least(100, greatest(0, sharpness_var / 8)) AS s_sharp, least(100, greatest(0, 100 - noise_std * 5)) AS s_noise,
  least(100, greatest(0, size_kb / greatest(mp, 0.01e0) / 15)) AS s_comp, least(100, mean_saturation / 1.5e0) * 0.4e0 + least(100, greatest(0, (p95 - p5) / 2)) * 0.6e0 AS s_color,
  least(100, greatest(0, ex + CASE WHEN brightness_std BETWEEN 30 AND 80 THEN 0 WHEN brightness_std < 15 THEN -15 WHEN brightness_std > 100 THEN -10 ELSE -5 END)) AS s_expo,
  CASE WHEN center_var > 20 THEN least(100, least(100, center_var / 8) + CASE WHEN edge_var > 0 AND center_var / greatest(edge_var, 1) > 1.5 THEN 5 ELSE 0 END) ELSE greatest(0, center_var / 8 * 100) END AS s_focus,
  CASE WHEN least(width, height) < 500 THEN greatest(0, aspect - 20) ELSE aspect END AS s_dist FROM m)
"""


@query("r11_photo_grade", _GRADE_SQL + f"""
SELECT asset_id, {_r1('s_res')} AS resolution, {_r1('s_sharp')} AS sharpness, {_r1('s_noise')} AS noise, {_r1('s_comp')} AS compression, {_r1('s_color')} AS color, {_r1('s_expo')} AS exposure,
  {_r1('s_focus')} AS focus, {_r1('s_dist')} AS distortion, {_r1('sharpness_var')} AS blur_score,
  abs(s_res * 0.1e0 + s_sharp * 0.2e0 + s_noise * 0.1e0 + s_comp * 0.05e0 + s_color * 0.1e0 + s_expo * 0.15e0 + s_focus * 0.2e0 + s_dist * 0.1e0 - {_r1('s_res * 0.1e0 + s_sharp * 0.2e0 + s_noise * 0.1e0 + s_comp * 0.05e0 + s_color * 0.1e0 + s_expo * 0.15e0 + s_focus * 0.2e0 + s_dist * 0.1e0')}) < 0.0501 AS composite_close,
  {_r1('s_res * 0.1e0 + s_sharp * 0.2e0 + s_noise * 0.1e0 + s_comp * 0.05e0 + s_color * 0.1e0 + s_expo * 0.15e0 + s_focus * 0.2e0 + s_dist * 0.1e0')} AS composite FROM p""", uses=("evt",))
def r11(spark, d):
    df = a.assets_evt(spark, d).withColumn("grade", grading.photo_grade())
    return df.select("asset_id", *[F.col(f"grade.{n}").alias(n) for n in (*grading.COMPOSITE_WEIGHTS, "composite", "blur_score")], F.lit(True).alias("composite_close"))


@query("r11_video_grade", _GRADE_SQL + f"""
SELECT asset_id, {_r1('CASE WHEN mp >= 20 THEN 100 WHEN mp >= 12 THEN 90 WHEN mp >= 5 THEN 70 WHEN mp >= 2 THEN 50 ELSE greatest(20, mp / 0.5 * 20) END')} AS resolution,
  {_r1("least(100, greatest(0, 80 + CASE WHEN mean_brightness < 60 OR mean_brightness > 210 THEN -30 WHEN mean_brightness < 80 OR mean_brightness > 180 THEN -10 ELSE 0 END + CASE WHEN brightness_std < 20 THEN -15 WHEN brightness_std > 90 THEN -10 ELSE 0 END))")} AS exposure,
  {_r1('least(100, center_var / 8)')} AS focus, {_r1('least(100, greatest(0, size_kb / 30e0 / greatest(mp, 0.1e0) / 15))')} AS compression, 80e0 AS distortion FROM p""", uses=("evt",))
def r11b(spark, d):
    df = a.assets_evt(spark, d).withColumn("kb_per_frame", F.col("size_kb") / 30.0).withColumn("grade", grading.photo_grade(video=True))
    return df.select("asset_id", *[F.col(f"grade.{n}").alias(n) for n in ("resolution", "exposure", "focus", "compression", "distortion")])


@query("r12_grade_report", _GRADE_SQL + f"""
, parts AS (SELECT *, {_r1('s_res * 0.25e0 + s_comp * 0.15e0 + s_sharp * 0.4e0 + ex * 0.2e0')} AS technical,
  CASE WHEN face_count > 0 THEN {_r1(f"least(face_count * 30 + 40, 100) * 0.2e0 + {_r1('least(face_ratio * 500, 100)')} * 0.35e0 + {_r1('least(face_sharpness_var / 5, 100)')} * 0.45e0")} ELSE 0e0 END AS face,
  {_r1(f"aspect * 0.3e0 + CASE WHEN center_x IS NULL THEN 50 ELSE {_r1('greatest(30, 100 - sqrt(abs(center_x - 0.5e0) * abs(center_x - 0.5e0) + abs(center_y - 0.45e0) * abs(center_y - 0.45e0)) * 200)')} END * 0.7e0")} AS composition,
  {_r1('greatest(0e0, (1 - face_distance / 0.8e0) * 100)')} AS recognition,
  {_r1(f"s_res * 0.1e0 + s_sharp * 0.25e0 + ex * 0.15e0 + {_r1('least(face_ratio * 500, 100)')} * 0.2e0 + least(face_sharpness_var / 5, 100) * 0.3e0")} AS scan FROM p)
SELECT asset_id, technical, face, composition, recognition, scan,
  CASE WHEN recognition IS NOT NULL THEN {_r1('technical * 0.2e0 + face * 0.3e0 + greatest(recognition, 10) * 0.25e0 + composition * 0.25e0')} ELSE {_r1('technical * 0.25e0 + face * 0.4e0 + composition * 0.35e0')} END AS overall FROM parts""", uses=("evt",))
def r12(spark, d):
    df = a.assets_evt(spark, d).withColumns(
        {"technical": grading.technical_grade(), "face": grading.face_grade(),
         "composition": grading.composition_grade(F.col("center_x"), F.col("center_y")),
         "recognition": grading.recognition_score(F.col("face_distance")), "scan": grading.scan_grade()}
    )
    scores = F.when(
        F.col("recognition").isNotNull(), F.create_map(F.lit("a"), F.col("recognition"), F.lit("b"), F.lit(10.0))
    ).otherwise(F.create_map().cast("map<string,double>"))
    overall = grading.overall_grade(F.col("technical"), F.col("face"), F.col("composition"), scores)
    return df.select("asset_id", "technical", "face", "composition", "recognition", "scan", overall.alias("overall"))


@query("r13_grid_measures", """
, g AS (SELECT vec_id, CAST(v AS DOUBLE[]) AS v, list_transform(range(0, 36), lambda i: (i // 6 + 1) * 8 + i % 6 + 1) AS inner_cells, list_transform(range(0, 16), lambda i: (i // 4 + 2) * 8 + i % 4 + 2) AS centre_cells FROM vectors),
l AS (SELECT *, list_transform(inner_cells, lambda c: v[c] + v[c + 2] + v[c - 7] + v[c + 9] - 4 * v[c + 1]) AS li, list_transform(centre_cells, lambda c: v[c] + v[c + 2] + v[c - 7] + v[c + 9] - 4 * v[c + 1]) AS lc FROM g)
SELECT vec_id, round(list_avg(v), 6) AS mean_brightness, round(list_stddev_pop(v), 6) AS brightness_std, round(list_aggregate(v, 'quantile_cont', 0.05), 6) AS p5, round(list_aggregate(v, 'quantile_cont', 0.95), 6) AS p95,
  round(list_var_pop(li), 6) AS sharpness_var, round(list_var_pop(lc), 6) AS center_var, round(list_var_pop(list_concat(li[1:6], li[31:36])), 6) AS edge_var FROM l""", uses=("vectors",))
def r13(spark, d):
    measures = grading.grid_measures("v", 8, 8)
    return a.vectors(spark, d).select("vec_id", *[F.round(c, 6).alias(n) for n, c in measures.items()])


@query("r14_raw_quality", """
SELECT asset_id, px * (b / 1024) AS pixels_kb, px * b AS pixels_bytes, round(least(px / 6e6, 1) * 0.6e0 + least(b / 3145728, 1) * 0.4e0, 9) AS capped_6mp,
  round(least(px / 12e6, 1) * 0.6e0 + least(b / 4194304, 1) * 0.4e0, 9) AS capped_12mp, px AS pixels
FROM (SELECT asset_id, CAST(width AS DOUBLE) * height AS px, size_kb * 100e0 AS b FROM assets)""", uses=("assets",))
def r14(spark, d):
    df = a.assets_doc(spark, d).withColumn("size_bytes", F.col("size_kb") * 100)
    forms = {v: grading.raw_quality(v) for v in ("pixels_kb", "pixels_bytes", "capped_6mp", "capped_12mp", "pixels")}
    return df.select("asset_id", *[(F.round(c, 9) if n.startswith("capped") else c).alias(n) for n, c in forms.items()])


def _descent(features: list[str], rounds: int = 80, adjust: str = "w") -> str:
    """Recursive SQL: one row per round with the coefficients as a list, bias first."""
    k = len(features)
    xs = ", ".join(f"{e} AS x{i}" for i, e in enumerate(features))
    z = " + ".join(["w[1]"] + [f"w[{i + 2}] * x{i}" for i in range(k)])
    grads = ", ".join(["sum(e)"] + [f"sum(e * x{i})" for i in range(k)])
    return f"""
, x AS (SELECT asset_id, preference, CASE preference WHEN 'like' THEN 1e0 ELSE 0e0 END AS y, {xs} FROM assets),
fit AS (SELECT 0 AS i, list_transform(range(0, {k + 1}), lambda j: 0e0) AS w
  UNION ALL SELECT i + 1, list_transform(range(1, {k + 2}), lambda j: w[j] - 0.5e0 * g[j] / n) FROM (
    SELECT i, w, [{grads}] AS g, count(*) AS n FROM (
      SELECT i, w, x.*, 1 / (1 + exp(-greatest(-10e0, least(10e0, {z})))) - y AS e FROM fit, x WHERE i < {rounds} AND preference IS NOT NULL) GROUP BY i, w)),
coef AS (SELECT {adjust} AS w FROM fit WHERE i = {rounds}),
p AS (SELECT x.*, 1 / (1 + exp(-greatest(-10e0, least(10e0, {z})))) AS p FROM x, coef)
"""


_FEATURES = [
    *[f"{c} / 100" for c in ("resolution", "sharpness", "noise", "compression", "color", "exposure", "focus")],
    "coalesce(composite, 50) / 100", "least(face_count / 5e0, 1)", "CAST(has_target_face AS INT)", "coalesce(1 - face_distance, 0.5e0)",
    "least(size_kb / 5000e0, 1)", "CAST(media_type = 'video' AS INT)",
]
_VIEW_FEATURES = [
    *_FEATURES[:7], "distortion / 100", *_FEATURES[7:11], "size_kb / 5000e0", "CAST(width AS DOUBLE) * height / 2e7", _FEATURES[12],
]


@query("g23_train_preference", _descent(_FEATURES) + "SELECT asset_id, preference, round(p, 6) AS probability FROM p", uses=("assets",), recursive=True)
def g23(spark, d):
    df = a.assets_doc(spark, d)
    model = preference.train_preference(df)
    return df.select("asset_id", "preference", F.round(model.probability(), 6).alias("probability"))


_QUIZ_SHIFT = "list_transform(w, lambda x, i: x + CASE i WHEN 3 THEN 0.3e0 WHEN 8 THEN 0.3e0 WHEN 11 THEN 0.5e0 ELSE 0 END)"


@query("r8_predicted_preference", _descent(_VIEW_FEATURES, adjust=_QUIZ_SHIFT) + """
SELECT asset_id, CASE WHEN preference IS NOT NULL THEN 0e0 ELSE round((p - 0.5e0) * 10, 6) END AS score,
  CASE WHEN preference IS NOT NULL THEN 0e0 ELSE round(greatest(0, 2 * (1 - abs(p - 0.5e0) * 2)), 6) END AS exploration,
  CASE WHEN p > 0.65 THEN 'like' WHEN p < 0.35 THEN 'dislike' END AS label, CAST(floor(abs(p - 0.5e0) * 200 + 0.5e0) AS INT) AS confidence FROM p""", uses=("assets",), recursive=True)
def r8(spark, d):
    df = a.assets_doc(spark, d)
    model = preference.train_preference(df, form="view").with_quiz(Quiz(faces="many", sharpness="high"))
    score, explore = preference.predicted_preference(model)
    label, confidence = preference.predicted_label(model)
    return df.select(
        "asset_id", F.round(score, 6).alias("score"), F.round(explore, 6).alias("exploration"), label.alias("label"),
        confidence.alias("confidence"),
    )
