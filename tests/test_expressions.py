"""Expressions, guards and hooks that the SQL comparison does not reach."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumisift.config import Category, Rule, lookup
from lumisift.operators import filters, hooks, joins, preference, rules, windows


def test_scorer_sees_only_the_wanted_rows(spark):
    @F.pandas_udf("double")
    def scorer(x: pd.Series) -> pd.Series:
        assert (x % 2 == 0).all()
        return x * 10.0

    out = hooks.score_with(spark.range(10), scorer, ["id"], "age", F.col("id") % 2 == 0)
    assert {(r.id, r.age) for r in out.collect()} == {(i, i * 10.0 if i % 2 == 0 else None) for i in range(10)}


def test_unsafe_detections(spark):
    rows = [("a", [("X", 0.6)]), ("b", [("X", 0.59)]), ("c", [("Y", 0.9)]), ("d", None)]
    df = spark.createDataFrame(rows, "hash string, det array<struct<class:string,score:double>>")
    df = df.withColumns({"status": F.lit("qualified"), "reject_reason": F.lit(None).cast("string")})
    got = {r.hash: (r.nsfw, r.status, r.reject_reason) for r in hooks.mark_unsafe(df, "det", ["X"]).collect()}
    assert got["a"] == (True, "rejected", "nsfw")
    assert all(got[k] == (False, "qualified", None) for k in "bcd")


def test_burst_sessions_by_number_and_looks(spark):
    names = [
        ("IMG_20220428_235958.jpg", [1.0, 0.0]), ("IMG_20220428_235959.jpg", [0.0, 1.0]),
        ("IMG_20220429_135959.jpg", [1.0, 0.0]), ("IMG_20220429_140000.jpg", [1.0, 0.0]),
        ("X_100.jpg", [1.0, 0.0]), ("X_103.jpg", [1.0, 0.01]), ("X_104.jpg", [0.0, 1.0]), ("X_108.jpg", [0.0, 1.0]), ("Y_109.jpg", [0.0, 1.0]),
    ]
    df = spark.createDataFrame([("f", n, h) for n, h in names] + [("g", "X_101.jpg", [1.0, 0.0])], "folder string, name string, h array<double>")
    out = windows.burst_sessions(df, "folder", "name", "h").collect()
    groups = {}
    for r in out:
        groups.setdefault(r.burst_id, []).append(r.name)
    found = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    # 13:59:59 and 14:00:00 are one second apart
    assert found == [
        ["IMG_20220428_235958.jpg", "IMG_20220428_235959.jpg"], ["IMG_20220429_135959.jpg", "IMG_20220429_140000.jpg"], ["X_100.jpg", "X_103.jpg"],
    ]


def test_nearest_place_everywhere(spark):
    rng = np.random.default_rng(1)
    places = [(i, f"p{i}", "AA", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)))]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)))]
    points += [(300, 90.0, 0.0), (301, -90.0, 77.0), (302, 10.0, 179.999), (303, 10.0, -179.999), (304, None, None)]
    g = spark.createDataFrame(places, "place_id long, name string, cc string, lat double, lon double")
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    got = {r.id: r.location for r in joins.nearest_place(p, g).collect()}

    def xyz(lat, lon):
        a, o = np.radians(lat), np.radians(lon)
        return np.array([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])

    table = np.array([xyz(x[3], x[4]) for x in places])
    for i, lat, lon in points[:-1]:
        best = int(((table - xyz(lat, lon)) ** 2).sum(1).argmin())
        assert got[i] == f"p{best}, AA"
    assert got[304] is None


def test_bursts_of_equal_numbers_form_a_star(spark):
    df = spark.createDataFrame([(i, "p", 7) for i in range(6)] + [(6, "p", 9), (7, "p", 20), (8, "q", 8)], "id long, p string, n long")
    got = {(r.a_id, r.b_id, r.distance) for r in joins.burst_pairs(df, ["p"], "n", "id").collect()}
    assert got == {(0, i, 0) for i in range(1, 6)} | {(0, 6, 2)}


def test_few_ratings_leave_the_model_untrained(spark):
    df = spark.createDataFrame([("like",), ("dislike",), (None,)], "preference string")
    for name in ("resolution", "sharpness", "noise", "compression", "color", "exposure", "focus", "distortion", "composite", "face_distance"):
        df = df.withColumn(name, F.lit(None).cast("double"))
    df = df.withColumns({"face_count": F.lit(0), "has_target_face": F.lit(False), "size_kb": F.lit(1), "media_type": F.lit("image"),
                         "width": F.lit(1), "height": F.lit(1)})
    model = preference.train_preference(df)
    assert model.weights is None
    score, explore = preference.predicted_preference(model)
    assert {tuple(r) for r in df.select(score, explore).collect()} == {(0.0, 0.0), (0.0, 1.0)}


def test_rules_with_tags_outside_the_vocabulary(spark):
    df = spark.createDataFrame(
        [(["dog park", "cat"], "/a", "x.jpg"), (["dog"], "/a", "x.jpg"), ([], "/dog", "x.jpg")], "tags array<string>, path string, filename string"
    ).withColumns({"face_count": F.lit(0), "width": F.lit(10), "height": F.lit(10), "sharpness": F.lit(50.0)})
    listed = [Rule("pets", ("dog", "cat"), ("park",)), Rule("rest", is_default=True)]
    scores = rules.rule_scores(listed, {"cat": "animals"})
    got = [[e.score for e in r.s] for r in df.select(scores.alias("s")).collect()]
    # two tag hits of two families minus one exclusion; one tag hit; one path hit without tags
    assert got == [[0, 3], [10, 3], [10, 3]]


def test_refinement_flags(spark):
    cats = [Category("day", day_offset=1), Category("theme", day_offset=-1), Category("year", month_from=1, month_to=12)]
    df = spark.createDataFrame([("day",), ("theme",), ("year",), (None,)], "category string")
    got = [r.x for r in df.select(rules.needs_refinement("category", cats).alias("x")).collect()]
    assert got == [False, True, True, False]


def test_dimensions_beyond_five_thousand(spark):
    cats = [Category(f"c{i}", age_days_from=i, age_days_to=i + 1) for i in range(5200)]
    words = [Category("many", keywords=tuple(f"w{i}x" for i in range(6000))), Category("two", keywords=("w7x", "w8x"))]
    df = spark.createDataFrame([(0, "a/w7x"), (5199, "w8x w9x w7x"), (5200, None), (None, "none")], "days int, path string")
    got = df.select(
        joins.bracket_of("days", cats).alias("b"), joins.keyword_match("path", words).alias("k"),
        lookup(F.col("days"), {i: i * 2 for i in range(6000)}).alias("l")).collect()
    assert [tuple(r) for r in got] == [("c0", "many", 0), ("c5199", "many", 10398), (None, None, 10400), (None, None, None)]
    left = filters.exclude_paths(df.filter("path is not null"), [f"w{i}x" for i in range(8, 6008)], ["zz"])
    assert sorted(r.path for r in left.collect()) == ["a/w7x", "none"]


def test_references_beyond_a_block(spark):
    refs = spark.range(30).select(F.col("id").cast("string").alias("person"), F.array(F.col("id").cast("double")).alias("enc"))
    faces = spark.createDataFrame([(1, [3.0]), (1, [29.0]), (2, None), (2, [None]), (3, [100.0]), (3, [1.0, 2.0])],
                                  "hash long, enc array<double>")
    for block in (7, 1000):
        got = {r["hash"]: (r.face_count, r.faces_found, r.face_distance) for r in
               joins.match_faces(faces, refs, 0.5, block_rows=block).collect()}
        assert got == {1: (2, ["29", "3"], 0.0), 2: (2, [], None), 3: (2, [], 71.0)}
    none = {r["hash"]: (r.face_count, r.faces_found) for r in joins.match_faces(faces, refs.limit(0)).collect()}
    assert none == {1: (2, []), 2: (2, []), 3: (2, [])}


def test_vocabulary_of_any_size(spark):
    from lumisift.operators.similarity import tag_similarity

    faces = spark.range(1).select(F.col("id").alias("hash"), F.array_repeat(F.lit(1.0), 10).alias("enc"))
    vocabulary = [(f"t{i}", "b", [float(i)] * 10) for i in range(10)]
    whole = tag_similarity(faces, vocabulary, "hash", "enc").collect()
    assert [t.tag for t in whole[0].scores] == [f"t{i}" for i in range(9, -1, -1)]
    assert tag_similarity(faces, vocabulary, "hash", "enc", max_bytes=100).collect() == whole
