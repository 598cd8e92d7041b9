"""Null groups, unusable vectors, malformed numbers and change logs."""

import datetime

from pyspark.sql import functions as F

from lumisift.functions.dates import folder_hint_date
from lumisift.functions.names import burst_key, last_number
from lumisift.operators import greedy, joins, windows
from lumisift.operators import similarity as s


def test_unusable_vectors_match_nothing(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0]), (6, [1.0]), (7, [1.0, None]), (8, None),
            (9, [0.6, 0.8]), (10, [0.6, 0.8, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    for size in (2, None):
        got = {(r.a_id, r.b_id): round(r.score, 6) for r in s.similar_pairs(df, "id", "v", 0.9, chunk_rows=size).collect()}
        assert got == {(3, 4): 1.0, (5, 6): 1.0}
        assert {(r.a_id, r.b_id) for r in s.similar_links(df, "id", "v", 0.9, chunk_rows=size).collect()} == {(3, 4), (5, 6)}
    half = df.withColumn("v", F.transform("v", lambda x: (x * 0.5).cast("float")))
    assert s.similar_pairs(half, "id", "v", 0.9).count() == 0
    kept = greedy.greedy_diverse(df.filter("id < 5"), ["id"], 0.9, None, "id", "v")
    assert {r.id for r in kept.collect()} == {1, 2, 3}


def test_cells_and_grid_agree(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6))
    v = np.concatenate([c + rng.normal(scale=0.05, size=(25, 6)) for c in centres])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    rows = s._vectors(df, "id", "v", [], False)
    assert s._layout(rows, s._radius(0.98), 8).pivots is not None  # cells prune tight clusters
    assert s._layout(rows, s._radius(-0.5), 8).pivots is None  # everything is near everything
    cos = v.astype("float64") @ v.astype("float64").T
    for t in (0.98, 0.3):
        want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if cos[i, j] >= t}
        assert {(r.a_id, r.b_id) for r in s.similar_pairs(df, "id", "v", t, chunk_rows=8).collect()} == want


def test_null_groups_stay(spark):
    rows = [(i, None if i % 2 else "a", [float(i), 1.0], 100 - i) for i in range(8)]
    df = spark.createDataFrame(rows, "hash long, category string, v array<float>, score int")
    unit = df.withColumn("v", F.transform("v", lambda x: (x / F.sqrt(F.get("v", 0) ** 2 + 1)).cast("float")))
    for k in (2, None):
        got = {r.category for r in greedy.greedy_diverse(unit, ["-score"], 0.999999, k, by=["category"]).collect()}
        assert got == {None, "a"}
    assert windows.round_robin(df, F.lit(None).cast("int"), "score", {}).count() == 8
    assert windows.evenly_spaced(df, ["category"], ["hash"], 2).count() == 4
    assert windows.evenly_spaced(df, ["category"], ["hash"], 9).count() == 8


def test_burst_cap_with_dates_and_null_groups(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(i, None, "IMG_", i, day + datetime.timedelta(days=i)) for i in range(4)]
    df = spark.createDataFrame(rows, "hash long, category string, prefix string, seq long, taken date")
    got = {r["hash"] for r in greedy.burst_cap(df, ["-taken"], ["category"], "prefix", "seq", "hash", 2, 5).collect()}
    assert got == {3, 2}
    pairs = joins.burst_pairs(df, ["category"], "seq", "hash", 1).collect()
    assert {(r.a_id, r.b_id) for r in pairs} == {(0, 1), (1, 2), (2, 3)}


def test_malformed_numbers(spark):
    long = "IMG_" + "1" * 3 + "9" * 18
    df = spark.createDataFrame([(f"/a/{long}.jpg",), ("/a/IMG_0042.jpg",), ("/a/x12.jpg",), ("/a/IMG_0042",)], "path string")
    got = [r.b for r in df.select(burst_key("path").alias("b")).collect()]
    assert tuple(got[0]) == ("/a", "IMG_111", 999999999999999999) and tuple(got[1]) == ("/a", "IMG_", 42) and got[2] is got[3] is None
    assert [r[0] for r in df.select(last_number(F.lit(long + ".jpg"))).collect()][0] == 999999999999999999
    hints = spark.createDataFrame([("99999999999 years",), ("2 years",), ("age 123456789012",)], "f string")
    got = [r[0] for r in hints.select(folder_hint_date("f", "2020-01-01")).collect()]
    assert got[0] is None and got[1] == datetime.date(2021, 12, 31) and got[2] is None
    assets = spark.createDataFrame([("p/a.jpg",), ("p/b.jpg",), ("p/c.jpg",)], "path string")
    sides = [("p/a.jpg.json", '{"photoTakenTime": {"timestamp": "n/a"}}'), ("p/a.json", '{"creationTime": {"timestamp": "86400"}}'),
             ("p/b.jpg.json", '{"photoTakenTime": {"timestamp": "99999999999999999"}}'), ("p/c.json", "{broken")]
    out = {r.path: r.sidecar_at for r in joins.join_sidecar(assets, spark.createDataFrame(sides, "path string, body string")).collect()}
    assert out["p/a.jpg"] == datetime.datetime(1970, 1, 2) and out["p/b.jpg"] is None and out["p/c.jpg"] is None


def test_changes_apply_by_field(spark):
    assets = spark.createDataFrame(
        [("a", "c0", "pool", "old", None, None), ("b", "c0", "qualified", None, "like", True), ("c", "c0", "selected", "kept", None, False)],
        "hash string, category string, status string, reject_reason string, preference string, trash boolean")
    log = [("a", 1, "move", "moved", "qualified", "like", None, None), ("a", 2, None, None, None, None, None, True),
           ("b", 1, None, None, None, None, True, None), ("b", 2, "save", None, "pool", None, None, False),
           ("c", 1, "deselect", None, "qualified", None, None, None), ("c", 2, "move", None, "pool", None, None, False)]
    changes = spark.createDataFrame(log, "hash string, ts int, action string, to_category string, new_status string, preference string, "
                                         "clear_preference boolean, trash boolean")
    got = {r["hash"]: tuple(r)[1:6] for r in joins.apply_changes(assets, changes).orderBy("hash").collect()}
    assert got == {"a": ("moved", "qualified", None, "like", True), "b": ("c0", "pool", "manual_reject", None, False),
                   "c": ("c0", "pool", "manual_reject", None, False)}
    one = changes.withColumn("request", F.lit("r"))  # items of one request: the last of a key counts whole
    got = {r["hash"]: (r.category, r.trash) for r in joins.apply_changes(assets, one).collect()}
    assert got["a"] == ("c0", True)
