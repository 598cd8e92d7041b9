"""Readers, writers and round trips on small files."""

import hashlib
import json

from pyspark.sql import functions as F

from lumisift.config import Category, categories_from_rows
from lumisift.functions.names import file_key
from lumisift.operators import joins
from lumisift.sources import exports, files


def test_scan_media(spark, tmp_path):
    for name in ("a/IMG_1.JPG", "a/b/clip.MOV", "a/notes.txt", "a/b/IMG_1.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    other = tmp_path / "usb"
    other.mkdir()
    (other / "x.heic").write_bytes(b"x" * 70000)
    scanned = files.scan_media(spark, [(str(tmp_path / "a"), "disk"), (str(other), "usb")], with_content=True)
    rows = {r.filename: r for r in scanned.withColumn("key", file_key("length", "content")).collect()}
    assert set(rows) == {"IMG_1.JPG", "clip.MOV", "IMG_1.png", "x.heic"}
    assert rows["clip.MOV"].is_video and not rows["x.heic"].is_video
    assert (rows["x.heic"].source_label, rows["x.heic"].source_ord) == ("usb", 1)
    data = b"x" * 70000
    assert rows["x.heic"].key == hashlib.md5(b"70000" + data[:65536]).hexdigest()


def test_scan_without_content_does_not_read_it(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"1")
    plan = files.scan_media(spark, [(str(tmp_path), "disk")])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_album_feed(spark, tmp_path):
    items = [
        {"id": "1", "filename": "a.jpg", "mimeType": "image/jpeg", "mediaMetadata": {"width": "10", "height": "20"}},
        {"id": "2", "filename": "b.mp4", "mimeType": "video/mp4", "mediaMetadata": {}},
        {"id": "3", "filename": "c.jpg", "mimeType": "image/jpeg", "mediaMetadata": {"video": {"fps": "30"}}},
        {"id": "4", "filename": "d.x", "mimeType": "application/x", "mediaMetadata": {}},
    ]
    (tmp_path / "feed.json").write_text(json.dumps({"mediaItems": items}))
    rows = files.read_album_feed(spark, str(tmp_path / "feed.json")).collect()
    assert [(r.id, r.width, r.height) for r in rows] == [("1", 10, 20)]


def test_catalog_import_and_round_trip(spark, tmp_path):
    images = [
        {"hash": "h1", "path": "/a", "date": "2020-02-30", "dhash": 2**64 - 1, "photo_grade": {"composite": 5.5},
         "tag_meta": {"scores": {"beach": 0.3}}, "unknown": 1},
        {"hash": "h2", "path": "/b", "date": "2020-02-29", "dhash": 5, "faces_found": ["x"]},
    ]
    (tmp_path / "db.json").write_text(json.dumps({"scan_date": "2020", "images": images}))
    df = files.import_catalog(spark, str(tmp_path / "db.json"))
    rows = {r.hash: r for r in df.collect()}
    assert rows["h1"].dhash == -1 and rows["h2"].dhash == 5
    assert rows["h1"].date is None and str(rows["h2"].date) == "2020-02-29"
    assert rows["h1"].photo_grade.composite == 5.5 and rows["h1"].tag_meta.scores == {"beach": 0.3}
    files.write_catalog(df, str(tmp_path / "store"), "1")
    back = files.read_catalog(spark, str(tmp_path / "store"), "1")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_templates(spark, tmp_path):
    trip = {
        "event_type": "trip", "display_name": "Trip", "categorization": "date_time_ranges", "required_fields": {"b": "x", "a": "y"},
        "categories": [{"id": "z", "display": "Z", "target": 5, "day_offset": 1}, {"id": "a", "display": "A", "keywords": ["food"], "day_offset": -1}],
    }
    (tmp_path / "trip.json").write_text(json.dumps(trip))
    templates = files.read_templates(spark, str(tmp_path))
    row = files.list_templates(templates).first()
    assert (row.event_type, row.num_categories, row.required_fields) == ("trip", 2, ["a", "b"])
    cats = files.load_template(spark, str(tmp_path), "trip")
    assert [c.id for c in cats] == ["z", "a"] and cats[1].keywords == ("food",) and cats[0].day_offset == 1
    assert categories_from_rows(files.template_categories(templates)) == cats


def test_changes_file(spark, tmp_path):
    rows = [{"hash": "1", "category": "a", "status": "qualified"}, {"hash": "2", "category": None, "status": "qualified"},
            {"hash": "3", "category": "a", "status": "pool"}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    assert [r.hash for r in files.read_changes(spark, str(tmp_path / "c.json")).collect()] == ["1"]


def test_sidecars(spark):
    assets = spark.createDataFrame([("/a/x.jpg",), ("/a/y.jpg",), ("/a/z.jpg",)], "path string")
    body = lambda key, ts: json.dumps({key: {"timestamp": str(ts)}})
    side = spark.createDataFrame(
        [("/a/x.jpg.json", body("photoTakenTime", 100)), ("/a/x.json", body("photoTakenTime", 200)), ("/a/y.json", body("creationTime", 300))],
        "path string, body string",
    )
    got = {r.path: r.sidecar_at and int(r.t) for r in joins.join_sidecar(assets, side).withColumn("t", F.unix_timestamp("sidecar_at")).collect()}
    assert got == {"/a/x.jpg": 100, "/a/y.jpg": 300, "/a/z.jpg": None}


def test_plans_and_manifests(spark, tmp_path):
    df = spark.createDataFrame(
        [("h1", "/1", "a.jpg", "c", "selected"), ("h2", "/2", "a.jpg", "c", "selected"), ("h3", "/3", "b", None, "selected"), ("h4", "/4", "d.jpg", "c", "pool")],
        "hash string, path string, filename string, category string, status string",
    )
    plan = exports.export_plan(df)
    assert {(r.hash, r.dest) for r in plan.collect()} == {("h1", "c/a.jpg"), ("h2", "c/a_1.jpg"), ("h3", "uncategorized/b")}
    exports.write_export_plan(plan, str(tmp_path / "plan"))
    assert spark.read.json(str(tmp_path / "plan")).filter("category = 'c'").count() == 2
    manifest = exports.selection_manifest(df.withColumns({"date": F.lit("2020-01-01"), "score": F.lit(1.0)}), {"min_kb": 80})
    exports.write_manifest(manifest, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).first().filters.min_kb == 80
    exports.write_analysis({"rows": df.groupBy("status").count()}, str(tmp_path / "analysis"))
    assert spark.read.json(str(tmp_path / "analysis/rows")).count() == 2


def test_config_sets(spark):
    old = spark.createDataFrame([(["b", "a"], ["x"])], "sources array<string>, names array<string>")
    assert joins.config_equal(old, ["a", "b"], ["x"]) and not joins.config_equal(old, ["a"], ["x"])
    assert not joins.config_equal(None, [], [])
    row = spark.range(1).select(joins.same_set(F.array(F.lit(1), F.lit(2), F.lit(1)), F.array(F.lit(2), F.lit(1))).alias("same")).first()
    assert row.same


def test_resolve_categories(spark):
    from lumisift.operators.aggregates import resolve_categories

    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "category string")
    assert [c.id for c in resolve_categories([], [], df, 9)] == ["a", "b"]
    assert resolve_categories([Category("x")], [Category("y")], df) == [Category("x")]
    assert resolve_categories([], [Category("y")], df) == [Category("y")]


def test_file_key_of_whole_contents(spark):
    from hashlib import md5

    long = b"a" * 65536
    df = spark.createDataFrame([(1, long + b"b"), (2, long + b"c"), (3, b"d")], "id long, content binary")
    rows = df.select("content", file_key(F.octet_length("content"), "content").alias("head"),
                     file_key(F.octet_length("content"), "content", None).alias("whole")).collect()
    for r in rows:
        size, content = str(len(r.content)).encode(), bytes(r.content)
        assert (r.head, r.whole) == (md5(size + content[:65536]).hexdigest(), md5(size + content).hexdigest())


def test_texts_beyond_64_kib_equal_their_sql(spark, tmp_path):
    import __spark_entry__ as entry
    from tests.compare import compare

    import duckdb

    text = "word " * 14000
    spark.createDataFrame([(1, text + "x", len(text) + 1), (2, text + "y", len(text) + 1)], "doc_id long, text string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "c1_file_key"
    assert compare(name, spark, con, str(tmp_path), entry.queries()[name], entry.oracle_sql()[name]) is None
