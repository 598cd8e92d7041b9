"""Streams over the events table (T1-T7), run to the end of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import quality_gate
from ..session import ensure_checkpoint_dir
from ..streaming import streams as st
from . import adapters as a
from .registry import query


def scratch(spark: SparkSession) -> str:
    """New folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = a.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return st.utc(raw).withColumns({"category": F.col("event_type"), "hash": F.md5(F.concat_ws("|", "user_id", "event_type"))})


def finish(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all its input and read its last result: with ``keys``, the last row of each key."""
    spark = df.sparkSession
    folder = scratch(spark)
    job = (
        df.writeStream.outputMode(mode).foreachBatch(st.log_batches(folder + "/out"))
        .option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    log = st.read_log(spark, folder + "/out")
    if keys:
        rest = [c for c in log.columns if c not in (*keys, "batch_id")]
        return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")
    if mode != "complete":
        return log
    # every batch of a complete stream holds the whole result; the last one counts
    last = log.agg(F.max("batch_id").alias("_last"))
    return log.join(last, F.col("batch_id") == F.col("_last")).drop("_last")


@query("t1_ingest_stream", """
SELECT category, count(*) AS n, min(asset_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY asset_id) AS r FROM (
  SELECT event_id AS asset_id, event_type AS category, md5(concat(CAST(user_id AS STRING), '|', event_type)) AS hash, 400 + (event_id * 37) % 4000 AS w, 300 + (event_id * 53) % 3000 AS h, 40 + (event_id * 71) % 5000 AS kb FROM events)
  WHERE kb >= 80 AND NOT (w < 600 AND h < 600)) WHERE r = 1 GROUP BY category""")
def t1(spark, d):
    folder = scratch(spark)
    n = F.col("event_id")
    files = events_stream(spark, d).select(
        "hash", n.alias("asset_id"), "category", F.format_string("/lib/%010d.jpg", n).alias("path"), F.lit("events").alias("source_label"),
        (F.lit(400) + (n * 37) % 4000).alias("width"), (F.lit(300) + (n * 53) % 3000).alias("height"), (F.lit(40) + (n * 71) % 5000).alias("size_kb"),
        F.lit("image").alias("media_type"),
    )
    st.ingest_stream(files, quality_gate(), folder + "/catalog", folder + "/state").awaitTermination()
    catalog = st.current_catalog(spark, folder + "/catalog")
    return catalog.groupBy("category").agg(F.count("*").alias("n"), F.min("asset_id").alias("first_id"))


@query("t2_dedup_stream", "SELECT DISTINCT md5(concat(CAST(user_id AS STRING), '|', event_type)) AS hash FROM events")
def t2(spark, d):
    return finish(st.dedup_stream(events_stream(spark, d).select("hash", "ts"), delay="40 days"), "append").select("hash")


def _rated_stream(spark, d):
    events = events_stream(spark, d)
    k = F.get_json_object("props", "$.k").cast("long")
    rated = events.select("user_id", "ts", k.alias("vec_id"), F.when(F.col("value") > 20, "like").otherwise("dislike").alias("preference"))
    return rated.join(a.raw_vectors(spark, d).select("vec_id", "v"), "vec_id")


@query("t3_running_centroids", """
, e AS (SELECT user_id, CASE WHEN value > 20 THEN 'like' ELSE 'dislike' END AS preference, CAST(json_extract_string(props, '$.k') AS BIGINT) AS vec_id, event_id FROM events),
m AS (SELECT user_id, preference, i, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM (SELECT user_id, preference, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e JOIN raw USING (vec_id)) GROUP BY ALL),
u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY user_id, preference)) AS c FROM m)
SELECT user_id, preference, n, CAST(i - 1 AS INT) AS pos, round(c, 5) AS x FROM u""", uses=("raw",))
def t3(spark, d):
    out = finish(st.running_centroids(_rated_stream(spark, d)), "update", ["user_id", "preference"])
    return _coordinates(out)


def _coordinates(out: DataFrame) -> DataFrame:
    rows = out.select("user_id", "preference", "n", F.posexplode("centroid").alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 5))


@query("t3_online_preference", """
, e AS (SELECT user_id, CASE WHEN value > 20 THEN 'like' ELSE 'dislike' END AS preference, ts, CAST(v AS DOUBLE[]) AS v FROM events JOIN raw ON vec_id = CAST(json_extract_string(props, '$.k') AS BIGINT)),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, preference ORDER BY ts) AS r FROM e),
walk AS (SELECT user_id, preference, 1::BIGINT AS n, v AS mid FROM o WHERE r = 1
  UNION ALL SELECT user_id, preference, n, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) FROM (
    SELECT w.user_id, w.preference, w.n + 1 AS n, list_transform(o.v, lambda x, i: (w.mid[i] * w.n + x) / (w.n + 1)) AS m FROM walk w JOIN o ON o.user_id = w.user_id AND o.preference = w.preference AND o.r = w.n + 1))
SELECT user_id, preference, n, CAST(generate_subscripts(c, 1) - 1 AS INT) AS pos, round(unnest(c), 5) AS x
FROM (SELECT user_id, preference, max(n) AS n, arg_max(mid, n) AS c FROM walk GROUP BY ALL)""", uses=("raw",), recursive=True)
def t3b(spark, d):
    return _coordinates(finish(st.online_preference(_rated_stream(spark, d)), "update", ["user_id", "preference"]))


@query("t4_burst_sessions", """
, g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, max_by(event_id, (value, event_id)) AS keep FROM s GROUP BY user_id, grp""".replace(", g AS", "WITH g AS", 1))
def t4(spark, d):
    out = finish(st.burst_session_stream(events_stream(spark, d), ["user_id"], "6 hours", "value", "event_id"), "complete")
    return out.select("user_id", "start", "n", "keep")


@query("t5_coverage_windows", """
WITH daily AS (SELECT event_type AS category, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL),
weekly AS (SELECT event_type AS category, date_trunc('day', ts) - to_days(CAST(i AS INT)) AS start, count(*) AS n FROM events, range(0, 7) t(i) GROUP BY ALL)
SELECT 'day' AS size, category, CAST(start AS TIMESTAMP) AS start, n, greatest(0, 100 - n) AS deficit FROM daily UNION ALL SELECT 'week', category, CAST(start AS TIMESTAMP), n, greatest(0, 100 - n) FROM weekly""")
def t5(spark, d):
    targets = {"click": 100, "view": 100, "purchase": 100, "error": 100, "signup": 100}
    events = events_stream(spark, d)
    day = finish(st.coverage_stream(events, targets), "complete").withColumn("size", F.lit("day"))
    week = finish(st.coverage_stream(events, targets, "7 days", "1 day"), "complete").withColumn("size", F.lit("week"))
    return day.unionByName(week).select("size", "category", "start", "n", "deficit")


@query("t6_change_stream", """
, c AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id)
SELECT asset_id, coalesce(kind, category) AS category, kind IS NOT NULL AS changed FROM assets LEFT JOIN c ON asset_id = user_id""", uses=("assets",))
def t6(spark, d):
    folder = scratch(spark)
    changes = events_stream(spark, d).select(
        F.col("user_id").alias("asset_id"), F.col("event_type").alias("to_category"), F.struct("ts", "event_id").alias("ts")
    )
    st.change_stream(changes, folder + "/log", folder + "/state").awaitTermination()
    out = st.changed_catalog(a.assets_doc(spark, d), folder + "/log", "asset_id")
    return out.select("asset_id", "category", "changed")


@query("t7_backfill_stream", """
SELECT asset_id, state, state <> 'outdated_tagger' AS needs_embed FROM (
  SELECT event_id AS asset_id, CASE WHEN event_id % 4 = 0 THEN 'never_processed' WHEN event_id % 5 = 0 THEN 'outdated_embed' WHEN vec_id IS NULL THEN 'vector_missing' WHEN event_id % 3 = 0 THEN 'outdated_tagger' END AS state
  FROM events LEFT JOIN raw ON vec_id = event_id) WHERE state IS NOT NULL""", uses=("raw",))
def t7(spark, d):
    folder = scratch(spark)
    n = F.col("event_id")
    arriving = events_stream(spark, d).select(
        n.alias("asset_id"), F.lit("qualified").alias("status"), (n % 4 != 0).alias("has_semantic"),
        F.when(n % 5 == 0, "e1").otherwise("e2").alias("embed_version"), F.when(n % 3 == 0, "t1").otherwise("t2").alias("tagger_version"),
    )
    vectors = a.raw_vectors(spark, d).withColumnRenamed("vec_id", "asset_id")
    st.backfill_stream(arriving, vectors, "e2", "t2", folder + "/log", folder + "/state", "asset_id").awaitTermination()
    return st.read_log(spark, folder + "/log").select("asset_id", "state", "needs_embed")


@query("t8_late_rows", """
WITH p AS (SELECT event_id, ts, event_id % 4 AS part FROM events),
w AS (SELECT part, max(ts) AS top FROM p GROUP BY part),
marks AS (SELECT a.part, max(b.top) - INTERVAL 5 DAY AS mark FROM w a JOIN w b ON b.part < a.part - 1 GROUP BY a.part)
SELECT count(*) AS late, (SELECT count(*) FROM p) AS arrived FROM p JOIN marks USING (part) WHERE ts <= mark""")
def t8(spark, d):
    """Events arrive in four batches, each over the whole time; what lies behind the watermark is counted.

    Spark holds a batch against the watermark with which the batch before it began.
    """
    folder = scratch(spark)
    events = a.table(spark, d, "events").select("event_id", "ts")
    for part in range(4):
        events.filter(F.col("event_id") % 4 == part).coalesce(1).write.parquet(f"{folder}/in/{part}")
    watch = st.LateRows()
    spark.streams.addListener(watch)
    late = 0
    try:
        stream = st.utc(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*"))
        job = (
            st.dedup_stream(stream, "event_id", delay="5 days").writeStream.outputMode("append").format("noop")
            .option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
        )
        job.awaitTermination()
        late = watch.total(job)
    finally:
        spark.streams.removeListener(watch)
    return events.agg(F.count("*").alias("arrived")).select(F.lit(late).cast("long").alias("late"), "arrived")
