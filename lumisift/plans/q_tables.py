"""Dimension operators with dimensions of any size as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import table_match as m
from . import adapters as a
from .registry import query

# a bracket for each order, of one day to three months
_BRACKETS = "SELECT o_orderkey AS ord, ('b' || CAST(o_orderkey AS STRING)) AS id, CAST(o_orderkey * 7 % 2300 AS INT) AS lo, CAST(o_orderkey * 7 % 2300 + 1 + o_orderkey % 90 AS INT) AS hi FROM orders WHERE o_orderkey % 3 > 0"


@query("j9_bracket_table", f"""
, b AS ({_BRACKETS}), age AS (SELECT DISTINCT date_diff('day', DATE '1995-06-01', date) AS age FROM dated),
half AS (SELECT age, min(ord) AS ord FROM age JOIN b ON age >= 0 AND age >= lo AND age < hi GROUP BY age),
closed AS (SELECT age, min(ord) AS ord FROM age JOIN b ON greatest(age, 0) BETWEEN lo AND hi GROUP BY age),
ladder AS (SELECT age, min(ord) AS ord FROM age JOIN b ON age >= 0 AND age <= hi GROUP BY age),
e AS (SELECT max_by(id, ord) AS last_id, max_by(hi, ord) AS top, min_by(id, ord) AS first_id FROM b)
SELECT asset_id, ('b' || CAST(half.ord AS STRING)) AS half_open,
  coalesce(('b' || CAST(closed.ord AS STRING)), CASE WHEN greatest(d.age, 0) > top THEN last_id ELSE first_id END) AS closed,
  coalesce(('b' || CAST(ladder.ord AS STRING)), CASE WHEN d.age >= 0 THEN last_id END) AS ladder
FROM (SELECT asset_id, date_diff('day', DATE '1995-06-01', date) AS age FROM dated) d CROSS JOIN e
  LEFT JOIN half ON half.age = d.age LEFT JOIN closed ON closed.age = d.age LEFT JOIN ladder ON ladder.age = d.age""", uses=("dated",))
def j9_table(spark, d):
    orders = a.table(spark, d, "orders").filter(F.col("o_orderkey") % 3 > 0)
    low = (F.col("o_orderkey") * 7 % 2300).cast("int")
    brackets = orders.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("id"),
        low.alias("age_days_from"), (low + 1 + (F.col("o_orderkey") % 90).cast("int")).alias("age_days_to"))
    out = a.assets_dated(spark, d).select("asset_id", F.datediff("date", F.to_date(F.lit("1995-06-01"))).alias("age"))
    for mode, name in (("half_open", "half_open"), ("closed_clamped", "closed"), ("ladder", "ladder")):
        out = m.bracket_join(out, "age", brackets, mode, name)
    return out.drop("age")


# a window for each event: its day, a start by its id, up to ten hours, some past midnight
_WINDOWS = """SELECT event_id AS ord, ('w' || CAST(event_id AS STRING)) AS id, CAST(event_id % 31 - 1 AS INT) AS o,
  CAST((event_id * 37 % 1440) * 60 AS INT) AS lo, CAST(((event_id * 37 + event_id % 600) % 1440) * 60 AS INT) AS hi, event_type AS k FROM events WHERE event_id % 5 = 0"""


def _clock(minutes):
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


@query("j10_day_time_table", f"""
, w AS ({_WINDOWS}), e AS (SELECT *, date_diff('day', DATE '2024-01-01', day) AS o, epoch_us(taken_at) % 86400000000 / 1e6 AS s FROM evt),
hit AS (SELECT e.asset_id, min(w.ord) AS ord FROM e JOIN w ON w.o <> -1 AND w.o = e.o AND
  CASE WHEN hi < lo THEN s >= lo OR s <= hi ELSE s >= lo AND s <= hi END GROUP BY 1),
theme AS (SELECT e.asset_id, min(w.ord) AS ord FROM e JOIN w ON w.o = -1 AND contains(lower(e.category), lower(w.k)) GROUP BY 1)
SELECT asset_id, ('w' || CAST(coalesce(hit.ord, theme.ord, (SELECT min(ord) FROM w WHERE o = -1)) AS STRING)) AS slot
FROM e LEFT JOIN hit USING (asset_id) LEFT JOIN theme USING (asset_id)""", uses=("evt",))
def j10_table(spark, d):
    n = F.col("event_id")
    windows = a.table(spark, d, "events").filter(n % 5 == 0).select(
        n.alias("ord"), F.concat(F.lit("w"), n.cast("string")).alias("id"), (n % 31 - 1).cast("int").alias("day_offset"),
        _clock(n * 37 % 1440).alias("time_from"), _clock((n * 37 + n % 600) % 1440).alias("time_to"),
        F.array("event_type").alias("keywords"))
    return m.day_time_join(a.assets_evt(spark, d), "taken_at", "category", windows, "2024-01-01", "slot").select("asset_id", "slot")


_MONTHS = """SELECT c_custkey AS ord, ('m' || CAST(c_custkey AS STRING)) AS id, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 1 + c_custkey % 12 END AS lo,
  CASE WHEN c_custkey % 10 = 0 THEN 12 ELSE 1 + c_custkey % 12 + c_custkey % 3 END AS hi,
  CASE WHEN c_custkey % 20 = 10 THEN CAST(1 + c_custkey % 5 AS STRING) END AS k FROM customer WHERE c_custkey > 3 AND (c_custkey % 12 < 6 OR c_custkey % 10 = 0)"""


@query("j11_month_table", f"""
, c AS ({_MONTHS}),
themes AS (SELECT asset_id, first(id ORDER BY ord) AS id FROM dated JOIN c ON lo = 1 AND hi = 12 AND k IS NOT NULL AND contains(lower(category), k) GROUP BY 1),
ranges AS (SELECT m, min_by(id, ord) AS id FROM (SELECT unnest(range(1, 13)) AS m) JOIN c ON NOT (lo = 1 AND hi = 12) AND m BETWEEN lo AND hi GROUP BY m)
SELECT asset_id, CASE WHEN year(date) = 1997 THEN coalesce(themes.id, ranges.id, (SELECT min_by(id, ord) FROM c WHERE lo = 1 AND hi = 12 AND k IS NULL)) END AS part
FROM dated LEFT JOIN themes USING (asset_id) LEFT JOIN ranges ON m = month(date)""", uses=("dated",))
def j11_table(spark, d):
    n, all_year = F.col("c_custkey"), F.col("c_custkey") % 10 == 0
    low = (1 + n % 12).cast("int")
    kinds = a.table(spark, d, "customer").filter((n > 3) & ((n % 12 < 6) | all_year)).select(
        n.alias("ord"), F.concat(F.lit("m"), n.cast("string")).alias("id"), F.when(all_year, 1).otherwise(low).alias("month_from"),
        F.when(all_year, 12).otherwise(low + (n % 3).cast("int")).alias("month_to"),
        F.when(n % 20 == 10, F.array((1 + n % 5).cast("string"))).alias("keywords"))
    return m.month_join(a.assets_dated(spark, d), "date", "category", kinds, 1997, "part").select("asset_id", "part")


# a keyword of three to ten characters from each document, 97 categories
@query("j12_keyword_table", """
, k AS (SELECT asset_id % 97 AS ord, lower(replace(substr(text, CAST(5 + asset_id % 40 AS INT), CAST(3 + asset_id % 8 AS INT)), chr(92), '/')) AS k FROM assets WHERE length(text) > 60),
listed AS (SELECT ord, k, count(*) AS times FROM k WHERE k <> '' GROUP BY 1, 2), words AS (SELECT DISTINCT k FROM listed),
hit AS (SELECT asset_id, k FROM assets JOIN words ON contains(lower(replace(text, chr(92), '/')), k)),
best AS (SELECT asset_id, ord, row_number() OVER (PARTITION BY asset_id ORDER BY sum(times) DESC, ord) AS n FROM hit JOIN listed USING (k) GROUP BY 1, 2)
SELECT asset_id, ('c' || CAST(ord AS STRING)) AS matched, coalesce(('c' || CAST(ord AS STRING)), (SELECT ('c' || CAST(min(ord) AS STRING)) FROM listed)) AS thematic
FROM assets LEFT JOIN (SELECT * FROM best WHERE n = 1) USING (asset_id)""", uses=("assets",))
def j12_table(spark, d):
    df = a.assets_doc(spark, d).select("asset_id", "text")
    n = F.col("asset_id")
    word = F.expr("translate(substr(text, int(5 + asset_id % 40), int(3 + asset_id % 8)), '\\\\', '/')")
    kinds = df.filter(F.length("text") > 60).groupBy((n % 97).alias("ord")).agg(F.collect_list(word).alias("keywords"))
    kinds = kinds.withColumn("id", F.concat(F.lit("c"), F.col("ord").cast("string")))
    return m.keyword_join(df, "text", kinds, "matched", thematic="thematic").select("asset_id", "matched", "thematic")


@query("j14_dictionary_table", """
, words AS (SELECT asset_id AS ord, replace(substr(text, CAST(3 + asset_id % 30 AS INT), CAST(4 + asset_id % 5 AS INT)), chr(92), '/') AS k, asset_id * 3 AS v FROM assets WHERE asset_id % 4 = 1),
firsts AS (SELECT k, min(ord) AS ord FROM words WHERE k <> '' GROUP BY k),
one AS (SELECT asset_id, min(ord) AS ord FROM assets JOIN firsts ON contains(replace(text, chr(92), '/'), k) GROUP BY 1),
codes AS (SELECT min(asset_id) AS ord, k FROM (SELECT asset_id, CASE WHEN asset_id % 50 = 0 THEN category ELSE lpad(CAST(asset_id * 7 % 1000 AS STRING), 3, '0') END AS k FROM assets WHERE asset_id % 3 = 0) GROUP BY k),
parts AS (SELECT asset_id, unnest(string_split(path, '/')) AS part, unnest(range(0, len(string_split(path, '/')))) AS pos FROM assets),
met AS (SELECT asset_id, pos, min(ord) AS ord FROM parts JOIN codes ON contains(part, k) GROUP BY 1, 2),
two AS (SELECT asset_id, min_by(ord, pos) AS ord FROM met GROUP BY 1)
SELECT asset_id, one.ord * 3 AS place, two.ord AS folder FROM assets LEFT JOIN one USING (asset_id) LEFT JOIN two USING (asset_id)""", uses=("assets",))
def j14_table(spark, d):
    df = a.assets_doc(spark, d).select("asset_id", "text", "path", "category")
    n = F.col("asset_id")
    words = df.filter(n % 4 == 1).select(
        n.alias("ord"), F.expr("translate(substr(text, int(3 + asset_id % 30), int(4 + asset_id % 5)), '\\\\', '/')").alias("k"), (n * 3).alias("v"))
    words = words.filter(F.col("k") != "")
    codes = df.filter(n % 3 == 0).select(
        n.alias("ord"), F.when(n % 50 == 0, F.col("category")).otherwise(F.lpad((n * 7 % 1000).cast("string"), 3, "0")).alias("k"), n.alias("v"))
    one = m.dictionary_join(df, "text", words, "place")
    return m.dictionary_join(one, "path", codes, "folder", per_part=True).select("asset_id", "place", "folder")
