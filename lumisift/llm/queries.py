"""Registered queries of the training-data operators over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fmindex, language, lexical, maintext, neardup, packing, phrases, suffix, tokens, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql.strip()
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CONTROL_SQL = r"'([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|ROLE )', '\1\\\2\3', 'g'"


@_query(rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(text, {_CONTROL_SQL})) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11
    WHEN 'assistant' THEN 4 ELSE 14 + length(regexp_replace(replace(replace(role, '%', '%25'), ']', '%5D'), {_CONTROL_SQL})) END AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op1_chat_format(spark, sf_dir):
    """All conversations, and one more in another layout, formatted and read back."""
    record = (
        '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, '
        '{"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
    )
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(record).alias("record"))
    canonical = chat.turns(_table(spark, sf_dir, "conversations")).unionByName(chat.turns_from_json(extra))
    back = chat.read_chats(chat.format_chats(canonical)).withColumn("_loss", chat.loss_text())
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@_query("""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (
  SELECT doc_id, i, md5_number(h[2 * i + 1:2 * i + 800]) AS k
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)),
r AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
m AS (SELECT *, max(i + 400) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r),
g AS (SELECT *, sum(CASE WHEN e IS NULL OR i > e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM m),
spans AS (SELECT doc_id, s, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2),
cuts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
parts AS (
  SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) || any_value(h[2 * (SELECT max(b) FROM spans s WHERE s.doc_id = d.doc_id) + 1:]) AS kept
  FROM cuts JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)
""")
def op2_suffix_dedup(spark, sf_dir):
    """Bytes covered by 400-byte strings that occur more than once."""
    found = suffix.dedup_report(_table(spark, sf_dir, "documents"), threshold=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


TOKEN_LIMIT = 1024


@_query()
def op3_token_counts(spark, sf_dir):
    """Byte-level BPE tokens of every document."""
    import public_tokenizers

    counted = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@_query(rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
iw AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS MATERIALIZED (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
met AS MATERIALIZED (SELECT doc_id, i, size, item FROM dw JOIN iw USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""")
def op9_decontaminate(spark, sf_dir):
    """Benchmark windows in every document."""
    found = decontaminate.scan_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, unnest(range(8)) AS k FROM (SELECT DISTINCT h FROM p)),
v AS (SELECT h, k, CAST(('0x' || h[5 * k + 1:5 * k + 5]) AS BIGINT) AS n FROM g),
a AS (SELECT *, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS s FROM v),
b AS (SELECT h, string_agg(s[(n >> 15) + 1] || s[((n >> 10) & 31) + 1] || s[((n >> 5) & 31) + 1] || s[(n & 31) + 1], '' ORDER BY k) AS d
  FROM a GROUP BY h),
m AS (SELECT h, max(page_id) AS origin FROM p GROUP BY h)
SELECT page_id, payload_bytes, d AS payload_digest, CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM p JOIN b USING (h) JOIN m USING (h)
""")
def op10_warc(spark, sf_dir):
    """Every page written to WARC archives and read back."""
    back = warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)
    return back.filter(F.col("gap_reason").isNull()).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query()
def op4_packing(spark, sf_dir):
    """Every document in a token-budget batch of its length bucket, by byte-level BPE tokens."""
    import public_tokenizers

    return packing.pack_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query()
def op5_language_id(spark, sf_dir):
    """Language of every document, learned outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@_query("""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op7_topk(spark, sf_dir):
    """Five best inner products for every fiftieth vector among all others."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query(r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (
  SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS o FROM p GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS n FROM p JOIN f USING (k) WHERE doc_id > o),
l AS (SELECT doc_id, list(n) AS ns FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS n FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY n) AS t FROM words ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ns), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op8_substring_dedup(spark, sf_dir):
    """Words covered by 50-word windows that a document with a smaller id holds too."""
    return fmindex.dedup_report(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query(r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + 4], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
""")
def op6_minhash_near_dedup(spark, sf_dir):
    """Components of documents whose five-word shingles agree to 85 of 100."""
    found = neardup.near_components(_table(spark, sf_dir, "documents"), percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@_query(rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, {_WORDS_SQL} AS w FROM documents),
s AS MATERIALIZED (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
i AS MATERIALIZED (SELECT item_id, row_number() OVER () AS item, {_WORDS_SQL} AS w FROM benchmark),
q AS MATERIALIZED (SELECT item, t, count(*) AS c FROM (SELECT item, unnest(w) AS t FROM i) GROUP BY ALL),
tf AS MATERIALIZED (
  SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY t, n),
m AS (SELECT row, doc_id, 100 - 75 + ((75 * len(w) * n) // l) AS m FROM d, s WHERE len(w) > 0),
sc AS (
  SELECT item, row, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (row) GROUP BY ALL),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (item) WHERE rank <= 10
""")
def op12_ranked_search(spark, sf_dir):
    """The ten best documents for every benchmark item."""
    return lexical.ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query()
def op11_main_text(spark, sf_dir):
    """Main text of every page."""
    return maintext.extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_query(r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM documents),
p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS x FROM t)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, g, count(*) AS f FROM (
    SELECT lang, k, w[i:i + k - 1] AS g
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, g, f AS a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.k, c.g, c.a, c.c, l.f AS l, r.f AS r, n.n,
    CAST((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.c] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.c + 1:] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_parts AS (
  SELECT lang, g[i:i + j - 1] AS g, f FROM (
    SELECT lang, g, f, k, j, unnest(range(1, k - j + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS j) WHERE j < k)),
cover AS (SELECT lang, g, max(f) AS f FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN cover ON cover.lang = b.lang AND cover.g = b.g
  WHERE cover.f IS NULL OR 100 * cover.f < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
""")
def op13_phrase_collocations(spark, sf_dir):
    """The first collocations of every language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))
