"""Phrase collocations by dynamic itemset counting over cyclic shard scans.

The corpus is dealt into shards that are scanned in turn, round and round. A phrase becomes active as soon as both
phrases it consists of but for one word (its first words and its last words) have reached the threshold in the shards
seen so far; from the next scan on it is counted, for one full cycle, so every shard counts exactly once. Longer phrases
thus start while shorter ones are still being counted.

Which phrases have reached the threshold, and in which scan, travels as one byte per hash place in a table of fixed size.
Places that phrases share only activate a phrase too early: it is counted for nothing, by its own words, never wrongly.

Most pairs of frequent words are rare. So the first cycle, while it counts words, also counts all pairs by hash bucket, in
a saturating array of bounded size; a pair becomes active only when its bucket has reached the threshold too, which it
has by the end of that cycle if the pair has.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _ODD, SpanHash, keep_table, mix, shared_folder, small_batches

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2_000
SHARDS = 4
# places of the table that travels with each scan: 2^PLACE_BITS bytes
PLACE_BITS = 24
NEVER = 255
# buckets of pairs: one for this many bytes of text, 2^PAIR_BITS at most; rows of a bucket array
PAIR_BYTES, PAIR_BITS, PAIR_CHUNK = 96, 26, 1 << 16
# bytes of text that a task takes apart at once
FLUSH_BYTES = 8 << 20
OUT_ROWS = 1 << 16

# the characters that end a piece, and the mark that stands for them; it is one of them, so no word can be equal to it
PIECE_ENDS, END = r"[.,;:!?\n\x0B\x0C\r]", "."


def _take_apart(hasher: SpanHash, lang: str, texts):
    """(ids, words, hashes): the words of an Arrow array of texts as numbers, each piece closed by -1; the different words
    in Arrow; and a hash of each with the language, which says where it is looked up, never what it is equal to."""
    import pyarrow as pa
    import pyarrow.compute as pc

    cut = pc.replace_substring_regex(pc.ascii_lower(texts), PIECE_ENDS, f" {END} ")
    cut = pc.binary_join_element_wise(pc.replace_substring(cut, "\t", " "), END, " ")
    coded = pc.split_pattern(cut, " ").flatten().dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    none, end = (pc.index(words, pa.scalar(x, words.type)).as_py() for x in ("", END))
    if none >= 0:
        ids = ids[ids != none]
    ids[ids == end] = -1
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    sums, at = hasher.sums(data), (offsets - offsets[0]).astype(np.int64)
    name = np.frombuffer(lang.encode("utf-8", "replace"), np.uint8)
    salt = hasher.spans(hasher.sums(name), np.array([0]), np.array([len(name)]))
    return ids, words, mix(hasher.spans(sums, at[:-1], at[1:]) ^ salt)


def _grouped(keys: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(one position, occurrences) for each different phrase of k words among the positions ``at``, by its words."""
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    edge = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(edge)
    owner = np.cumsum(edge) - 1
    if any((ids[at + j] != ids[at[first][owner] + j]).any() for j in range(k)):  # two phrases with one key
        order = np.lexsort([ids[at + j] for j in range(k)])
        at = at[order]
        edge = np.ones(len(at), bool)
        edge[1:] = False
        for j in range(k):
            edge[1:] |= ids[at[1:] + j] != ids[at[:-1] + j]
        first = np.flatnonzero(edge)
    return at[first], np.diff(np.concatenate([first, [len(at)]]))


def _pair_buckets(ids: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Bucket of each pair of neighbouring words in one run of tokens."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return _bucket(hashes[ids[at]] * _ODD + hashes[ids[at + 1]], size)


def _bucket(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys ^ _ODD) & np.uint64(size - 1)).astype(np.int64)


def _add(total: np.ndarray, more: np.ndarray, at=slice(None)) -> None:
    """Saturating sum: ``more`` onto the elements ``at`` of ``total``."""
    most = np.iinfo(total.dtype).max
    total[at] = np.minimum(total[at].astype(np.int64) + more, most).astype(total.dtype)


def count_active(
    ids: np.ndarray, hashes: np.ndarray, table: np.ndarray, pairs: np.ndarray, step: int, shards: int, longest: int,
):
    """(k, position, place, start, occurrences) of the phrases that this scan counts in one run of tokens.

    ``ids`` ends with -1. A phrase of k words starts in the scan after the one in which the last of its parts (of a pair:
    its bucket in ``pairs`` as well) became known, and is counted in ``shards`` scans; a single word starts in scan 0.
    The start depends on the tables alone, and their entries never change once set, so all tasks of all scans agree on it.
    """
    n = len(ids)
    where = np.arange(n)
    end = np.where(ids < 0, where, n)
    left = np.minimum.accumulate(end[::-1])[::-1] - where  # words up to the end of the piece
    mask = np.uint64(len(table) - 1)
    places = mix(hashes + np.uint64(1)) & mask
    if step < shards:
        counts = np.bincount(ids[ids >= 0], minlength=len(hashes))
        met = np.flatnonzero(counts)
        at = np.zeros(len(hashes), np.int64)
        at[ids[ids >= 0]] = where[ids >= 0]
        yield 1, at[met], places[met], np.zeros(len(met), np.int64), counts[met]
    # the scan after which a phrase at a position was known, with all its parts
    known = np.full(n, NEVER, np.uint8)
    known[ids >= 0] = table[places][ids[ids >= 0]]
    word = np.zeros(n, np.uint64)
    word[ids >= 0] = hashes[ids[ids >= 0]]
    key = word.copy()
    for k in range(2, longest + 1):
        parts = np.maximum(known[:-1], known[1:])
        at = np.flatnonzero((parts != NEVER) & (left[:-1] >= k))
        if not len(at):
            return
        key[at] = key[at] * _ODD + word[at + k - 1]
        place = mix(key[at] + np.uint64(k)) & mask
        start = parts[at].astype(np.int64) + 1
        if k == 2:
            since = pairs[_bucket(key[at], len(pairs))]
            start = np.maximum(start, since.astype(np.int64) + 1)
            now = np.flatnonzero((since != NEVER) & (step < start + shards))
        else:
            now = np.flatnonzero(step < start + shards)
        if len(now):
            order = np.full(n, -1, np.int64)
            order[at[now]] = now
            found, counts = _grouped(key[at[now]], ids, at[now], k)
            yield k, found, place[order[found]], start[order[found]], counts
        fresh = np.full(n, NEVER, np.uint8)
        fresh[at] = np.maximum(parts[at], table[place])
        known = fresh


_COUNT = "lang string, phrase string, k int, place long, start int, f long, counts binary"
_NAMES = ["lang", "phrase", "k", "place", "start", "f", "counts"]
_KEYS = _NAMES[:5]


def _scan(shard: DataFrame, shared, step: int, shards: int, longest: int, kind: str) -> DataFrame:
    """Occurrences of the active phrases in one shard, and in the first cycle the chunks of its pair counts (k is 0,
    place the number of the chunk). ``shared`` has the packed tables."""

    def scan(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        table, pairs = (np.frombuffer(zlib.decompress(x), np.uint8) for x in shared.value)
        hasher = SpanHash()
        met = np.zeros(len(pairs) if step < shards else 0, kind)

        def flush(held):
            for lang, parts in held.items():
                ids, words, hashes = _take_apart(hasher, lang, pa.concat_arrays(parts))
                if len(met):
                    _add(met, *reversed(np.unique(_pair_buckets(ids, hashes, len(met)), return_counts=True)))
                for k, at, place, start, f in count_active(ids, hashes, table, pairs, step, shards, longest):
                    for i in range(0, len(at), OUT_ROWS):
                        part = slice(i, i + OUT_ROWS)
                        columns = [words.take(pa.array(ids[at[part] + j])) for j in range(k)]
                        n = len(columns[0])
                        yield pa.RecordBatch.from_arrays([
                            pa.repeat(pa.scalar(lang, pa.string()), n), pc.binary_join_element_wise(*columns, " ") if k > 1 else columns[0],
                            pa.array(np.full(n, k, np.int32)), pa.array(place[part].astype(np.int64)),
                            pa.array(start[part].astype(np.int32)), pa.array(f[part].astype(np.int64)), pa.nulls(n, pa.binary()),
                        ], _NAMES)

        held, size = {}, 0
        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            for lang in langs.unique().to_pylist():
                held.setdefault(lang, []).append(texts.filter(pc.equal(langs, lang)))
            size += texts.nbytes
            if size >= FLUSH_BYTES:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)
        for at in range(0, len(met), PAIR_CHUNK):
            part = met[at:at + PAIR_CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([0], pa.int32()), pa.array([at // PAIR_CHUNK], pa.int64()),
                    pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([part.tobytes()], pa.binary()),
                ], _NAMES)

    return shard.mapInArrow(scan, _COUNT)


def _merge(chunks: DataFrame, by: list, kind: str) -> DataFrame:
    """Saturating sums of equal chunks."""

    def merge(key, chunks):
        import pyarrow as pa

        total = None
        for x in chunks.column("counts"):
            part = np.frombuffer(x.as_py(), kind)
            if total is None:
                total = part.copy()
            else:
                _add(total, part)
        return pa.table({"place": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    return chunks.groupBy(*by).applyInArrow(merge, "place long, counts binary")


def _add_pairs(total: np.ndarray, chunks: DataFrame) -> None:
    """Add a scan's pair counts; the array of bounded size is all that reaches the driver. Chunks merge in two rounds, so
    no group holds a row of every task."""
    kind = total.dtype.name
    some = _merge(chunks, ["place", F.pmod(F.spark_partition_id(), F.lit(64))], kind)
    for row in _merge(some, ["place"], kind).collect():
        part = np.frombuffer(bytes(row.counts), kind)
        _add(total[row.place * PAIR_CHUNK:row.place * PAIR_CHUNK + len(part)], part)


def _mark(table: np.ndarray, reached: DataFrame, step: int) -> bool:
    """Enter the places of phrases that reached the threshold; bitmaps of the table's size reach the driver, no phrases."""
    at = F.col("place") + 1
    maps = reached.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    fresh = False
    # one job, not one for each partition; the rows together have a bit for each place
    for row in maps.collect():
        bits = np.unpackbits(np.frombuffer(bytes(row.bits), np.uint8), bitorder="little").astype(bool)
        part = table[(row.b - 1) * 32768:row.b * 32768]
        new = bits[:len(part)] & (part == NEVER)
        part[new] = step
        fresh |= bool(new.any())
    return fresh


def count_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = MAX_WORDS, min_count: int = MIN_COUNT,
    shards: int = SHARDS, place_bits: int = PLACE_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, k, f) of every phrase of up to ``longest`` words with f of at least
    ``min_count``, and (lang, n) with the number of all words.

    Tables of a scan hold the phrases still being counted; those below the threshold go once their cycle is complete.
    At most ``longest`` cycles are needed (a step takes one byte, so there may be 250 steps). More ``place_bits`` (24: 16 MB) keep the activation sharp on larger corpora;
    results do not depend on them, nor on the number of pair buckets.
    """
    if longest * shards > 250:
        raise ValueError("a step must fit one byte: longest * shards may be 250 at most")
    small_batches(docs)
    spark = docs.sparkSession
    path = shared_folder(spark, "shards")
    named = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    # dealt in turn, written once
    named.filter(F.length("text") > 0).withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")) \
        .write.partitionBy("shard").parquet(path)
    schema = "lang string, text string, shard int"
    corpus = spark.read.schema(schema).parquet(path)
    size = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pairs = np.full(1 << min(PAIR_BITS, max(4, (size // PAIR_BYTES).bit_length())), NEVER, np.uint8)
    kind = "uint8" if min_count <= 255 else "uint16" if min_count <= 65535 else "uint32"
    met = np.zeros(len(pairs), kind)
    table = np.full(1 << place_bits, NEVER, np.uint8)
    open_, done, totals = None, [], None
    step, last = 0, -1
    # phrases start at most one scan after the last fresh entry
    while step < shards or step <= last + shards:
        # few places are taken at first, so the packed tables are small
        shared = spark.sparkContext.broadcast([zlib.compress(x.tobytes(), 1) for x in (table, pairs)])
        scanned = _scan(corpus.filter(F.col("shard") == step % shards), shared, step, shards, longest, kind)
        if step < shards:
            scanned = keep_table(scanned, "scan")  # read for its pair counts, too
        counted = scanned.filter(F.col("k") > 0).select(*_KEYS, "f")
        if open_ is not None:
            counted = counted.unionByName(open_)
        counted = keep_table(counted.groupBy(*_KEYS).agg(F.sum("f").alias("f")), "phrases")
        over = counted.filter(F.col("f") >= min_count)
        complete = F.col("start") + (shards - 1) <= step
        done.append(over.filter(complete))
        if step == shards - 1:
            totals = keep_table(counted.filter(F.col("k") == 1).groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        open_ = counted.filter(~complete)
        if _mark(table, over.filter(F.col("k") < longest), step):
            last = step
        if step < shards:
            _add_pairs(met, scanned.filter(F.col("k") == 0).select("place", "counts"))
            fresh = (met >= min_count) & (pairs == NEVER)
            pairs[fresh] = step
            if fresh.any():
                last = step
        shared.destroy()
        step += 1
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return keep_table(found.select("lang", "phrase", "k", "f"), "frequent"), totals


def _words(phrase: Column, first: Column | int, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), first, count), " ")


def _big(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = MAX_WORDS, min_count: int = MIN_COUNT,
    top: int = TOP, shards: int = SHARDS, place_bits: int = PLACE_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A text is lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, those at blanks and tabs into words;
    phrases never cross pieces. a counts a phrase of 2 to ``longest`` words, n all words of its language; of the cuts of
    the phrase into two parts with counts l and r, the one with the lowest score floor(1000 * a * n / (l * r)) counts,
    on ties the shortest first part. Phrases as frequent as a longer one around them are left out. Order: score, a, both
    descending, then the phrase by its bytes. A null language is ``und``; null and empty texts have no words; repeated
    rows count again; empty tables give no rows; other columns are ignored. Sums and products are decimals of 38 digits.
    """
    frequent, totals = count_phrases(docs, text, lang, longest, min_count, shards, place_bits)
    candidates = frequent.filter(F.col("k") > 1).withColumnRenamed("f", "a")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c")
    cuts = candidates.select("lang", "phrase", "k", "a", cut).withColumn("head", _words(F.col("phrase"), 1, F.col("c"))) \
        .withColumn("tail", _words(F.col("phrase"), F.col("c") + 1, F.col("k") - F.col("c")))
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    # a row for each language that has words: the count is small, and checked by Spark before it broadcasts
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang") \
        .withColumn("over", _big(F.col("a") * 1000) * _big(F.col("n"))).withColumn("under", _big(F.col("l")) * _big(F.col("r"))) \
        .withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "c", "l", "r")).alias("b"))
    # a longer phrase as frequent as this one has one among its parts of one word more
    longer = frequent.filter(F.col("k") > 2)
    inner = F.explode(F.array(
        _words(F.col("phrase"), 1, F.col("k") - 1), _words(F.col("phrase"), 2, F.col("k") - 1))).alias("phrase")
    covers = longer.select("lang", "f", inner).groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    kept = best.join(covers, ["lang", "phrase"], "left").filter(F.coalesce(F.col("cover"), F.lit(0)) < F.col("a"))
    rows = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best come from the best of its parts
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return rows.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
