"""Suffix, FM-index and MinHash deduplication against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumisift.llm import fmindex, neardup, suffix

ODD = [(100, None, "z"), (101, "", "z"), (102, " ", "z"), (103, "ab", "z"), (None, "nothing here at all", "z")]


def _texts(seed: int, words: int, count: int, alphabet: int = 40) -> list[str]:
    rng = random.Random(seed)
    pool = ["w%d" % i for i in range(alphabet)] + ["é日", "a\tb"]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, words))) for _ in range(count)]


# bytes
def _brute_bytes(texts, threshold):
    where = {}
    raw = [(t or "").encode() for t in texts]
    for d, r in enumerate(raw):
        for i in range(len(r) - threshold + 1):
            where.setdefault(r[i:i + threshold], []).append((d, i))
    gone = [np.zeros(len(r), bool) for r in raw]
    for found in where.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i:i + threshold] = True
    out = []
    for r, g in zip(raw, gone):
        runs = int((np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1).sum())
        out.append((len(r), int(g.sum()), runs, hashlib.sha256(bytes(b for b, x in zip(r, g.tolist()) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix(spark, seed):
    base = _texts(seed, 60, 12)
    shared = base[0][:40]
    rows = [(i, t, "x") for i, t in enumerate([*base, base[3], shared + base[5], base[6] + shared + shared, "a" * 90, "ab" * 60])]
    rows += [*ODD, rows[2], rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)
                 for r in suffix.dedup_report(df, threshold=13, gram=4, step=3).collect())
    want = sorted(((i if i is not None else -1), *b) for (i, *_), b in zip(rows, _brute_bytes([r[1] for r in rows], 13)))
    assert got == want
    assert suffix.dedup_report(df.limit(0), threshold=13, gram=4, step=3).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_over_words(spark, seed):
    base = _texts(seed, 60, 12)
    shared = " ".join(base[0].split()[:12])
    texts = [*base, base[3], shared + "\n " + base[5], base[6] + "  " + shared + " " + shared, "a " * 90, None, "", " x \t"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    split = [[w.decode() for w in (t or "").encode().split()] for t in texts]
    where = {}
    for d, w in enumerate(split):
        for i in range(len(w) - 6):
            where.setdefault(tuple(w[i:i + 7]), []).append((d, i))
    gone = {(d, i + k) for found in where.values() if len(found) > 1 for d, i in found for k in range(7)}
    want = {d: [x for i, x in enumerate(w) if (d, i) not in gone] for d, w in enumerate(split)}
    out = suffix.remove_repeats(df, threshold=7, words=True, gram=3, step=2).collect()
    assert {r.doc_id: (r.text or "").split() for r in out} == want and gone


def test_pipeline_cuts_short_words(spark):
    # 60 words in under 256 bytes
    passage = " ".join("a%x" % i for i in range(60))
    assert len(passage) < 256
    df = spark.createDataFrame([(1, "one " + passage + " two"), (2, "three\n" + passage.replace(" ", "\n") + " four")],
                               "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeat_stage(spark, df, "").collect()}
    assert out == {1: "one two", 2: "three\nfour"}


def test_suffix_long_text_and_stage(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long, "x"), (2, long[700_000:700_600], "y"), (3, "short é", None), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in suffix.dedup_report(df).collect()}
    assert got[1].spans == [[700_000, 700_600]] and got[2].n_removed == 600 and got[3].n_removed == 0
    kept = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    assert kept[1].text == long[:700_000] + long[700_600:] and kept[2].text == "" and kept[4].text is None
    assert [kept[i].source for i in (1, 2, 3)] == ["x", "y", None]
    cut = spark.createDataFrame([(1, "é" + "x" * 20), (2, "è" + "x" * 20)], "doc_id long, text string")
    # the shared string begins inside a character; its rest goes with it
    assert {r.text for r in suffix.remove_repeats(cut, threshold=20, gram=4, step=3).collect()} == {"é", "è"}


def test_frequent_digits_spread(spark, monkeypatch):
    """Rows of one frequent digit, and of one frequent kind of it, stay in the tasks that read them."""
    n = 4000
    items = spark.range(n, numPartitions=8).select(
        F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") - F.col("id") % 4).alias("digit"),
        F.when(F.col("id") % 8 == 0, F.col("id")).otherwise(F.lit(-1)).alias("whole"), F.lit(0).cast("long").alias("first"),
        F.lit(0).cast("long").alias("last"))
    most, keep = {}, suffix.keep_table

    def counted(df, name):
        table = keep(df.withColumn("_task", F.spark_partition_id()), name)
        most[name] = max(r["count"] for r in table.filter("digit = 7").groupBy("_task").count().collect())
        return table.drop("_task")

    monkeypatch.setattr(suffix, "keep_table", counted)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as for a table of many digits
    try:
        repeated, stand = suffix._settle(items)
    finally:
        spark.conf.set(limit, before)
    assert most["shared"] <= n // 4 and most["judged"] <= n // 4  # one task held all n / 2 and n * 3 / 8
    assert sorted(r.row for r in repeated.collect()) == [i for i in range(n) if i % 8]
    left = [r.row for r in stand.collect()]
    assert sorted(i for i in left if i % 8 == 0) == list(range(0, n, 8)) and len(left) == n // 8 + 1


# words
def _brute_words(rows, window):
    first = {}
    words = [(t or "").encode().split() for _, t, *_ in rows]
    for (d, *_), w in zip(rows, words):
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, *_), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone.tolist()) if not g)
        out.append((d if d is not None else -1, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard_words", [30, 1 << 16])
def test_fm_index_dedup(spark, shard_words):
    base = _texts(3, 50, 12, 12)
    rows = [(i, t, 1) for i, t in enumerate([*base, base[3], base[0][:60] + " " + base[5], base[6] + "  " + base[7], "q " * 40, "q " * 30])]
    rows += [*[(i, t, 2) for i, t, _ in ODD], rows[2], rows[2], (4, rows[1][1], 3), (50, None, 0)]
    rows += [(60 + i, "near " + " ".join(f"c{j}" for j in range(25)) + f" end{i} q r s", 0) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digit int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_removed, r.kept_sha256)
                 for r in fmindex.dedup_report(df, window=5, gram=2, shard_words=shard_words).collect())
    assert got == _brute_words(rows, 5)
    assert fmindex.dedup_report(df.limit(0), window=5, gram=2).count() == 0


def test_wavelet_and_backward_search():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 11, 500)
    tree = fmindex.WaveletMatrix(text, 4)
    at, symbol = rng.integers(0, 501, 200), rng.integers(0, 11, 200)
    assert tree.rank(symbol, at).tolist() == [int((text[:a] == s).sum()) for a, s in zip(at, symbol)]
    words = rng.integers(1, 4, 300).astype(np.uint64)
    lengths = np.array([100, 0, 150, 50])
    index = fmindex.FMIndex(words, lengths, np.array([7, 1, 5, 9]), 8)
    parts = np.split(words, np.cumsum(lengths)[:-1])
    for n in (1, 2, 5, 8):
        for start in (0, 40, 200):
            p = words[start:start + n]
            low, high = np.array([0]), np.array([index.tree.size])
            for w in p[::-1]:
                low, high = index.step(low, high, index.codes(np.array([w])))
            hits = [d for d, part in zip((7, 1, 5, 9), parts) for i in range(len(part) - n + 1) if (part[i:i + n] == p).all()]
            assert high[0] - low[0] == len(hits) and (not hits or index.smallest(low, high)[0] == min(hits))


# near copies
def _brute_components(rows, percent):
    words = {d: (t or "").lower().split() for d, t, *_ in rows if d is not None}
    sets = {d: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    ids = sorted(sets)
    comp = {d: d for d in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("percent,chunk", [(85, 4096), (80, 16)])
def test_near_components(spark, monkeypatch, percent, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = random.Random(9)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        for c in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 999)}"
            if c % 3 == 0:
                base = copy  # a chain of drifting copies
            rows.append((len(rows), " ".join(copy), 0))
    big = [f"big{i}" for i in range(150)]
    for c in range(150):
        copy = list(big)
        for _ in range(c % 5):
            copy[rng.randrange(len(copy))] = f"y{rng.randint(0, 9999)}"
        rows.append((len(rows) + 1000, " ".join(copy), 0))
    rows += [(5000, "one two", 1), (5001, "ONE\ttwo", 1), (5002, "one two three", 1), (5003, None, 1), (5004, "", 1), (5005, " ", 1),
             (None, "one two", 1), (5006, "a b c d e", 1), (5007, "a b c d e", 1), (5000, "one two", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = neardup.near_components(df, percent=percent).collect()
    assert len(got) == len(rows) and [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == _brute_components(rows, percent)
    left = neardup.keep_one(df, percent=percent)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {None} | {c for _, c in _brute_components(rows, percent).values()}
    assert neardup.near_components(df.limit(0)).count() == 0


def test_repeated_rows_do_not_make_buckets_equal(spark):
    members = {10: [1, 5, 5, 9], 11: [1, 7, 7, 9], 12: [9, 7, 1, 7], 13: [1, 9], 14: [4]}
    banded = spark.createDataFrame([(d, h) for h, ds in members.items() for d in ds], "doc_id long, h long")
    got = sorted((r.h, r.size, r.lo, r.hi) for r in neardup._buckets(banded).collect())
    assert got == [(10, 4, 1, 9), (11, 4, 1, 9), (13, 2, 1, 9)]


def test_members_of_large_buckets_spread(spark):
    """Rows of a frequent bucket of several components stay in the tasks that read them; buckets of one component go."""
    n = 4000
    members = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.lit(10) + (F.col("id") / 8).cast("long")).alias("h"), F.col("id").alias("doc"))
    found = spark.range(n).filter("id % 2 = 0 or id < 2000").select(
        F.col("id").alias("_id"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).otherwise(F.lit(1)).alias("component"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as for a table of many buckets
    try:
        got = neardup._in_open_buckets(members, found).withColumn("_task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(limit, before)
    hot = np.bincount([r["_task"] for r in got if r.h == 7])
    assert hot.sum() == n // 2 and hot.max() <= n // 8  # one task held all n / 2
    assert sorted(r.doc for r in got if r.h != 7) == list(range(2001, n, 2))


def test_odd_sketch_estimates():
    plan = neardup.band_plan(80)
    minhasher, rng = neardup.MinHasher(*plan), np.random.default_rng(3)
    for share in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(40):
            n = 1200
            common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 1 << 63, (n - len(common)) // 2, dtype=np.uint64)]) for _ in range(2))
            far = np.bitwise_count(minhasher.sketch(minhasher.minima(a)) ^ minhasher.sketch(minhasher.minima(b))).sum(dtype=np.int64)
            true = len(common) / (len(a) + len(b) - len(common))
            errors.append(neardup.estimate(far, plan[0] * plan[1]) - true)
            assert far <= neardup.most_bits(80, plan[0] * plan[1])
        assert abs(np.mean(errors)) < 0.02


def _twins(a: str, b: str, doublings: int) -> tuple[str, str]:
    """A Thue-Morse string and its complement, which every polynomial modulo 2^64 confuses once they are long enough."""
    x, y = a, b
    for _ in range(doublings):
        x, y = x + y, y + x
    return x, y


def test_strings_built_to_collide(spark):
    one, two = _twins("a", "b", 10)
    short, other = _twins("skxvtrge", "gszoykqu", 5)
    tail = "".join(chr(97 + i * 7 % 26) for i in range(144))
    pairs = [(1, short + tail), (2, other + tail), (3, one), (4, two)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    want = sorted((i, *b) for (i, _), b in zip(pairs, _brute_bytes([t for _, t in pairs], 400)))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix.dedup_report(df, threshold=400).collect())
    assert got == want and all(x[2] == 0 for x in got[:2])
    same = " ".join(f"w{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"a b {one}"), (4, f"a b {two}")], "doc_id long, text string")
    assert {r.n_removed for r in fmindex.dedup_report(df).collect()} == {0}
    assert {r.doc_id: r.component_id for r in neardup.near_components(df, percent=85).filter("doc_id > 2").collect()} == {3: 3, 4: 4}
    left = suffix.remove_repeats(df, threshold=50, words=True)
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, df.collect()))


def test_helper_names_in_the_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 5, 6, 7, 8), (2, text, 5, 6, 7, 8), (3, "other words", 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, _runs int, _r int, _gone int")
    left = suffix.remove_repeats(df, threshold=50, words=True)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect())) == [(1, "", 5, 6, 7, 8), (2, "", 5, 6, 7, 8), (3, "other words", 5, 6, 7, 8)]
    assert sorted(map(tuple, neardup.keep_one(df).collect())) == [rows[0], rows[2]]
