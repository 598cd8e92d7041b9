"""Packing, language identification, top-k search and the pipeline on small tables."""

import collections
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumisift.llm import language, packing, tokens, topk
from lumisift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# packing
def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))

        best = min(padding([*x, lengths[-1]]) for r in range(min(k, len(lengths))) for x in itertools.combinations(lengths[:-1], r))
        got = packing.best_boundaries(np.array(lengths), np.array(counts), k)
        assert len(got) <= k and got[-1] == lengths[-1] and padding(got) == best


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 31, 200]), "k") for i in range(300)] + [(None, None, "k"), (7, "a b", "k"), (7, "a b", "k"), (301, "w " * 5000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = packing.pack(df, buckets=3, token_budget=256).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.padded_length
        batches.setdefault(r.batch_id, []).append(r)
    for rs in batches.values():
        assert len({r.bucket for r in rs}) == 1 and sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) * rs[0].padded_length <= 256 or len(rs) == 1
    assert len({r.padded_length for r in got}) <= 3
    for b in {r.bucket for r in got}:
        mine = [r for r in got if r.bucket == b]
        assert len({r.batch_id for r in mine}) == math.ceil(len(mine) / max(1, 256 // max(1, mine[0].padded_length)))
    assert packing.pack(df.limit(0)).count() == 0
    bins = spark.range(1 << 16).select((F.col("id") * F.col("id") + F.col("id")).alias("n"))
    top = packing.choose_boundaries(bins, "n", 5)
    assert top[-1] == (1 << 16) ** 2 - (1 << 16) and len(top) == 5


def test_registered_packing_counts_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(
        [(-1, "日本語" * 2000), (-2, None), (-3, "x" * 90_000)], "doc_id long, text string"))
    plain = tokens._load(path)
    want = {r.doc_id: len(plain.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    got = packing.pack_tokens(docs, path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.n_tokens <= r.padded_length for r in got)
    size = collections.Counter(r.batch_id for r in got)
    assert all(size[r.batch_id] * r.padded_length <= packing.TOKEN_BUDGET or size[r.batch_id] == 1 for r in got)
    for found in (QUERIES["op4_packing"](spark, SF), corpus_pipeline.packing_stage(spark, docs, SF)):
        assert all(r.n_tokens == want[r.doc_id] for r in found.collect())


def test_binned_boundaries_lose_at_most_one_part_in_128(spark):
    rng = random.Random(3)
    rows = [int(2 ** rng.uniform(11, 17)) for _ in range(3000)]
    lengths, counts = np.unique(np.array(rows), return_counts=True)

    def padded(bounds):
        return sum(min(b for b in bounds if b >= n) for n in rows)

    least = padded(packing.best_boundaries(lengths, counts, 4))
    binned = packing.choose_boundaries(spark.createDataFrame([(n,) for n in rows], "n long"), "n", 4)
    assert least <= padded(binned) <= least * 129 / 128


# language
def test_kernel_scores_equal_folded_scores():
    texts = ["the cat sat", "le chat est là", "der hund und", "the dog and the cat", "la souris est", "die katze und das"]
    labels = ["en", "fr", "de", "en", "fr", "de"]
    model = language.fit(texts, labels, landmarks=6, bits=12)
    asked = ["the cat and", "le chat", "und der", "?", "x" * 700_000]
    grams = [set(language.present(t, 12).tolist()) for t in asked]
    marks = [set(np.flatnonzero(row).tolist()) for row in model.landmarks]
    kernel = np.array([[len(g & m) / math.sqrt(max(1, len(g)) * len(m)) for m in marks] for g in grams])
    want = kernel @ model.weights + model.folded[-1]
    rows = language._unit(language._presence(asked, 12))
    assert np.allclose(rows @ model.folded[:-1] + model.folded[-1], want, atol=1e-4)
    best, score = language.score(model, asked)
    assert [model.languages[b] for b in best[:3]] == ["en", "fr", "de"] and ((score >= 0) & (score <= 1)).all()


def test_language_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = QUERIES["op5_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None, "en", 0.5), (2, "", None, 0.5), (3, "12 !?", "de", 0.5), (None, "the and of", "en", 0.5),
                                 (3, "12 !?", "de", 0.5)], "doc_id long, text string, lang string, score double")
    model = language.train(docs.limit(200))
    got = sorted((r.doc_id or 0, r.lang_pred != "und") for r in language.predict(odd, model).collect())
    assert got == [(0, True), (1, False), (2, False), (3, False), (3, False)]
    assert language.predict(odd.limit(0), model).count() == 0
    empty = language.train(odd.limit(0))
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    assert language.keep_known(odd, model).columns == odd.columns and language.keep_known(odd, model).count() == 1


def test_long_texts_are_learned_and_unlabelled_texts_stay(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(i, "the dog and the cat ", "en") for i in range(40)] + [(100 + i, "der hund und die katze " * 2000, "de") for i in range(40)]
    model = language.train(spark.createDataFrame(rows, schema))
    assert model.languages == ["de", "en"]
    assert language.label(model, ["und der hund", "and the dog"])[0].tolist() == ["de", "en"]
    bare = spark.createDataFrame([(1, "the dog", None), (2, "12 !", None), (3, None, None), (4, "", None), (5, "é", None)], schema)
    kept = corpus_pipeline.language_stage(spark, bare, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 5]
    full = np.arange(0, 1 << 16, 3)
    assert all((language._unpacked(language._packed(x)) == x).all() for x in (full, full[:5], full[:0]))


# top-k
@pytest.mark.parametrize("sizes", [(7, 5, 3), (1000, 1000, 64)])
def test_top_k(spark, sizes):
    rng = random.Random(6)
    vectors = [(i, [round(rng.gauss(0, 1), 2) for _ in range(4)]) for i in range(120)]
    vectors += [(200 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(30)]  # many ties
    vectors += [(300, None), (301, [None, 1.0, 1.0, 1.0]), (302, [float("nan"), 1.0, 1.0, 1.0]), (303, [float("inf"), 1.0, 1.0, 1.0]),
                (305, [1.0, 2.0]), (310, [3.0, 1.0]), (315, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (0, vectors[0][1])]
    df = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<float>, rank int, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(
        df, F.col("vec_id") % 5 == 0, k=4, shard_rows=sizes[0], group_rows=sizes[1], pivots=sizes[2]).collect())
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(good):
        if q % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), c) for c, v in good.items() if c != q and len(v) == len(good[q]))
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:4])]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [4, 256, 1 << 22, 1 << 27])
def test_leaves_meet_in_large_products(monkeypatch, size):
    """Few meetings of leaves, with the same answers: many ties, copies, sums that need floats, doubles and 64-bit integers."""
    rng = np.random.default_rng(7)
    x = rng.integers(-size, size, (3000, 6)).astype(np.float64)
    x[500:2000] = x[500:2000] // (size // 2) * (size // 2)
    x[2000:2400] = x[2000]
    ids = np.arange(len(x)) * 3
    rows = np.arange(0, len(x), 10)
    calls = []
    add = topk.Best.add
    monkeypatch.setattr(topk.Best, "add", lambda self, *a: calls.append(1) or add(self, *a))
    monkeypatch.setattr(topk, "CELLS", 1 << 18, raising=False)
    best = topk.Best(ids[rows], 5, np.full(len(rows), -(1 << 61)))
    topk.dual_search(topk.CoverTree(x[rows]), topk.CoverTree(x), ids, best)
    whole = x.astype(np.int64).astype(object)
    scores = whole[rows] @ whole.T
    scores[np.arange(len(rows)), rows] = -(1 << 70)
    for n, r in enumerate(scores):
        want = sorted(zip((-s for s in r), ids))[:5]
        assert [(-s, v) for s, v in zip(best.score[n].tolist(), best.vec[n].tolist())] == [(s, int(v)) for s, v in want]
    assert len(calls) < 400


# pipeline
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == kept and kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == kept
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_products_beyond_doubles():
    rng = np.random.default_rng(2)
    for size in (1 << 10, 1 << 25, 1 << 30, 1 << 40):
        q, c = (rng.integers(-size, size, (3, 5)).astype(np.float64) for _ in range(2))
        limit = (1 << 62) - 1
        want = [[max(-limit, min(limit, sum(int(x) * int(y) for x, y in zip(a, b)))) for b in c] for a in q]
        assert topk.inner_products(q, c).tolist() == want


def test_scores_beyond_doubles(spark):
    rows = [(0, [float(2**20), 1.0 / 256]), (1, [float(2**20), 1.0 / 256]), (2, [float(2**20), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).collect()}
    assert got == {(1, 2**56 + 1), (2, 2**56)}
