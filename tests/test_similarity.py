"""Similarity joins, components and order-dependent operators against brute force on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.operators import graph, greedy, selection
from lumisift.operators import similarity as s
from lumisift.operators.ranges import ranked, running_sum


def unit(rng, n, dim):
    v = rng.normal(size=(n, dim)).astype("float32")
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clustered(seed=1, n=240, dim=8):
    """Random unit vectors, a dense group that holds a third of the rows, and exact copies."""
    rng = np.random.default_rng(seed)
    v = unit(rng, n, dim)
    third = n // 3
    base = v[0] + rng.normal(scale=0.03, size=(third, dim)).astype("float32")
    v[:third] = base / np.linalg.norm(base, axis=1, keepdims=True)
    v[third : third + 20] = v[third]  # copies
    return v


def frame(spark, v, **columns):
    n = len(v)
    names = list(columns)
    rows = [(i, [float(x) for x in v[i]], *[columns[c][i] for c in names]) for i in range(n)]
    kinds = {int: "long", float: "double", str: "string"}
    schema = "id long, v array<float>" + "".join(f", {c} {kinds[type(columns[c][0])]}" for c in names)
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(s, "CHUNK_ROWS", 16)


def closure(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.985])
def test_similar_pairs_with_pivots_and_chunks(spark, small_chunks, threshold):
    v = clustered()
    got = s.similar_pairs(frame(spark, v), "id", "v", threshold).collect()
    d = v.astype("float64")
    cos = d @ d.T
    _, first = np.unique(v, axis=0, return_index=True)
    reps = set(first.tolist())
    want = {(i, j) for i in reps for j in reps if i < j and cos[i, j] >= threshold}
    plain = [(r.a_id, r.b_id) for r in got if not r.copy]
    assert len(plain) == len(set(plain))
    assert {p for p in plain if abs(cos[p] - threshold) > 1e-6} == {p for p in want if abs(cos[p] - threshold) > 1e-6}
    stars = {(r.a_id, r.b_id) for r in got if r.copy}
    assert stars == {(80, i) for i in range(81, 100)}


def test_links_have_the_components_of_the_pairs_but_few_edges(spark, small_chunks):
    v = clustered()
    links = s.similar_links(frame(spark, v), "id", "v", 0.9)
    got = {r.id: r.component for r in graph.connected_components(links).collect()}
    d = v.astype("float64")
    cos = d @ d.T
    pairs = [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if cos[i, j] >= 0.9]
    want = closure(pairs, range(len(v)))
    linked = {i for p in pairs for i in p}
    assert got == {i: want[i] for i in linked}
    assert links.count() < len(pairs)


def test_best_match_with_pivots(spark, small_chunks):
    v = clustered(2)
    df = frame(spark, v)
    got = {r.id: r.score for r in s.best_match(df, df.filter("id % 3 = 0"), "id", "v", 0.6, exclude_same=True).collect()}
    d = v.astype("float64")
    cos = d @ d.T
    np.fill_diagonal(cos, -1)
    best = cos[:, ::3].max(1)
    assert set(got) == {i for i in range(len(v)) if best[i] >= 0.6}
    assert all(abs(got[i] - best[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("radius", [0, 1])
def test_hamming_pairs(spark, radius):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)]
    values = list(base)
    for b in base:
        for k in range(1, 9):
            x = b & (2**64 - 1)
            for bit in rng.choice(64, k, replace=False):
                x ^= 1 << int(bit)
            values.append(x - 2**64 if x >= 2**63 else x)
    values += [values[0]] * 5
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    got = [(r.a_id, r.b_id, r.distance) for r in s.hamming_pairs(df, "id", "h", 5, probe_radius=radius).collect()]
    assert len(got) == len(set(got))
    first = {}
    for i, x in enumerate(values):
        first.setdefault(x, i)
    want = set()
    for x, i in first.items():
        for y, j in first.items():
            n = bin((x ^ y) & (2**64 - 1)).count("1")
            if i < j and n <= 5:
                want.add((i, j, n))
    copies = {(first[x], i, 0) for i, x in enumerate(values) if first[x] != i}
    assert set(got) == want | copies


def walk(cos, order, t, k=None, seeds=()):
    taken = []
    for i in order:
        if k is not None and len(taken) >= k:
            break
        if all(cos[i, j] < t for j in [*taken, *seeds]):
            taken.append(i)
    return taken


@pytest.mark.parametrize("k,batch", [(5, 4), (60, 8), (400, 16)])
def test_greedy_pick_in_small_batches(spark, k, batch):
    v = clustered(4)
    quality = [float((i * 37) % 101) for i in range(len(v))]
    df = frame(spark, v, q=quality)
    picked = greedy.greedy_pick(df, ["-q"], greedy.Closeness(vec="v", threshold=0.7), k, "id", batch=batch)
    got = [r.id for r in picked.orderBy("pick").collect()]
    d = v.astype("float64")
    order = sorted(range(len(v)), key=lambda i: (-quality[i], i))
    assert got == walk(d @ d.T, order, 0.7, k)


def test_greedy_pick_without_shipping_the_accepted_rows(spark, monkeypatch):
    monkeypatch.setattr(greedy, "MAX_ACCEPTED_BYTES", 0)
    v = clustered(5, 120)
    df = frame(spark, v, g=[i % 2 for i in range(len(v))])
    picked = greedy.greedy_pick(df, ["id"], greedy.Closeness(vec="v", threshold=0.6), 40, "id", ["g"], batch=8)
    d = v.astype("float64")
    for g in (0, 1):
        got = [r.id for r in picked.filter(F.col("g") == g).orderBy("pick").collect()]
        assert got == walk(d @ d.T, range(g, len(v), 2), 0.6, 40)


def test_greedy_unlimited_with_seeds(spark, small_chunks):
    v = clustered(6)
    quality = [float((i * 37) % 101) for i in range(len(v))]
    df = frame(spark, v, q=quality)
    seeds = df.filter("id % 10 = 7")
    picked = greedy.greedy_diverse(df.filter("id % 10 <> 7"), ["-q"], 0.8, None, "id", "v", seeds=seeds)
    d = v.astype("float64")
    order = sorted((i for i in range(len(v)) if i % 10 != 7), key=lambda i: (-quality[i], i))
    assert [r.id for r in picked.orderBy("pick").collect()] == walk(d @ d.T, order, 0.8, None, range(7, len(v), 10))


@pytest.mark.parametrize("turns", [0, 2])
def test_greedy_unlimited_in_batches(spark, monkeypatch, turns):
    for name, size in (("WALK_ROWS", 20), ("WALK_TURNS", turns), ("HEAD_ROWS", 40)):
        monkeypatch.setattr(greedy, name, size)
    compared = []
    match = greedy.with_earlier_match
    monkeypatch.setattr(greedy, "with_earlier_match", lambda df, *x: compared.append(df.count()) or match(df, *x))
    v = clustered(8)
    quality = [float((i * 41) % 103) for i in range(len(v))]
    picked = greedy.greedy_diverse(frame(spark, v, q=quality), ["-q"], 0.8, None, "id", "v")
    d = v.astype("float64")
    order = sorted(range(len(v)), key=lambda i: (-quality[i], i))
    assert [r.id for r in picked.orderBy("pick").collect()] == walk(d @ d.T, order, 0.8)
    assert compared[0] < len(v) / 2  # rows are not compared with all others


def sequential_suppress(cos, q, t, stop):
    gone = set()
    for i in range(len(q)):
        if i in gone:
            continue
        for j in range(i + 1, len(q)):
            if j in gone or cos[i, j] < t:
                continue
            if q[i] >= q[j]:
                gone.add(j)
            else:
                gone.add(i)
                if stop:
                    break
    return gone


@pytest.mark.parametrize("stop", [True, False])
def test_suppress_pairs(spark, small_chunks, stop):
    v = clustered(7, 150)
    q = [float((i * 53) % 17) for i in range(len(v))]
    gone = greedy.suppress_pairs(frame(spark, v, q=q), 0.75, "id", "v", "id", "q", stop=stop)
    d = v.astype("float64")
    assert {r.id for r in gone.collect()} == sequential_suppress(d @ d.T, q, 0.75, stop)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"))
    found = graph.connected_components(edges)
    assert found.count() == 201 and found.filter("component = 0").count() == 201


def test_ranked_equals_a_window_for_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 5000).alias("x"), "id",
    )
    got = {r.id: r["rank"] for r in ranked(df, ["g"], [F.col("x").desc(), "id"]).collect()}
    from pyspark.sql import Window

    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("x").desc(), "id")))
    assert got == {r.id: r["rank"] for r in want.collect()}


def test_running_sum_over_blocks(spark, monkeypatch):
    from lumisift.operators import ranges

    monkeypatch.setattr(ranges, "BLOCK_ROWS", 7)
    got = running_sum(spark.range(100), "id", F.col("id") % 5, "total").orderBy("id").collect()
    assert [r.total for r in got] == np.cumsum(np.arange(100) % 5).tolist()


def test_clusters_of_the_reference_size(spark):
    """Three groups of five near copies and 35 single rows: three clusters, twelve suppressed rows; running it again
    on its own output changes nothing."""
    rng = np.random.default_rng(8)
    single = unit(rng, 38, 64)
    rows = []
    for g in range(3):
        for k in range(5):
            x = single[g] + rng.normal(scale=0.002, size=64)
            rows.append(x / np.linalg.norm(x))
    v = np.array(rows + list(single[3:]), dtype="float32")
    df = frame(spark, v).select(
        F.format_string("h%02d", "id").alias("hash"), F.col("v").alias("vector"), F.lit("qualified").alias("status"),
        (F.col("id") % 7).cast("double").alias("composite"), F.lit(10).alias("size_kb"),
    )
    once = graph.cluster(df, 0.985, None)
    from lumisift.operators.aggregates import cluster_diagnostics

    assert tuple(cluster_diagnostics(once).first()) == (3, 12, 5)
    again = graph.cluster(once, 0.985, None)
    key = lambda r: tuple(r[c] or "" for c in ("hash", "cluster_id", "suppressed_by", "cluster_size"))
    assert sorted(map(key, once.collect())) == sorted(map(key, again.collect()))
    best = once.filter("is_representative").groupBy("cluster_id").count().collect()
    assert all(r["count"] == 1 for r in best)


def test_tiered_refill_and_backup(spark):
    from lumisift.plans.q_selection import REFILL_NEEDS, _refill, rated_assets

    d = "/root/testdata/sf0.001"
    t = 0.35
    fill, backup = _refill(spark, d, t)
    data = rated_assets(spark, d).select("vec_id", "vector", "category", "quality", "face_count").collect()
    v = {r.vec_id: np.array(r.vector, dtype="float64") for r in data}
    cat = {r.vec_id: r.category for r in data}
    q = {r.vec_id: r.quality for r in data}
    faces = {r.vec_id: r.face_count for r in data}
    ids = sorted(v)
    for c, need in REFILL_NEEDS.items():
        mine = [i for i in ids if cat[i] == c]
        chosen = [i for i in mine if i % 5 == 0]
        one = [i for i in mine if i % 5 == 1]
        two = [i for i in mine if i % 5 > 1 and i % 2 == 0]
        offered = [(0, i) for i in one] + [(1, i) for i in two]
        order = [i for _, i in sorted(offered, key=lambda x: (x[0], -q[x[1]], x[1]))]
        taken = []
        for i in order:
            if len(taken) < need and all(v[i] @ v[j] < t for j in [*taken, *chosen]):
                taken.append(i)
        extra = sorted((i for i in mine if i % 5 == 3 and i not in taken), key=lambda i: (-faces[i], -q[i], i))
        extra = extra[: max(0, need - len(taken))]
        got = fill.filter(F.col("category") == c).collect()
        assert {r.vec_id for r in got if r["pass"] == "diverse"} == set(taken)
        assert {r.vec_id for r in got if r["pass"] == "relaxed"} == set(extra)
        spare = []
        for i in order:
            if i in taken or i in extra or len(spare) >= 10:
                continue
            if all(v[i] @ v[j] < t for j in [*taken, *extra, *chosen, *spare]):
                spare.append(i)
        assert {r.vec_id for r in backup.filter(F.col("category") == c).collect()} == set(spare)


def test_adaptive_even_diverse(spark):
    import __spark_entry__ as entry
    from lumisift.plans.q_selection import rated_assets

    d = "/root/testdata/sf0.001"
    got = {(r.label, r.vec_id) for r in entry.queries()["e8_adaptive_even_diverse"](spark, d).collect()}
    data = rated_assets(spark, d).select("vec_id", "vector", "label", "date").collect()
    v = {r.vec_id: np.array(r.vector, dtype="float64") for r in data}
    want = set()
    for label in {r.label for r in data}:
        mine = [r for r in data if r.label == label]
        old = [r.vec_id for r in mine if r.vec_id % 4 == 0]
        fresh = [r for r in mine if r.vec_id % 4 > 0 and all(v[r.vec_id] @ v[o] < 0.30 for o in old)]
        fresh.sort(key=lambda r: (r.date, r.vec_id))
        spread = [fresh[int(i * (len(fresh) / 12))] for i in range(12)] if len(fresh) > 12 else fresh
        taken = []
        for r in spread:
            if all(v[r.vec_id] @ v[x] < 0.30 for x in taken):
                taken.append(r.vec_id)
        want |= {(label, i) for i in taken}
    assert got == want


def test_quick_fill_against_a_walk(spark):
    """The same steps row by row in numpy; the score is recomputed from the published weights."""
    import hashlib

    from lumisift.plans.q_selection import GROUPS, rated_assets
    from lumisift.operators.preference import PreferenceModel

    d = "/root/testdata/sf0.001"
    df = rated_assets(spark, d)
    got = {r.vec_id for r in selection.quick_fill(
        df, GROUPS, PreferenceModel(None), vec="vector", dhash="dhash", key="vec_id").filter("picked").collect()}
    rows = {r.vec_id: r for r in df.collect()}
    v = {i: np.array(r.vector, dtype="float64") for i, r in rows.items()}

    def mid(label):
        m = np.mean([v[i] for i, r in rows.items() if r.preference == label and live(r)], axis=0)
        return m / np.linalg.norm(m)

    def live(r):
        return r.status != "rejected"

    like, dislike = mid("like"), mid("dislike")
    liked = [i for i, r in rows.items() if r.preference == "like" and live(r)]
    disliked = [i for i, r in rows.items() if r.preference == "dislike" and live(r)]

    def bits(i, j):
        return bin((rows[i].dhash ^ rows[j].dhash) & (2**64 - 1)).count("1")

    def burst(i, j):
        return rows[i].path[:7] == rows[j].path[:7] and abs(i * 3 - j * 3) <= 3

    def duplicate(i, state):
        worst = 0.0
        if any(burst(i, j) for j in state):
            worst = 100.0
        near = min((bits(i, j) for j in state), default=99)
        worst = max(worst, 100.0 if near <= 5 else (10 - near) * 15.0 if near <= 10 else 0.0)
        top = max((v[i] @ v[j] for j in state), default=-1)
        worst = max(worst, 100.0 if top > 0.95 else (top - 0.88) * (100 / 0.07) if top > 0.88 else 0.0)
        return min(worst, 100.0)

    def score(i, state):
        r = rows[i]
        if r.preference:
            pref = 95.0 if r.preference == "like" else 5.0
        else:
            pref = 50 + v[i] @ like * 20 - max(0, v[i] @ dislike) * 15
            pref += max(0, max(v[i] @ v[j] for j in liked) - 0.85) * 60 - max(0, max(v[i] @ v[j] for j in disliked) - 0.80) * 50
            pref = min(100, max(0, pref))
        qual = min(100, r.composite + (10 if r.has_target_face else 5 if r.face_count else 0))
        div = 50.0
        if state:
            top = max(v[i] @ v[j] for j in state)
            div -= max(0, top - 0.75) * 200
            day = sum(rows[j].date == r.date for j in state)
            place = sum(rows[j].location == r.location for j in state) if r.location else 0
            div -= min(30, (day - 3) * 5) if day > 3 else 0
            div -= min(20, (place - 5) * 4) if place > 5 else 0
            div = max(-100, min(100, div))
        explore = 0.0 if r.preference else min(100, 40 + int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 100 / 100 * 30)
        return 0.6 * pref + 0.2 * qual + 0.1 * div + 0.1 * explore - duplicate(i, state)

    state, picked = [], set()
    for c in GROUPS:
        for media, target in (("image", c.target), ("video", c.video_target)):
            pool = [i for i, r in rows.items() if r.category == c.id and r.media_type == media and live(r)]
            already = [i for i in pool if rows[i].status == "selected"]
            state += already
            room = max(0, target - len(already))
            start = list(state)
            open_rows = sorted((i for i in pool if rows[i].status != "selected"), key=lambda i: (-score(i, start), i)) if room else []
            for i in open_rows:
                if room == 0:
                    break
                if duplicate(i, state) >= 100:
                    continue
                picked.add(i)
                state.append(i)
                room -= 1
    assert got == picked


def test_links_of_a_dense_group_are_linear(spark, monkeypatch):
    """A group of near copies that holds most rows yields about one link per row, and few compared chunk pairs."""
    monkeypatch.setattr(s, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(9)
    v = unit(rng, 400, 8)
    v[:300] = v[0] + rng.normal(scale=0.002, size=(300, 8)).astype("float32")
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")
    df = frame(spark, v)
    links = s.similar_links(df, "id", "v", 0.95)
    assert links.count() < 900
    d = v.astype("float64")
    cos = d @ d.T
    want = closure([(i, j) for i in range(400) for j in range(i + 1, 400) if cos[i, j] >= 0.95], range(400))
    got = {r.id: r.component for r in graph.connected_components(links).collect()}
    assert all(got.get(i, i) == want[i] for i in range(400))
    rows = s._vectors(df, "id", "v", [], False)
    pivots = s._draw_pivots(rows, 400, s._radius(0.95))
    roles = {r["_role"]: r["count"] for r in s._placed(rows, [], pivots, s._radius(0.95), True).groupBy("_role").count().collect()}
    assert roles["core"] >= 300


def test_bit_arrays_of_256_bits(spark):
    import random

    rng = random.Random(2)
    base = [[rng.randrange(2) for _ in range(256)] for _ in range(40)]
    rows = [(i, b, None if i % 3 == 0 else i % 3) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for flips in (0, 1, 29, 30, 31):
            c = list(b)
            for p in rng.sample(range(256), flips):
                c[p] ^= 1
            rows.append((len(rows), c, None if i % 3 == 0 else i % 3))
    odd = [(1000, None, 1), (1001, [None] * 256, 1), (1002, [0] * 255, 1), (1003, [0] * 255, 1), (1004, [1] * 256, None), (1005, [1] * 256, None)]
    df = spark.createDataFrame(rows + odd, "id int, bits array<int>, g int")
    got = {(r.a_id, r.b_id): r.distance for r in s.bit_array_pairs(df, "id", "bits", 0.12, 256, ["g"]).collect()}
    firsts = {}
    for i, b, g in rows:
        firsts.setdefault((tuple(b), g), i)
    expected = {(1004, 1005): 0}
    for i, b, g in rows:
        if firsts[tuple(b), g] != i:
            expected[firsts[tuple(b), g], i] = 0
    single = [(i, b, g) for i, b, g in rows if firsts[tuple(b), g] == i]
    for i, b, g in single:
        for k, c, h in single:
            d = sum(x != y for x, y in zip(b, c))
            if i < k and g == h and d / 256 < 0.12:
                expected[i, k] = d
    assert got == expected
    assert s.bit_array_pairs(df.limit(0), "id", "bits").count() == 0


def test_null_groups_in_hash_and_burst_joins(spark):
    rows = [(1, 5, None, "a", 1, [1.0, 0.0]), (2, 5, None, "a", 2, [0.8, 0.6]), (3, 4, None, "a", 40, [0.0, 1.0]), (4, 5, 7, "a", 1, [1.0, 0.0]),
            (5, 7, 7, None, 2, [0.8, 0.6])]
    df = spark.createDataFrame(rows, "id int, h long, g int, p string, n long, v array<double>")
    got = {(r.a_id, r.b_id): r.distance for r in s.hamming_pairs(df, "id", "h", 1, by=["g"]).collect()}
    assert got == {(1, 2): 0, (1, 3): 1, (4, 5): 1}
    near = {(r.a_id, r.b_id, r.signal) for r in s.burst_visual_pairs(df, "id", "v", "p", "n", ["g"], 0.95, 0.7).collect()}
    assert near == {(1, 2, "burst")}


def test_tags_in_blocks_and_unusable_vectors(spark):
    vocabulary = [(f"t{i}", "f", [float(i), 1.0]) for i in range(7)]
    df = spark.createDataFrame([(1, [1.0, 0.5]), (2, [-1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [1.0])], "id int, v array<double>")
    whole = sorted(s.tag_similarity(df, vocabulary, "id", "v").collect())
    assert [r.id for r in whole] == [1, 2] and [t.tag for t in whole[0].scores] == [f"t{i}" for i in range(6, -1, -1)]
    assert sorted(s.tag_similarity(df, vocabulary, "id", "v", max_bytes=32).collect()) == whole
    assert s.tag_similarity(df, [], "id", "v").collect()[0].scores == []


def test_mixed_lengths_and_null_elements(spark):
    rows = [(1, [1.0, 0.0, 0.0], "a"), (2, [1.0], "a"), (3, [0.0, 1.0], "a"), (4, [1.0, 0.0], "a"), (5, [0.6, 0.8], "a"), (6, [None, 1.0], "a"),
            (7, None, "a"), (8, [0.6, 0.8], "b"), (9, [0.8, 0.6], "b"), (10, [1.0], "b"), (11, [], "a")]
    df = spark.createDataFrame(rows, "id int, v array<double>, g string")
    for k in (20, None):
        picked = greedy.greedy_diverse(df, ["id"], 0.9, k, "id", "v").select("id").collect()
        assert sorted(r.id for r in picked) == [1, 2, 3, 4, 5, 6, 11]
        grouped = greedy.greedy_diverse(df, ["id"], 0.9, k, "id", "v", ["g"]).select("id").collect()
        assert sorted(r.id for r in grouped) == [1, 2, 3, 4, 5, 6, 8, 10, 11]
    got = {r.g: (round(r.mean_dist, 9), round(r.min_dist, 9), round(r.max_dist, 9)) for r in s.distance_statistics(df, "id", "v", ["g"]).collect()}
    near = [np.sqrt(2), np.sqrt(0.36 + 0.04), np.sqrt(0.16 + 0.64)]
    assert got == {"a": (round(float(np.mean(near)), 9), round(float(min(near)), 9), round(float(max(near)), 9)),
                   "b": (round(float(np.sqrt(0.08)), 9),) * 3}


def test_every_pair_of_copies(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.99, 0.14106736], [0.99, 0.14106736], [0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<float>")
    found = s.every_pair(s.similar_pairs(df, "id", "v", 0.98)).collect()
    assert sorted((r.a_id, r.b_id) for r in found) == [(i, j) for i in range(5) for j in range(i + 1, 5)]


@pytest.mark.parametrize("name", ["j5_hamming_pairs", "j7_phash_pairs", "j7_phash_pairs_256", "s15_removal_log"])
def test_groups_of_copies_equal_their_sql(spark, tmp_path, name):
    """Groups of four equal hashes and of three near vectors."""
    import duckdb

    import __spark_entry__ as entry
    from tests.compare import compare

    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 64))
    v = np.repeat(base, 4, axis=0) * np.tile([1.0, 2.0, 1.0, 1.0], 12)[:, None]
    v[2::4] += 1e-4 * rng.standard_normal((12, 64))
    v = v / np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, x.tolist(), i // 4 % 3) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(name, spark, con, str(tmp_path), entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name,small", [
    ("j4_cosine_pairs", False), ("j4_cosine_pairs", True), ("j4_cosine_pairs_by_label", True), ("j4_sign_hash_pairs", False),
    ("j20_burst_visual_pairs", False), ("j4_cosine_pairs_075", False), ("j4_cosine_pairs_085", False), ("j6_semantic_pairs", False)])
def test_pairs_of_copies_equal_their_sql(spark, tmp_path, monkeypatch, name, small):
    """Groups of copies with near vectors beside them, rows that come twice, and an id that stands at several vectors."""
    import duckdb

    import __spark_entry__ as entry
    from tests.compare import compare

    if small:
        monkeypatch.setattr(s, "CHUNK_ROWS", 4)
        monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(6)
    v = np.repeat(rng.standard_normal((9, 64)), 7, axis=0)
    v[4::7] += 0.03 * rng.standard_normal((9, 64))
    v[5::7] += 0.06 * rng.standard_normal((9, 64))
    v = v / np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, x.tolist(), i // 7 % 3) for i, x in enumerate(v)]
    rows += rows[:10] + ([(3, v[15].tolist(), 0), (3, v[16].tolist(), 0), (15, v[0].tolist(), 0)] if small else [])
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(name, spark, con, str(tmp_path), entry.queries()[name], entry.oracle_sql()[name]) is None


def test_exploded_sides_are_never_broadcast(spark):
    """Spark takes the exploded bands of a small table for small."""
    df = spark.range(200).select("id", F.xxhash64("id").alias("h"))
    plan = s.hamming_pairs(df, "id", "h", 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan.split("Union")[1].split("_rep")[0] and s.hamming_pairs(df, "id", "h", 64, probe_radius=1).count() == 200 * 199 // 2


def test_blocks_decide_like_doubles():
    """Products in 32 bits never decide a pair at the threshold."""
    rng = np.random.default_rng(8)
    x = unit(rng, 300, 24).astype("float64")
    y = unit(rng, 200, 24).astype("float64")
    for t in np.sort((x @ y.T).ravel())[[500, 30_000, 59_000]]:
        block = s._Block(np.arange(300), x, np.arange(200) + 1000, y, False)
        exact = np.einsum("ik,jk->ij", x, y)
        near = np.concatenate([hit for _, hit in block.near(float(t))])
        assert (near == (exact >= t))[np.abs(exact - t) > 1e-12].all() and near.shape == (300, 200)
    own = s._Block(np.arange(300), x, np.arange(0), x[:0], True)
    pairs = s._pairs_of(own, 0.3)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.3, 1))
    assert sorted(zip(pairs["a_id"].tolist(), pairs["b_id"].tolist())) == list(zip(i.tolist(), j.tolist()))


def test_a_row_meets_a_bounded_number_of_chunks():
    assert s._tile_rows(1_000, 64, 128) == 128
    for total in (100_000, 700_000, 1_500_000):
        assert total / s._tile_rows(total, 64, 128) <= s.TILES
    assert s._tile_rows(10**9, 64, 128) * 64 * 4 <= s.TILE_BYTES


def test_suppression_settles_in_few_rounds(spark, monkeypatch):
    """A chain in which each row meets the next: rows two steps apart settle together, whatever their order."""
    calls = []
    keep = greedy.cut_lineage
    monkeypatch.setattr(greedy, "cut_lineage", lambda df: calls.append(1) or keep(df))
    angle = np.arange(40) * 0.1
    v = np.column_stack([np.cos(angle), np.sin(angle)]).astype("float32")
    q = [float(i) for i in range(40)]
    gone = greedy.suppress_pairs(frame(spark, v, q=q), 0.99, "id", "v", "id", "q")
    # each row is beaten by the next, better one
    assert {r.id for r in gone.collect()} == set(range(39))
    assert len(calls) < 20


@pytest.mark.parametrize("stop,most", [(True, 1 << 20), (True, 40), (False, 40)])
def test_suppression_in_heads(spark, monkeypatch, stop, most):
    """Heads meet the rows that are left behind them, and no pair of the others is formed; tasks that may report few
    edges leave the later rows of a head to the next one. Groups, copies, equal qualities and a dense group."""
    for name, value in (("HEAD_FIRST", 12), ("HEAD_MOST", 60), ("HEAD_EDGES", most), ("BETTER", 2)):
        monkeypatch.setattr(greedy, name, value, raising=False)
    monkeypatch.setattr(greedy, "similar_pairs", None)
    monkeypatch.setattr(s, "SLICE_CELLS", 64)
    v = clustered(11, 360)
    q = [float((i * 53) % 19) for i in range(len(v))]
    g = [i % 2 for i in range(len(v))]
    df = frame(spark, v, q=q, g=g)
    d = v.astype("float64")
    gone = greedy.suppress_pairs(df, 0.75, "id", "v", "id", "q", stop=stop)
    assert sorted(r.id for r in gone.collect()) == sorted(sequential_suppress(d @ d.T, q, 0.75, stop))
    if most < 1000:
        apart = np.where(np.equal.outer(g, g), d @ d.T, -1.0)
        gone = greedy.suppress_pairs(df.unionByName(df.filter("id < 30")), 0.75, "id", "v", "id", "q", ["g"], stop=stop)
        want = sequential_suppress(apart, q, 0.75, stop)
        assert sorted(r.id for r in gone.collect()) == sorted([*want, *(i for i in want if i < 30)])


def test_few_similar_rows_are_left_to_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(greedy, "HEAD_FIRST", 20)
    monkeypatch.setattr(greedy, "FEW_ROWS", 50)
    calls = []
    pairs = greedy.similar_pairs
    monkeypatch.setattr(greedy, "similar_pairs", lambda *a, **k: calls.append(1) or pairs(*a, **k))
    v = clustered(12, 200)
    v[:100] = unit(np.random.default_rng(1), 100, 8)
    q = [float((i * 53) % 19) for i in range(len(v))]
    d = v.astype("float64")
    gone = greedy.suppress_pairs(frame(spark, v, q=q), 0.97, "id", "v", "id", "q")
    assert {r.id for r in gone.collect()} == sequential_suppress(d @ d.T, q, 0.97, True) and calls
