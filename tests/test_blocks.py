"""Block bounds and the sign-hash mode on clustered vectors, against numpy."""

import numpy as np
import pytest

from lumisift.operators import blocks as b
from lumisift.operators import similarity as s


def clustered(count=1500, centres=25, size=48, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, size))
    c /= np.linalg.norm(c, axis=1)[:, None]
    x = c[rng.integers(0, centres, count)] + 0.35 / np.sqrt(size) * rng.standard_normal((count, size))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype("float32").astype("float64")


@pytest.fixture(scope="module")
def rows():
    x = clustered()
    x[7] = x[6]  # a copy
    return x


@pytest.fixture(scope="module")
def table(spark, rows):
    odd = [(5000, [1.0, 0.0]), (5001, [1.0, 0.0001]), (5002, [0.0] * 48), (5003, None), (5004, [None] * 48)]
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + odd, "id long, v array<float>").repartition(4)


def expected(rows, threshold):
    score = rows @ rows.T
    i, j = np.nonzero(np.triu(score >= threshold, 1))
    near = np.abs(score - threshold) < 1e-6
    return {p for p in zip(i.tolist(), j.tolist()) if 7 not in p} , near.any()


@pytest.mark.parametrize("threshold", [0.92, 0.85, 0.75])
def test_pairs_through_blocks(table, rows, threshold, monkeypatch):
    monkeypatch.setattr(s, "_draw_pivots", lambda *a, **k: None)  # no cells
    found = s.similar_pairs(table, "id", "v", threshold, chunk_rows=4).collect()
    got = {(r.a_id, r.b_id) for r in found if not r.copy and r.a_id < 5000}
    assert got == expected(rows, threshold)[0]
    assert {(r.a_id, r.b_id) for r in found if r.copy} == {(6, 7)}
    assert {(r.a_id, r.b_id) for r in found if r.a_id >= 5000} == {(5000, 5001)}
    assert len(found) == len(got) + 2


def test_blocks_are_dropped(table):
    report = {t: s.block_report(table.filter("id < 5000"), "id", "v", t, chunk_rows=4).first() for t in (0.92, 0.85, 0.75)}
    shares = {t: r.compared / r.pairs for t, r in report.items()}
    print("block pairs compared:", {t: f"{r.compared} of {r.pairs}" for t, r in report.items()})
    assert shares[0.92] <= shares[0.85] <= shares[0.75] < 0.5


def test_no_bound_hides_a_pair(rows):
    """The bounds of any two blocks hold for all rows in them."""
    fitted = b.Blocks(b._spread(rows[:200], 12), b._spread(rows[:200], 12)[:5], np.linalg.svd(rows[:200], full_matrices=False)[2][:6].T, 40)
    home, at = b.coordinates(fitted, rows)
    t = len(fitted.table)
    assert np.allclose(fitted.basis.T @ fitted.basis, np.eye(6))
    for g in range(12):
        for h in range(12):
            x, y = rows[home == g], rows[home == h]
            if not len(x) or not len(y):
                continue
            low, high = (np.array([f(at[home == k], axis=0) for k in (g, h)]) for f in (np.min, np.max))
            gap = np.maximum(low[0, :t] - high[1, :t], low[1, :t] - high[0, :t]).max()
            ends = [p * q for p in (low[0, t:-1], high[0, t:-1]) for q in (low[1, t:-1], high[1, t:-1])]
            most = np.max(ends, axis=0).sum() + high[0, -1] * high[1, -1]
            score = x @ y.T
            assert score.max() <= most + 1e-9
            assert np.sqrt(max(0.0, 2 - 2 * score.max())) >= gap - 1e-6


def test_other_joins_through_blocks(spark, table, rows, monkeypatch):
    monkeypatch.setattr(s, "_draw_pivots", lambda *a, **k: None)
    score = rows @ rows.T
    left, right = table.filter("id % 2 = 0"), table.filter("id % 2 = 1 and id < 5000")
    best = {r.id: r.score for r in s.best_match(left, right, "id", "v", 0.85, chunk_rows=4).collect()}
    odd = score[0::2, 1::2].max(1)
    assert set(best) == {2 * i for i in range(len(odd)) if odd[i] >= 0.85}
    assert all(abs(best[2 * i] - odd[i]) < 1e-6 for i in range(len(odd)) if 2 * i in best)
    late = {r["rank"] for r in s.with_earlier_match(table.filter("id < 5000").withColumnRenamed("id", "rank"), "rank", "v", 0.85, chunk_rows=4).collect()}
    assert late == {j for j in range(len(rows)) if (score[j, :j] >= 0.85).any()}
    links = [(r.a_id, r.b_id) for r in s.similar_links(table.filter("id < 5000"), "id", "v", 0.85, chunk_rows=4).collect()]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, y in links:
        label[max(root(x), root(y))] = min(root(x), root(y))
    near = score >= 0.85
    seen = [-1] * len(rows)
    for i in range(len(rows)):
        if seen[i] < 0:
            todo = [i]
            while todo:
                k = todo.pop()
                if seen[k] < 0:
                    seen[k] = i
                    todo += np.flatnonzero(near[k]).tolist()
    assert [root(i) for i in range(len(rows))] == seen


def test_sign_hash_mode(table, rows):
    wanted = expected(rows, 0.85)[0]
    found = s.approximate_pairs(table, "id", "v", 0.85, recall=0.95).collect()
    got = {(r.a_id, r.b_id) for r in found if not r.copy and r.a_id < 5000}
    assert got <= wanted and len([r for r in found if not r.copy and r.a_id < 5000]) == len(got)
    recall = len(got) / len(wanted)
    print("recall of the sign-hash mode:", round(recall, 4), "tables:", s.sign_tables(0.85, 0.95, 12))
    assert recall >= 0.9
    assert {(r.a_id, r.b_id) for r in found if r.copy} == {(6, 7)}
    assert s.approximate_pairs(table.limit(0), "id", "v", 0.85).count() == 0
