"""Exact top-k by inner product: cover trees over queries and candidates, searched together."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

# rows of a leaf, and most children of a node: two leaves meet in one matrix product, so they are large
LEAF, FAN = 1_024, 32
CELLS = 1 << 21  # scores that a task holds at once
PIVOTS = 64
SAMPLE = 4_096  # rows from which pivots are drawn; they steer the cells only, never the result
# rows of one candidate shard and one query group; both kinds grow in number, not in size
SHARD_ROWS, GROUP_ROWS = 16_384, 2_048
BUNDLE_ROWS = 16_384  # queries that meet a shard in one task
_RATIO = 0.5


class CoverTree:
    """Nested nets: each child centre covers its points within half the parent's radius or better.

    Nodes are arrays: centre row, covering radius (the true largest distance), and either children or point rows.
    Equal points fall into one leaf of radius 0, whatever their number.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.points = points
        squares = np.einsum("ij,ij->i", points, points)
        # whole numbers whose sums of products are exact in doubles
        self._squares = squares if squares.max(initial=0) < 1 << 50 and not (points % 1).any() else None
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        todo = [(np.arange(len(points)), 0, -1)] if len(points) else []
        while todo:
            rows, centre, parent = todo.pop()
            away = self._distance(rows, int(rows[centre]))
            node = len(self.centre)
            self.centre.append(int(rows[centre]))
            # a margin for rounding, so that the radius never errs to the low side
            self.radius.append(float(away.max()) * (1 + 1e-9) + 1e-9 if away.max() else 0.0)
            self.children.append([])
            self.rows.append(None)
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= leaf or not away.max():
                self.rows[node] = rows
                continue
            # farthest-first net: every point ends within half the radius of some centre of the net
            goal, centres = away.max() * _RATIO, [centre]
            owner, near = np.zeros(len(rows), np.int64), away.copy()
            while near.max() > goal and len(centres) < fan:
                far = int(near.argmax())
                new = self._distance(rows, int(rows[far]))
                closer = new < near
                owner[closer], near[closer] = len(centres), new[closer]
                owner[far], near[far] = len(centres), 0
                centres.append(far)
            for n, c in enumerate(centres):
                mine = np.flatnonzero(owner == n)
                todo.append((rows[mine], int(np.searchsorted(mine, c)), node))

    def _distance(self, rows: np.ndarray, to: int) -> np.ndarray:
        if self._squares is not None:
            return np.sqrt(self._squares[rows] + self._squares[to] - 2 * (self.points[rows] @ self.points[to]))
        gap = self.points[rows] - self.points[to]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def bound(q: np.ndarray, q_radius: float, c: np.ndarray, c_radius) -> np.ndarray:
    """Largest inner product of any point within q_radius of q with any within c_radius of a row of c."""
    nq, nc = math.sqrt(float(q @ q)), np.sqrt(np.einsum("ij,ij->i", c, c))
    value = c @ q + q_radius * nc + c_radius * nq + q_radius * c_radius
    # rounding grows with the terms of the sum, not with what is left of it
    return value + 1e-9 * np.abs(value) + 1e-12 * nq * nc + 1e-6


def _largest_sum(q: np.ndarray, c: np.ndarray) -> float:
    return float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of whole numbers, queries x candidates: in doubles while every sum stays below
    2^53, in 64-bit integers below 2^63, else in Python's integers (scores beyond 2^62 are reported as 2^62 - 1, with their
    sign)."""
    most = _largest_sum(q, c)
    if most < 1 << 53:
        return np.rint(q @ c.T).astype(np.int64)
    if most < 1 << 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    big = [[int(x) for x in row] for row in c]
    out = [[sum(x * y for x, y in zip(map(int, row), other)) for other in big] for row in q]
    limit = (1 << 62) - 1
    return np.array([[max(-limit, min(limit, x)) for x in row] for row in out], np.int64).reshape(len(q), len(c))


class Best:
    """The k best (score, vec_id) for each query; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.own, self.k = ids, k
        self.score = np.full((len(ids), k), -(1 << 62), np.int64)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = floor  # scores that other shards already guarantee

    def bars(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach to matter."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def worst(self, rows: np.ndarray) -> int:
        return int(self.bars(rows).min())

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: queries x candidates, whole numbers of any type that holds them exactly."""
        hit = scores >= self.bars(rows).astype(scores.dtype)[:, None]
        # early blocks, before any score is known: only the best of the block, one more since a row may meet itself
        beyond = len(ids) - self.k - 1
        if beyond > 0 and np.count_nonzero(hit) > 8 * self.k * len(rows):
            hit &= scores >= np.partition(scores, beyond, axis=1)[:, beyond, None]
        i, j = np.nonzero(hit)
        score, vec = scores[i, j].astype(np.int64), ids[j]
        at = rows[i]
        # a score equal to the kth known one counts with a smaller id only
        new = (vec != self.own[at]) & ((score > self.score[at, -1]) | (vec < self.vec[at, -1]))
        if not new.any():
            return
        some, group = np.unique(i[new], return_inverse=True)
        some = rows[some]
        group = np.concatenate([np.repeat(np.arange(len(some)), self.k), group])
        score = np.concatenate([self.score[some].ravel(), score[new]])
        vec = np.concatenate([self.vec[some].ravel(), vec[new]])
        order = np.lexsort((vec, -score, group))
        first = np.searchsorted(group[order], np.arange(len(some)))
        best = order[first[:, None] + np.arange(self.k)]
        self.score[some], self.vec[some] = score[best], vec[best]


def dual_search(queries: CoverTree, cands: CoverTree, cand_ids: np.ndarray, best: Best) -> None:
    """Walk pairs of nodes, best bound first; drop a pair when its bound is below the query node's worst kth score.

    A bound equal to that score is followed, since a tie may go to a smaller id. Two leaves meet in matrix products of
    bounded size, in the smallest numbers that hold every sum exactly.
    """
    if not queries.centre or not cands.centre:
        return
    x, y = queries.points, cands.points
    most = _largest_sum(x, y)
    if most < 1 << 24:
        x, y = x.astype(np.float32), y.astype(np.float32)
    members: dict[int, np.ndarray] = {}

    def rows_of(node: int) -> np.ndarray:
        if node not in members:
            own = queries.rows[node]
            members[node] = own if own is not None else np.concatenate([rows_of(c) for c in queries.children[node]])
        return members[node]

    c_centres, c_radius = cands.points[cands.centre], np.array(cands.radius)
    todo = [(0, 0, np.inf)]
    while todo:
        q, c, most = todo.pop()
        rows = rows_of(q)
        if most < best.worst(rows):
            continue
        if queries.rows[q] is not None and cands.rows[c] is not None:
            mine = cands.rows[c]
            for j in range(0, len(mine), CELLS // LEAF):
                there = mine[j:j + CELLS // LEAF]
                for i in range(0, len(rows), LEAF):
                    here = rows[i:i + LEAF]
                    exact = x[here] @ y[there].T if most < 1 << 53 else inner_products(x[here], y[there])
                    best.add(here, exact, cand_ids[there])
            continue
        # the wider node is split
        if cands.rows[c] is None and (queries.rows[q] is not None or cands.radius[c] >= queries.radius[q]):
            kids = np.array(cands.children[c])
            b = bound(queries.points[queries.centre[q]], queries.radius[q], c_centres[kids], c_radius[kids])
            todo += [(q, int(kids[i]), float(b[i])) for i in np.argsort(b)]
        else:
            here = c_centres[c:c + 1]
            for kid in queries.children[q]:
                b = bound(queries.points[queries.centre[kid]], queries.radius[kid], here, c_radius[c:c + 1])
                todo.append((kid, c, float(b[0])))


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def quantise(vector: Column, factor: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, _v): rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("_v"), bad.alias("_bad"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & ~F.col("_bad")).drop("_bad")


def _prepared(rows: DataFrame, factor: int) -> DataFrame:
    """(vec_id, dim, v): usable vectors as whole numbers."""
    # a double times a power of two, rounded down, is a double again: components stay exact, sums see inner_products
    ints = quantise(F.col("_v"), factor)
    return rows.select("vec_id", ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).select(
        "vec_id", F.size("v").alias("dim"), "v")


def _assign(df: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``cell``, the nearest pivot; vectors become packed doubles."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = np.asarray(part.column("v").flatten()).astype(np.float64).reshape(part.num_rows, int(dim))
                cell = np.zeros(len(x), np.int64)
                p = shared.value.get(int(dim))
                if p is not None and dim:
                    cell = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("dim"), pa.array(cell), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["vec_id", "dim", "cell", "v"])

    return df.mapInArrow(run, "vec_id long, dim int, cell long, v binary")


def _net(rows, most: int) -> dict[int, np.ndarray]:
    """Farthest-first pivots for each dimension, from a bounded sample."""
    out = {}
    for dim in {len(r) for r in rows if len(r)}:
        x = np.array([r for r in rows if len(r) == dim], np.float64)
        chosen, near = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < most and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[dim] = x[chosen]
    return out


def _split(df: DataFrame, size: int, name: str) -> DataFrame:
    """Adds ``name``, the number of the shard: cells cut by a hash of the id into parts of about ``size`` rows."""
    sizes = df.groupBy("dim", "cell").agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / size).cast("long")
    joined = df.join(sizes, ["dim", "cell"])
    return joined.withColumn(name, F.xxhash64("dim", "cell", F.pmod(F.xxhash64("vec_id"), parts))).drop("_n", "cell")


def _hull(df: DataFrame, by: str) -> DataFrame:
    """(by, dim, centre, radius, norm): covering ball of each part, from means and largest distances."""

    def run(pdf_key, pdf):
        x = _unpack(pdf["v"])
        if not int(pdf["dim"].iloc[0]):
            x = np.zeros((len(pdf), 1))
        centre = x.mean(0)
        radius = np.sqrt(((x - centre) ** 2).sum(1).max())
        return pd.DataFrame([(pdf_key[0], int(pdf["dim"].iloc[0]), centre.tolist(), float(radius))],
                            columns=[by, "dim", "centre", "radius"])

    return df.groupBy(by).applyInPandas(run, f"{by} long, dim int, centre array<double>, radius double")


_FOUND = "query_id long, vec_id long, score long"


def _search(queries: DataFrame, cands: DataFrame, pairs: DataFrame, k: int, floor: DataFrame | None, bundles: int) -> DataFrame:
    """The k best of each query inside each shard of its pairs; the groups of a bundle meet a shard in one task, so that a
    shard travels once for each bundle and its tree is built once."""
    pairs = pairs.withColumn("bundle", F.pmod(F.xxhash64("grp"), F.lit(bundles)))
    q = queries.join(pairs, "grp")
    if floor is not None:
        q = q.join(floor.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    else:
        q = q.withColumn("floor", F.lit(None).cast("long"))
    # new names on both sides: queries and candidates stem from one table
    q = q.select(F.col("bundle").alias("qg"), F.col("shard").alias("qs"), F.col("vec_id").alias("q_id"), F.col("v").alias("qv"), "floor")
    c = cands.join(pairs.select("shard", "bundle").distinct(), "shard").select(
        F.col("bundle").alias("cg"), F.col("shard").alias("cs"), F.col("vec_id").alias("c_id"), F.col("v").alias("cv"))
    # a fixed number: the work grows with the pairs, so partitions must not be merged by their size in bytes
    spark = cands.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    q, c = q.repartition(parts, "qg", "qs"), c.repartition(parts, "cg", "cs")

    def run(left: pd.DataFrame, right: pd.DataFrame):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, y = _unpack(left["qv"]), _unpack(right["cv"])
        if not x.shape[1]:
            x, y = np.zeros((len(left), 1)), np.zeros((len(right), 1))
        order = np.argsort(right["c_id"].to_numpy(), kind="stable")
        y, ids = y[order], right["c_id"].to_numpy()[order]
        floor_ = left["floor"].fillna(-(1 << 61)).to_numpy().astype(np.int64)
        best = Best(left["q_id"].to_numpy(), k, floor_)
        dual_search(CoverTree(x), CoverTree(y), ids, best)
        own = np.repeat(left["q_id"].to_numpy(), k)
        vec, score = best.vec.ravel(), best.score.ravel()
        good = (score > -(1 << 62)) & (score >= np.repeat(floor_, k))
        return pd.DataFrame({"query_id": own[good], "vec_id": vec[good], "score": score[good]})

    return q.groupBy("qg", "qs").cogroup(c.groupBy("cg", "cs")).applyInPandas(run, _FOUND)


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): the kth best score so far; null where fewer are known. Each part sends k rows at most."""
    best = found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("_s"))
    return best.select("query_id", F.when(F.size("_s") >= k, F.element_at("_s", k)).alias("floor"))


def top_k(
    vectors: DataFrame, query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", factor: int = 256,
    shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS, pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with all other rows.

    ``query`` says which rows ask. Components become floor(factor * x); ties go to the smaller vec_id. Rows with a null
    key or vector, or with a null or non-finite component, take no part; vectors meet only those of their length; all
    results come back where fewer than k exist. Rows that repeat a vec_id count once, with the smallest vector. Other
    columns are ignored.

    Cells around pivots are cut into shards of bounded size, queries into groups. First each group meets one shard of
    its own cell, which gives each query a score it can count on; then groups meet the shards whose ball can still
    beat the worst of these. Each meeting is a dual-tree search of all groups of a bundle in a shard. Bundles and shards
    meet queries * rows / (BUNDLE_ROWS * shard_rows) times at worst, when no ball can be left out.
    """
    rows = _usable(vectors, key, vector)
    sample = rows.select("_v", F.xxhash64("vec_id").alias("_h")).orderBy("_h").limit(SAMPLE).collect()
    ready = keep(_assign(_prepared(rows, factor), _net([[math.floor(factor * x) for x in r["_v"]] for r in sample], pivots)))
    asks = ready.join(vectors.select(F.col(key).cast("long").alias("vec_id"), query.alias("_ask")).filter("_ask").select(
        "vec_id").distinct(), "vec_id", "left_semi")
    shards = keep(_split(ready, shard_rows, "shard"))
    groups = keep(_split(asks, group_rows, "grp"))
    s_ball, g_ball = keep(_hull(shards, "shard")), keep(_hull(groups, "grp"))
    # balls of parts: one row per group_rows or shard_rows vectors; blocks of the grid, not pairs of vectors
    grid = g_ball.select("grp", "dim", F.col("centre").alias("a"), F.col("radius").alias("ra")).join(
        s_ball.select("shard", "dim", F.col("centre").alias("b"), F.col("radius").alias("rb")), "dim")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    most = dot + F.col("ra") * norm("b") + F.col("rb") * norm("a") + F.col("ra") * F.col("rb")
    grid = keep(grid.select("grp", "shard", (most * (1 + 1e-9) + 1e-3).alias("most"), (dot - F.col("ra")).alias("_near")))
    first = grid.groupBy("grp").agg(F.max_by("shard", F.struct("_near", "shard")).alias("shard"))
    bundles = max(1, -(-groups.count() // BUNDLE_ROWS))
    found = keep(_search(groups, shards, first, k, None, bundles))
    floor = keep(_kth(found, k))
    # a group's worst: queries without k answers yet keep every shard
    asked = groups.select("grp", F.col("vec_id").alias("query_id")).join(floor, "query_id", "left")
    worst = asked.groupBy("grp").agg(F.min(F.coalesce("floor", F.lit(-(1 << 61)))).alias("worst"))
    rest = grid.join(worst, "grp").filter(F.col("most") >= F.col("worst")).select("grp", "shard").join(
        first, ["grp", "shard"], "left_anti")
    more = _search(groups, shards, rest, k, floor, bundles)
    every = found.unionByName(more)
    # Spark cuts each input partition to k rows per query before the shuffle
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
