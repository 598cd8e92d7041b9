"""Similarity joins over unit vectors and bit hashes: exact, without a cross join.

Vectors at cosine >= t lie within r = sqrt(2 - 2t). Pivots are drawn from the data, so dense regions get more of
them; every vector belongs to the cell of its nearest pivot and also visits each cell whose border is within r
(generalised hyperplane bound, as in metric-space similarity joins). Two similar vectors therefore meet in a cell.
Pivots decide speed only, never the result. A crowded cell is split into chunks of bounded size; each pair of chunks
is one group of at most two chunks, multiplied as Arrow blocks. Where cells do not prune, rows form blocks instead, and
``blocks.py`` drops the block pairs that cannot hold a similar pair.

Equal vectors collapse first: a group of copies is tied to its smallest key and represented by it. Where only
connectivity matters (``similar_links``), rows within r / 2 of their pivot form the core of the cell: any two of them
are similar, so they are tied to one of them and never compared with each other. Pivots keep a distance of r / 2, so a
dense group of near copies has one pivot and costs linear work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import unit_normalize
from ..session import cut_lineage
from . import blocks as block_bounds
from .keys import join_by

CHUNK_ROWS = 1024
MAX_PIVOTS = 2048
SLICE_ROWS = 2048
MAX_PIVOT_BYTES = 64 << 20
GRID_FACTOR = 8  # blocks are this much larger than the chunks of cells
TILES = 16  # chunks grow with the table, so that a row meets about this many of them, up to TILE_BYTES
TILE_BYTES = 32 << 20  # 32-bit numbers of a chunk
MANY_BLOCKS = 1024  # where the bounds drop most pairs, blocks stay this small
PIVOT_SAMPLE, SAMPLE_NUMBERS = 16_384, 2 << 20
PROBE_ROWS = 512  # rows on which the visits are measured; they decide speed only
COPY_COST = 300  # comparisons that take as long as sending one copy of a row
FEW_VISITS = 4  # of many cells: the work stays linear in the rows
SLICE_CELLS = 2 << 20  # scores that a task holds at once
BROADCAST_ROWS = 50_000  # rows with copies that travel with the tasks
_SLACK = 1e-6  # rounding of 32-bit unit vectors


def _vectors(df: DataFrame, key: str, vec: str, by: list[str], normalize: bool) -> DataFrame:
    """Usable vectors with their length as one more group column: a zero vector means "none", and so does a null or a
    null element; vectors of different length never meet."""
    usable = F.exists(F.col(vec), lambda x: x != 0) & ~F.exists(F.col(vec), lambda x: x.isNull())
    rows = df.filter(F.col(vec).isNotNull())
    if normalize:
        rows = rows.withColumn(vec, unit_normalize(vec))
    return rows.filter(usable).select(F.col(key).alias("_id"), *by, F.size(vec).alias("_len"), F.col(vec).alias("_v"))


def _product(a: str, b: str) -> Column:
    """Inner product in doubles, as the Arrow blocks compute it."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _copies(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors under their smallest id, links from that id to the other copies)."""
    digest = [F.xxhash64("_v").alias("_d1"), F.xxhash64(F.lit(1), "_v").alias("_d2")]
    keyed = rows.select("_id", *by, *digest, "_v")
    keys = [*by, "_d1", "_d2"]
    distinct = keyed.groupBy(*keys).agg(
        F.min("_id").alias("_rep"), F.min_by("_v", "_id").alias("_v"), F.count("*").alias("_n")
    )
    groups = distinct.filter(F.col("_n") > 1).select(*[F.col(k).alias(f"_g{k}") for k in keys], "_rep")
    links = (
        keyed.select("_id", *keys, "_v").join(groups, _equal(keys, "_g")).filter(F.col("_id") != F.col("_rep"))
        .select(*by, F.col("_rep").alias("a_id"), F.col("_id").alias("b_id"), _product("_v", "_v").alias("score"))
    )
    return distinct.select(F.col("_rep").alias("_id"), *by, "_v"), links


@dataclass(frozen=True)
class _Members:
    """Rows under the class that stands for them, where that is not the row alone."""

    rows: DataFrame  # (by, _class, _member, _n, _score), one for each row of such a class
    total: int
    by: list[str]

    def write_out(self, found: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
        """Pairs of classes as pairs of their rows, and the pairs inside a class; a crowded class meets in parts."""
        ordered = F.col("a_id") < F.col("b_id")
        if not self.total:
            return found.filter(ordered)
        parts = _chunks(F.col("_n"), CHUNK_ROWS)
        known = self.rows.withColumn("_part", F.pmod(F.xxhash64("_member"), parts).cast("int"))
        names = [*self.by, "_class", "_part"]

        def hinted(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if self.total <= BROADCAST_ROWS else df

        sizes = self.rows.select(*self.by, "_class", "_n").distinct()
        wide = found
        for side in ("a_id", "b_id"):
            wide = join_by(wide.withColumnRenamed(side, "_class"), hinted(sizes), [*self.by, "_class"], "left")
            wide = wide.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
            wide = join_by(wide, hinted(known.select(*names, "_member")), names, "left")
            # a part without rows
            wide = wide.filter(F.col("_n").isNull() | F.col("_member").isNotNull())
            wide = wide.withColumn(side, F.coalesce("_member", F.col("_class"))).drop("_class", "_part", "_member", "_n")
        low, high = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
        wide = wide.select(*self.by, low.alias("a_id"), high.alias("b_id"), "score", "copy")

        good = known.filter(F.col("_score") > threshold if strict else F.col("_score") >= threshold).filter("_n > 1")
        others = F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other")
        left = good.select(*names, F.col("_member").alias("a_id"), F.col("_score").alias("score"), others)
        right = good.select(*self.by, "_class", F.col("_part").alias("_other"), F.col("_member").alias("b_id"), others.alias("_part"))
        # a part holds few rows, but Spark does not know in how many parts they meet
        inside = join_by(left.hint("merge"), right, [*names, "_other"]).select(*self.by, "a_id", "b_id", "score", F.lit(True).alias("copy"))
        return wide.unionByName(inside).filter(ordered)


def _classes(raw: DataFrame, by: list[str]) -> tuple[DataFrame, _Members]:
    """(distinct vectors, their rows), for joins that report rows and not classes; rows without an id pair with none.

    A class goes by its smallest id, so a vector that occurs once needs no look-up afterwards. Where an id stands at
    several vectors, classes are numbered instead.
    """
    keyed = raw.filter(F.col("_id").isNotNull()).select(
        "_id", *by, F.xxhash64("_v").alias("_d1"), F.xxhash64(F.lit(1), "_v").alias("_d2"), "_v")
    keys = [*by, "_d1", "_d2"]
    distinct = keyed.groupBy(*keys).agg(
        F.min("_id").alias("_class"), F.min_by("_v", "_id").alias("_v"), F.count("*").alias("_n"))
    apart = keyed.select("_id", *keys).distinct().groupBy("_id", *by).agg(F.count("*").alias("_n")).filter("_n > 1")
    numbered = not apart.isEmpty()
    if numbered:
        distinct = distinct.withColumn("_class", F.monotonically_increasing_id())
    distinct = cut_lineage(distinct)
    crowded = distinct.filter(F.lit(numbered) | (F.col("_n") > 1)).select(*keys, "_class", "_n", _product("_v", "_v").alias("_score"))
    members = cut_lineage(join_by(keyed.select(*keys, F.col("_id").alias("_member")), crowded, keys).drop("_d1", "_d2"))
    return distinct.select(F.col("_class").alias("_id"), *by, "_v"), _Members(members, members.count(), by)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1) if n else np.zeros((0, 1))


@dataclass(frozen=True)
class _Layout:
    """How rows meet: cells around pivots, blocks with bounds between them, or without either one grid of chunk pairs."""

    pivots: np.ndarray | None
    chunk: int
    replication: float  # copies of a row: cells it visits, or chunks it meets
    blocks: block_bounds.Blocks | None = None


def _tile_rows(total: int, width: int, least: int) -> int:
    """Rows of a chunk: a bounded number of chunks for each table, as long as one stays below TILE_BYTES."""
    return max(least, min(-(-total // TILES), TILE_BYTES // (4 * max(1, width))))


def _layout(
    rows: DataFrame, radius: float, chunk_rows: int | None, sides: int = 1, core: bool = False,
) -> _Layout:
    """Cells where they prune, else blocks; both are exact.

    The number of cells that a row visits, and the share of block pairs that the bounds leave, are measured on samples;
    the layout that sends and compares less is taken.
    """
    threshold = 1.0 - (radius**2 - 2 * _SLACK) / 2
    total = rows.count()
    chunk_rows = chunk_rows or CHUNK_ROWS
    if total <= chunk_rows:
        return _Layout(None, chunk_rows, 1.0)

    def blocks_of(block_rows: int) -> tuple[_Layout, np.ndarray]:
        fitted, sample = block_bounds.draw(rows, total, block_rows)
        left = block_bounds.share(fitted, sample, radius, threshold)
        return _Layout(None, block_rows, max(1.0, left * total / block_rows), fitted), sample

    least = chunk_rows * GRID_FACTOR
    blocks, sample = blocks_of(max(least, -(-total // MANY_BLOCKS)))
    tile = _tile_rows(total, sample.shape[1], least)
    if tile > blocks.chunk and blocks.replication > TILES:
        blocks, sample = blocks_of(tile)
    pivots = _draw_pivots(rows, total, radius, chunk_rows)
    if pivots is None:
        return blocks
    x = sample[:PROBE_ROWS]
    if x.shape[1] != pivots.shape[1]:
        return blocks
    near = _reach(x, pivots, radius)
    visits = float(near.sum(1).mean()) / (2 if sides == 1 else 1) + 1
    # rows of a core are never compared with each other
    settled = float((_squares(x, pivots).min(1) <= (radius / 2) ** 2).mean()) if core else 0.0
    per_cell = total * (visits - settled) / len(pivots)
    chunk = max(chunk_rows, min(int(per_cell) + 1, tile))
    cells = _Layout(pivots, chunk, visits * max(1.0, per_cell / chunk))

    def cost(plan: _Layout, met: float) -> float:
        return plan.replication * COPY_COST + met

    if visits <= min(FEW_VISITS, len(pivots) / 8):
        return cells
    # rows that a row is compared with
    in_cells = cost(cells, visits * per_cell + len(pivots))
    return cells if in_cells <= cost(blocks, blocks.replication * blocks.chunk / 2) else blocks


def _reach(x: np.ndarray, pivots: np.ndarray, radius: float) -> np.ndarray:
    """Which cells besides its own each row visits."""
    gaps = np.sqrt(_squares(pivots, pivots))
    np.fill_diagonal(gaps, np.inf)
    d2 = _squares(x, pivots)
    rows = np.arange(len(x))
    home = d2.argmin(1)
    near = (d2 - d2[rows, home][:, None]) / (2 * gaps[home]) <= radius + _SLACK
    near[rows, home] = False
    return near


def _draw_pivots(rows: DataFrame, total: int, radius: float, chunk_rows: int | None = None) -> np.ndarray | None:
    """Pivots from a sample in key-hash order, at least radius / 2 apart; none when everything fits into one chunk.

    Each is the farthest from those before it, so every dense region of the sample gets one; of more than MAX_PIVOTS
    those with the most rows of the sample around them stay.
    """
    wanted = min(2 * MAX_PIVOTS, max(total // (chunk_rows or CHUNK_ROWS), total // 32 if total >= 1 << 15 else 0))
    if wanted < 2:
        return None
    length = rows.select(F.size("_v").alias("n")).first()["n"]
    limit = wanted if total < 1 << 15 else max(wanted, min(PIVOT_SAMPLE, SAMPLE_NUMBERS // max(1, length)))
    sample = [r["_v"] for r in rows.select("_v").orderBy(F.xxhash64("_id")).limit(limit).collect()]
    # the most frequent length; vectors of other lengths share the first cell
    lengths = [len(v) for v in sample]
    common = max(set(lengths), key=lengths.count)
    drawn = np.array([v for v in sample if len(v) == common], dtype="float64")
    wanted = min(wanted, max(1, MAX_PIVOT_BYTES // (8 * drawn.shape[1])))
    light = drawn.astype("float32")
    squares = (light**2).sum(1)

    def apart(i: int) -> np.ndarray:
        return np.maximum(squares + squares[i] - 2 * (light @ light[i]), 0.0)

    kept, gap = [0], apart(0)
    home = np.zeros(len(light), dtype=int)
    while len(kept) < wanted:
        far = int(gap.argmax())
        if gap[far] < (radius / 2) ** 2 + 1e-6:
            break
        new = apart(far)
        nearer = new < gap
        home[nearer], gap[nearer] = len(kept), new[nearer]
        kept.append(far)
    around = np.bincount(home, minlength=len(kept))
    best = np.sort(np.argsort(-around, kind="stable")[:MAX_PIVOTS])
    return drawn[np.array(kept)[best]]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two matrices."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0.0)


# a row's place in a cell, as cell * 4 + flags
_HOME, _CORE = 1, 2


def _assign(pivots: np.ndarray, radius: float, upward: bool, core: bool = False):
    """Places of a vector: its own cell first, then the cells it visits (only higher ones with ``upward``)."""
    # computed where it is used; it is larger than the pivots
    known: list[np.ndarray] = []
    ordinal = np.arange(len(pivots))
    # a margin keeps 32-bit unit vectors from passing as core by rounding
    inner = (radius / 2 * (1 - 1e-4)) ** 2 if core else -1.0

    @F.pandas_udf("array<int>")
    def places(v: pd.Series) -> pd.Series:
        out = []
        if not known:
            known.append(np.sqrt(_squares(pivots, pivots)).astype("float32"))
            np.fill_diagonal(known[0], np.inf)
        gaps = known[0]
        for start in range(0, len(v), SLICE_ROWS):
            part = v.iloc[start : start + SLICE_ROWS]
            other = np.array([len(e) != pivots.shape[1] for e in part])
            x = np.stack([np.zeros(pivots.shape[1]) if o else np.asarray(e, dtype="float64") for e, o in zip(part, other)])
            d2 = _squares(x, pivots)
            rows = np.arange(len(x))
            home = d2.argmin(1)
            near = (d2 - d2[rows, home][:, None]) / (2 * gaps[home]) <= radius + _SLACK
            if upward:
                near &= ordinal[None, :] > home[:, None]
            near[rows, home] = False
            own = home * 4 + _HOME + np.where(d2[rows, home] <= inner, _CORE, 0)
            own[other], near[other] = _HOME, False
            out += [np.concatenate(([o], np.flatnonzero(row) * 4)).astype("int32") for o, row in zip(own, near)]
        return pd.Series(out)

    return places


@dataclass(frozen=True)
class _Block:
    """One pair of chunks inside a task."""

    ids_a: np.ndarray
    a: np.ndarray
    ids_b: np.ndarray
    b: np.ndarray
    own: bool  # both sides are the same chunk

    def other(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of the second side."""
        return (self.ids_a, self.a) if self.own else (self.ids_b, self.b)

    def near(self, threshold: float, strict: bool = False):
        """Slices of the comparison as (first row, matrix of similar pairs); in an own chunk only pairs above the
        diagonal. Products in 32 bits decide where their rounding cannot matter, products in doubles the rest."""
        x, y = self.a, self.other()[1]
        if not len(x) or not len(y):
            return
        light, lighter = x.astype("float32"), y.astype("float32")
        # bound on the rounding of a 32-bit product of these vectors
        margin = (x.shape[1] + 8) * 2.0**-24 * float(np.linalg.norm(x, axis=1).max() * np.linalg.norm(y, axis=1).max())
        step = max(1, SLICE_CELLS // len(y))
        for start in range(0, len(x), step):
            score = light[start:start + step] @ lighter.T
            hit = score >= threshold - margin
            i, j = np.nonzero(hit)
            doubtful = score[i, j] <= threshold + margin
            i, j = i[doubtful], j[doubtful]
            exact = _products(x, start + i, y, j)
            hit[i, j] = exact > threshold if strict else exact >= threshold
            if self.own:
                hit = np.triu(hit, start + 1)
            yield start, hit


def _products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of x with the rows j of y."""
    out = np.empty(len(i))
    step = max(1, SLICE_CELLS // x.shape[1])
    for k in range(0, len(i), step):
        out[k:k + step] = np.einsum("ij,ij->i", x[i[k:k + step]], y[j[k:k + step]])
    return out


def _pairs_of(block: _Block, threshold: float, strict: bool = False) -> dict:
    """Similar pairs of a block, smaller id first, with their score."""
    ids, y = block.other()
    at = [(start + i, j) for start, hit in block.near(threshold, strict) for i, j in [np.nonzero(hit)]]
    i, j = (np.concatenate([p[k] for p in at]) if at else np.zeros(0, dtype=int) for k in (0, 1))
    left, right = block.ids_a[i], ids[j]
    swap = left > right
    return {
        "a_id": np.where(swap, right, left), "b_id": np.where(swap, left, right), "score": _products(block.a, i, y, j),
    }


def _hooked(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Component labels (smallest place of each) after the edges x - y are added."""
    while len(x):
        p, q = label[x], label[y]
        open_ = p != q
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        label = label.copy()
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=object)


def _run(tasks: DataFrame, by: list[str], fields: list[T.StructField], reduce) -> DataFrame:
    """Apply ``reduce(block) -> dict of columns`` to every chunk pair."""
    key_fields = [tasks.schema[c] for c in by]
    schema = T.StructType([*key_fields, *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)

    def work(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        ids = _ids(table.column("_id"))
        data = _matrix(table.column("_v"))
        own = bool(table.column("_own")[0].as_py())
        first = side == 0
        block = _Block(ids[first], data[first], ids[~first], data[~first], own)
        out = reduce(block)
        n = len(next(iter(out.values())))
        columns = [pa.array([table.column(c)[0].as_py()] * n, type=arrow_schema.field(c).type) for c in by]
        columns += [pa.array(out[f.name], type=arrow_schema.field(f.name).type) for f in fields]
        return pa.Table.from_arrays(columns, schema=arrow_schema)

    keys = [*by, "_cell", "_pair", "_own", "_i", "_j"]
    # a fixed number: the work grows with the pairs, so partitions must not be merged by their size in bytes
    parts = max(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * tasks.sparkSession.sparkContext.defaultParallelism)
    return tasks.repartition(parts, *keys).groupBy(*keys).applyInArrow(work, schema)


def _chunks(n: Column, chunk: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / chunk)).cast("int")


def _placed(rows: DataFrame, by: list[str], pivots: np.ndarray | None, radius: float, core: bool) -> DataFrame:
    """Rows with a cell and their role in it: core or other home row, or visitor."""
    if pivots is None:
        return rows.withColumn("_cell", F.lit(0)).withColumn("_role", F.lit("other"))
    places = _assign(pivots, radius, upward=True, core=core)
    spread = rows.withColumn("_places", places("_v")).select("_id", *by, "_v", F.explode_outer("_places").alias("_place"))
    flags = F.col("_place").bitwiseAND(F.lit(3))
    role = F.when(flags == _HOME + _CORE, "core").when(flags == _HOME, "other").otherwise("visitor")
    return spread.withColumns({"_cell": F.shiftright("_place", 2), "_role": role}).drop("_place")


def _equal(df_keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in df_keys:
        same &= F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


_SLOTS = "array<struct<pair:int,own:boolean,i:int,j:int,side:int>>"


def _self_tasks(placed: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """Rows copied to every chunk pair they take part in.

    Chunk pairs inside a cell: other x other (each unordered pair once), core x other, core x visitor, other x visitor.
    """
    keys = [*by, "_cell"]
    roles = ("core", "other", "visitor")
    sizes = placed.groupBy(*[F.col(k).alias(f"_s{k}") for k in keys]).agg(
        *[F.count_if(F.col("_role") == r).alias(f"_n_{r}") for r in roles]
    )
    known = placed.join(sizes, _equal(keys, "_s")).drop(*[f"_s{k}" for k in keys])
    mine = {r: F.pmod(F.xxhash64("_id"), _chunks(F.col(f"_n_{r}"), chunk)).cast("int") for r in roles}

    def slot(pair: int, own: Column, i: Column, j: Column, side: Column) -> Column:
        return F.struct(
            F.lit(pair).alias("pair"), own.alias("own"), i.cast("int").alias("i"), j.cast("int").alias("j"),
            side.cast("int").alias("side"),
        )

    def meeting(role: str, make) -> Column:
        """One slot per chunk of the other role; none when it is empty."""
        n = F.col(f"_n_{role}")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), _chunks(n, chunk) - 1), make)).otherwise(F.array().cast(_SLOTS))

    no = F.lit(False)

    def first(pair: int, role: str, other: str) -> Column:
        return meeting(other, lambda j: slot(pair, no, mine[role], j, F.lit(0)))

    def second(pair: int, role: str, other: str) -> Column:
        return meeting(other, lambda i: slot(pair, no, i, mine[role], F.lit(1)))

    among = meeting(
        "other",
        lambda j: slot(0, j == mine["other"], F.least(mine["other"], j), F.greatest(mine["other"], j),
                       F.when(mine["other"] <= j, 0).otherwise(1)),
    )
    slots = (
        F.when(F.col("_role") == "other", F.concat(among, second(1, "other", "core"), first(3, "other", "visitor")))
        .when(F.col("_role") == "core", F.concat(first(1, "core", "other"), first(2, "core", "visitor")))
        .otherwise(F.concat(second(2, "visitor", "core"), second(3, "visitor", "other")))
    )
    return known.select("_id", *by, "_v", "_cell", F.explode(slots).alias("_s")).select(
        "_id", *by, "_v", "_cell", F.col("_s.pair").alias("_pair"), F.col("_s.own").alias("_own"), F.col("_s.i").alias("_i"),
        F.col("_s.j").alias("_j"), F.col("_s.side").alias("_side"),
    )


def _tasks(rows: DataFrame, by: list[str], plan: _Layout, threshold: float) -> DataFrame:
    """Chunk pairs of one table, by the layout chosen for it."""
    if plan.blocks is not None:
        return block_bounds.self_tasks(rows, by, plan.blocks, _radius(threshold), threshold)
    return _self_tasks(cut_lineage(_placed(rows, by, plan.pivots, _radius(threshold), core=False)), by, plan.chunk)


def _core_links(placed: DataFrame, by: list[str]) -> DataFrame:
    """Core rows tied to the smallest key of their cell's core."""
    core = placed.filter(F.col("_role") == "core").select("_id", *by, "_cell")
    keys = [*by, "_cell"]
    reps = core.groupBy(*[F.col(k).alias(f"_r{k}") for k in keys]).agg(F.min("_id").alias("_rep"))
    return core.join(reps, _equal(keys, "_r")).filter(F.col("_id") != F.col("_rep")).select(
        *by, F.col("_rep").alias("a_id"), F.col("_id").alias("b_id")
    )


def _id_fields(df: DataFrame, key: str) -> list[T.StructField]:
    kind = df.schema[key].dataType
    return [T.StructField("a_id", kind), T.StructField("b_id", kind)]


def _radius(t: float) -> float:
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * t) + 2 * _SLACK))


def similar_pairs(
    df: DataFrame, key: str, vec: str, threshold: float, by: list[str] | None = None, normalize: bool = False,
    strict: bool = False, chunk_rows: int | None = None, every: bool = False,
) -> DataFrame:
    """Pairs a_id < b_id with cosine >= threshold (> with ``strict``), inside the groups of ``by``.

    Pairs are formed between distinct vectors; further copies of a vector are tied to its smallest key with
    ``copy`` true, so a group of n copies yields n - 1 rows and stands for all its pairs; their score is the vector's
    product with itself, under the same test. With ``every`` all pairs of rows are written out instead, those of copies
    too, as joining the table with itself shows them; rows may share a key then. Zero vectors and vectors with null
    elements match nothing, and vectors of different length never meet.
    """
    by = by or []
    keys = [*by, "_len"]
    raw = cut_lineage(_vectors(df, key, vec, by, normalize))
    rows, copies = _classes(raw, keys) if every else _copies(raw, keys)
    plan = _layout(raw, _radius(threshold), chunk_rows)

    def reduce(block: _Block) -> dict:
        return _pairs_of(block, threshold, strict)

    fields = [*_id_fields(rows, "_id"), T.StructField("score", T.DoubleType())]
    found = _run(_tasks(rows, keys, plan, threshold), keys, fields, reduce).withColumn("copy", F.lit(False))
    if every:
        return copies.write_out(found, threshold, strict).drop("_len")
    same = copies.filter(F.col("score") > threshold if strict else F.col("score") >= threshold)
    return found.unionByName(same.withColumn("copy", F.lit(True))).drop("_len")


def every_pair(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id) of ``similar_pairs`` without ``by``, with all pairs of each copy written out."""
    star = pairs.filter("copy").select(F.col("a_id").alias("_rep"), F.col("b_id").alias("_member"))
    members = star.unionByName(star.select("_rep", F.col("_rep").alias("_member")).distinct())

    def side(name: str) -> DataFrame:
        return members.select(F.col("_rep").alias(name), F.col("_member").alias(f"_{name}"))

    wide = pairs.filter(~F.col("copy")).select("a_id", "b_id").join(side("a_id"), "a_id", "left").join(side("b_id"), "b_id", "left")
    x, y = F.coalesce("_a_id", "a_id"), F.coalesce("_b_id", "b_id")
    equal = members.withColumnRenamed("_member", "a_id").join(members.withColumnRenamed("_member", "b_id"), "_rep")
    return wide.select(F.least(x, y).alias("a_id"), F.greatest(x, y).alias("b_id")).unionByName(
        equal.filter("a_id < b_id").select("a_id", "b_id"))


def sign_tables(threshold: float, recall: float, bits: int) -> int:
    """Tables of ``bits`` sign bits in which a pair at the threshold shares a code with at least this chance."""
    agree = 1.0 - float(np.arccos(np.clip(threshold, -1.0, 1.0))) / np.pi
    return max(1, int(np.ceil(np.log(1.0 - recall) / np.log1p(-(agree**bits)))))


def approximate_pairs(
    df: DataFrame, key: str, vec: str, threshold: float, recall: float = 0.95, bits: int = 12, by: list[str] | None = None,
    normalize: bool = False, chunk_rows: int | None = None, seed: int = 0, every: bool = False,
) -> DataFrame:
    """``similar_pairs`` by sign hashes: every pair returned is exact, and a pair at the threshold is found with a chance
    of at least ``recall`` (nearer pairs with a higher one).

    A row has one code of ``bits`` signs of random projections in each table; rows that share a code are compared in full.
    The number of tables follows from threshold and recall, whatever the data. A crowded code is cut into chunks like a
    cell. Copies are tied together exactly, or written out with ``every``, as in ``similar_pairs``. Vectors with another length than most have codes of
    their own, so they are compared with all of that length.
    """
    by = by or []
    keys = [*by, "_len"]
    raw = cut_lineage(_vectors(df, key, vec, by, normalize))
    rows, copies = _classes(raw, keys) if every else _copies(raw, keys)
    tables = sign_tables(threshold, recall, bits)
    powers = 1 << np.arange(bits)

    @F.pandas_udf("array<long>")
    def codes(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), dtype=object)
        lengths = np.array([len(e) for e in v])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            x = np.stack([np.asarray(v.iloc[i], dtype="float64") for i in at])
            # the same planes in every task
            planes = np.random.default_rng([seed, int(n)]).standard_normal((int(n), tables * bits))
            signs = (x @ planes >= 0).reshape(len(at), tables, bits) @ powers
            for i, row in zip(at, signs + (np.arange(tables) << bits)):
                out[i] = row.astype("int64")
        return pd.Series(out)

    def reduce(block: _Block) -> dict:
        return _pairs_of(block, threshold)

    placed = cut_lineage(rows.withColumn("_cell", F.explode_outer(codes("_v"))).withColumn("_role", F.lit("other")))
    fields = [*_id_fields(rows, "_id"), T.StructField("score", T.DoubleType())]
    found = _run(_self_tasks(placed, keys, chunk_rows or CHUNK_ROWS), keys, fields, reduce)
    # a pair may share several codes
    once = found.groupBy(*keys, "a_id", "b_id").agg(F.max("score").alias("score")).withColumn("copy", F.lit(False))
    if every:
        return copies.write_out(once, threshold).drop("_len")
    same = copies.filter(F.col("score") >= threshold)
    return once.unionByName(same.withColumn("copy", F.lit(True))).drop("_len")


def block_report(
    df: DataFrame, key: str, vec: str, threshold: float, by: list[str] | None = None, normalize: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Blocks of each group, their pairs, and the pairs that the bounds leave to be compared; for tuning."""
    by = by or []
    keys = [*by, "_len"]
    rows = cut_lineage(_vectors(df, key, vec, by, normalize))
    fitted, _ = block_bounds.draw(rows, rows.count(), (chunk_rows or CHUNK_ROWS) * GRID_FACTOR)
    if fitted is None:
        return rows.select(*by).withColumns({c: F.lit(0).cast("long") for c in ("blocks", "pairs", "compared")}).limit(0)
    return block_bounds.report(rows, keys, fitted, _radius(threshold), threshold).drop("_len")


def similar_links(
    df: DataFrame, key: str, vec: str, threshold: float, by: list[str] | None = None, normalize: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Links with the same connected components as the similar pairs, at most one per row and chunk pair.

    Each chunk pair reports its local components as stars, so a dense group never emits all its pairs.
    """
    by = by or []
    keys = [*by, "_len"]
    raw = cut_lineage(_vectors(df, key, vec, by, normalize))
    rows, copies = _copies(raw, keys)
    plan = _layout(raw, _radius(threshold), chunk_rows, core=True)

    def reduce(block: _Block) -> dict:
        ids = block.ids_a if block.own else np.concatenate([block.ids_a, block.ids_b])
        order = np.argsort(ids)
        place = np.empty(len(ids), dtype=int)
        place[order] = np.arange(len(ids))
        shift = 0 if block.own else len(block.ids_a)
        label = np.arange(len(ids))
        for start, hit in block.near(threshold):
            i, j = np.nonzero(hit)
            label = _hooked(label, place[start + i], place[shift + j])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return {"a_id": ids[order[label[moved]]], "b_id": ids[order[moved]]}

    same = copies.filter(F.col("score") >= threshold).drop("score")
    if plan.blocks is not None:
        found = _run(_tasks(rows, keys, plan, threshold), keys, _id_fields(df, key), reduce)
        return found.unionByName(same).drop("_len")
    placed = cut_lineage(_placed(rows, keys, plan.pivots, _radius(threshold), core=True))
    found = _run(_self_tasks(placed, keys, plan.chunk), keys, _id_fields(df, key), reduce)
    return found.unionByName(_core_links(placed, keys)).unionByName(same).drop("_len")


def with_earlier_match(
    df: DataFrame, rank: str, vec: str, threshold: float, by: list[str] | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Ranks of the rows that have a similar row of smaller rank in their group; the rank identifies a row.

    Tasks report at most one row per row and chunk pair, whatever the number of similar pairs.
    """
    by = by or []
    keys = [*by, "_len"]
    rows = cut_lineage(_vectors(df, rank, vec, by, False))
    plan = _layout(rows, _radius(threshold), chunk_rows)

    def reduce(block: _Block) -> dict:
        ids = block.other()[0]
        late = [np.zeros(0, dtype="int64")]
        for start, hit in block.near(threshold):
            i, j = np.nonzero(hit)
            left, right = block.ids_a[start + i], ids[j]
            late.append(np.unique(np.maximum(left, right)[left != right]))
        return {"_id": np.unique(np.concatenate(late).astype("int64"))}

    hits = _run(_tasks(rows, keys, plan, threshold), keys, [T.StructField("_id", T.LongType())], reduce)
    return hits.select(*by, F.col("_id").alias(rank)).distinct()


def distance_statistics(df: DataFrame, key: str, vec: str, by: list[str]) -> DataFrame:
    """Mean, smallest and largest Euclid distance over all pairs of each group that have one length, summed up inside the
    tasks. Vectors that are null or hold a null take no part; a group without a pair has no row."""
    # a distance to a zero vector is a distance
    rows = df.filter(F.col(vec).isNotNull() & ~F.exists(F.col(vec), lambda x: x.isNull())).select(
        F.col(key).alias("_id"), *by, F.size(vec).alias("_len"), F.col(vec).alias("_v"))
    keys = [*by, "_len"]

    def reduce(block: _Block) -> dict:
        other = block.a if block.own else block.b
        d = np.sqrt(np.maximum(
            (block.a**2).sum(1)[:, None] + (other**2).sum(1)[None, :] - 2 * block.a @ other.T, 0.0
        ))
        d = d[np.triu_indices(len(d), 1)] if block.own else d.ravel()
        if not len(d):
            return {"n": [], "total": [], "low": [], "high": []}
        return {"n": [len(d)], "total": [d.sum()], "low": [d.min()], "high": [d.max()]}

    fields = [T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("total", "low", "high")]
    parts = _run(_self_tasks(_placed(rows, keys, None, 0.0, False), keys, CHUNK_ROWS), keys, fields, reduce)
    return parts.groupBy(*by).agg(
        (F.sum("total") / F.sum("n")).alias("mean_dist"), F.min("low").alias("min_dist"), F.max("high").alias("max_dist")
    )


def _between_tasks(
    left: DataFrame, right: DataFrame, by: list[str], pivots: np.ndarray | None, radius: float, chunk: int
) -> DataFrame:
    """Left rows in their own cell, right rows in every cell they reach; chunks as in the self join."""
    if pivots is None:
        a = left.withColumn("_cell", F.lit(0))
        b = right.withColumn("_cell", F.lit(0))
    else:
        places = _assign(pivots, radius, upward=False)
        a = left.withColumn("_cell", F.shiftright(F.get(places("_v"), 0), 2))
        b = right.withColumn("_cell", F.explode_outer(places("_v"))).withColumn("_cell", F.shiftright("_cell", 2))
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    keys = [*by, "_cell"]
    sizes = both.groupBy(*[F.col(k).alias(f"_s{k}") for k in keys]).agg(
        F.count_if(F.col("_side") == 0).alias("_na"), F.count_if(F.col("_side") == 1).alias("_nb")
    ).filter((F.col("_na") > 0) & (F.col("_nb") > 0))
    known = both.join(sizes, _equal(keys, "_s"))
    first = F.col("_side") == 0
    mine = F.pmod(F.xxhash64("_id"), _chunks(F.when(first, F.col("_na")).otherwise(F.col("_nb")), chunk)).cast("int")
    others = F.sequence(F.lit(0), _chunks(F.when(first, F.col("_nb")).otherwise(F.col("_na")), chunk) - 1)
    spread = known.withColumn("_mine", mine).withColumn("_other", F.explode(others))
    return spread.select(
        "_id", *by, "_v", "_cell", F.lit(0).alias("_pair"), F.lit(False).alias("_own"), "_side",
        F.when(first, F.col("_mine")).otherwise(F.col("_other")).alias("_i"),
        F.when(first, F.col("_other")).otherwise(F.col("_mine")).alias("_j"),
    )


def best_match(
    left: DataFrame, right: DataFrame, key: str, vec: str, threshold: float, by: list[str] | None = None,
    right_key: str | None = None, right_vec: str | None = None, strict: bool = False, exclude_same: bool = False,
    name: str = "score", chunk_rows: int | None = None,
) -> DataFrame:
    """Largest cosine of each left row to a right row, for left rows that reach the threshold.

    ``exclude_same`` skips a right row with the left row's own key. Tasks report at most one row per left row.
    """
    by = by or []
    keys = [*by, "_len"]
    a = cut_lineage(_vectors(left, key, vec, by, False))
    b = _vectors(right, right_key or key, right_vec or vec, by, False)
    if not exclude_same:
        b, _ = _copies(b, keys)  # copies on the right cannot change the maximum
    plan = _layout(a, _radius(threshold), chunk_rows, sides=2)

    def reduce(block: _Block) -> dict:
        if not len(block.b) or not len(block.a):
            return {"_id": [], "score": []}
        top = np.full(len(block.a), -np.inf)
        step = max(1, SLICE_CELLS // len(block.b))
        for start in range(0, len(block.a), step):
            score = block.a[start:start + step] @ block.b.T
            if exclude_same:
                score[block.ids_a[start:start + step, None] == block.ids_b[None, :]] = -np.inf
            top[start:start + step] = score.max(1)
        hit = top > threshold if strict else top >= threshold
        return {"_id": block.ids_a[hit], "score": top[hit]}

    fields = [T.StructField("_id", left.schema[key].dataType), T.StructField("score", T.DoubleType())]
    if plan.blocks is not None:
        tasks = block_bounds.between_tasks(a, b, keys, plan.blocks, _radius(threshold), threshold)
    else:
        tasks = _between_tasks(a, b, keys, plan.pivots, _radius(threshold), plan.chunk)
    hits = _run(tasks, keys, fields, reduce)
    return hits.groupBy(F.col("_id").alias(key), *by).agg(F.max("score").alias(name))


def not_similar_to(
    candidates: DataFrame, chosen: DataFrame, key: str, vec: str, threshold: float, by: list[str] | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Candidates that stay below the threshold against every chosen row of their group."""
    near = best_match(candidates, chosen, key, vec, threshold, by, chunk_rows=chunk_rows).select(key, *(by or []))
    return join_by(candidates, near, [key, *(by or [])], "left_anti")


@dataclass(frozen=True)
class _Bands:
    """Bands of a bit string held in 64-bit columns; some band of two near strings differs in at most ``radius`` bits."""

    words: list[str]
    edges: list[int]
    radius: int

    def value(self, k: int, words: list[str] | None = None) -> Column:
        """Bits of band k as a number; a band may reach over the border of two columns."""
        names = words or self.words
        low, size = self.edges[k], self.edges[k + 1] - self.edges[k]
        first, shift = divmod(low, 64)
        out = F.shiftrightunsigned(F.col(names[first]), shift) if shift else F.col(names[first])
        if shift + size > 64:
            out = out.bitwiseOR(F.shiftleft(F.col(names[first + 1]), 64 - shift))
        return out if size == 64 else out.bitwiseAND(F.lit((1 << size) - 1))

    def probes(self, k: int) -> Column:
        """The band's value and those within ``radius`` flips (0 or 1)."""
        value = self.value(k)
        size = self.edges[k + 1] - self.edges[k]
        flips = [value.bitwiseXOR(F.lit(1 << s if s < 63 else -(1 << 63))) for s in range(size)] if self.radius else []
        return F.array(value, *flips)

    def __len__(self) -> int:
        return len(self.edges) - 1


def _band_pairs(points: DataFrame, by: list[str], bands: _Bands, limit: int) -> DataFrame:
    """(by, a_id, b_id, distance) of the points (_id, by, words) that differ in 1 to ``limit`` bits.

    One side is stored under its band values, the other probes them, so a near pair meets; it is kept only in the first
    band in which it does. A null group is a group like any other.
    """
    count = len(bands)
    other = [f"{w}2" for w in bands.words]

    def entry(k: int, v: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), v.alias("v"))

    def named(k: int):
        return lambda v: entry(k, v)

    # outer explodes keep Spark from copying the band expressions into an inferred filter below
    stored = points.select("_id", *by, *bands.words, F.explode_outer(F.array(*[entry(k, bands.value(k)) for k in range(count)])).alias("_b"))
    asking = points.select(
        F.col("_id").alias("_id2"), *by, *[F.col(w).alias(o) for w, o in zip(bands.words, other)],
        F.explode_outer(F.concat(*[F.transform(bands.probes(k), named(k)) for k in range(count)])).alias("_b"))
    # Spark sizes an explode like one row, so it would take either side for small and pass it whole through the driver
    stored, asking = (x.select(*[c for c in x.columns if c != "_b"], F.col("_b.k").alias("_k"), F.col("_b.v").alias("_at")) for x in (stored, asking))
    joined = join_by(stored.hint("merge"), asking, [*by, "_k", "_at"]).filter(F.col("_id") < F.col("_id2"))
    earlier = F.lit(False)
    for k in range(count - 1):
        differs = F.bit_count(bands.value(k).bitwiseXOR(bands.value(k, other)))
        earlier |= (F.lit(k) < F.col("_k")) & (differs <= bands.radius)
    distance = F.lit(0)
    for w, o in zip(bands.words, other):
        distance = distance + F.bit_count(F.col(w).bitwiseXOR(F.col(o)))
    return joined.filter((distance <= limit) & ~earlier).select(
        *by, F.col("_id").alias("a_id"), F.col("_id2").alias("b_id"), distance.cast("int").alias("distance"))


def _copy_pairs(rows: DataFrame, points: DataFrame, by: list[str], words: list[str]) -> DataFrame:
    """Copies of a bit string tied to its smallest key."""
    groups = points.filter(F.col("_n") > 1).select(*by, *words, F.col("_id").alias("_rep"))
    return join_by(rows, groups, [*by, *words]).filter(F.col("_id") != F.col("_rep")).select(
        *by, F.col("_rep").alias("a_id"), F.col("_id").alias("b_id"), F.lit(0).alias("distance"))


def _word_pairs(rows: DataFrame, by: list[str], words: list[str], width: int, limit: int, radius: int) -> DataFrame:
    count = max(1, min(width, limit // (radius + 1) + 1))
    bands = _Bands(words, [round(i * width / count) for i in range(count + 1)], radius)
    points = rows.groupBy(*by, *words).agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    return _band_pairs(points, by, bands, limit).unionByName(_copy_pairs(rows, points, by, words))


def hamming_pairs(
    df: DataFrame, key: str, bits: str, threshold: int, by: list[str] | None = None, width: int = 64,
    probe_radius: int | None = None,
) -> DataFrame:
    """Pairs a_id < b_id whose hashes differ in at most ``threshold`` bits; exact by the pigeonhole principle.

    The bits are cut into bands. With m bands some band differs in at most threshold // m bits, so each row probes
    the other rows' band values within that many flips: none with threshold + 1 bands, one with half as many and
    wider (hence more selective) bands. Equal hashes collapse first and are tied to their smallest key (distance 0).
    Null hashes match nothing; a null group is a group of its own.
    """
    by = by or []
    radius = (1 if threshold > 3 else 0) if probe_radius is None else probe_radius
    # hashes are often derived from wide columns; compute them once, the rest works on slim rows
    rows = cut_lineage(df.select(F.col(key).alias("_id"), *by, F.col(bits).alias("_w0"))).filter(F.col("_w0").isNotNull())
    return _word_pairs(rows, by, ["_w0"], width, threshold, radius)


def hamming_best(
    left: DataFrame, right: DataFrame, key: str, bits: str, threshold: int, exclude_same: bool = False,
    width: int = 64, name: str = "min_bits",
) -> DataFrame:
    """Smallest number of different bits of each left row to a right row, where it is within ``threshold``.

    Bands as in ``hamming_pairs``; the right side, usually the selected rows, carries the probes. Per hash value of
    the right side two keys are enough to find one that is not the left row itself.
    """
    bands = threshold // 2 + 1
    edges = [round(i * width / bands) for i in range(bands + 1)]
    points = left.filter(F.col(bits).isNotNull()).select(F.col(key).alias("_id"), F.col(bits).alias("_h"))
    values = right.filter(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("_h2")).agg(
        F.min(key).alias("_lo"), F.max(key).alias("_hi")
    )

    def band(h: Column, k: int) -> Column:
        return F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))

    def entry(k: int, v: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), v.alias("v"))

    own = points.withColumn("_b", F.explode_outer(F.array(*[entry(k, band(F.col("_h"), k)) for k in range(bands)])))
    probes = []
    for k in range(bands):
        value = band(F.col("_h2"), k)
        probes += [entry(k, value)] + [
            entry(k, value.bitwiseXOR(F.lit(1 << s))) for s in range(edges[k + 1] - edges[k])
        ]
    asking = values.withColumn("_b", F.explode_outer(F.array(*probes)))
    # as in ``_band_pairs``: neither side is as small as Spark takes it
    joined = own.hint("merge").join(asking, "_b").withColumn("_d", F.bit_count(F.col("_h").bitwiseXOR(F.col("_h2"))))
    hits = joined.filter(F.col("_d") <= threshold)
    if exclude_same:
        hits = hits.filter((F.col("_lo") != F.col("_id")) | (F.col("_hi") != F.col("_id")))
    return hits.groupBy(F.col("_id").alias(key)).agg(F.min("_d").cast("int").alias(name))


def bit_array_pairs(df: DataFrame, key: str, bits: str, share: float = 0.12, length: int = 256,
                    by: list[str] | None = None) -> DataFrame:
    """Pairs of 0/1 arrays of ``length`` elements whose share of different bits stays below ``share`` (strictly).

    An array is packed into 64-bit columns, whose bands work as in ``hamming_pairs``: at 256 bits and 0.12, 16 bands of
    16 bits, each probed with up to one flip. Arrays that are null, hold a null or have another length match nothing.
    """
    by = by or []
    limit = int(np.ceil(share * length)) - 1  # largest count with count / length < share
    if limit < 0:
        limit, share = 0, 0.0
    words = [f"_w{i}" for i in range(-(-length // 64))]
    packed = [
        F.aggregate(F.slice(F.col(bits), 64 * i + 1, min(64, length - 64 * i)), F.lit(0).cast("long"),
                    lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x.cast("int") != 0, F.lit(1).cast("long")).when(x.isNotNull(), F.lit(0).cast("long"))))
        for i in range(len(words))
    ]
    usable = F.col(bits).isNotNull() & (F.size(bits) == length)
    rows = df.filter(usable).select(F.col(key).alias("_id"), *by, *[p.alias(w) for p, w in zip(packed, words)])
    rows = cut_lineage(rows).filter(reduce_and([F.col(w).isNotNull() for w in words]))
    if share <= 0:
        return _copy_pairs(rows, rows.limit(0).withColumn("_n", F.lit(0)), by, words)
    return _word_pairs(rows, by, words, length, limit, 1 if limit > 3 else 0)


def reduce_and(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out &= t
    return out


def burst_visual_pairs(
    df: DataFrame, key: str, vec: str, prefix: str, number: str, by: list[str], threshold: float = 0.85,
    burst_threshold: float = 0.55, gap: int = 30,
) -> DataFrame:
    """Pairs at cosine >= threshold, or numbered within ``gap`` under one prefix and at cosine >= burst_threshold.

    One similarity join at the high threshold; the lower one is only tested on numbered neighbours, which meet by
    an equi-join on stretches of the number.
    """
    visual = similar_pairs(df, key, vec, threshold, by, every=True).select(*by, "a_id", "b_id", "score")
    rows = df.filter(F.col(number).isNotNull() & F.col(vec).isNotNull()).select(
        *by, prefix, F.col(number).alias("_n"), F.col(key).alias("_id"), F.col(vec).alias("_v")
    )
    stretch = F.floor(F.col("_n") / (gap + 1))
    left = rows.withColumn("_cell", stretch)
    right = rows.select(
        *by, prefix, F.col("_n").alias("_n2"), F.col("_id").alias("_id2"), F.col("_v").alias("_v2"),
        F.explode(F.array(stretch, stretch - 1)).alias("_cell"),
    )
    from ..functions.vectors import dot

    ordered = (F.col("_n2") > F.col("_n")) | ((F.col("_n2") == F.col("_n")) & (F.col("_id") < F.col("_id2")))
    # a null group is a group of its own; a null prefix stands for no name at all
    right = right.withColumnRenamed(prefix, "_prefix2").withColumnRenamed("_cell", "_cell2")
    near = (
        join_by(left.filter(F.col(prefix).isNotNull()).withColumn("_prefix2", F.col(prefix)).withColumn("_cell2", F.col("_cell")),
                right.filter(F.col("_prefix2").isNotNull()), [*by, "_prefix2", "_cell2"])
        .filter(ordered & (F.col("_n2") - F.col("_n") <= gap))
        .withColumn("score", dot("_v", "_v2"))
        .filter((F.col("score") >= burst_threshold) & (F.col("score") < threshold))
        .select(*by, F.least("_id", "_id2").alias("a_id"), F.greatest("_id", "_id2").alias("b_id"), "score")
    )
    return visual.withColumn("signal", F.lit("visual")).unionByName(near.withColumn("signal", F.lit("burst")))


def tag_similarity(df: DataFrame, vocabulary: list[tuple[str, str, list[float]]], key: str, vec: str,
                   minimum: float = -1.0, max_bytes: int = 64 << 20) -> DataFrame:
    """Cosine of each row to each vocabulary entry as an array (ord, tag, family, score), largest first.

    The vocabulary travels as matrices of at most ``max_bytes``; a larger one is compared block by block, and the
    blocks' arrays of a row are merged by one shuffle. Rows whose vector is null, holds a null or has another length than
    the vocabulary have no row in the result. ``key`` is unique.
    """
    entry = "struct<ord:int,tag:string,family:string,score:double>"
    if not vocabulary:
        return df.filter(F.col(vec).isNotNull()).select(key, F.array().cast(f"array<{entry}>").alias("scores"))
    width = len(vocabulary[0][2])
    step = max(1, max_bytes // (8 * max(1, width)))
    rows = df.filter(F.col(vec).isNotNull() & (F.size(vec) == width) & ~F.exists(vec, lambda x: x.isNull()))

    def block(start: int):
        part = vocabulary[start:start + step]
        shared = df.sparkSession.sparkContext.broadcast(
            ([t for t, _, _ in part], [f for _, f, _ in part], np.array([e for _, _, e in part], dtype="float64")))

        @F.pandas_udf(f"array<{entry}>")
        def scores(v: pd.Series) -> pd.Series:
            tags, families, table = shared.value
            out = []
            for row in (np.stack([np.asarray(e, dtype="float64") for e in v]) @ table.T if len(v) else ()):
                order = np.lexsort((np.arange(len(row)), -row))
                out.append([{"ord": start + int(i), "tag": tags[i], "family": families[i], "score": float(row[i])}
                            for i in order if row[i] >= minimum])
            return pd.Series(out)

        return rows.select(key, scores(vec).alias("scores"))

    found = None
    for start in range(0, len(vocabulary), step):
        found = block(start) if found is None else found.unionByName(block(start))
    if step >= len(vocabulary):
        return found
    merged = found.groupBy(key).agg(F.flatten(F.collect_list("scores")).alias("scores"))
    by_score = F.array_sort("scores", lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(x["ord"] - y["ord"]))
    return merged.select(key, by_score.alias("scores"))


# Most fill tags per family.
FILL_CAPS = {"people": 2, "activity": 4}


def select_tags(scored: DataFrame, k: int = 10, minimum: float = 0.20, strong: float = 0.26,
                caps: dict[str, int] = FILL_CAPS) -> DataFrame:
    """Tags of a row: every strong one, then the best fills up to k in all, with a cap per family of fills.

    ``scored`` has ``scores`` in descending order. All work stays inside the row's array.
    """
    entries = F.filter("scores", lambda s: s.getField("score") >= minimum)
    hard = F.filter(entries, lambda s: s.getField("score") >= strong)
    soft = F.filter(entries, lambda s: s.getField("score") < strong)

    def allowed(s: Column, i: Column) -> Column:
        before = F.slice(soft, 1, i)
        test = F.lit(True)
        for family, cap in caps.items():
            used = F.size(F.filter(before, lambda b: b.getField("family") == family))
            test &= (s.getField("family") != family) | (used < cap)
        return test

    fills = F.filter(soft, allowed)
    room = F.greatest(F.lit(0), F.lit(k) - F.size(hard))
    chosen = F.concat(hard, F.slice(fills, F.lit(1), room))
    from ..functions.numbers import half_even

    return scored.withColumn("_chosen", chosen).select(
        *[c for c in scored.columns if c != "scores"],
        F.transform("_chosen", lambda s: s.getField("tag")).alias("tags"),
        F.map_from_entries(
            F.transform("_chosen", lambda s: F.struct(s.getField("tag"), half_even(s.getField("score"), 4)))
        ).alias("tag_scores"),
    )
