"""Blocks of near rows with exact bounds between them, for similarity joins that pivot cells do not prune.

Rows gather around homes, spread over the data; a home's rows are cut into blocks of bounded size. Every row has a few
coordinates: distances to the pivots of a table, its leading components under a rotation fitted on a sample, and the
norm of what the rotation leaves. A block keeps the smallest and the largest of each. Two blocks hold no similar pair

* if for some pivot their distances lie further apart than the join radius (triangle inequality), or
* if the largest inner product of their boxes of leading components and the product of their largest remaining norms
  together stay below the threshold (Cauchy-Schwarz on the remaining components).

Homes are compared first, so blocks of homes that cannot match never meet. Sample, homes and rotation decide speed only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keys import same

HOMES, TABLE, LEADING = 256, 16, 8
# sample: numbers that reach the driver
SAMPLE_ROWS, SAMPLE_NUMBERS = 2_048, 2 << 20
SLICE_ROWS = 2_048
# margin of the 32-bit coordinates
MARGIN = 1e-4
_HOME_SHIFT = 32
_FAR = 1e18


@dataclass(frozen=True)
class Blocks:
    """What the bounds are built from."""

    homes: np.ndarray
    table: np.ndarray
    basis: np.ndarray  # orthonormal columns
    chunk: int


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def _spread(x: np.ndarray, wanted: int) -> np.ndarray:
    """Rows far from each other, each the farthest from those before it, moved to the middle of the rows around them."""
    chosen, far = [0], _squares(x, x[:1])[:, 0]
    while len(chosen) < min(wanted, len(x)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _squares(x, x[chosen[-1:]])[:, 0])
    homes = x[chosen].copy()
    for _ in range(4):
        near = _squares(x, homes).argmin(1)
        for h in range(len(homes)):
            if (near == h).any():
                homes[h] = x[near == h].mean(0)
    return homes


def draw(rows: DataFrame, total: int, chunk: int) -> tuple[Blocks | None, np.ndarray]:
    """Blocks fitted on a bounded sample in key-hash order, and the sample; none for an empty table."""
    length = rows.select(F.size("_v").alias("n")).first()
    if length is None:
        return None, np.zeros((0, 1))
    limit = max(64, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, length["n"])))
    sample = [r["_v"] for r in rows.select("_v").orderBy(F.xxhash64(F.lit(3), "_id")).limit(limit).collect()]
    lengths = [len(v) for v in sample]
    common = max(set(lengths), key=lengths.count)
    x = np.array([v for v in sample if len(v) == common], dtype="float64")
    homes = _spread(x, max(1, min(HOMES, -(-total // chunk))))
    basis = np.linalg.svd(x, full_matrices=False)[2][:LEADING].T
    return Blocks(homes, homes[:TABLE], basis, chunk), x


def coordinates(blocks: Blocks, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, coordinates) of each row: distances to the table, leading components, remaining norm."""
    lead = x @ blocks.basis
    rest = np.sqrt(np.maximum((x**2).sum(1) - (lead**2).sum(1), 0.0))
    return _squares(x, blocks.homes).argmin(1), np.column_stack([np.sqrt(_squares(x, blocks.table)), lead, rest])


def share(blocks: Blocks, x: np.ndarray, radius: float, threshold: float) -> float:
    """Part of all block pairs that the bounds leave, estimated on the sample."""
    home, at = coordinates(blocks, x)
    low = np.stack([at[home == h].min(0) if (home == h).any() else np.full(at.shape[1], np.inf) for h in range(len(blocks.homes))])
    high = np.stack([at[home == h].max(0) if (home == h).any() else np.full(at.shape[1], -np.inf) for h in range(len(blocks.homes))])
    weight = np.bincount(home, minlength=len(blocks.homes)) / len(x)
    used = np.flatnonzero(weight)
    left = 0.0
    t = len(blocks.table)
    for h in used:
        gap = np.maximum(low[h, :t] - high[used, :t], low[used, :t] - high[h, :t]).max(1)
        ends = [a * b for a in (low[h, t:-1], high[h, t:-1]) for b in (low[used, t:-1], high[used, t:-1])]
        most = np.max(ends, axis=0).sum(1) + high[h, -1] * high[used, -1]
        left += weight[h] * weight[used][(gap <= radius + MARGIN) & (most >= threshold - MARGIN)].sum()
    return left


def _coordinate_udf(blocks: Blocks):
    width, size = len(blocks.table) + blocks.basis.shape[1] + 1, blocks.homes.shape[1]

    @F.pandas_udf("struct<home:int,at:array<float>>")
    def place(v: pd.Series) -> pd.DataFrame:
        homes, out = [], []
        for start in range(0, len(v), SLICE_ROWS):
            part = v.iloc[start:start + SLICE_ROWS]
            other = np.array([len(e) != size for e in part])
            x = np.stack([np.zeros(size) if o else np.asarray(e, dtype="float64") for e, o in zip(part, other)])
            home, at = coordinates(blocks, x)
            # vectors of another length: one home, and no bound
            home[other], at[other] = 0, np.concatenate([np.zeros(width - 1), [_FAR]])
            homes.append(home)
            out += list(at.astype("float32"))
        return pd.DataFrame({"home": np.concatenate(homes).astype("int32"), "at": out})

    return place


def _bounds(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    at = [F.get("_at", i) for i in range(width)]
    return rows.groupBy(*keys).agg(
        F.array(*[F.min(c) for c in at]).alias("_lo"), F.array(*[F.max(c) for c in at]).alias("_hi"), F.count("*").alias("_n"))


def _possible(blocks: Blocks, radius: float, threshold: float) -> Column:
    """Whether the bounds ``_lo``, ``_hi`` and ``_lo2``, ``_hi2`` allow a similar pair."""
    t, k = len(blocks.table), blocks.basis.shape[1]

    def end(name: str, i: int) -> Column:
        return F.get(name, i).cast("double")

    out = F.lit(True)
    for i in range(t):
        gap = F.greatest(end("_lo", i) - end("_hi2", i), end("_lo2", i) - end("_hi", i))
        out &= gap <= radius + MARGIN
    most = end("_hi", t + k) * end("_hi2", t + k)
    for i in range(t, t + k):
        most += F.greatest(*[end(a, i) * end(b, i) for a in ("_lo", "_hi") for b in ("_lo2", "_hi2")])
    return out & (most >= threshold - MARGIN)


def _side(rows: DataFrame, by: list[str], blocks: Blocks) -> DataFrame:
    """Rows with their block; a home with more rows than a block is cut by a hash of the id."""
    placed = rows.withColumn("_p", _coordinate_udf(blocks)("_v")).select(
        "_id", *by, "_v", F.col("_p.home").cast("long").alias("_home"), F.col("_p.at").alias("_at"))
    placed = cut_lineage(placed)
    keys = [*by, "_home"]
    sizes = placed.groupBy(*[F.col(c).alias(f"_s{c}") for c in keys]).agg(F.count("*").alias("_rows"))
    part = F.pmod(F.xxhash64("_id"), F.greatest(F.lit(1), F.ceil(F.col("_rows") / blocks.chunk)))
    return placed.join(sizes, same(keys, "_s")).withColumn(
        "_block", F.shiftleft("_home", _HOME_SHIFT) + part).drop("_rows", *[f"_s{c}" for c in keys])


def _second(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}2" if c in names else f"_r{c}") for c in df.columns if c != "_n"])


def _meet(a: DataFrame, b: DataFrame, by: list[str], blocks: Blocks, radius: float, threshold: float, own: bool) -> DataFrame:
    """(by, _i, _j): block pairs that may hold a similar pair; each unordered pair once if both sides are one table."""
    width = len(blocks.table) + blocks.basis.shape[1] + 1
    may = _possible(blocks, radius, threshold)
    homes = [_bounds(x, [*by, "_home"], width) for x in (a, b)]
    right = _second(homes[1], ["_home", "_lo", "_hi"])
    order = F.col("_home") <= F.col("_home2") if own else F.lit(True)
    near = homes[0].join(right, same(by, "_r")).filter(order & may).select(*by, "_home", "_home2")
    inner = [_bounds(x, [*by, "_home", "_block"], width).drop("_n") for x in (a, b)]
    names = [*by, "_home"]
    one = near.join(inner[0].select(*[F.col(c).alias(f"_l{c}" if c in names else c) for c in inner[0].columns]), same(names, "_l"))
    one = one.drop(*[f"_l{c}" for c in names])
    two = _second(inner[1].select(*by, F.col("_home").alias("_at_home"), "_block", "_lo", "_hi"), ["_block", "_lo", "_hi"])
    both = one.join(two, same(by, "_r") & (F.col("_home2") == F.col("_r_at_home")))
    order = F.col("_block") <= F.col("_block2") if own else F.lit(True)
    return both.filter(order & may).select(*by, F.col("_block").alias("_i"), F.col("_block2").alias("_j"))


def _send(rows: DataFrame, pairs: DataFrame, by: list[str], column: str, side: int) -> DataFrame:
    to = pairs.select(*[F.col(c).alias(f"_p{c}") for c in by], "_i", "_j", "_own", F.col(column).alias("_to"))
    return rows.join(to, same(by, "_p") & (F.col("_block") == F.col("_to"))).select(
        "_id", *by, "_v", F.lit(0).alias("_cell"), F.lit(0).alias("_pair"), "_own", "_i", "_j", F.lit(side).alias("_side"))


def self_tasks(rows: DataFrame, by: list[str], blocks: Blocks, radius: float, threshold: float) -> DataFrame:
    """Rows copied to every block pair they take part in."""
    placed = _side(rows, by, blocks)
    pairs = cut_lineage(_meet(placed, placed, by, blocks, radius, threshold, True).withColumn("_own", F.col("_i") == F.col("_j")))
    return _send(placed, pairs, by, "_i", 0).unionByName(_send(placed, pairs.filter(~F.col("_own")), by, "_j", 1))


def between_tasks(left: DataFrame, right: DataFrame, by: list[str], blocks: Blocks, radius: float, threshold: float) -> DataFrame:
    """As ``self_tasks``, for the rows of two tables."""
    a, b = _side(left, by, blocks), _side(right, by, blocks)
    pairs = cut_lineage(_meet(a, b, by, blocks, radius, threshold, False).withColumn("_own", F.lit(False)))
    return _send(a, pairs, by, "_i", 0).unionByName(_send(b, pairs, by, "_j", 1))


def report(rows: DataFrame, by: list[str], blocks: Blocks, radius: float, threshold: float) -> DataFrame:
    """One row per group: number of blocks, of their unordered pairs (own ones included), and of those compared."""
    placed = _side(rows, by, blocks)
    held = placed.select(*by, "_block").distinct().groupBy(*by).agg(F.count("*").alias("blocks"))
    met = _meet(placed, placed, by, blocks, radius, threshold, True).groupBy(*[F.col(c).alias(f"_m{c}") for c in by]).agg(
        F.count("*").alias("compared"))
    n = F.col("blocks")
    return held.join(met, same(by, "_m"), "left").select(
        *by, "blocks", (n * (n + 1) / 2).cast("long").alias("pairs"), F.coalesce("compared", F.lit(0)).cast("long").alias("compared"))
