"""Expressions over array columns: products, distances, perceptual hashes, histograms, grid measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, accumulated in double."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit_normalize(v: Column | str) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    return divide(v, norm(v))


def divide(v: Column | str, by: Column) -> Column:
    """Every element divided by one number (kept as it is when that is zero); the divisor is evaluated once per row."""
    v = col(v)
    return F.zip_with(
        v, F.array_repeat(by, F.size(v)),
        lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")),
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclid(a: Column | str, b: Column | str) -> Column:
    diff = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d * d))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def bit_difference(a: Column | str, b: Column | str) -> Column:
    """Share of positions that differ between two 0/1 arrays."""
    a, b = col(a), col(b)
    differing = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, x: acc + x
    )
    return differing / F.size(a)


def _neighbours(grid: Column | str, width: int, height: int, compare) -> Column:
    """``compare(left, right)`` for horizontal neighbours, row by row. The grid is read twice, not once per cell."""
    g, n = col(grid), width * height
    every = F.zip_with(F.slice(g, 1, n - 1), F.slice(g, 2, n - 1), compare)
    # the last cell of a row has no right neighbour
    return F.filter(every, lambda _, i: (i + 1) % width != 0)


def dhash(grid: Column | str, width: int = 9, height: int = 8) -> Column:
    """Difference hash: one bit per horizontal neighbour pair, set when the left value is larger, first pair highest."""
    bits = _neighbours(grid, width, height, lambda left, right: (left > right).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def phash(grid: Column | str, width: int = 17, height: int = 16) -> Column:
    """Perceptual hash as a 0/1 array, set when the right value is larger."""
    return _neighbours(grid, width, height, lambda left, right: (right > left).cast("tinyint"))


def histogram(values: Column | str, bins: int, low: float = 0.0, high: float = 256.0) -> Column:
    """Counts per equal-width bin of [low, high); the last bin is closed."""
    v = col(values)
    step = (high - low) / bins

    def falls_in(b: int):
        closing = F.lit(b == bins - 1)
        return lambda x: (F.floor((x.cast("double") - low) / step) == b) | (closing & (x.cast("double") == high))

    return F.array(*[F.size(F.filter(v, falls_in(b))).cast("double") for b in range(bins)])


def visual_vector(grid: Column | str, channels: list[Column], bins: int = 8, scale: float = 1.0) -> Column:
    """Grey grid plus per-channel histograms (as shares, times ``scale``), unit length."""
    parts = [F.transform(col(grid), lambda x: x.cast("double"))]
    for channel in channels:
        share = divide(histogram(channel, bins), F.size(channel).cast("double") / scale)
        parts.append(share)
    return unit_normalize(F.concat(*parts))


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return total / F.size(values)


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(variance(values))


def variance(values: Column) -> Column:
    centred = F.zip_with(values, F.array_repeat(mean(values), F.size(values)), lambda x, m: x.cast("double") - m)
    return F.aggregate(centred, F.lit(0.0), lambda acc, x: acc + x * x) / F.size(values)


def percentile(values: Column, share: float) -> Column:
    """Linear interpolation between the two closest ranks of a small array."""
    ordered = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    position = (F.size(values) - 1) * F.lit(float(share))
    low = F.floor(position).cast("int")
    below = F.get(ordered, low)
    above = F.coalesce(F.get(ordered, low + 1), below)
    return below + (above - below) * (position - low)


def laplacian_variance(grid: Column, width: int, rows: range, cols: range) -> Column:
    """Variance of the 4-neighbour Laplacian over the given interior cells of a row-major grid."""
    cells = [r * width + c for r in rows for c in cols]

    def at(i: Column) -> Column:
        return F.get(grid, i).cast("double")

    response = F.transform(
        F.array(*[F.lit(i) for i in cells]),
        lambda i: at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4.0 * at(i),
    )
    return variance(response)
