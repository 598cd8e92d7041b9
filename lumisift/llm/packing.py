"""Packing into length buckets whose boundaries a dynamic program chooses over the global histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import ranked
from .common import keep_table
from .tokens import token_counts

BUCKETS = 16
TOKEN_BUDGET = 16_384
# lengths up to 2^EXACT_BITS have a bin each; beyond, each power of two has 2^FINE_BITS bins
EXACT_BITS, FINE_BITS = 11, 7
# characters that end words; fixed value
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bin(length: Column) -> Column:
    """Number of the histogram bin; at most 2^EXACT_BITS + 64 * 2^FINE_BITS of them, whatever the lengths."""
    log = F.length(F.bin(F.greatest(length, F.lit(1)))) - 1
    fine = F.call_function("shiftright", length, F.greatest(log - FINE_BITS, F.lit(0)))
    return F.when(length < (1 << EXACT_BITS), length).otherwise((log.cast("long") + 1) * (1 << (FINE_BITS + 8)) + fine)


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding; lengths ascending and distinct.

    cost(i, j) pads lengths i..j to lengths[j]. The sum of rows times bound is the only part that depends on the cut.
    """
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    bound = lengths.astype(np.float64)
    best = rows[1:] * bound  # one bucket for the first j + 1 lengths
    back = []
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + (rows[j + 1] - rows[1:j + 1]) * bound[j]
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], cut[j] = cost[i], i
        back.append(cut)
        best = new
    out, j = [], n - 1
    for cut in reversed(back):
        if j < 0:
            break
        if cut[j] >= 0:
            out.append(int(lengths[j]))
            j = int(cut[j])
    out.append(int(lengths[j]))
    return sorted(set(out))


def choose_boundaries(lengths: DataFrame, length: str, buckets: int = BUCKETS) -> list[int]:
    """Boundaries from the histogram of all rows; only its bins, whose number is bounded, reach the driver.

    Exact while every length has a bin of its own, which holds below 2^EXACT_BITS; above, lengths within one part in
    2^FINE_BITS move together, and the bound is the longest length of the bin, so no row exceeds its bucket. Moving each
    bound of the best cut up to the top of its bin lengthens it by at most one part in 2^FINE_BITS, so the padded
    total is at most 1 + 2^-FINE_BITS (129/128) times the least one.
    """
    bins = lengths.groupBy(_bin(F.col(length)).alias("b")).agg(F.max(length).alias("top"), F.count("*").alias("n"))
    found = sorted((r["top"], r["n"]) for r in bins.collect())
    return best_boundaries(np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), buckets)


def pack(
    docs: DataFrame, length: Column | None = None, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_length, batch_id, slot) for every row.

    ``length`` is the token count of a row; by default the words of its text (null: none), see ``pack_tokens``. Bucket numbers ascend with
    their bound. A batch holds as many rows of one bucket as fit in ``token_budget`` at the bucket's bound; a row
    longer than the budget has a batch of its own, uncut. Rows of a bucket are dealt in an order drawn from their
    key, then by key, so batches mix sources; repeated rows stay, null keys come first. ``slot`` counts from 0. An
    empty table has no batches.
    """
    size = word_count(F.col(text).cast("string")) if length is None else F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), size.alias("n_tokens"))
    bounds = choose_boundaries(rows, "n_tokens", buckets)
    if not bounds:
        return rows.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("padded_length"),
                           F.lit(0).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("slot"))
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(table, lambda b: b < F.col("n_tokens")))
    rows = rows.withColumn("bucket", bucket).withColumn("_dealt", F.xxhash64("doc_id"))
    # ranges of (bucket, draw) spread a full bucket over many tasks
    rows = ranked(rows, ["bucket"], ["_dealt", "doc_id", "n_tokens"], "_rank")
    padded = F.element_at(table, F.col("bucket") + 1)
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(padded, F.lit(1))))
    at = F.col("_rank").cast("long") - 1
    # a batch number is unique over buckets: the bucket in the upper bits
    return rows.withColumn("padded_length", padded).withColumn("_fit", fit).select(
        "doc_id", "n_tokens", "bucket", "padded_length",
        (F.shiftleft(F.col("bucket").cast("long"), 40) + F.floor(at / F.col("_fit"))).cast("long").alias("batch_id"),
        (at % F.col("_fit")).alias("slot"),
    )


def pack_tokens(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """``pack`` by the tokens that the tokenizer file counts in each whole text."""
    counted = token_counts(docs, tokenizer_path, key, text).select("doc_id", "n_tokens")
    # the counts are read for the histogram, the ranges and the ranks
    return pack(keep_table(counted, "lengths"), F.col("n_tokens"), buckets=buckets, token_budget=token_budget)
