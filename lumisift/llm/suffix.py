"""Removal of repeated byte strings by a depth-limited most-significant-digit radix sort of suffixes.

Only the first ``threshold`` bytes of a suffix count, so a suffix is a window. The passes go from a coarse digit to the
whole window, and a window leaves as soon as it is alone under its digits:

1. Digit one is the window's smallest 32-byte string (leftmost on ties). Equal windows choose the same one at the same
   offset, and neighbouring windows share it, so a run of some hundred windows is one row. Runs whose digit occurs once
   are unique. Runs that are equal byte for byte, place of the digit included, are repeated as a whole.
2. The other runs are cut at fixed distances from the digit into blocks of 24 windows. Digit two is the part that all
   windows of a block share. Blocks alone under it are unique, equal blocks are repeated.
3. What is left is sorted by whole windows. Groups of two or more are exactly the repeated windows.

Digits are 64-bit hashes that only say what meets: strings that collide there are kinds of one group. What is equal is
decided by keyed digests of the bytes themselves, of 64 bits inside a group and of 128 bits for whole windows, with a key
drawn for each run. Counts are aggregates that merge before the shuffle, and the counts of frequent strings are broadcast
to their rows, so a string shared by a third of all rows gathers nowhere.

The same passes run over words (``words=True``): then white space between words does not count (the bytes are those of
the words joined by one blank), and ``threshold``, ``gram``, ``step`` and all positions are numbers of words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLOCK, SpanHash, anchor_runs, digest, free_name, join_counted, keep_table, mix, row_number_of, run_key, small_batches,
    word_hashes, word_spans,
)

THRESHOLD = 400
GRAM = 32
STEP = 24
# the same for words
WORD_GRAM, WORD_STEP = 8, 8


class _Text:
    """Units (bytes, or words) of a text, and the bytes of any run of them."""

    def __init__(self, hasher: SpanHash, raw: bytes, words: bool):
        self.raw = b" ".join(raw.split()) if words else raw
        data = np.frombuffer(self.raw, np.uint8)
        self.units = word_hashes(hasher, data) if words else data
        self.start, self.end = (x.tolist() for x in word_spans(data)) if words else (None, None)

    def part(self, a: int, b: int) -> bytes:
        """Bytes of units a..b, for a < b."""
        return self.raw[a:b] if self.start is None else self.raw[self.start[a]:self.end[b - 1]]


def _utf8(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _runs(hasher: SpanHash, text: _Text, threshold: int, gram: int, key: bytes):
    """(digit, whole, anchor, first, last) of each run of windows of a text, in blocks of bounded size."""
    parts = []
    total = len(text.units) - threshold + 1
    for begin in range(0, max(total, 0), BLOCK):
        part = text.units[begin:min(begin + BLOCK, total) + threshold - 1]
        sums = hasher.sums(part)
        anchor, first, last = anchor_runs(hasher.every(sums, gram), threshold - gram + 1)
        digit = hasher.spans(sums, anchor, anchor + gram)
        anchor, first, last = anchor + begin, first + begin, last + begin
        whole = np.fromiter(
            (digest(key, text.part(a, b), at) for a, b, at in zip(first.tolist(), (last + threshold).tolist(), (anchor - first).tolist())),
            np.int64, len(first))
        parts.append((digit.view(np.int64), whole, anchor, first, last))
    if not parts:
        return None
    return [np.concatenate(x) for x in zip(*parts)]


def _first_digits(rows: DataFrame, threshold: int, gram: int, words: bool, key: bytes) -> DataFrame:
    def run(batches):
        hasher = SpanHash()
        for pdf in batches:
            out = []
            for row, text in zip(pdf["row"], pdf["text"]):
                found = _runs(hasher, _Text(hasher, _utf8(text), words), threshold, gram, key)
                if found is not None:
                    out.append(pd.DataFrame({
                        "row": row, "digit": found[0], "whole": found[1], "anchor": found[2], "first": found[3],
                        "last": found[4]}))
                if len(out) >= 512:
                    yield pd.concat(out, ignore_index=True)
                    out = []
            if out:
                yield pd.concat(out, ignore_index=True)

    return rows.mapInPandas(run, "row long, digit long, whole long, anchor long, first long, last long")


def _settle(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) among items with digit, whole, row, first and last.

    Items alone under their digit drop out. Items equal to another are repeated. Where a digit has several kinds, one
    item stands for each kind in the next pass.
    """
    by = items.groupBy("digit").agg(
        F.count("*").alias("_all"), F.min("whole").alias("_lo"), F.max("whole").alias("_hi")
    ).filter(F.col("_all") > 1).select(F.col("digit").alias("_d"), "_all", (F.col("_lo") != F.col("_hi")).alias("_mixed"))
    shared = keep_table(join_counted(items, by, {"digit": "_d"}, "_all").drop("_d", "_all"), "shared")
    mixed = shared.filter("_mixed").withColumn("_id", F.xxhash64("row", "first"))
    kinds = mixed.groupBy(F.col("digit").alias("_d"), F.col("whole").alias("_w")).agg(
        F.count("*").alias("_n"), F.min("_id").alias("_rep"))
    judged = keep_table(join_counted(mixed, kinds, {"digit": "_d", "whole": "_w"}, "_n").select(
        *items.columns, (F.col("_n") > 1).alias("_twice"), (F.col("_id") == F.col("_rep")).alias("_stands")), "judged")
    repeated = shared.filter(~F.col("_mixed")).select("row", "first", "last").unionByName(
        judged.filter("_twice").select("row", "first", "last"))
    return repeated, judged.filter("_stands").dropDuplicates(["row", "first"]).drop("_twice", "_stands")


def repeated_windows(
    rows: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, step: int = STEP, words: bool = False,
) -> DataFrame:
    """(row, first, last): runs of window starts, in bytes or words, whose window also starts elsewhere; runs may touch.

    ``rows`` has ``row`` (equal only for equal rows) and ``text``.
    """
    small_batches(rows)
    key = run_key()
    one, open_ = _settle(keep_table(_first_digits(rows, threshold, gram, words, key), "digits"))
    need = open_.groupBy("row").agg(F.collect_list(F.struct("digit", "anchor", "first", "last")).alias("r"))
    # one copy of the bytes of each kind of run, a few hundred each
    cut = keep_table(_cut_bytes(need.hint("shuffle_hash").join(rows, "row"), threshold, words), "bytes")
    two, open_ = _settle(keep_table(cut.mapInPandas(
        _blocks(threshold, step, words, key), "row long, digit long, whole long, run long, first long, last long"), "blocks"))
    parts = open_.groupBy("row", F.col("run").alias("first")).agg(F.collect_list(F.struct("first", "last")).alias("r"))
    windows = keep_table(cut.join(parts.hint("shuffle_hash"), ["row", "first"]).select("row", "first", "bytes", "r").mapInPandas(
        _windows(threshold, words, key), "row long, first long, window long, more long"), "windows")
    often = windows.groupBy(F.col("window").alias("_w"), F.col("more").alias("_m")).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    three = join_counted(windows, often, {"window": "_w", "more": "_m"}, "n").select("row", "first", F.col("first").alias("last"))
    return one.unionByName(two).unionByName(three)


def _cut_bytes(joined: DataFrame, threshold: int, words: bool) -> DataFrame:
    """One row per run, with its bytes."""

    def run(batches):
        hasher = SpanHash()
        for pdf in batches:
            out = []
            for row, body, runs in zip(pdf["row"], pdf["text"], pdf["r"]):
                text = _Text(hasher, _utf8(body), words)
                for r in runs:
                    first, last = int(r["first"]), int(r["last"])
                    out.append((row, r["digit"], r["anchor"], first, last, text.part(first, last + threshold)))
                if len(out) >= 8192:
                    yield pd.DataFrame(out, columns=["row", "digit", "anchor", "first", "last", "bytes"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["row", "digit", "anchor", "first", "last", "bytes"])

    return joined.select("row", "text", "r").mapInPandas(
        run, "row long, digit long, anchor long, first long, last long, bytes binary")


def _blocks(threshold: int, step: int, words: bool, key: bytes):
    """Cuts runs at fixed distances from their anchor. A window that starts ``d`` before the anchor is in block
    d // step; the core of a block is what its windows share, so it runs from its last start to its first end."""

    def run(batches):
        hasher = SpanHash()
        for pdf in batches:
            out = []
            for row, digit, anchor, first, last, raw in pdf[
                ["row", "digit", "anchor", "first", "last", "bytes"]
            ].itertuples(index=False):
                text = _Text(hasher, raw, words)
                sums = hasher.sums(text.units)
                number = np.arange((anchor - last) // step, (anchor - first) // step + 1)
                # full blocks by distance, then clipped to the run
                low = np.maximum(anchor - (number * step + step - 1), first)
                high = np.minimum(anchor - number * step, last)
                core_low, core_high = anchor - number * step, anchor - (number * step + step - 1) + threshold
                # of a block that the run cuts off, only the bytes inside the run are at hand; the core lies in every
                # window of the full block, so in every window of the clipped one too
                core = hasher.spans(sums, core_low - first, core_high - first)
                meet = mix(core ^ (np.uint64(digit & (2**64 - 1)) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                for i in range(len(number)):
                    a, b = int(low[i]), int(high[i])
                    whole = digest(key, text.part(a - first, b - first + threshold), anchor - a)
                    out.append((row, meet[i].view(np.int64), whole, first, a, b))
                if len(out) >= 8192:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    def frame(out):
        return pd.DataFrame(out, columns=["row", "digit", "whole", "run", "first", "last"])

    return run


def _windows(threshold: int, words: bool, key: bytes):
    """Digests of the single windows of the given parts of a run, 128 bits as two numbers."""

    def run(batches):
        hasher = SpanHash()
        for pdf in batches:
            rows, at, found = [], [], []
            for row, first, raw, parts in zip(pdf["row"], pdf["first"], pdf["bytes"], pdf["r"]):
                text = _Text(hasher, raw, words)
                start = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in parts])
                found += [hashlib.blake2b(text.part(a, a + threshold), digest_size=16, key=key).digest() for a in (start - first).tolist()]
                rows.append(np.full(len(start), row))
                at.append(start)
            if rows:
                both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"row": np.concatenate(rows), "first": np.concatenate(at), "window": both[:, 0], "more": both[:, 1]})

    return run


def merge_runs(first: np.ndarray, last: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal (start, end) of what windows of ``width`` starting at first..last cover."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + width)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return list(zip(first[new].tolist(), end[np.concatenate([new[1:] - 1, [len(end) - 1]])].tolist()))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds ``row``, see ``row_number_of``."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("row", row_number_of(run_key(), F.col("doc_id").cast("string"), F.col("text")))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, **options) -> DataFrame:
    """(doc_id, text, spans) for every row of ``docs``: ``spans`` are the maximal byte runs [start, end) covered by
    strings of ``threshold`` bytes that start elsewhere too, in the same text or another; null where none is.

    Null is the empty text; texts shorter than the threshold have no such string; repeated rows stay and repeat each
    other; other columns are ignored.
    """
    rows = _keyed(docs, key, text)
    found = repeated_windows(rows.select("row", "text"), threshold, **options)
    spans = found.groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return rows.join(spans.hint("shuffle_hash"), F.col("row") == F.col("_row"), "left").select("doc_id", "text", "runs")


def _spans_of(runs, threshold: int) -> list[tuple[int, int]]:
    if runs is None:
        return []
    first = np.fromiter((r["first"] for r in runs), np.int64, len(runs))
    last = np.fromiter((r["last"] for r in runs), np.int64, len(runs))
    return merge_runs(first, last, threshold)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) of every row; see ``repeated_spans``."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc, body, runs in zip(pdf["doc_id"], pdf["text"], pdf["runs"]):
                raw, spans = body.encode("utf-8", "surrogatepass"), _spans_of(runs, threshold)
                out.append((doc, len(raw), sum(b - a for a, b in spans), [list(s) for s in spans],
                            hashlib.sha256(_without(raw, spans)).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return repeated_spans(docs, key, text, threshold, **options).mapInPandas(
        run, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string")


def _word_bytes(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, up to the next word or the end of the text."""
    start = np.append(word_spans(np.frombuffer(raw, np.uint8))[0], len(raw))
    return [(int(start[a]), int(start[b])) for a, b in spans]


def remove_repeats(
    docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, words: bool = False, **options,
) -> DataFrame:
    """``docs`` with the repeated bytes, or words with the white space that follows them, cut out of ``text``; the
    other columns stay.

    Bytes of a character that a span cuts in two go with the span. Rows are matched by their whole content.
    """
    options = ({"gram": WORD_GRAM, "step": WORD_STEP} if words else {}) | options
    columns = docs.columns
    row, met, cuts = (free_name(docs, n) for n in ("_row", "_r", "_runs"))
    rows = docs.withColumn(row, row_number_of(run_key(), F.to_json(F.struct(*[F.col(c) for c in columns if c != text])), F.col(text).cast("string")))
    plain = rows.select(F.col(row).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = repeated_windows(plain, threshold, words=words, **options)
    spans = found.groupBy(F.col("row").alias(met)).agg(F.collect_set(F.struct("first", "last")).alias(cuts))
    joined = rows.join(spans.hint("shuffle_hash"), F.col(row) == F.col(met), "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, kept = batch.schema.get_field_index(text), []
            for t, runs in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index(cuts)).to_pylist()):
                if runs and t is not None:
                    raw, spans = t.encode("utf-8"), _spans_of(runs, threshold)
                    t = _without(raw, _word_bytes(raw, spans) if words else spans).decode("utf-8", "ignore")
                kept.append(t)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(kept, batch.schema.field(at).type))
            yield batch.select(columns)

    return joined.select(*columns, cuts).mapInArrow(run, docs.schema)
