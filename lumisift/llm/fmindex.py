"""Removal of word windows that also stand in a document with a smaller id, by FM-indexes per shard.

A window's anchor is its smallest 8-word string (leftmost on ties), so equal windows share the anchor's words, and
neighbouring windows share an anchor: a segment is a run of windows with one anchor. Only segments whose anchor
occurs more than once are indexed or searched, each different segment once. A shard holds the segments of a range of
anchors; its FM-index (Burrows-Wheeler transform in a wavelet matrix) answers backward searches, which give the
matching statistics of the segments streamed past it: how far each position's match reaches, and in which documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, WordDigests, anchor_runs, digest, gram_hashes, keep_table, row_number_of, run_key, word_hashes, word_spans

WINDOW = 50
GRAM = 8
# words in one shard's index; an anchor with more segments than fit is cut into several shards
SHARD_WORDS = 1 << 19


class WaveletMatrix:
    """Rank of any symbol at any position of a sequence of small integers, one bit plane per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size = bits, len(symbols)
        self.planes, self.counts, self.zeros = [], [], []
        now = symbols
        for b in range(bits - 1, -1, -1):
            bit = ((now >> b) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[:len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.planes.append(words)
            self.counts.append(counts)
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        # where each symbol's occurrences begin in the last plane
        self.start = np.zeros((1 << bits) + 1, np.int64)
        if len(now):
            order = np.bincount(now, minlength=1 << bits)
            value = np.arange(1 << bits)
            turned = np.zeros_like(value)
            for b in range(bits):
                turned |= ((value >> b) & 1) << (bits - 1 - b)
            placed = np.argsort(turned, kind="stable")
            first = np.concatenate([[0], np.cumsum(order[placed])[:-1]])
            self.start[placed] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position ``at``, for arrays of both."""
        pos = at
        for level in range(self.bits):
            word, shift = pos >> 6, (pos & 63).astype(np.uint64)
            below = self.planes[level][word] & ((np.uint64(1) << shift) - np.uint64(1))
            ones = self.counts[level][word] + np.bitwise_count(below)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            pos = np.where(bit == 1, self.zeros[level] + ones, pos - ones)
        return pos - self.start[symbol]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols (or a little more), by doubling; ties by place."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    have = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[:n - have] = rank[have:]
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        have *= 2
        if have >= depth or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """FM-index of many word sequences, each closed by its own end mark 0; ``docs`` holds a document per sequence."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, docs: np.ndarray, depth: int):
        self.alphabet, codes = np.unique(words, return_inverse=True)
        text = np.zeros(len(words) + len(lengths), np.int64)
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = codes + 1
        order = suffix_array(text, depth)
        # rows that agree in their first ``depth`` words stand in any order; searches never look deeper
        self.bits = max(1, int(len(self.alphabet)).bit_length())
        self.tree = WaveletMatrix(text[order - 1], self.bits)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        owner = np.repeat(docs, lengths + 1)[order]
        self.low = [owner]
        width = 1
        while width * 2 <= len(owner):
            last = self.low[-1]
            self.low.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 for words the index does not hold."""
        if not len(self.alphabet):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def step(self, low, high, symbol):
        """One backward step for arrays of row ranges."""
        base = self.less[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest document among the rows of each non-empty range."""
        level = np.floor(np.log2(np.maximum(high - low, 1))).astype(np.int64)
        out = np.empty(len(low), self.low[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.low[k][low[at]], self.low[k][high[at] - (1 << int(k))])
        return out


def earlier_windows(index: FMIndex, words: np.ndarray, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray, window: int):
    """For each segment (its first word, its number of windows, its document): mask over all its windows of those that
    the index holds in a smaller document.

    Backward searches run side by side, from the last word of each window; a search ends when no row is left whose
    document is smaller, as no longer match can have one.
    """
    symbol = index.codes(words)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(starts, counts) + offset
    own = np.repeat(docs, counts)
    alive = np.arange(len(first))
    low, high = np.zeros(len(first), np.int64), np.full(len(first), index.tree.size, np.int64)
    for back in range(window - 1, -1, -1):
        s = symbol[first[alive] + back]
        held = s >= 0
        alive, low, high, s = alive[held], low[held], high[held], s[held]
        low, high = index.step(low, high, s)
        held = low < high
        alive, low, high = alive[held], low[held], high[held]
        if back % 3 == 0 and len(alive):
            held = index.smallest(low, high) < own[alive]
            alive, low, high = alive[held], low[held], high[held]
        if not len(alive):
            break
    out = np.zeros(len(first), bool)
    out[alive] = True
    return out


def _segments(rows: DataFrame, window: int, gram: int, key: bytes) -> DataFrame:
    """Segments with their anchor's hash, which says what meets, and a keyed digest of their words, which says what is
    equal."""

    def run(batches):
        hasher = SpanHash()
        for pdf in batches:
            out = []
            for row, doc, text in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                raw = b" ".join(text.encode("utf-8", "surrogatepass").split())
                data = np.frombuffer(raw, np.uint8)
                grams = gram_hashes(word_hashes(hasher, data), gram)
                anchor, first, last = anchor_runs(grams, window - gram + 1)
                if not len(anchor):
                    continue
                start, end = word_spans(data)
                begin, stop = start[first].tolist(), end[last + window - 1].tolist()
                whole = np.fromiter(
                    (digest(key, raw[a:b], at) for a, b, at in zip(begin, stop, (anchor - first).tolist())), np.int64, len(first))
                out.append(pd.DataFrame({"row": row, "doc_id": doc, "digit": grams[anchor].view(np.int64),
                                         "whole": whole, "first": first, "last": last}))
                if len(out) >= 512:
                    yield pd.concat(out, ignore_index=True)
                    out = []
            if out:
                yield pd.concat(out, ignore_index=True)

    return rows.mapInPandas(run, "row long, doc_id long, digit long, whole long, first long, last long")


def _cut(joined: DataFrame, window: int, key: bytes) -> DataFrame:
    """One row per segment, with its words as packed 64-bit keyed digests."""

    def run(batches):
        digests = WordDigests(key)
        for pdf in batches:
            out = []
            for row, doc, text, runs in zip(pdf["row"], pdf["doc_id"], pdf["text"], pdf["r"]):
                words = digests.of(text.encode("utf-8", "surrogatepass").split())
                for r in runs:
                    first, last = int(r["first"]), int(r["last"])
                    out.append((row, doc, r["digit"], r["parts"], first, last, words[first:last + window].tobytes()))
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    columns = ["row", "doc_id", "digit", "parts", "first", "last", "words"]
    return joined.select("row", "doc_id", "text", "r").mapInPandas(
        run, "row long, doc_id long, digit long, parts long, first long, last long, words binary")


def _search(cut: DataFrame, shards: int, window: int) -> DataFrame:
    """(row, first, last): windows that stand in a smaller document, from one index per shard.

    An anchor whose segments exceed a shard has several parts. Its segments are dealt to the parts twice, once to be
    indexed and once to be streamed, and each part's stream passes each part's index, so no task holds the anchor.
    """
    base = F.pmod(F.xxhash64("digit"), F.lit(shards))
    mine = F.pmod(F.xxhash64("row", "first"), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))

    def shard(index, stream):
        return F.when(F.col("parts") > 1, F.xxhash64("digit", index, stream)).otherwise(base)

    spread = cut.withColumn("_mine", mine).withColumn("_p", every)
    held = spread.select(
        shard(F.col("_mine"), F.col("_p")).alias("shard"), F.col("doc_id").alias("h_doc"), F.col("words").alias("h_words"))
    asks = spread.select(shard(F.col("_p"), F.col("_mine")).alias("at"), "row", "doc_id", "first", "words")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"row": [], "first": [], "last": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        lengths = left["h_words"].str.len().to_numpy() // 8
        index = FMIndex(np.frombuffer(b"".join(left["h_words"]), np.uint64), lengths, left["h_doc"].to_numpy(), window)
        rows, lows, highs = [], [], []
        for at in range(0, len(right), 4096):
            ask = right.iloc[at:at + 4096]
            words = np.frombuffer(b"".join(ask["words"]), np.uint64)
            size = ask["words"].str.len().to_numpy() // 8
            counts = size - window + 1
            starts = np.cumsum(size) - size
            mask = earlier_windows(index, words, starts, counts, ask["doc_id"].to_numpy(), window)
            # runs of found windows inside each segment
            segment = np.repeat(np.arange(len(ask)), counts)
            offset = np.arange(len(mask)) - np.repeat(np.cumsum(counts) - counts, counts)
            edge = mask & ~np.concatenate([[False], mask[:-1] & (segment[1:] == segment[:-1])])
            stop = mask & ~np.concatenate([mask[1:] & (segment[1:] == segment[:-1]), [False]])
            rows.append(ask["row"].to_numpy()[segment[edge]])
            lows.append(ask["first"].to_numpy()[segment[edge]] + offset[edge])
            highs.append(ask["first"].to_numpy()[segment[stop]] + offset[stop])
        return pd.DataFrame({"row": np.concatenate(rows), "first": np.concatenate(lows), "last": np.concatenate(highs)})

    return held.groupBy("shard").cogroup(asks.groupBy("at")).applyInPandas(run, "row long, first long, last long")


def earlier_runs(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(row, first, last): runs of windows, by first word, that also start in a document with a smaller doc_id.

    ``rows`` has ``row`` (equal only for equal rows), ``doc_id`` (not null) and ``text``.
    """
    key = run_key()
    segments = keep_table(_segments(rows, window, gram, key), "segments")
    kinds = segments.groupBy("digit", "whole").agg(F.count("*").alias("n"), F.min("doc_id").alias("_doc"))
    by = kinds.groupBy("digit").agg(F.sum("n").alias("_all"), F.count("*").alias("_kinds")).filter(F.col("_all") > 1)
    marked = kinds.join(by, "digit").select(F.col("digit").alias("_d"), F.col("whole").alias("_w"), "_doc", "_kinds")
    shared = keep_table(segments.join(marked, (F.col("digit") == F.col("_d")) & (F.col("whole") == F.col("_w"))).select(
        "row", "doc_id", "digit", "first", "last", "_kinds", "_doc"), "shared")
    # equal to a segment of a smaller document: every window is
    whole = shared.filter(F.col("doc_id") > F.col("_doc")).select("row", "first", "last")
    # the others are in the smallest document of their kind; other kinds may hold their windows in a smaller one
    fits = max(1, shard_words // (2 * window))
    stand = shared.filter((F.col("_kinds") > 1) & (F.col("doc_id") == F.col("_doc"))).dropDuplicates(["row", "first"])
    stand = stand.withColumn("parts", F.ceil(F.col("_kinds") / fits).cast("long"))
    need = stand.groupBy("row").agg(F.collect_list(F.struct("digit", "parts", "first", "last")).alias("r"))
    cut = keep_table(_cut(need.hint("shuffle_hash").join(rows, "row"), window, key), "words")
    total = cut.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    return whole.unionByName(_search(cut, int(total // shard_words) + 1, window))


def earlier_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, text, runs) for every row: ``runs`` are runs (first, last) of windows of ``window`` words, by number of
    their first word, that also start in a document with a smaller id; null where none is.

    Null is the empty text; shorter texts have no window; rows with a null id take no part and keep their words; rows
    with one id are one document, so they never count as smaller than each other; other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", row_number_of(run_key(), F.col("doc_id").cast("string"), F.col("text")))
    found = earlier_runs(rows.filter(F.col("doc_id").isNotNull()), window, **options)
    spans = found.groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return rows.join(spans.hint("shuffle_hash"), F.col("row") == F.col("_row"), "left").select("doc_id", "text", "runs")


def _kept(words: list[bytes], runs, window: int) -> list[bytes]:
    if runs is None:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        cover[r["first"]] += 1
        cover[r["last"] + window] -= 1
    gone = np.cumsum(cover)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of every row; ``kept`` has the kept words joined by one space."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc, body, runs in zip(pdf["doc_id"], pdf["text"], pdf["runs"]):
                words = body.encode("utf-8", "surrogatepass").split()
                kept = _kept(words, runs, window)
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), joined.decode("utf-8", "replace"), hashlib.sha256(joined).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return earlier_spans(docs, key, text, window, **options).mapInPandas(
        run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
