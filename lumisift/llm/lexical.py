"""Ranked lexical search: documents as paths of a frequency-ordered trie, searched depth first with bounds per item.

Every document is cut down to the terms that some item of the block asks for (its restricted term vector). A task keeps
its documents in shards; in each, the vectors, most frequent term first, are the paths of a trie, so documents with the
same frequent terms share nodes. A node knows the largest tf of each term and the smallest m below it. As a term's score
grows with tf and falls with m, the sum over an item's terms bounds every document below, and a subtree that cannot beat
the item's worst kept score is never entered.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_table, small_batches
from .decontaminate import normalise

TOP = 10
# UTF-8 bytes of item texts whose terms travel with the tasks at once; more items are searched block by block
BLOCK_BYTES = 2 << 20
# documents and term entries of one trie, and documents of a leaf
SHARD_DOCS, SHARD_ENTRIES, LEAF = 1 << 13, 1 << 21, 32
# m counts MIX of 100 parts by the length of the document
MIX = 75
_LAST = np.iinfo(np.int64).max


def _item_blocks(items: DataFrame, item: str, text: str, limit: int):
    """Lists of (item_id, {term: occurrences}) of items with a term; the texts of a list hold about ``limit`` bytes."""
    rows = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // limit)
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        found = [(r.item, dict(Counter(normalise(r.text)))) for r in part.toLocalIterator()]
        if found := [(i, terms) for i, terms in found if terms]:
            yield found


_VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"


def _vectors(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Restricted term vectors of the documents with a term, with the number of all their terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(
        F.length("text") > 0)

    def cut(batches):
        import pandas as pd

        place = shared.value.get
        for pdf in batches:
            out = []
            for doc, body in zip(pdf["doc_id"], pdf["text"]):
                words = normalise(body)
                if words:
                    counts = Counter(map(place, words))
                    counts.pop(None, None)
                    out.append((doc, len(words), list(counts), list(counts.values())))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "terms", "tfs"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return narrow.mapInPandas(cut, _VECTOR)


def _statistics(vectors: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents, terms of all documents, documents that hold each term of the vocabulary)."""

    def count(batches):
        import pyarrow as pa

        df, n, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n += batch.num_rows
            length += int(np.sum(batch.column("n").to_numpy(zero_copy_only=False), dtype=np.int64))
            df += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[n, length], df[at]]))], ["term", "f"])

    rows = vectors.select("n", "terms").mapInArrow(count, "term long, f long").groupBy("term").agg(F.sum("f").alias("f"))
    found = {r.term: r.f for r in rows.collect()}  # a row for each term of the block, and two
    df = np.zeros(size, np.int64)
    for term, f in found.items():
        if term >= 0:
            df[term] = f
    return found.get(-2, 0), found.get(-1, 0), df


def _lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with n terms."""
    if len(n) and MIX * int(n.max()) * documents >= 1 << 62:
        return np.array([100 - MIX + MIX * int(x) * documents // terms for x in n], np.int64)
    return 100 - MIX + MIX * n * documents // terms


def _saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // np.maximum(1000 * tf + 8 * m, 1)


class Trie:
    """The trie of one shard in flat arrays; leaves are runs of neighbouring paths."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, offsets: np.ndarray, ranks: np.ndarray, tfs: np.ndarray):
        count = len(ids)
        size = np.diff(offsets)
        owner = np.repeat(np.arange(count), size)
        order = np.lexsort((ranks, owner))  # most frequent term first
        ranks, tfs = ranks[order], tfs[order]
        raw = ranks.astype(">u4").tobytes()
        paths = [raw[4 * a:4 * b] for a, b in zip(offsets[:-1], offsets[1:])]
        line = sorted(range(count), key=paths.__getitem__)  # neighbours share prefixes
        place = np.empty(count, np.int64)
        place[line] = np.arange(count)
        self.ids, self.m = ids[line], m[line]
        self.count = count
        paths = [paths[i] for i in line]
        self._grow(paths)
        # postings by (term, place), for leaves; node maxima by (term, node), for bounds
        at = place[owner]
        by = np.lexsort((at, ranks))
        self.keys = ranks[by].astype(np.int64) * count + at[by]
        self.tfs = tfs[by].astype(np.int64)
        self._maxima(ranks[by].astype(np.int64), at[by])
        self.least_m = np.array([self.m[a:b].min() for a, b in zip(self.first, self.end)], np.int64)
        self.least_id = np.array([self.ids[a:b].min() for a, b in zip(self.first, self.end)], np.int64)

    def _grow(self, paths: list[bytes]) -> None:
        """first, end and children of each node; node 0 is the root."""
        self.first, self.end, self.children = [], [], []
        open_ = [(0, len(paths), -1)]
        while open_:
            a, b, parent = open_.pop()
            node = len(self.first)
            self.first.append(a)
            self.end.append(b)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= LEAF:
                continue
            low, high = paths[a], paths[b - 1]
            depth = next((i for i in range(0, min(len(low), len(high)), 4) if low[i:i + 4] != high[i:i + 4]), min(len(low), len(high)))
            heads = [p[depth:depth + 4] for p in paths[a:b]]
            cuts = [a] + [a + i for i in range(1, b - a) if heads[i] != heads[i - 1]] + [b]
            if len(cuts) == 2:  # equal vectors
                cuts = [*range(a, b, LEAF), b]
            start = cuts[0]
            for left, right in zip(cuts[1:], [*cuts[2:], None]):
                # small neighbours share a leaf
                if right is None or right - start > LEAF:
                    open_.append((start, left, node))
                    start = left

    def _maxima(self, terms: np.ndarray, at: np.ndarray) -> None:
        """The largest tf of each term below each node, sorted by (term, node)."""
        nodes = len(self.first)
        leaves = [i for i in range(nodes) if not self.children[i]]
        leaf_of = np.empty(self.count, np.int64)
        for i in leaves:
            leaf_of[self.first[i]:self.end[i]] = i
        parent = np.full(nodes, -1)
        for i, below in enumerate(self.children):
            parent[below] = i
        keys, best = _largest(terms * nodes + (leaf_of[at] if len(at) else at), self.tfs)
        all_keys, all_best = [keys], [best]
        while len(keys):
            term, node = np.divmod(keys, nodes)
            up = parent[node]
            keep = up >= 0
            keys, best = _largest(term[keep] * nodes + up[keep], best[keep])
            all_keys.append(keys)
            all_best.append(best)
        self.node_keys, self.node_tfs = _largest(np.concatenate(all_keys), np.concatenate(all_best))

    def _pick(self, keys: np.ndarray, tfs: np.ndarray, low: np.ndarray, high: np.ndarray):
        """(number of the term, key, tf) of the entries between low and high of each term."""
        a, b = np.searchsorted(keys, low), np.searchsorted(keys, high)
        size = b - a
        which = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(which)) + np.repeat(a - (np.cumsum(size) - size), size)
        return which, keys[at], tfs[at]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """``best``, a list of (-score, id) in order, with the documents of the shard that belong there."""
        nodes = len(self.first)
        which, keys, tfs = self._pick(self.node_keys, self.node_tfs, terms * nodes, (terms + 1) * nodes)
        node = keys - terms[which] * nodes
        bound = np.zeros(nodes, np.int64)
        np.add.at(bound, node, weights[which] * _saturated(tfs, self.least_m[node]))
        open_ = [0]
        while open_:
            i = open_.pop()
            if bound[i] <= 0 or len(best) == top and (-int(bound[i]), int(self.least_id[i])) > best[-1]:
                continue
            if self.children[i]:
                open_ += sorted(self.children[i], key=bound.__getitem__)  # the highest bound comes next
                continue
            a, b = self.first[i], self.end[i]
            which, keys, tfs = self._pick(self.keys, self.tfs, terms * self.count + a, terms * self.count + b)
            at = keys - terms[which] * self.count
            score = np.zeros(b - a, np.int64)
            np.add.at(score, at - a, weights[which] * _saturated(tfs, self.m[at]))
            floor = max(1, -best[-1][0]) if len(best) == top else 1
            good = np.flatnonzero(score >= floor)
            if len(good):
                best = sorted(best + list(zip((-score[good]).tolist(), self.ids[a:b][good].tolist())))[:top]
        return best


def _largest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, each with its largest value."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    return keys[start], np.maximum.reduceat(values, start)


def _search(vectors: DataFrame, items, vocabulary: dict[bytes, int], top: int) -> DataFrame:
    """(item_no, doc_id, score): the best documents of each task for each item."""
    documents, terms, df = _statistics(vectors, len(vocabulary))
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in df]
    asked = []
    for _, counts in items:
        place = np.array([vocabulary[t] for t in counts], np.int64)
        asked.append((rank[place], np.array([weight[p] * c for p, c in zip(place.tolist(), counts.values())], np.int64)))
    shared = vectors.sparkSession.sparkContext.broadcast((rank, asked, documents, terms))

    def search(batches):
        import pyarrow as pa

        rank, asked, documents, terms = shared.value
        best = [[] for _ in asked]

        def shard(parts):
            ids = np.concatenate([p[0] for p in parts])
            sizes = np.concatenate([p[2] for p in parts])
            trie = Trie(
                ids, _lengths(np.concatenate([p[1] for p in parts]), documents, terms),
                np.concatenate([[0], np.cumsum(sizes)]), rank[np.concatenate([p[3] for p in parts])],
                np.concatenate([p[4] for p in parts]))
            for i, (wanted, weights) in enumerate(asked):
                best[i] = trie.search(wanted, weights, best[i], top)

        parts, rows, entries = [], 0, 0
        for batch in batches:
            lists = batch.column("terms")
            parts.append((
                batch.column("doc_id").fill_null(int(_LAST)).to_numpy(zero_copy_only=False),
                batch.column("n").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()),
                lists.flatten().to_numpy(zero_copy_only=False),
                batch.column("tfs").flatten().to_numpy(zero_copy_only=False)))
            rows, entries = rows + batch.num_rows, entries + len(parts[-1][3])
            if rows >= SHARD_DOCS or entries >= SHARD_ENTRIES:
                shard(parts)
                parts, rows, entries = [], 0, 0
        if rows:
            shard(parts)
        out = [(i, doc, -score) for i, found in enumerate(best) for score, doc in found]
        doc = [None if d == _LAST else d for _, d, _ in out]
        yield pa.RecordBatch.from_arrays([
            pa.array([o[0] for o in out], pa.int64()), pa.array(doc, pa.int64()), pa.array([o[2] for o in out], pa.int64()),
        ], ["item_no", "doc_id", "score"])

    return vectors.mapInArrow(search, "item_no long, doc_id long, score long")


def ranked_documents(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item with a score above 0.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Every document counts for the number
    of documents, the term total and the document frequencies; every one is ranked. Equal scores go by ascending
    document id, null ids last. Null and empty texts have no terms; an item without terms, or whose terms occur nowhere
    or weigh nothing, has no rows. Each row of ``items`` is an item, so rows that repeat an id rank by themselves and
    repeated document rows take a rank each. Empty tables give no rows; other columns are ignored.

    Texts are read once per block of items; between tasks only ``top`` rows per item and task move.
    """
    small_batches(docs)
    spark = docs.sparkSession
    id_type = items.schema[item].dataType
    result = None
    for number, block in enumerate(_item_blocks(items, item, item_text, block_bytes)):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in block for t in counts}))}
        vectors = keep_table(_vectors(docs, key, text, vocabulary), "vectors")
        found = _search(vectors, block, vocabulary, top)
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item_no long, item_id {id_type.simpleString()}")
        # the names of one block, whose size the block bounds
        part = found.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    return result
