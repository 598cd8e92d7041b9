"""Helpers shared by the training-data operators: shared folders, byte and word hashes, content-chosen anchors."""

from __future__ import annotations

import os
import uuid
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from ..session import cut_lineage, ensure_checkpoint_dir

def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder path below ``spark.checkpoint.dir``, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; see ``session.cut_lineage``."""
    return cut_lineage(df)


def keep_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Like ``keep``, as a Parquet table in the shared folder: smaller on disk for many rows."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TEXT_BATCH = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> None:
    """Let Arrow batches of the session hold at most TEXT_BATCH rows: whole texts are long, and a batch stands in memory
    several times, on both sides."""
    now = int(df.sparkSession.conf.get(_BATCH, "10000"))
    if now <= 0 or now > TEXT_BATCH:
        df.sparkSession.conf.set(_BATCH, str(TEXT_BATCH))


BROADCAST_ROWS = 50_000


def for_join(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed table of short rows, marked for broadcast where its counted rows are few, else for a hash join
    whose large side is not sorted."""
    ready = keep(narrow)
    return broadcast(ready) if ready.count() <= rows else ready.hint("shuffle_hash")


HOT_KEYS = 8192


def join_counted(rows: DataFrame, by: DataFrame, keys: dict[str, str], count: str) -> DataFrame:
    """``rows`` joined with ``by`` on ``keys`` (column of ``rows``: column of ``by``); ``by`` has each key once, with
    ``count``, the number of its rows.

    Keys with more than one part in HOT_KEYS of the rows are fewer than HOT_KEYS. They are broadcast, so their rows stay
    where they are; the rows of the others are shuffled.
    """
    known = keep_table(by, "counts")
    total = known.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) > total // HOT_KEYS
    same = [F.col(a) == F.col(b) for a, b in keys.items()]
    hot, rest = broadcast(known.filter(often)), known.filter(~often).hint("merge")
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(rest, same))


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def run_key() -> bytes:
    """Key of the digests of one run, drawn on the driver and carried to its tasks, so that repeated tasks agree and no
    text can be made to collide in advance."""
    return os.urandom(16)


def digest(key: bytes, data: bytes, at: int = 0) -> int:
    """64 bits of a keyed cryptographic digest of ``data`` and a number, as a signed integer."""
    return int.from_bytes(blake2b(data, digest_size=8, key=key, person=at.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def row_number_of(key: bytes, *parts: Column) -> Column:
    """64 bits of a salted SHA-256 of the columns: the same whenever a task runs again; different rows share one with a
    chance of 2^-64."""
    marked = [F.coalesce(F.concat(F.lit("1"), F.length(p).cast("string"), F.lit(":"), p), F.lit("0")) for p in parts]
    return F.xxhash64(F.unhex(F.sha2(F.concat(F.lit(key.hex()), *marked), 256)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordDigests(dict):
    """Keyed digest of each word; a task remembers so many."""

    LIMIT = 1 << 20

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8, key=self.key).digest(), "little")
        if len(self) < self.LIMIT:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class SpanHash:
    """Hash of any byte span of one buffer in constant time, from prefix sums of a polynomial modulo 2^64.

    Unequal spans can be built that share a hash. It may only say which strings meet, never which are equal.
    """

    def __init__(self):
        rng = np.random.default_rng(7)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) > n:
            return
        size = max(n + 1, 1 << 16)
        size = 1 << (size - 1).bit_length()
        back = pow(_BASE, -1, 1 << 64)
        for name, base in (("power", _BASE), ("inverse", back)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            setattr(self, name, np.multiply.accumulate(out))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums; element i covers the first i bytes, or the first i of an array of 64-bit hashes."""
        n = len(data)
        self._grow(n)
        out = np.zeros(n + 1, np.uint64)
        values = self.table[data] if data.dtype == np.uint8 else data
        np.cumsum(values * self.power[:n], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes start..end for arrays of positions; spans of different length get different seeds."""
        raw = (sums[end] - sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def every(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Hash of each span of this length, without the seed of ``spans``."""
        n = len(sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((sums[length:] - sums[:n]) * self.inverse[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than space and 0x09 to 0x0D."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[data], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(hasher: SpanHash, data: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word of a byte buffer."""
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    return hasher.spans(hasher.sums(data), start, end)


_ODD = np.uint64(0x9FB21C651E98DF25)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (n at least 1), order included."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for i in range(1, n):
        out *= _ODD
        out += words[i:i + count]
    return mix(out)


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    have, low = 1, keys
    while have * 2 <= width:
        low = np.minimum(low[:len(low) - have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


BLOCK = 1 << 20
_POSITION = np.uint64((1 << 22) - 1)


def anchor_runs(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): the runs of windows of ``width`` grams that share their smallest gram, leftmost on ties.

    Equal windows choose the same anchor at the same offset wherever they stand, so equal windows only ever meet
    under one gram. Works in blocks, so that memory stays bounded for long texts.
    """
    total = len(grams) - width + 1
    if total <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    found = []
    for begin in range(0, total, BLOCK):
        part = grams[begin:min(begin + BLOCK, total) + width - 1]
        keys = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        found.append((_sliding_min(keys, width) & _POSITION).astype(np.int64) + begin)
    chosen = np.concatenate(found)
    edge = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [total]]) - 1
    return chosen[first], first, last
