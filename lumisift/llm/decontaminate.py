"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 10
# characters of normalised windows that one automaton may hold; a larger benchmark is cut into blocks of that size
AUTOMATON_CHARS = 32 << 20

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def normalise(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def windows_of(words: list[bytes], width: int) -> set[bytes]:
    """Windows of an item; an item with fewer words, but not none, is one window."""
    if not words:
        return set()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def _benchmark_blocks(benchmark: DataFrame, item: str, text: str, width: int, limit: int):
    """Lists of (item_id, windows), one at least; each holds a bounded number of characters. The id may be null."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter(
        F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # each word is part of up to ``width`` windows; items spread by hash, so a block holds about its share
    blocks = max(1, -(-2 * total * width // limit))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = [(r.item, sorted(windows_of(normalise(r.text), width))) for r in part.toLocalIterator()]
        yield [(i, w) for i, w in rows if w]


def _automaton(rows):
    import ahocorasick

    owners: dict[bytes, list[int]] = {}
    for n, (_, windows) in enumerate(rows):
        for w in windows:
            owners.setdefault(w, []).append(n)
    machine = ahocorasick.Automaton()
    for w, who in owners.items():
        # one character per byte: the text is scanned as bytes, so offsets map back without a second decoding
        machine.add_word(" " + w.decode("latin-1") + " ", (w.count(b" ") + 1, tuple(who)))
    if owners:
        machine.make_automaton()
    return machine, bool(owners)


def _scan(words: list[bytes], machine) -> tuple[np.ndarray, set[int]]:
    """(mask of hit words, numbers of the items met)."""
    hit = np.zeros(len(words) + 1, np.int64)
    met: set[int] = set()
    if not words:
        return hit[:0] > 0, met
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    spaces = None
    for end, (size, who) in machine.iter(line):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        last = int(np.searchsorted(spaces, end))  # the space that closes word last - 1
        hit[last - size] += 1
        hit[last] -= 1
        met.update(who)
    return np.cumsum(hit)[:-1] > 0, met


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _byte_spans(text: str, runs: list[tuple[int, int]]) -> list[list[int]]:
    """Word runs as (start, end) byte offsets in the UTF-8 form of the original text."""
    if not runs:
        return []
    raw = np.frombuffer(text.encode("utf-8", "replace").translate(_FOLD), np.uint8)
    edge = np.diff(np.concatenate([[0], (raw != 0x20).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [[int(start[a]), int(end[b - 1])] for a, b in runs]


_OUT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<long>>"


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = WINDOW, automaton_chars: int = AUTOMATON_CHARS,
) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted as strings), spans (byte offsets of hit runs).

    Every text is scanned once per automaton; a benchmark within ``automaton_chars`` needs one automaton. With more,
    each row carries its hit words and items from one to the next, so the result does not depend on their number. Null
    and empty texts have no words; items without words have no windows; an empty benchmark hits nothing; an item is
    listed once however many rows have its id; windows of items with a null id hit and are not listed; repeated
    documents and null ids keep one row per row. Other columns are ignored.
    """
    small_batches(docs)
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = [spark.sparkContext.broadcast(r) for r in _benchmark_blocks(benchmark, item, item_text, width, automaton_chars)]
    # runs of hit words as start, end, start, end ...
    found = narrow.withColumn("runs", F.array().cast("array<long>")).withColumn("items", F.array().cast("array<string>"))
    for number, shared in enumerate(parts, 1):
        last = number == len(parts)

        def scan(batches, shared=shared, last=last):
            items = shared.value
            machine, any_window = _automaton(items)
            for pdf in batches:
                out = []
                for doc, body, before, names in zip(pdf["doc_id"], pdf["text"], pdf["runs"], pdf["items"]):
                    words = normalise(body)
                    mask, met = _scan(words, machine) if any_window else (np.zeros(len(words), bool), set())
                    for a, b in zip(before[::2], before[1::2]):
                        mask[a:b] = True
                    runs = _runs(mask)
                    names = sorted({*names, *(items[n][0] for n in met if items[n][0] is not None)})
                    if last:
                        out.append((doc, len(words), int(mask.sum()), names, _byte_spans(body, runs)))
                    else:
                        out.append((doc, body, [x for r in runs for x in r], names))
                frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_hit", "items", "spans"] if last else ["doc_id", "text", "runs", "items"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

        found = found.mapInPandas(scan, _OUT if last else found.schema)
    return found


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WINDOW, automaton_chars: int = AUTOMATON_CHARS,
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay. One pass over the rows per automaton,
    no shuffle."""
    small_batches(docs)
    for rows in _benchmark_blocks(benchmark, item, item_text, width, automaton_chars):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            import pyarrow as pa

            machine, any_window = _automaton(shared.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([not (any_window and _scan(normalise(t), machine)[1]) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
