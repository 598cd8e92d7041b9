"""Exact token counts of whole texts; huge texts are encoded in overlapping chunks that meet at proven boundaries."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches

CHUNK = 1 << 15
OVERLAP = 1 << 9
# a boundary this close to the end of a cut chunk is not proven: a special string may still begin before it
MARGIN = 64
# a blank between characters that are no white space (U+180E was one once) begins a word of the byte-level pattern
PIECE = re.compile("(?<=[^\\s\u180e])(?= [^\\s\u180e])")
# a blank or line feed beside other white space, or the cutting mark itself: such texts are cut by PIECE, all others in
# front of every blank, around every line feed, and between letters whose class never changed and
# the marks behind them
_WHITE = "\\s\\p{Z}\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{180e}"
UNEVEN = f"(?s)[{_WHITE}][ \n]|[ \n][{_WHITE}]|\\x00"
_LETTER, _MARK = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", "[.,;:!?%$&*#]"
# texts counted at once, in bytes
COUNT_BYTES = 8 << 20
# pieces whose counts a task remembers, and their longest length
PIECES, PIECE_CHARS = 1 << 20, 48


def _load(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _boundaries(encoding, tokens_from: int, low: int, high: int) -> list[tuple[int, int]]:
    """(offset, tokens before it) at each word start between low and high (character offsets of the chunk)."""
    out = []
    words, offsets = encoding.word_ids, encoding.offsets
    for i in range(len(words)):
        start = offsets[i][0]
        if start > high:
            break
        if start >= low and (i == 0 or words[i] != words[i - 1]):
            # a character split over tokens would share its start; a word start never does
            if i == 0 or offsets[i - 1][1] <= start:
                out.append((start, i + tokens_from))
    return out


def _cuts_at_blanks(path: str) -> bool:
    """Whether pieces of ``PIECE`` have as many tokens as the text they make up: byte-level pattern, no normaliser, no
    added token with a blank or with rules for its surroundings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        and before.get("use_regex", True) and model["type"] == "BPE" and not model.get("dropout")
        and all(not re.search(r"\s", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"])
                for t in spec.get("added_tokens") or [])
    )


class _Pieces:
    """Tokens of texts as the sum over their pieces; each different short piece is encoded once while remembered."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, {}
        # added tokens are found before words are cut
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.marks = not any(re.search(_LETTER + _MARK, t) for t in added)

    def _of(self, pieces: list[str]) -> list[int]:
        """Tokens of different pieces."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if not new:
            return list(map(known.__getitem__, pieces))
        if len(known) + len(new) > PIECES:
            self.known = known = {p: known[p] for p in pieces if p in known}
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        out = list(map(known.__getitem__, pieces))
        for p in new:
            if len(p) > PIECE_CHARS:
                del known[p]
        return out

    def cut(self, texts: list[str]) -> list[int]:
        """Counts of any texts, cut by PIECE."""
        cut = [PIECE.split(t) for t in texts]
        pieces = list({p for parts in cut for p in parts})
        known = dict(zip(pieces, self._of(pieces)))
        return [sum(map(known.__getitem__, parts)) for parts in cut]

    def count(self, texts) -> np.ndarray:
        """Counts of an Arrow array of texts. Pieces are coded by number in Arrow, so each different one is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.zeros(len(texts), np.int64)
        uneven = np.asarray(pc.match_substring_regex(texts, UNEVEN))
        if uneven.any():
            out[uneven] = self.cut(texts.filter(pa.array(uneven)).to_pylist())
        even = texts.filter(pa.array(~uneven))
        if not len(even):
            return out
        marked = pc.replace_substring(pc.replace_substring(even, " ", "\0 "), "\n", "\0\n\0")
        if self.marks:
            marked = pc.replace_substring_regex(marked, f"({_LETTER})({_MARK})", "\\1\0\\2")
        lists = pc.split_pattern(marked, "\0")
        start = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        tokens = np.array(self._of(words.dictionary.to_pylist()), np.int64)
        out[~uneven] = np.add.reduceat(tokens[words.indices.to_numpy()], start[:-1] - start[0])
        return out


# starts of pieces that a chunk reports in an overlap; its neighbour sees the same ones, but for one at its very start
SEAMS = 8


def _seams(text: str, low: int, high: int) -> list[int]:
    """The first starts of pieces from low to high."""
    out = []
    for m in PIECE.finditer(text, low, min(len(text), high + 3)):
        if m.start() > high or len(out) == SEAMS:
            break
        out.append(m.start())
    return out


def _count_chunks(pieces: _Pieces, rows: list) -> list:
    """(row, at, last, n, head, tail) of chunks (row, at, overlap, last, text, chunk), from starts of pieces alone."""
    import pyarrow as pa

    cuts, parts = [], []
    for _, at, overlap, last, text, chunk in rows:
        head = _seams(text, 0, overlap) if at else []
        tail = [] if last else [x for x in _seams(text, chunk, len(text) - MARGIN) if not head or x > head[-1]]
        edges = [0, *head, *tail, len(text)]
        cuts.append((head, tail))
        parts += [text[a:b] for a, b in zip(edges, edges[1:])]
    counts, out, i = pieces.count(pa.array(parts, pa.string())), [], 0
    for (row, at, _, last, _, _), (head, tail) in zip(rows, cuts):
        size = len(head) + len(tail) + 1
        before = np.cumsum(counts[i:i + size]).tolist()
        marks = [list(x) for x in zip([*head, *tail], before)]
        out.append((row, at, last, before[-1], marks[:len(head)], marks[len(head):]))
        i += size
    return out


def _chunks(wide: DataFrame, path: str, chunk: int, by_piece: bool) -> DataFrame:
    """(row, k, n, head, tail) for each chunk; head and tail are the word starts in the overlaps, with the tokens
    before each. With ``by_piece`` only the starts of pieces, which the characters beside them prove."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chars") - 1, F.lit(chunk).cast("long"))).alias("at")
    pieces = wide.select("row", "chars", "overlap", "text", starts).select(
        "row", "at", "overlap", (F.col("at") + chunk + F.col("overlap") >= F.col("chars")).alias("last"),
        F.expr(f"substring(text, int(at) + 1, int({chunk} + overlap))").alias("text"),
    ).repartition("row", "at")

    def encode(batches):
        tokenizer = _load(path)
        pieces = _Pieces(tokenizer)
        for pdf in batches:
            out = []
            if by_piece:
                rows = [(*r, chunk) for r in pdf[["row", "at", "overlap", "last", "text"]].itertuples(index=False)]
                for i in range(0, len(rows), 128):
                    out += _count_chunks(pieces, rows[i:i + 128])
                yield pd.DataFrame(out, columns=["row", "at", "last", "n", "head", "tail"])
                continue
            for row, at, overlap, last, text in pdf[["row", "at", "overlap", "last", "text"]].itertuples(index=False):
                e = tokenizer.encode(text, add_special_tokens=False)
                head = _boundaries(e, 0, 0, overlap) if at else []
                high = len(text) - MARGIN
                tail = [] if last else _boundaries(e, 0, chunk, high)
                out.append((row, at, last, len(e.ids), [list(x) for x in head], [list(x) for x in tail]))
            yield pd.DataFrame(out, columns=["row", "at", "last", "n", "head", "tail"])

    return pieces.mapInPandas(
        encode, "row long, at long, last boolean, n long, head array<array<long>>, tail array<array<long>>")


def _splice(chunks: DataFrame, chunk: int) -> DataFrame:
    """(row, n): tokens between the boundaries on which neighbours agree; null where some neighbours do not agree.

    Both sides of such a boundary are proven. The left chunk is right up to it by induction, because a word end is
    fixed by the text up to one character past it. The right chunk is right from there on, because the pattern looks
    at nothing before a word start. Chunks after the first ``last`` one lie inside it and are dropped.
    """
    w = chunks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "last", "n", "head", "tail"))).alias("c"))

    def splice(batches):
        for pdf in batches:
            out = []
            for row, parts in zip(pdf["row"], pdf["c"]):
                total, start = 0, 0
                for i, left in enumerate(parts):
                    if left["last"]:
                        total += left["n"] - start
                        break
                    right = dict((int(a), int(b)) for a, b in parts[i + 1]["head"])
                    meet = [(int(b), right[int(a) - chunk]) for a, b in left["tail"] if int(a) - chunk in right and int(b) >= start]
                    if not meet:
                        total = None
                        break
                    total += meet[0][0] - start
                    start = meet[0][1]
                out.append((row, total))
            frame = pd.DataFrame(out, columns=["row", "n"])
            frame["n"] = frame["n"].astype("Int64")
            yield frame

    return w.mapInPandas(splice, "row long, n long")


def token_counts(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
    by_piece: bool = True,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the tokenizer file's library counts the whole text.

    Texts of up to ``chunk`` characters are encoded at once. Longer ones are cut into chunks that overlap; where two
    neighbours share no proven boundary, the overlap of that text doubles until it covers the text. Null is the empty
    text, with no tokens; repeated rows stay; other columns are ignored. The path must exist on every executor.
    ``by_piece`` counts a short text as the sum of its blank-separated pieces where the tokenizer file allows that (else,
    or when it is off, as a whole); the counts are the same, with less work where words repeat.
    """
    by_piece = by_piece and _cuts_at_blanks(tokenizer_path)
    small_batches(docs)
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    length = F.length("text").cast("long")

    def count(batches):
        import pyarrow as pa

        tokenizer = _load(tokenizer_path)
        pieces = _Pieces(tokenizer)

        def counted(some):
            ids, sizes, texts = (pa.concat_arrays([b.column(c) for b in some]) for c in ("doc_id", "n_bytes", "text"))
            if by_piece:
                n = pieces.count(texts)
            else:
                n = [len(e) for i in range(0, len(texts), 256) for e in tokenizer.encode_batch_fast(
                    texts.slice(i, 256).to_pylist(), add_special_tokens=False)]
            return pa.RecordBatch.from_arrays([ids, sizes, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        some, held = [], 0
        for batch in batches:
            some.append(batch)
            held += batch.column("text").nbytes
            if held >= COUNT_BYTES:
                yield counted(some)
                some, held = [], 0
        if some:
            yield counted(some)

    sized = narrow.withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = "doc_id long, n_bytes long, n_tokens long"
    small = sized.filter(length <= chunk).mapInArrow(count, schema)
    # the id of a huge text's row; a reliable copy, because the number must not change when a task runs again
    huge = sized.filter(length > chunk).withColumn("chars", length)
    huge = keep(huge.withColumn("row", F.monotonically_increasing_id()))
    result, wide, quick = small, overlap, by_piece
    open_ = huge.withColumn("overlap", F.lit(wide).cast("long"))
    longest = huge.agg(F.max("chars")).first()[0]
    while longest is not None:
        counted = keep(_splice(_chunks(open_, tokenizer_path, chunk, quick), chunk))
        done = counted.filter(F.col("n").isNotNull())
        result = result.unionByName(
            huge.select("row", "doc_id", "n_bytes").join(done, "row").select("doc_id", "n_bytes", F.col("n").alias("n_tokens")))
        left = counted.filter(F.col("n").isNull()).select("row")
        if left.isEmpty() or not quick and wide >= longest:
            break
        # starts of pieces were not enough somewhere: all word starts, then wider overlaps
        wide, quick = (wide, False) if quick else (wide * 2, False)
        open_ = huge.join(left, "row", "left_semi").withColumn("overlap", F.lit(wide).cast("long"))
    return result
