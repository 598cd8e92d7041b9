"""Language identification: n-gram presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPECTRUM = (1, 2, 3)
BITS = 16
# documented bounds of what the driver sees: labelled rows per language and in all. Of each it sees the set of n-grams,
# at most 2^BITS bits however long the text is
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 600, 6_000
LANDMARKS = 240
RIDGE = 1e-2
# slope of the logistic curve that turns the lead of the best language into a score
SLOPE = 6.0


def present(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct hashed n-grams of a text, lower-case, for every n of the spectrum; what is not a letter is a blank and
    runs of blanks are one.

    Texts are read in blocks that overlap by the longest n-gram, so memory stays bounded for long ones.
    """
    seen = np.zeros(1 << bits, bool)
    step, tail = 1 << 18, max(SPECTRUM) - 1
    for at in range(0, max(len(text), 1), step):
        part = text[at:at + step + tail].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        # below 128 only a-z are letters; every character above counts as one
        letter = (code >= 128) | ((code >= 97) & (code <= 122))
        code = np.where(letter, code, 32).astype(np.uint64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        code = code[keep]
        for n in SPECTRUM:
            if len(code) < n:
                break
            mixed = np.full(len(code) - n + 1, n, np.uint64)
            for i in range(n):
                mixed = (mixed ^ code[i:len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            seen[(mixed >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """``landmarks``: presence rows; ``weights``: landmark coefficients per language; ``folded`` is their product, so a
    batch is scored by one matrix product: kernel(x, landmarks) @ weights = presence(x) @ folded / norm(x)."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    folded: np.ndarray
    bits: int


def _rows(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), 1 << bits), np.float32)
    for i, s in enumerate(sets):
        out[i, s] = 1
    return out


def _presence(texts: list[str], bits: int) -> np.ndarray:
    return _rows([present(t, bits) for t in texts], bits)


def _packed(places: np.ndarray) -> bytes:
    """Places below 2^16 as numbers of two bytes, or as bits where that is shorter."""
    if len(places) < 1 << 12:
        return b"n" + places.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, bool)
    bits[places] = True
    return b"b" + np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"n":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt(rows.sum(axis=1, keepdims=True)), 1)


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, bits: int = BITS) -> Model:
    """Kernel ridge regression on the Nystroem features of the landmarks, one output (+1 or -1) per language.

    k(x, y) = shared n-grams / sqrt(n-grams of x * n-grams of y). Landmarks are drawn evenly from each language.
    Rows of a language share a weight of one, so a frequent language does not win by number.
    """
    return fit_sets([present(t, bits) for t in texts], labels, landmarks, ridge, bits)


def fit_sets(
    sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, bits: int = BITS,
) -> Model:
    """``fit`` on the n-gram sets of the texts."""
    languages = sorted(set(labels))
    by = {c: [i for i, x in enumerate(labels) if x == c] for c in languages}
    share = max(1, landmarks // max(1, len(languages)))
    chosen = [i for c in languages for i in by[c][:share]]
    base = _unit(_rows([sets[i] for i in chosen], bits))
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    dim = root.shape[1]
    gram, target = np.zeros((dim + 1, dim + 1)), np.zeros((dim + 1, len(languages)))
    for at in range(0, len(sets), 128):
        rows = _unit(_rows(sets[at:at + 128], bits))
        z = np.hstack([(rows @ base.T) @ root, np.ones((len(rows), 1))])
        y = np.array([[1.0 if x == c else -1.0 for c in languages] for x in labels[at:at + 128]])
        w = np.array([[1.0 / len(by[x])] for x in labels[at:at + 128]])
        gram += (z * w).T @ z
        target += (z * w).T @ y
    penalty = ridge * np.eye(dim + 1)
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(gram + penalty, target)
    weights = root @ beta[:-1]
    folded = np.vstack([(base.T @ weights), beta[-1:]]).astype(np.float32)
    return Model(languages, base, weights, folded, bits)


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the best language, score between 0 and 1) for a batch of texts."""
    rows = _unit(_presence(texts, model.bits))
    out = rows @ model.folded[:-1] + model.folded[-1]
    best = out.argmax(axis=1)
    top = out[np.arange(len(out)), best]
    rest = out.copy()
    rest[np.arange(len(out)), best] = -np.inf
    lead = top - rest.max(axis=1) if out.shape[1] > 1 else np.full(len(out), 9.0)
    return best, 1 / (1 + np.exp(-SLOPE * np.minimum(lead, 9.0).astype(np.float64)))


def held_out(key: Column) -> Column:
    """Whether a row's key falls in the quarter that is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", landmarks: int = LANDMARKS) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out quarter: at most SAMPLE_ROWS rows,
    SAMPLE_PER_LANGUAGE per language, drawn by a hash of the key. Their texts are read whole, on the executors; the
    driver gets the n-gram sets, whose size does not grow with the text."""
    small_batches(docs)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        ~held_out(F.col("_k")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).withColumn("draw", F.pmod(F.xxhash64("_k", F.lit("sample")), F.lit(1 << 40)))
    # a language with fewer than a few rows in the table can't be learned; the most frequent come first
    counts = sorted(((r["n"], r["lang"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "lang").limit(SAMPLE_ROWS // 4).collect()), key=lambda x: (-x[0], x[1]))
    if not counts:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros((0, 0)), np.zeros(((1 << BITS) + 1, 0), np.float32), BITS)
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(counts)))
    limit = F.lit(0).cast("double")
    for n, name in counts:
        # half as many again as wanted, so that the number drawn reaches it; the rest is cut off below
        limit = F.when(F.col("lang") == name, F.lit(min(1.0, (1.5 * each + 40) / n) * (1 << 40))).otherwise(limit)
    draws: dict[str, list[int]] = {}
    for r in rows.filter(F.col("draw") < limit).select("lang", "draw").collect():
        draws.setdefault(r["lang"], []).append(r["draw"])
    cut = F.lit(-1).cast("long")
    for name, found in draws.items():
        cut = F.when(F.col("lang") == name, F.lit(sorted(found)[:each][-1])).otherwise(cut)

    def sets(batches):
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "draw": pdf["draw"], "grams": [_packed(present(t)) for t in pdf["text"]]})

    drawn = rows.filter(F.col("draw") <= cut).select("lang", "draw", "text").mapInPandas(sets, "lang string, draw long, grams binary")
    taken: dict[str, list[np.ndarray]] = {}
    for name, _, grams in sorted((r["lang"], r["draw"], bytes(r["grams"])) for r in drawn.collect()):
        if len(taken.setdefault(name, [])) < each:
            taken[name].append(_unpacked(grams))
    labels = [c for c in sorted(taken) for _ in taken[c]]
    return fit_sets([g for c in sorted(taken) for g in taken[c]], labels, landmarks)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred and score for every row, from the text alone.

    Null texts, texts without a letter, and all texts of a model without languages are ``und`` with score 0; repeated
    rows stay.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.folded, model.bits))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        ready = _ready(shared.value)
        for pdf in batches:
            names, scores = label(ready, pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": names, "score": scores})

    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double")


def _ready(parts) -> Model:
    languages, folded, bits = parts
    return Model(languages, folded, folded, folded, bits)


def label(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(language or ``und``, score) of each text, in batches of bounded size."""
    names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
    todo = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    for at in range(0, len(todo), 64):
        part = todo[at:at + 64]
        best, value = score(model, [texts[i] for i in part])
        names[part], scores[part] = [model.languages[b] for b in best], value
    return names, scores


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und``; all columns stay. A model without languages knows none
    from the other, so it rejects only null texts and texts without a letter."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.folded, model.bits))

    def run(batches):
        import pyarrow as pa

        ready = _ready(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            known = label(ready, texts)[0] != "und" if ready.languages else [has_letter(t) for t in texts]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
