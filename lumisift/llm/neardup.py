"""Near-duplicate documents: MinHash bands find candidates, odd sketches verify them, full shingle sets confirm them.

Documents with equal sets are one node from the start. A band bucket of two is a pair; buckets with equal members count
once. In larger buckets each member proposes its nearest members by odd sketch, and all meet the smallest id, so a
group of thousands of copies gives links in proportion to its size. Then every pair of a bucket that passes the sketch
and lies in two components is compared on full sets, once: no link between different components is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import WordDigests, free_name, gram_hashes, join_counted, keep, keep_table, mix, run_key, small_batches

SHINGLE = 5
PERCENT = 80
MISS = 1e-9  # chance that a pair at the threshold shares no band
MAX_HASHES = 300
SKETCH_BITS = 1024
# seven standard deviations of the similarity that a sketch of some 260 samples estimates near 0.8
SKETCH_MARGIN = 0.16
CHUNK = 1024  # members of a bucket that one task compares with as many others
NEAREST, STAR = 4, 64


def band_plan(percent: int) -> tuple[int, int]:
    """(rows, bands): the most rows per band for which few enough hashes reach the miss rate at the threshold."""
    s = percent / 100
    for rows in range(12, 0, -1):
        bands = 1 if s >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-(s ** rows))))
        if rows * bands <= MAX_HASHES:
            return rows, bands
    return 1, MAX_HASHES


def shingles(digests: WordDigests, text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles as 64-bit numbers, ascending: runs of ``size`` words, A-Z lower-cased; fewer words are one.

    Words are keyed digests, so two shingles share a number by chance only, about 2^-60 for a pair.
    """
    words = digests.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(words):
        return words
    if len(words) < size:
        return mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(words, size))


class MinHasher:
    """Minima of ``count`` hash functions over a set, their band keys and their odd sketch."""

    def __init__(self, rows: int, bands: int):
        rng = np.random.default_rng(11)
        self.rows, self.bands, count = rows, bands, rows * bands
        self.flip = rng.integers(0, 1 << 32, count, dtype=np.uint32)
        self.times = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.index = mix(np.arange(1, count + 1, dtype=np.uint64))

    def minima(self, values: np.ndarray) -> np.ndarray:
        folded = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
        low = None
        for at in range(0, len(folded), 1024):
            part = ((folded[at:at + 1024, None] ^ self.flip) * self.times).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        grid = minima.astype(np.uint64).reshape(self.bands, self.rows)
        out = self.index[:self.bands].copy()
        for i in range(self.rows):
            out = mix(out ^ (grid[:, i] + np.uint64(i)))
        return out

    def sketch(self, minima: np.ndarray) -> np.ndarray:
        """Parity of the samples (function, minimum) that fall on each of SKETCH_BITS places."""
        place = (mix(self.index ^ minima.astype(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        parity = (np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.uint8)
        return np.packbits(parity, bitorder="little").view(np.uint64)


def estimate(differing_bits, samples: int):
    """Similarity that an XOR population count stands for: equal samples cancel, each other one flips two places."""
    flips = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * np.asarray(differing_bits) / SKETCH_BITS, 1e-9))
    return 1 - flips / (2 * samples)


def most_bits(percent: int, samples: int) -> int:
    """The largest XOR population count that a pair at the threshold may have."""
    least = max(0.05, percent / 100 - SKETCH_MARGIN)
    bits = np.arange(SKETCH_BITS // 2)
    return int(bits[estimate(bits, samples) >= least].max())


def _signatures(docs: DataFrame, rows: int, bands: int, key: bytes) -> DataFrame:
    def run(batches):
        hasher, minhasher = WordDigests(key), MinHasher(rows, bands)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                found = shingles(hasher, text)
                if not len(found):
                    out.append((doc, 0, 0, 0, None, None))
                    continue
                low = minhasher.minima(found)
                # two order-free digests of the set
                one, two = mix(found).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found ^ np.uint64(0x5851F42D4C957F2D)))
                out.append((doc, len(found), one.view(np.int64), two.view(np.int64),
                            minhasher.keys(low).view(np.int64), minhasher.sketch(low).view(np.int64)))
                if len(out) == 2048:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    def frame(out):
        pdf = pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2", "bands", "sketch"])
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf

    return docs.mapInPandas(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        hasher = WordDigests(key)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at:at + 512]
                yield pd.DataFrame({"doc_id": part["doc_id"], "set": [shingles(hasher, t).tobytes() for t in part["text"]]})

    return docs.mapInPandas(run, "doc_id long, set binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))

    def run(batches):
        for pdf in batches:
            good = []
            for x, y in zip(pdf["sa"], pdf["sb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[good, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def _units(members: DataFrame) -> DataFrame:
    """Members with the unit of work they take part in. A bucket of up to CHUNK members is one unit; a larger one is cut
    into chunks, and each pair of chunks is a unit, in which only members of different ``side`` meet."""
    units = members.withColumn("_c", F.ceil(F.col("size") / CHUNK).cast("long"))
    units = units.withColumn("_k", F.pmod(F.xxhash64("doc"), F.col("_c")))
    units = units.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    return units.withColumn("unit", F.xxhash64("h", F.least("_k", "_j"), F.greatest("_k", "_j"))).withColumn(
        "side", F.when(F.col("_k") == F.col("_j"), 0).when(F.col("_k") < F.col("_j"), 1).otherwise(2))


def _by_task(units: DataFrame, rows: int) -> DataFrame:
    """Many units share a group, so that small buckets don't cost a group each."""
    return units.withColumn("_task", F.pmod("unit", F.lit(max(1, units.count() // rows)))).groupBy("_task")


def _each_unit(pdf: pd.DataFrame):
    """Column arrays of each unit, members by document."""
    pdf = pdf.iloc[np.lexsort((pdf["doc"].to_numpy(), pdf["unit"].to_numpy()))]
    unit = pdf["unit"].to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
    for s, e in zip(edges[:-1], edges[1:]):
        yield pdf.iloc[s:e]


def _sketches(part: pd.DataFrame) -> np.ndarray:
    return np.array(part["sketch"].tolist(), np.int64).reshape(len(part), -1).view(np.uint64)


def _passing(i: int, sketch, n, side, limit: int, percent: int) -> np.ndarray:
    """Which members may be similar to member i, by size, sketch and side."""
    far = np.bitwise_count(sketch ^ sketch[i]).sum(axis=1, dtype=np.int64)
    ok = (far <= limit) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
    if side[i]:
        ok &= side != side[i]
    ok[i] = False
    return np.where(ok, far, -1)


def _propose(members: DataFrame, limit: int, percent: int) -> DataFrame:
    """(a, b) from buckets of three and more: each member with its NEAREST others by sketch, and all with the smallest
    document of the bucket; in buckets beyond STAR members the latter only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = [], []
        for part in _each_unit(pdf):
            doc, n, side = (part[c].to_numpy() for c in ("doc", "n", "side"))
            sketch, low = _sketches(part), int(part["lo"].iloc[0])
            for i in np.flatnonzero(doc == low) if len(part) > STAR else range(len(part)):
                far = _passing(i, sketch, n, side, limit, percent)
                ok = np.flatnonzero(far >= 0)
                if doc[i] != low and len(ok) > NEAREST:
                    ok = ok[np.lexsort((doc[ok], far[ok]))[:NEAREST]]
                left.append(np.minimum(doc[ok], doc[i]))
                right.append(np.maximum(doc[ok], doc[i]))
        return pd.DataFrame({"a": np.concatenate(left) if left else [], "b": np.concatenate(right) if right else []}, dtype="int64")

    units = _units(members).select("unit", "side", "doc", "n", "lo", "sketch")
    return _by_task(units, 20_000).applyInPandas(run, "a long, b long").distinct()


def _asking(comp: np.ndarray) -> np.ndarray:
    """Members outside the largest component of a unit; each pair of two components has one of them."""
    names, counts = np.unique(comp, return_counts=True)
    return np.flatnonzero(comp != names[counts.argmax()])


def _undecided(members: DataFrame, limit: int, percent: int) -> DataFrame:
    """(unit, side, doc, comp) of the members that some member of another component may match."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in _each_unit(pdf):
            n, side, comp = (part[c].to_numpy() for c in ("n", "side", "comp"))
            sketch, open_ = _sketches(part), np.zeros(len(part), bool)
            for i in _asking(comp):
                ok = (_passing(i, sketch, n, side, limit, percent) >= 0) & (comp != comp[i])
                if ok.any():
                    open_ |= ok
                    open_[i] = True
            out.append(part.loc[open_, ["unit", "side", "doc", "comp"]])
        return pd.concat(out) if out else pdf.iloc[:0][["unit", "side", "doc", "comp"]]

    units = _units(members).select("unit", "side", "doc", "n", "comp", "sketch")
    return _by_task(units, 20_000).applyInPandas(run, "unit long, side int, doc long, comp long")


def _links_inside(undecided: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components, from the full sets of the members of each unit; one link for each
    member and other component is enough for the components, so a unit never gives all its pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = [], []
        for part in _each_unit(pdf):
            doc, side, comp = (part[c].to_numpy() for c in ("doc", "side", "comp"))
            own = [np.frombuffer(x, np.uint64) for x in part["set"]]
            size = np.array([len(x) for x in own])
            every, begin = np.concatenate(own), np.cumsum(size) - size
            asks = _asking(comp)
            for at in range(0, len(asks), 32):
                some = asks[at:at + 32]
                # which of the asking members' shingles each shingle of the unit is
                vocabulary = np.unique(np.concatenate([own[i] for i in some]))
                place = np.minimum(np.searchsorted(vocabulary, every), len(vocabulary) - 1)
                known = vocabulary[place] == every
                for i in some:
                    mine = np.zeros(len(vocabulary), bool)
                    mine[np.searchsorted(vocabulary, own[i])] = True
                    both = np.add.reduceat((mine[place] & known).astype(np.int64), begin)
                    ok = (comp != comp[i]) & (100 * both >= percent * (size + size[i] - both))
                    if side[i]:
                        ok &= side != side[i]
                    met = np.flatnonzero(ok)
                    met = met[np.unique(comp[met], return_index=True)[1]]
                    left.append(np.minimum(doc[met], doc[i]))
                    right.append(np.maximum(doc[met], doc[i]))
        return pd.DataFrame({"a": np.concatenate(left) if left else [], "b": np.concatenate(right) if right else []}, dtype="int64")

    held = sets.select(F.col("doc_id").alias("doc"), "set")
    tasks = max(1, undecided.count() // 2_000)
    units = undecided.join(held, "doc").withColumn("_task", F.pmod("unit", F.lit(tasks)))
    return units.groupBy("_task").applyInPandas(run, "a long, b long").distinct()


def _buckets(banded: DataFrame) -> DataFrame:
    """(size, lo, hi, h) of the buckets of two and more rows; of those with equal members, one.

    Members are compared by the sums of the halves of their hashes: unlike XOR, a sum does not lose a member that
    occurs twice.
    """
    member = F.xxhash64("doc_id")
    every = banded.groupBy("h").agg(
        F.count("*").alias("size"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        F.sum(member.bitwiseAND(F.lit(0xFFFFFFFF))).alias("x"), F.sum(F.shiftrightunsigned(member, 32)).alias("y"),
    ).filter("size > 1")
    return every.groupBy("size", "lo", "hi", "x", "y").agg(F.min("h").alias("h")).drop("x", "y")


def _in_open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` of the buckets that hold more than one component; the others are done. ``found`` has _id, component."""
    comp = F.coalesce("component", "doc")
    mixed = members.select("h", "doc").join(found, F.col("doc") == F.col("_id"), "left").groupBy("h").agg(
        F.min(comp).alias("_lo"), F.max(comp).alias("_hi"), F.count("*").alias("_rows")).filter("_lo < _hi").select(
        F.col("h").alias("_h"), "_rows")
    return join_counted(members, mixed, {"h": "_h"}, "_rows").select(*members.columns)


def near_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two documents are linked if 100 * intersection >= percent * union of their distinct five-word shingles (A-Z
    lower-cased; fewer words are one shingle); the component is the smallest doc_id reachable. Null and empty texts
    have no shingle and no link. Rows with a null id take no part: their component is null. Repeated rows share a
    component; other columns are ignored. A pair at the threshold stays unseen with a chance of about MISS.
    """
    small_batches(docs)
    rows, bands = band_plan(percent)
    limit = most_bits(percent, rows * bands)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    secret = run_key()
    sig = keep_table(_signatures(plain, rows, bands, secret), "signatures")
    some = sig.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    kinds = keep_table(some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "kinds")
    reps = some.join(kinds.select("k1", "k2", "n", F.col("rep").alias("doc_id")), ["k1", "k2", "n", "doc_id"], "left_semi")
    banded = reps.select("doc_id", F.explode("bands").alias("h"))
    buckets = keep_table(_buckets(banded), "buckets")
    ready = reps.select("doc_id", "n", "sketch")
    a = ready.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("wa"))
    b = ready.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("wb"))
    far = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    twos = buckets.filter("size = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).join(a, "a").join(b, "b").filter(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (far <= limit)).select("a", "b")
    crowd = buckets.filter("size > 2").select(F.col("h").alias("_h"), "size", "lo")
    members = banded.join(crowd, F.col("h") == F.col("_h")).select("h", "size", "lo", F.col("doc_id").alias("doc"))
    members = keep_table(members.join(ready.withColumnRenamed("doc_id", "doc"), "doc"), "members")
    pairs = keep_table(_propose(members, limit, percent).unionByName(twos).distinct(), "pairs")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = ids.select(F.col("id").alias("_d")).distinct().hint("shuffle_hash")
        return keep_table(_sets(plain.join(wanted, F.col("doc_id") == F.col("_d"), "left_semi").distinct(), secret), "sets")

    # any document of the pairs and of buckets of three and more may be asked for
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(
        members.select(F.col("doc").alias("id")))
    sets = sets_of(ids)
    edges = keep(_confirm(pairs, sets, percent).distinct())
    found = connected_components(edges, "a", "b").select(F.col("id").alias("_id"), "component")
    state = keep_table(_in_open_buckets(members, found).join(found, F.col("doc") == F.col("_id"), "left").select(
        "h", "size", "doc", "n", "sketch", F.coalesce("component", "doc").alias("comp")), "state")
    undecided = keep_table(_undecided(state, limit, percent), "undecided")
    more = _links_inside(undecided, sets, percent)
    found = connected_components(edges.unionByName(more), "a", "b").select(F.col("id").alias("_id"), "component")
    roots = kinds.join(found, F.col("rep") == F.col("_id"), "left").select(
        "k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    return sig.select("doc_id", "n", "k1", "k2").join(roots, ["k1", "k2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; rows with a null id stay."""
    name = free_name(docs, "_gone")
    gone = near_components(docs, key, text, percent).filter(F.col("component_id") < F.col("doc_id")).select(
        F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(key).cast("long") == F.col(name), "left_anti")
