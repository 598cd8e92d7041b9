"""Connected components by star contraction, and clusters of near copies built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .similarity import hamming_pairs, similar_links
from .windows import pick_representative


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """(id, component) for every id in an edge; the component is its smallest id.

    Alternates the large-star and small-star steps (Kiveris et al., 2014). Hubs are reduced by aggregates that merge
    before the shuffle; each round is checkpointed.
    """
    ends = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter(F.col("x") != F.col("y"))
    current = cut_lineage(ends.distinct())
    before = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("_m")).select("x", F.least("x", "_m").alias("m"))
        large = (
            both.join(low, "x").filter(F.col("y") > F.col("x"))
            .select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        )
        smallest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = (
            large.join(smallest, "x").filter(F.col("y") != F.col("m"))
            .select(F.col("y").alias("x"), F.col("m").alias("y"))
        )
        current = cut_lineage(small.unionByName(smallest.select("x", F.col("m").alias("y"))).distinct())
        after = _state(current)
        if after == before:
            members = current.select(F.col("x").alias("id"), F.col("y").alias("component"))
            roots = current.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct()
            return members.unionByName(roots)
        before = after


def cluster(
    assets: DataFrame,
    visual_threshold: float | None,
    hash_threshold: int | None = 5,
    semantic_threshold: float | None = None,
    key: str = "hash",
    visual: str = "vector",
    bits: str = "dhash",
    semantic: str = "semantic_vector",
) -> DataFrame:
    """Clusters of near copies: components over hash, visual and semantic links, with one representative each.

    Rejected rows and rows without a visual vector or hash take no part. Rows outside any cluster get nulls, also
    where they held values before.
    """
    fields = ("cluster_id", "is_representative", "suppressed_by", "cluster_size")
    clean = assets.drop(*[f for f in fields if f in assets.columns])
    signal = F.lit(False)
    for name in (visual, bits):
        if name in clean.columns:
            signal |= F.col(name).isNotNull()
    eligible = clean.filter((F.coalesce(F.col("status"), F.lit("pool")) != "rejected") & signal)
    links = []
    if hash_threshold is not None and bits in clean.columns:
        links.append(hamming_pairs(eligible, key, bits, hash_threshold).select("a_id", "b_id"))
    if visual_threshold is not None and visual in clean.columns:
        links.append(similar_links(eligible, key, visual, visual_threshold))
    if semantic_threshold is not None and semantic in clean.columns:
        links.append(similar_links(eligible, key, semantic, semantic_threshold, normalize=True))
    edges = links[0]
    for part in links[1:]:
        edges = edges.unionByName(part)
    found = connected_components(edges).withColumnRenamed("id", key).withColumnRenamed("component", "cluster")
    members = eligible.select(key, "composite", "size_kb").join(found, key)
    marks = pick_representative(members, "cluster", key).select(key, *fields)
    return clean.join(marks, key, "left")


def removal_log(clusters: DataFrame, vectors: DataFrame, key: str = "hash", vec: str = "v") -> DataFrame:
    """(removed, kept, similarity) for every suppressed member."""
    from ..functions.vectors import dot

    gone = clusters.filter(F.col("suppressed_by").isNotNull()).select(
        F.col(key).alias("removed"), F.col("suppressed_by").alias("kept")
    )
    a = vectors.select(F.col(key).alias("removed"), F.col(vec).alias("_va"))
    b = vectors.select(F.col(key).alias("kept"), F.col(vec).alias("_vb"))
    return gone.join(a, "removed").join(b, "kept").select("removed", "kept", dot("_va", "_vb").alias("similarity"))
