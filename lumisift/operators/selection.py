"""Complete selections: auto-select, quick fill, tiered refill, even spread."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Category, QualityWeights, Quiz, RankingWeights, lookup
from ..functions.names import burst_key
from ..functions.vectors import dot
from ..session import cut_lineage
from .aggregates import selection_report
from .filters import FACE_LIMITS, FACE_LIMITS_QUICK, face_distance_gate, face_limit, select_eligibility
from .greedy import Closeness, greedy_diverse, greedy_pick
from .preference import PreferenceModel
from .scoring import (
    closeness_bonus, crowding, diversity_component, duplicate_penalty, exploration_component, final_score,
    preference_component, quality_component, quality_score,
)
from .similarity import best_match, hamming_best, not_similar_to
from .windows import evenly_spaced, round_robin, top_k_per_group

# Similarity threshold of each strategy.
STRATEGIES = {"balanced": 0.85, "quality": 0.95, "diverse": 0.75}


def _limits(spark, wanted: dict[str, int], column: str) -> DataFrame:
    return spark.createDataFrame(list(wanted.items()), f"{column} string, limit int")


def auto_select(
    df: DataFrame,
    categories: Iterable[Category],
    strategy: str = "balanced",
    weights: QualityWeights = QualityWeights(),
    names_given: bool = False,
    vec: str | None = "vector",
    phash: str | None = None,
    bucket: Column | None = None,
    threshold: float | None = None,
    key: str = "hash",
    dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(catalog with new status, report): the best and sufficiently different rows of every category.

    A row without a vector is never compared by vector and may be picked.
    """
    cats = list(categories)
    wanted = {c.id: c.target for c in cats}
    ages = {c.id: c.age_days_to for c in cats if c.age_days_to is not None}
    pool = select_eligibility(df, names_given).filter(F.col("category").isin(*wanted))
    if names_given:
        upper = lookup(F.col("category"), ages, "ages") if ages else F.lit(None)
        pool = face_distance_gate(pool, upper, FACE_LIMITS)
    bonus = closeness_bonus() if names_given else F.lit(0.0)
    scored = cut_lineage(pool.withColumn("_score", quality_score(weights) + bonus))
    if strategy in ("balanced", "diverse"):
        month = F.date_format("date", "yyyy-MM") if bucket is None else bucket
        placed = round_robin(scored, month, "_score", wanted, key=key, name="_order")
        order = ["_order"]
    else:
        placed, order = scored, ["-_score"]
    close = Closeness(vec=vec, threshold=threshold or STRATEGIES[strategy], phash=phash)
    picked = greedy_pick(
        placed, order, close, max(wanted.values()), key, ["category"], _limits(df.sparkSession, wanted, "category")
    )
    picked = cut_lineage(picked.select(key, "category", "_score", "pick"))
    report = selection_report(picked, scored, cats, "pick", "_score")
    if dry_run:
        return df, report
    marks = scored.select(F.col(key), F.lit(True).alias("_pool")).join(
        picked.select(key, F.lit(True).alias("_picked")), key, "left"
    )
    status = (
        F.when(F.col("_picked"), "selected").when(F.col("_pool"), "qualified").otherwise(F.col("status"))
    )
    return df.join(marks, key, "left").withColumn("status", status).drop("_pool", "_picked"), report


def selection_context(
    candidates: DataFrame, state: DataFrame, key: str = "hash", vec: str | None = "vector",
    semantic: str | None = None, dhash: str | None = None, path: str | None = "path", exclude_same: bool = False,
) -> DataFrame:
    """Everything the diversity and duplicate scores need to know about the rows selected so far.

    Adds visual_max (> 0.75), semantic_max (> 0.90), min_bits (<= 10), burst, same_date and same_place. Each is a
    keyed aggregate joined back, so the selected set may be of any size.
    """
    out = candidates

    def attach(part: DataFrame) -> DataFrame:
        return out.join(part, key, "left")

    if vec:
        out = attach(best_match(candidates, state, key, vec, 0.75, exclude_same=exclude_same, name="visual_max"))
    else:
        out = out.withColumn("visual_max", F.lit(None).cast("double"))
    if semantic:
        out = attach(best_match(candidates, state, key, semantic, 0.90, exclude_same=exclude_same, name="semantic_max"))
    else:
        out = out.withColumn("semantic_max", F.lit(None).cast("double"))
    if dhash:
        out = attach(hamming_best(candidates, state, key, dhash, 10, exclude_same=exclude_same, name="min_bits"))
    else:
        out = out.withColumn("min_bits", F.lit(None).cast("int"))
    if path:
        out = attach(burst_near(candidates, state, key, path, exclude_same=exclude_same))
    out = out.withColumn("burst", F.coalesce(F.col("burst"), F.lit(False)) if path else F.lit(False))
    out = crowding(out, state, "date", "same_date")
    return crowding(out, state, "location", "same_place")


def burst_near(candidates: DataFrame, state: DataFrame, key: str, path: str, gap: int = 3,
               exclude_same: bool = False) -> DataFrame:
    """Keys of candidates numbered within ``gap`` of a selected row of the same folder and prefix."""
    def keyed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(F.col(key).alias(f"{prefix}id"), burst_key(path).alias("_b")).filter("_b is not null").select(
            f"{prefix}id", F.col("_b.folder").alias("_f"), F.col("_b.prefix").alias("_p"), F.col("_b.seq").alias(f"{prefix}seq")
        )

    # smallest and largest id per number are enough to find one that is not the row itself
    taken = keyed(state, "s").groupBy("_f", "_p", "sseq").agg(F.min("sid").alias("_lo"), F.max("sid").alias("_hi"))
    near = taken.withColumn("cseq", F.explode(F.sequence(F.col("sseq") - gap, F.col("sseq") + gap)))
    hits = keyed(candidates, "c").join(near, ["_f", "_p", "cseq"])
    if exclude_same:
        hits = hits.filter((F.col("_lo") != F.col("cid")) | (F.col("_hi") != F.col("cid")))
    return hits.select(F.col("cid").alias(key)).distinct().withColumn("burst", F.lit(True))


def rank_components(
    df: DataFrame, model: PreferenceModel, any_selected: bool, names_given: bool = True, quiz: Quiz = Quiz(),
    weights: RankingWeights = RankingWeights(), key: str = "hash",
) -> Column:
    """Score struct for rows that carry the columns of ``selection_context`` and the similarity columns
    like_centroid, dislike_centroid, like_max and dislike_max."""
    p = model.probability()
    preference = preference_component(
        F.col("like_centroid"), F.col("dislike_centroid"), F.col("like_max"), F.col("dislike_max"), p, names_given
    )
    diversity = diversity_component(
        F.col("visual_max"), F.col("semantic_max"), F.col("same_date"), F.col("same_place"), F.lit(any_selected)
    )
    duplicate = duplicate_penalty(F.col("burst"), F.col("min_bits"), F.col("visual_max"))
    no_face = F.col("no_face_penalty") if "no_face_penalty" in df.columns else None
    return final_score(
        preference, quality_component(quiz), diversity, exploration_component(p, key), duplicate, no_face, weights
    )


def with_preference_signals(df: DataFrame, key: str = "hash", vec: str = "vector") -> DataFrame:
    """Cosine to the liked and disliked centroids, and the largest cosine to a liked (> 0.85) or disliked (> 0.80) row."""
    from .aggregates import centroid

    rated = df.filter(F.col(vec).isNotNull())
    out = df
    for label, name, level in (("like", "like", 0.85), ("dislike", "dislike", 0.80)):
        mine = rated.filter(F.col("preference") == label)
        found = centroid(mine, [], vec).select("centroid").first()  # one vector
        middle = F.lit(list(found["centroid"])) if found and found["centroid"] else F.lit(None).cast("array<double>")
        out = out.withColumn(f"{name}_centroid", dot(vec, middle))
        near = best_match(rated, mine, key, vec, level, name=f"{name}_max")
        out = out.join(near, key, "left")
    return out


def quick_fill(
    df: DataFrame,
    categories: Iterable[Category],
    model: PreferenceModel,
    names_given: bool = False,
    manual: bool = False,
    unlimited: bool = False,
    vec: str = "vector",
    dhash: str | None = None,
    semantic: str | None = None,
    quiz: Quiz = Quiz(),
    weights: RankingWeights = RankingWeights(),
    key: str = "hash",
) -> DataFrame:
    """Fill every category up to its targets, images before videos; what is selected counts for all later steps.

    The categories form a short configured list and depend on each other, so they run one after the other; inside
    one, scoring and picking are distributed. Returns the catalog with new status and a ``picked`` flag.
    """
    base = select_eligibility(df, names_given, videos_exempt=True, manual=manual)
    base = cut_lineage(with_preference_signals(base, key, vec).withColumn("_burst", burst_key("path")))
    state: DataFrame | None = None
    picks: DataFrame | None = None
    for cat in categories:
        for media in ("image", "video"):
            target = cat.target if media == "image" else cat.video_target
            is_video = F.coalesce(F.col("media_type"), F.lit("image")) == "video"
            pool = base.filter((F.col("category") == cat.id) & (is_video if media == "video" else ~is_video))
            if names_given and not manual and media == "image":
                pool = pool.filter(F.col("face_distance") <= face_limit(F.lit(cat.age_days_to), FACE_LIMITS_QUICK))
            already = pool.filter(F.col("status") == "selected")
            state = already if state is None else state.unionByName(already)
            state = cut_lineage(state)
            have = already.count()
            room = None if unlimited else max(0, target - have)
            if room == 0:
                continue
            open_rows = pool.filter(F.col("status") != "selected")
            started = not state.isEmpty()
            context = selection_context(open_rows, state, key, vec, semantic, dhash) if started else open_rows.withColumns(
                {"visual_max": F.lit(None).cast("double"), "semantic_max": F.lit(None).cast("double"),
                 "min_bits": F.lit(None).cast("int"), "burst": F.lit(False),
                 "same_date": F.lit(0), "same_place": F.lit(0)}
            )
            scores = rank_components(context, model, started, names_given, quiz, weights, key)
            scored = context.withColumn("_breakdown", scores).withColumn("_final", F.col("_breakdown.final"))
            fresh = scored.filter(F.col("_breakdown.duplicate_penalty") < 100)
            close = Closeness(vec=vec, threshold=0.95, strict=True, dhash=dhash, burst="_burst")
            new = greedy_pick(fresh, ["-_final"], close, (1 << 62) if room is None else room, key)
            new = cut_lineage(new.select(*base.columns))
            state = state.unionByName(new)
            picks = new.select(key) if picks is None else picks.unionByName(new.select(key))
    if picks is None:
        return df.withColumn("picked", F.lit(False))
    marked = df.join(picks.withColumn("picked", F.lit(True)), key, "left")
    chosen = F.coalesce(F.col("picked"), F.lit(False))
    return marked.withColumn("status", F.when(chosen, "selected").otherwise(F.col("status"))).withColumn("picked", chosen)


def tiered_refill(
    tiers: list[DataFrame],
    chosen: DataFrame,
    needs: dict[str, int],
    threshold: float,
    order: list[str],
    key: str = "hash",
    vec: str = "v",
    category: str = "category",
    relaxed: DataFrame | None = None,
    relaxed_order: list[Column] | None = None,
    backup_size: int = 0,
) -> tuple[DataFrame, DataFrame | None]:
    """(refill, backup): fill the needs of each category from the tiers in turn, then build a backup pool.

    A row must differ from everything chosen in its category. The tier is the first sort key; ``order`` decides
    inside a tier (arrival or quality). Relaxed rows fill what is left without any similarity test. Backup rows
    must differ from the chosen rows, the refill and each other.
    """
    spark = chosen.sparkSession
    offered = None
    for i, tier in enumerate(tiers):
        part = tier.withColumn("tier", F.lit(i))
        offered = part if offered is None else offered.unionByName(part, allowMissingColumns=True)
    offered = cut_lineage(offered.join(chosen.select(key), key, "left_anti"))
    open_ = offered.filter(F.col(category).isin(*[c for c, n in needs.items() if n > 0]))
    fill = greedy_diverse(
        open_, ["tier", *order], threshold, max([1, *needs.values()]), key, vec, [category], chosen,
        _limits(spark, needs, category),
    )
    fill = cut_lineage(fill.withColumn("pass", F.lit("diverse")))
    if relaxed is not None:
        have = fill.groupBy(category).agg(F.count("*").alias("_have"))
        left = relaxed.join(chosen.select(key), key, "left_anti").join(fill.select(key), key, "left_anti")
        left = left.filter(F.col(category).isin(*needs))
        best = top_k_per_group(left, [category], relaxed_order or [F.col(key)], max(needs.values(), default=0), name="pick")
        lack = lookup(F.col(category), needs, "needs").cast("long") - F.coalesce(F.col("_have"), F.lit(0))
        extra = best.join(have, category, "left").filter(F.col("pick") <= lack).drop("_have")
        extra = extra.withColumn("pass", F.lit("relaxed")).withColumn("tier", F.lit(len(tiers)))
        fill = fill.unionByName(extra, allowMissingColumns=True)
    if not backup_size:
        return fill, None
    taken = chosen.select(key, category, vec).unionByName(fill.select(key, category, vec))
    rest = offered.join(fill.select(key), key, "left_anti")
    backup = greedy_diverse(rest, ["tier", *order], threshold, backup_size, key, vec, [category], taken)
    return fill, backup


def adaptive_even_diverse(
    candidates: DataFrame, existing: DataFrame, n: int, threshold: float, date: str, key: str = "hash",
    vec: str = "v", by: list[str] | None = None,
) -> DataFrame:
    """Rows unlike the existing ones, spread evenly over time, then without near copies among themselves."""
    by = by or []
    fresh = not_similar_to(candidates.filter(F.col(vec).isNotNull()), existing, key, vec, threshold, by)
    spread = evenly_spaced(fresh, by, [date, key], n, "slot")
    return greedy_diverse(spread, ["slot"], threshold, n, key, vec, by)
