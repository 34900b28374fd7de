"""Boost reranking, relevance floors, quotas and diverse selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions.numeric import citation_score, clamp, recency_score, region_ramp, rigor_score, rounded

# Boosts of each profile.
PROFILES = {
    "conservative": {"causal": 0.30, "foundational": 0.20, "recent": 0.15, "region": 0.30},
    "moderate": {"causal": 0.50, "foundational": 0.30, "recent": 0.20, "region": 0.60},
    "aggressive": {"causal": 0.80, "foundational": 0.50, "recent": 0.30, "region": 1.00},
}


def profile(name: str | None) -> dict[str, float]:
    """No name gives the conservative profile, an unknown one the moderate."""
    return PROFILES["conservative"] if name is None else PROFILES.get(name, PROFILES["moderate"])


def rerank_unified(rows: DataFrame, now: int, region: str | None = None, name: str | None = None, weight: Column | None = None, promoted: Column | None = None, digits: int = 6) -> DataFrame:
    """``score`` = cosine times one plus the boosts for rigour, citations, region, learned weight and promotion."""
    b = profile(name)
    cos = F.col("cosine")
    ramp = region_ramp(cos)
    boost = b["causal"] * rigor_score(F.col("sms_level")) + b["foundational"] * citation_score(F.col("citation_count"), F.col("year"), now)
    if region is not None:
        boost = boost + b["region"] * F.coalesce((F.col("region") == region).cast("double"), F.lit(0.0)) * ramp
    if weight is not None:
        boost = boost + F.coalesce(clamp(weight - 1, -0.5, 1.0), F.lit(0.0)) * ramp
    if promoted is not None:
        boost = boost + F.coalesce(promoted, F.lit(0.0)) * ramp
    return rows.withColumn("score", rounded(cos * (1 + boost), digits))


# Weights of the merged score.
MERGED = {"similarity": 0.428, "rigor": 0.157, "citation": 0.160, "recency": 0.021, "fts": 0.087, "directness": 0.147}


def rerank_merged(rows: DataFrame, now: int, digits: int = 6) -> DataFrame:
    """Weighted sum of similarity, rigour, citations (damped off topic), recency, lexical rank and directness, with a bonus for reviews."""
    similarity = clamp(F.col("cosine"), 0.0, 1.0)
    damp = 0.2 + 0.8 * similarity
    direct = F.when(F.col("cosine") >= 0.3, 1.0).when(F.col("cosine") >= 0.1, 0.7).otherwise(0.0)
    total = (
        MERGED["similarity"] * similarity
        + MERGED["rigor"] * rigor_score(F.col("sms_level"))
        + MERGED["citation"] * citation_score(F.col("citation_count"), F.col("year"), now) * damp
        + MERGED["recency"] * recency_score(F.col("year"), now)
        + MERGED["directness"] * direct
        + F.when(F.lower("title").rlike("review|meta"), 0.025).otherwise(0.0)
    )
    return rows.withColumn("score", rounded(total, digits))


# What a topicality label adds, titles that tell of a review, and the weights of single channels.
DIRECTNESS = {"direct-lac": 0.10, "direct-global": 0.07, "indirect": 0.0, "excluded": -0.15}
REVIEW_TITLE = r"(systematic|literature|meta[ -]?analy[sz]is|narrative) (review|analysis)|meta[ -]analys[ie]s|evidence synthesis|handbook of|annual review of|scoping review|umbrella review"
CHANNEL_WEIGHTS = {
    "causal": {"similarity": 0.282, "citation": 0.046, "rigor": 0.400, "recency": 0.021, "region": 0.146, "fts": 0.105},
    "foundational": {"similarity": 0.213, "citation": 0.633, "rigor": 0.080, "recency": 0.000, "region": 0.023, "fts": 0.071},
    "recent": {"similarity": 0.496, "citation": 0.217, "rigor": 0.031, "recency": 0.203, "region": 0.030, "fts": 0.023},
    "lac": {"similarity": 0.223, "citation": 0.079, "rigor": 0.024, "recency": 0.023, "region": 0.600, "fts": 0.051},
}


def directness(label: Column) -> Column:
    """What a topicality label adds to a score; nothing for none or another."""
    out = F.lit(0.0)
    for name, value in DIRECTNESS.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def review_bonus(design: Column, title: Column) -> Column:
    """0.025 for a review by its design or title."""
    return F.when((F.lower(design) == "review") | F.coalesce(F.lower(title).rlike(REVIEW_TITLE), F.lit(False)), 0.025).otherwise(0.0)


def channel_score(rows: DataFrame, channel: str, now: int, region: str, digits: int = 6) -> DataFrame:
    """``score``: the weighted sum of a single channel's profile; rows without a lexical rank ``fts`` have none of its part."""
    w = CHANNEL_WEIGHTS[channel]
    total = (
        w["similarity"] * clamp(F.col("cosine"), 0.0, 1.0)
        + w["citation"] * citation_score(F.col("citation_count"), F.col("year"), now)
        + w["rigor"] * rigor_score(F.col("sms_level"))
        + w["recency"] * recency_score(F.col("year"), now)
        + w["region"] * F.coalesce((F.col("region") == region).cast("double"), F.lit(0.0))
    )
    if "fts" in rows.columns:
        total = total + w["fts"] * F.coalesce("fts", F.lit(0.0))
    return rows.withColumn("score", rounded(total, digits))


def weak_before(rows: DataFrame) -> DataFrame:
    """How many weak-method rows stand before each row of a bounded pool with positions ``pos``."""
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("weak_before", F.count_if(F.coalesce(F.col("sms_level") <= 2, F.lit(True))).over(before))


def load_more(rows: DataFrame, pages: int, size: int = 20, ahead: int = 1) -> DataFrame:
    """The rows of ``pages`` pages, and of ``ahead`` more that are not ``shown`` yet."""
    return rows.where(F.col("pos") <= (pages + ahead) * size).withColumn("shown", F.col("pos") <= pages * size)


def order_within(rows: DataFrame, score: str, name: str = "pos") -> DataFrame:
    """Positions from 1 of a bounded pool by a score, ties to the smaller id."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), "id")))


def pool(rows: DataFrame, score: str, size: int = 200) -> DataFrame:
    return order_within(rows.orderBy(F.desc(score), "id").limit(size), score)


def relevance_floor(rows: DataFrame, least: float = 0.45, below_top: float = 0.15, keep: int = 8, strict: bool = False) -> DataFrame:
    """Rows of a pool at or above max(least, top - below_top); if fewer than ``keep`` are, the best ``keep`` by cosine (unless strict)."""
    every = Window.partitionBy()
    floor = F.greatest(F.lit(least), F.round(F.max("cosine").over(every) - below_top, 6))
    marked = rows.withColumn("above", F.col("cosine") >= floor).withColumn("best", F.row_number().over(Window.orderBy(F.desc("cosine"), "id")))
    marked = marked.withColumn("n_above", F.count_if("above").over(every))
    kept = F.col("above") if strict else F.when(F.col("n_above") >= keep, F.col("above")).otherwise(F.col("best") <= keep)
    return marked.where(kept).drop("above", "best", "n_above")


def cosine_gate(top: Column, low: float = 0.32, high: float = 0.50, below_top: float = 0.18) -> Column:
    return F.round(clamp(top - below_top, low, high), 6)


def passes_gate(cosine: Column, citations: Column, year: Column, gate: Column, synthetic: Column | None = None) -> Column:
    """At the gate or above; a well-cited older work may lie 0.10 below; synthetic rows and those without cosine pass."""
    free = cosine.isNull() | (cosine <= 0) if synthetic is None else synthetic | cosine.isNull() | (cosine <= 0)
    classic = (citations >= 75) & (year >= 1900) & (year < 2020) & (cosine >= F.round(gate - 0.10, 6))
    return free | (cosine >= gate) | F.coalesce(classic, F.lit(False))


def topicality(cosine: Column, gate: Column, lac: Column) -> Column:
    return F.when(cosine >= gate, F.when(lac, "direct-lac").otherwise("direct-global")).when(cosine >= F.round(gate - 0.08, 6), "indirect").otherwise("excluded")


def quota_reorder(rows: DataFrame, by_cosine: int = 25, per_channel: int = 12) -> DataFrame:
    """The head takes the best by raw cosine and the best of every channel; the rest follows by score."""
    cos = F.row_number().over(Window.orderBy(F.desc("cosine"), "id"))
    own = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), "id"))
    head = rows.withColumn("head", (cos <= by_cosine) | (own <= per_channel))
    return head.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("head"), F.desc("score"), "id")))


def select_diverse(rows: DataFrame, key: Column, k: int = 50, digits: int = 6) -> DataFrame:
    """The best row of each key, then k of them; the third and later weak-method rows lose a growing penalty.

    As the penalty of the j-th weak row only depends on j, picking greedily is ordering by score less penalty.
    """
    best = rows.withColumn("n_key", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))).where("n_key = 1").drop("n_key")
    weak = F.coalesce(F.col("sms_level") <= 2, F.lit(True))
    nth = F.row_number().over(Window.partitionBy(weak).orderBy(F.desc("score"), "id")) - 1
    penalty = F.when(weak & (nth >= 3), F.least(0.015 * (nth - 2), F.lit(0.06))).otherwise(0.0)
    adjusted = best.withColumn("adjusted", F.round(F.col("score") - penalty, digits))
    return adjusted.withColumn("pick", F.row_number().over(Window.orderBy(F.desc("adjusted"), F.desc("score"), "id"))).where(F.col("pick") <= k)


def by_channel_order(kind: str) -> list[Column]:
    """The order of a single sort channel: by level, citations or year before the score."""
    first = {"causal": [F.desc_nulls_last("sms_level")], "foundational": [F.desc_nulls_last("citation_count")], "recent": [F.desc_nulls_last("year")]}
    return [*first.get(kind, []), F.desc("score"), F.asc("id")]


def interleave(rows: DataFrame, share: dict[str, float], k: int = 20) -> DataFrame:
    """Rankings of several channels woven by shares: the n-th row of a channel falls due at n / share; first sight counts."""
    weights = F.create_map(*[x for c, s in share.items() for x in (F.lit(c), F.lit(float(s)))])
    nth = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("similarity"), "id"))
    due = rows.withColumn("due", F.round(nth / weights[F.col("channel")], 6))
    first = due.groupBy("id").agg(F.min(F.struct("due", "channel")).alias("f")).select("id", "f.due", "f.channel")
    top = first.orderBy("due", "channel", "id").limit(k)
    return top.withColumn("slot", F.row_number().over(Window.orderBy("due", "channel", "id")))


def hybrid_product(rows: DataFrame, now: int, region: str, gate: float, digits: int = 6) -> DataFrame:
    """Similarity times the causal boost, the larger of the recent and the foundational one, the regional one, and the gate."""
    b = profile("moderate")
    recent = 1 + b["recent"] * recency_score(F.col("year"), now)
    classic = 1 + b["foundational"] * citation_score(F.col("citation_count"), F.col("year"), now)
    local = 1 + b["region"] * F.coalesce((F.col("region") == region).cast("double"), F.lit(0.0))
    product = F.col("cosine") * (1 + b["causal"] * rigor_score(F.col("sms_level"))) * F.greatest(recent, classic) * local
    return rows.withColumn("score", rounded(F.when(F.col("cosine") >= gate, product).otherwise(0.0), digits))


def evidence_floor(rows: DataFrame, k: int, is_wanted: Column, least: int) -> DataFrame:
    """The first k by position with at least ``least`` wanted rows: those missing replace the last unwanted ones."""
    marked = rows.withColumn("wanted", F.coalesce(is_wanted, F.lit(False))).withColumn("inside", F.col("pos") <= k)
    marked = marked.withColumn("n_in", F.count_if(F.col("wanted") & F.col("inside")).over(Window.partitionBy()))
    side = Window.partitionBy("wanted", "inside")
    up = F.row_number().over(side.orderBy("pos"))
    down = F.row_number().over(side.orderBy(F.desc("pos")))
    spare = F.count_if(F.col("wanted") & ~F.col("inside")).over(Window.partitionBy())
    swaps = F.greatest(F.lit(0), F.least(F.lit(least) - F.col("n_in"), spare))
    kept = F.when(F.col("inside"), F.col("wanted") | (down > swaps)).otherwise(F.col("wanted") & (up <= swaps))
    return marked.withColumn("kept", kept).where("kept").drop("wanted", "inside", "n_in", "kept")


def cross_encoder_order(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """By judged class, then judge's score, then position; rows without a score last."""
    judged = rows.join(scores, "id", "left")
    order = F.when(F.col("judged").isNull(), 3).when(F.col("judged") >= 0.7, 0).when(F.col("judged") >= 0.5, 1).otherwise(2)
    return judged.withColumn("band", order).withColumn("judged_pos", F.row_number().over(Window.orderBy("band", F.desc_nulls_last("judged"), "pos")))


def promote_reviews(rows: DataFrame, within: int = 30) -> DataFrame:
    """Reviews come first among the first ``within`` rows; the order is otherwise kept."""
    review = F.lower("title").rlike("review|meta")
    moved = F.when((F.col("pos") <= within) & review, 0).when(F.col("pos") <= within, 1).otherwise(2)
    return rows.withColumn("promoted_pos", F.row_number().over(Window.orderBy(moved, "pos")))


def priority_score(now: int) -> Column:
    """Which works to read first: rating, level, log of citations, region and age."""
    rating = F.when(F.col("abs_rating") == "4*", 5.0).when(F.col("abs_rating") == "4", 4.0).when(F.col("abs_rating") == "3", 3.0).otherwise(0.0)
    return F.round(
        rating * 2 + F.coalesce(F.col("sms_level"), F.lit(0)) * 3.0 + F.log10(F.coalesce("citation_count", F.lit(0)) + 1.0) * 2 + F.when(F.col("region") == "LAC", 3.0).otherwise(0.0) + F.greatest(F.lit(0.0), 5 - (F.lit(now) - F.col("year")) / 5.0),
        6,
    )


def lazy_card_priority(position: Column) -> Column:
    """1 to 20 by position, with rigour and a step for citations, to three places."""
    cited = F.when(F.col("citation_count") >= 100, 2.0).when(F.col("citation_count") >= 25, 1.0).otherwise(0.0)
    return F.round(F.greatest(F.lit(1.0), 20 - 0.1 * position) + F.coalesce(F.col("sms_level"), F.lit(0)) + cited, 3)
