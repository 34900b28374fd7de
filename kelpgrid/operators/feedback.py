"""Learning from feedback: exclusion and promotion by past queries, and weights of domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions.numeric import clamp
from kelpgrid.functions.vector import with_cosine

LIKES = ("like", "save", "add")
DISLIKES = ("dislike", "dismiss")


def signal(kind: Column) -> Column:
    return F.when(kind.isin(*LIKES), 1).when(kind.isin(*DISLIKES), -1).otherwise(0)


def similar_feedback(feedback: DataFrame, query: DataFrame, kinds: tuple[str, ...], least: float = 0.85) -> DataFrame:
    """``id, similarity``: works with feedback of these kinds given on queries close to the present one."""
    rows = feedback.where(F.col("kind").isin(*kinds))
    near = with_cosine(rows, query, "query_embedding", name="sim").where(F.col("sim") >= least)
    return near.groupBy("id").agg(F.max("sim").alias("similarity"))


def without_disliked(works: DataFrame, feedback: DataFrame, query: DataFrame, least: float = 0.85) -> DataFrame:
    return works.join(similar_feedback(feedback, query, DISLIKES, least), "id", "left_anti")


def signal_counts(signals: DataFrame, least: int = 8) -> DataFrame:
    """``user_id, domain, pos, neg`` of those with enough signals."""
    counts = signals.groupBy("user_id", "domain").agg(F.count_if(F.col("signal") > 0).alias("pos"), F.count_if(F.col("signal") < 0).alias("neg"))
    return counts.where(F.col("pos") + F.col("neg") >= least)


def beta_weights(signals: DataFrame, least: int = 8, step: float = 0.15, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """New weight of each (user, domain) with enough signals: 0.5 + 1.5 times the posterior mean, at most a step from 1, within bounds."""
    enough = signal_counts(signals, least)
    alpha, beta = F.col("pos") + 1, F.col("neg") + 1
    raw = 0.5 + 1.5 * alpha / (alpha + beta)
    stepped = clamp(clamp(raw, 1 - step, 1 + step), low, high)
    return enough.select("user_id", "domain", "pos", "neg", F.round(raw, 6).alias("raw"), F.round(stepped, 6).alias("weight"))


def unless_drifting(proposals: DataFrame, most: float = 0.10) -> DataFrame:
    """All proposals, each with the ``drift`` of all: the mean distance of their weights from 1; none if it is more than ``most``."""
    drift = proposals.agg(F.avg(F.abs(F.col("weight") - 1)).alias("drift")).where(F.col("drift") <= most)
    return proposals.join(F.broadcast(drift.select(F.round("drift", 6).alias("drift"))))  # one row or none


def approve(weights: DataFrame, proposals: DataFrame) -> DataFrame:
    """Weights with approved proposals put in their place."""
    new = proposals.where("approved").select("user_id", "domain", F.col("weight").alias("new"))
    return weights.join(new, ["user_id", "domain"], "full").select("user_id", "domain", F.coalesce("new", "weight").alias("weight"))
