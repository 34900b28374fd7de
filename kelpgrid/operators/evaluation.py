"""Quality of retrieval and of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_scores(rows: DataFrame, truth: str = "truth", said: str = "said") -> DataFrame:
    """``label, tp, fp, fn, f1`` of each label; f1 is 0 where it is undefined."""
    pairs = rows.groupBy(truth, said).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col(said).alias("label"), F.lit(False).alias("is_truth")))).alias("x"), "n", (F.col(truth) == F.col(said)).alias("ok"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    grouped = each.groupBy("x.label").agg(count(F.col("ok") & F.col("x.is_truth")).alias("tp"), count(~F.col("ok") & ~F.col("x.is_truth")).alias("fp"), count(~F.col("ok") & F.col("x.is_truth")).alias("fn"))
    under = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return grouped.withColumn("f1", F.round(F.when(under > 0, 2.0 * F.col("tp") / under).otherwise(0.0), 6))


def recall_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query, found, wanted, recall`` with the first k of each query's ranking."""
    top = ranked.where(F.col("rank") <= k).select("query", "id").withColumn("hit", F.lit(1))
    joined = relevant.select("query", "id").join(top, ["query", "id"], "left")
    return joined.groupBy("query").agg(F.count("hit").alias("found"), F.count("*").alias("wanted")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))


def precision_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Relevant rows among the first k, over k itself."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("query", "id").distinct(), ["query", "id"], "left_semi")
    found = hits.groupBy("query").agg(F.count("*").alias("found"))
    return ranked.select("query").distinct().join(found, "query", "left").select("query", F.round(F.coalesce("found", F.lit(0)) / k, 6).alias("precision"))


def density(ranked: DataFrame, k: int) -> DataFrame:
    """Distinct venues, types and topics among the first k rows of each query."""
    return ranked.where(F.col("rank") <= k).groupBy("query").agg(F.count_distinct("venue").alias("venues"), F.count_distinct("publication_type").alias("types"), F.count_distinct("topic").alias("topics"), F.count("*").alias("n"))


def rank_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, before, after, delta``: of two rankings; delta is null for those that came or went."""
    joined = before.select("id", F.col("rank").alias("before")).join(after.select("id", F.col("rank").alias("after")), "id", "full")
    return joined.withColumn("delta", F.col("before") - F.col("after"))


def level_distribution(ranked: DataFrame, k: int = 20) -> DataFrame:
    """``sms_level, n, lac_rate, mean``: the first k rows by level, and in a row without a level all of them."""
    top = ranked.where(F.col("pos") <= k)
    rate = F.round(100.0 * F.count_if(F.col("region") == "LAC") / F.count("*"), 1)
    return top.groupingSets([[F.col("sms_level")], []], "sms_level").agg(F.count("*").alias("n"), rate.alias("lac_rate"), F.round(F.avg("sms_level"), 2).alias("mean"))


def discounted(rank: Column) -> Column:
    """1 / log2(rank + 2) of a rank from 0."""
    return 1 / F.log2(rank + 2)


def top_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Rows in both top k, and their share of k."""
    both = a.where(F.col("rank") <= k).select("id").join(b.where(F.col("rank") <= k).select("id"), "id")
    return both.agg(F.count("*").alias("common"), F.round(F.count("*") / F.lit(k), 6).alias("share"))


def per_group_top(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
