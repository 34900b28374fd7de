"""Exact order statistics of groups of any size: numbers, ranks and percentiles without a group in one task.

Rows are dealt to ranges of (group, order) and numbered within their range; what is before a range in its group comes from
prefix sums over the ranges, of which there are no more than shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.sources.stored import written


def numbered(rows: DataFrame, by: list[str], order: list[Column], weight: str | None = None, before: str = "before", total: str = "total") -> DataFrame:
    """``rows`` with how many rows of their group come ``before`` in the order and the ``total`` of the group; with ``weight`` its sums.

    The order should tell rows apart: equal ones stay in one range and are numbered in any order. The ranges are written
    once, as their bounds are sampled.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    ranged = written(rows.repartitionByRange(parts, *keys, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    n = F.col(weight) if weight else F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    # Groups are joined by a struct, which holds null keys together.
    group = F.struct(*keys) if by else F.lit(0)
    sums = ranged.groupBy(group.alias("group_"), "range_").agg(F.sum(n).alias("n_"))
    earlier = Window.partitionBy("group_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group_", "range_", F.coalesce(F.sum("n_").over(earlier), none).alias("base_"), F.sum("n_").over(Window.partitionBy("group_")).alias(total))
    inside = Window.partitionBy("group_", "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("group_", group).withColumn("in_", F.coalesce(F.sum(n).over(inside), none))
    s = sums.withColumnsRenamed({"group_": "sum_group_", "range_": "sum_range_"})
    joined = own.join(s, F.col("group_").eqNullSafe(F.col("sum_group_")) & (F.col("range_") == F.col("sum_range_")))
    return joined.withColumn(before, F.col("base_") + F.col("in_")).drop("group_", "range_", "in_", "base_", "sum_group_", "sum_range_")


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], interpolated: bool = True) -> DataFrame:
    """One row a group with an exact percentile of its values by each name in ``shares``, and ``n``; nulls do not count.

    Between two values it is interpolated; else the lower one is taken. Equal values are counted before they are ordered.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_"))
    ranked = numbered(counted, by, [F.col(value)], "n_")
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("total") - 1)
        here = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n_")), F.col(value)))
        low, high = here(F.floor(at)), here(F.ceil(at))
        part = F.max(at - F.floor(at))
        out.append(((low + (high - low) * part) if interpolated else low).alias(name))
    return ranked.groupBy(*by).agg(*out, F.max("total").alias("n"))
