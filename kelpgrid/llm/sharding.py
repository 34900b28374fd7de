"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 points. Every shard holds some virtual nodes on it, placed by a hash; a row falls on the point of
its key's hash and belongs to the next virtual node clockwise. Arcs (what lies between two virtual nodes) are filled
in, clockwise from point 0; rows of an arc that find their shard full continue clockwise to the next shard with
room. A shard's room is bounded, so balance is guaranteed, and a further shard moves little more than what it takes.

All of it is DataFrame functions: the rows of an arc are only counted, one row of at most ``shards * nodes`` counts is
folded into spans (``arc, shard, first, until``), and every row finds its span by its number within its arc. Numbers
are prefix sums over parts of arcs, so that no key, however frequent, is numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpgrid.llm.staging import stage

POINTS = 1 << 16
#: Rows of an arc are dealt to so many parts by their key, and those of one key to so many by the partition that they are read in.
KEY_PARTS, PLACE_PARTS = 64, 64


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """``point, arc, shard``: the arc of every point, numbered clockwise, and the shard of the virtual node that ends it.

    Two virtual nodes on one point: the smaller (shard, replica) has it. Points after the last node belong to the first.
    """
    node = spark.range(shards * nodes).select(F.floor(F.col("id") / nodes).cast("int").alias("shard"), F.pmod("id", F.lit(nodes)).alias("replica"))
    at = F.shiftrightunsigned(F.xxhash64(F.lit("node"), "shard", "replica"), 48).cast("int")
    placed = node.groupBy(at.alias("point")).agg(F.min(F.struct("shard", "replica")).alias("node")).select("point", "node.shard")
    points = spark.range(POINTS).select(F.col("id").cast("int").alias("point")).join(F.broadcast(placed), "point", "left")
    ahead = Window.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the points of the ring, whose number is fixed
    held = F.struct(F.col("point").alias("arc"), "shard")
    found = points.withColumn("next", F.last(F.when(F.col("shard").isNotNull(), held), ignorenulls=True).over(ahead))
    first = F.min(F.when(F.col("shard").isNotNull(), held)).over(Window.partitionBy())
    return found.select("point", F.coalesce("next", first).alias("next")).select("point", "next.arc", "next.shard")


def rooms(total: Column, shards: int, slack: float) -> Column:
    """How many of ``total`` rows each shard takes at most: counts that differ by one at most, each ``slack`` larger."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.ceil((F.floor(total / shards) + F.when(s < total % shards, 1).otherwise(0)) * (1 + slack)).cast("long"))


def spans(arcs: DataFrame, shards: int, slack: float) -> DataFrame:
    """``arc, shard, first, until``: the rows of every arc, by their number within it, that each shard takes.

    ``arcs`` is (arc, shard, n), one row for each virtual node. Arcs come in clockwise order; the walk of an arc meets
    each shard where its next virtual node is.
    """
    filled = F.array_sort(F.collect_list(F.struct("arc", "shard", F.coalesce("n", F.lit(0).cast("long")).alias("n"))))
    one = arcs.agg(filled.alias("arcs"), F.sum("n").alias("total"))  # a row for each virtual node
    order = F.transform("arcs", lambda a: a.shard)
    one = one.select("arcs", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.concat(order, order).alias("order"))
    walked = one.select("arcs", rooms(F.col("total"), shards, slack).alias("room"), F.transform("arcs", lambda a, i: F.array_distinct(F.slice("order", i + 1, F.size("arcs")))).alias("walks"))
    taken = "array<struct<arc:int,shard:int,first:bigint,until:bigint>>"
    none = F.lit(0).cast("long")

    def fill(state: Column, arc: Column) -> Column:
        """One arc: what is left of it goes from shard to shard of its walk."""

        def offer(s: Column, shard: Column) -> Column:
            n = F.least(arc.n - s.done, s.room[shard])
            span = F.struct(arc.arc.alias("arc"), shard.alias("shard"), s.done.alias("first"), (s.done + n).alias("until"))
            room = F.transform(s.room, lambda r, i: F.when(i == shard, r - n).otherwise(r))
            return F.when(n > 0, F.struct(room.alias("room"), (s.done + n).alias("done"), F.concat(s.out, F.array(span)).alias("out"))).otherwise(s)

        begun = F.struct(state.room.alias("room"), none.alias("done"), state.out.alias("out"))
        return F.when(arc.n > 0, F.aggregate(arc.walk, begun, offer)).otherwise(state)

    start = F.struct(F.col("room"), none.alias("done"), F.array().cast(taken).alias("out"))
    with_walk = F.zip_with("arcs", "walks", lambda a, w: F.struct(a.arc.alias("arc"), a.n.alias("n"), w.alias("walk")))
    return walked.select(F.explode(F.aggregate(with_walk, start, fill).out).alias("s")).select("s.*")


def shard(docs: DataFrame, shards: int = 16, nodes: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``.

    A row's place on the ring is that of its id alone. ``slack`` 0 bounds the loads so that counts differ by one at
    most (law ``rows``); a larger one lets shards hold that share more and moves fewer rows. ``slot`` numbers the rows of a
    shard from 0 without gaps. Rows of an arc are in the order of a second hash of the id; rows of one id, which
    are alike to the ring, in the order of the partitions that they are read in. Null ids are one key; null texts have no
    bytes; repeated rows have a slot each; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    circle = stage(ring(spark, shards, nodes), "ring")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.col(id_col).cast("long")
    part = F.pmod(F.xxhash64(F.lit("part"), doc), F.lit(KEY_PARTS)) * PLACE_PARTS + F.pmod(F.spark_partition_id(), F.lit(PLACE_PARTS))
    rows = docs.select(
        doc.alias("doc_id"),
        (F.octet_length(data) + F.lit(1).cast("long")).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.lit("row"), doc), 48).cast("int").alias("point"),
        part.cast("int").alias("part"),
    )
    placed = stage(rows.join(F.broadcast(circle.select("point", "arc")), "point").drop("point"), "placed")  # the ring has 65,536 rows
    parts = placed.groupBy("arc", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 parts
    parts = stage(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")), "parts")
    counted = circle.select("arc", "shard").distinct().join(parts.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left")
    taken = stage(spans(counted, shards, slack), "spans")
    slots = Window.partitionBy("shard").orderBy("arc", "first").rowsBetween(Window.unboundedPreceding, -1)  # of spans, at most one for each pair of arc and shard
    taken = taken.withColumn("base", F.coalesce(F.sum(F.col("until") - F.col("first")).over(slots), F.lit(0)).cast("long"))
    within = Window.partitionBy("arc", "part").orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id", "text_crc32", "size")
    numbered = placed.withColumn("k", F.row_number().over(within)).join(parts.select("arc", "part", "before"), ["arc", "part"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("k") - 1)
    inside = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("until"))
    found = numbered.join(F.broadcast(taken), "arc").where(inside)  # shards * shards * nodes spans at most
    law = F.lit("rows" if slack == 0 else f"at most {1 + slack} times the mean of rows")
    return found.select("doc_id", "size", "text_crc32", law.alias("law"), "shard", (F.col("base") + F.col("number") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
