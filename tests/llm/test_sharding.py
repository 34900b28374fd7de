"""The ring with bounded loads against a walk that places one arc after the other."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kelpgrid.llm import sharding


def walked(arcs, shards, total):
    """Rows of every arc that each shard takes, for ``arcs`` as (arc, shard, rows) in order."""
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = Counter()
    for k, (arc, _, n) in enumerate(arcs):
        for _, s, _ in arcs[k:] + arcs[:k]:
            take = min(n, room[s])
            room[s] -= take
            n -= take
            out[arc, s] += take
    return +out


def test_spans_follow_the_walk(spark):
    arcs = [(10, 0, 7), (20, 1, 0), (30, 0, 5), (35, 2, 1), (60, 1, 9), (90, 2, 30)]
    rows = spark.createDataFrame(arcs, "arc int, shard int, n long")
    found = Counter({(r.arc, r.shard): r.until - r["first"] for r in sharding.spans(rows, 3, 0.0).collect()})
    assert found == walked(arcs, 3, 52)


def test_ring_covers_every_point(spark):
    circle = sharding.ring(spark, 5, 20).collect()
    assert len(circle) == sharding.POINTS and {r.shard for r in circle} == set(range(5))
    nodes = sorted({(r.arc, r.shard) for r in circle})
    for r in circle:
        assert (r.arc, r.shard) == next((n for n in nodes if n[0] >= r.point), nodes[0])


def rows_of(spark):
    data = [(i, "x" * (i % 50)) for i in range(300)] + [(7, "same")] * 400 + [(None, None)] * 20 + [(5, "é"), (5, "other")]
    return data, spark.createDataFrame([(i, t, "a", 1, 2) for i, t in data], "doc_id long, text string, shard string, arc int, point int").repartition(7)


def test_counts_slots_and_digests(spark):
    data, docs = rows_of(spark)
    found = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_slack_bounds_loads_and_a_further_shard_moves_few(spark, small):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for slack, most in ((0.0, 0.2), (0.25, 0.12)):
        a, b = (sharding.shard(docs, n, slack=slack).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (16, 17))
        moved = a.join(b, "doc_id").where("s16 <> s17").count()
        largest = a.groupBy("s16").count().agg(F.max("count")).first()[0]
        assert largest <= 250 * (1 + slack) + 1 and moved < most * 4000, moved


def test_fewer_rows_than_shards_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard(docs).collect()) == [0, 0, 0]
    assert sharding.shard(docs.limit(0)).collect() == []
