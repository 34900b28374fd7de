"""Inverted index, vector cells, keyed tables, order statistics, paged source, admitted hits and leases."""

from __future__ import annotations

import json
import math
import random
import re
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from kelpgrid.functions.vector import cosine_to
from kelpgrid.operators import cells, classify, dedup, inverted, order
from kelpgrid.plans import stored
from kelpgrid.plans.works import works
from kelpgrid.sources.keyed import KeyedTable
from kelpgrid.sources.paged import PagedSource
from kelpgrid.streaming import state


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- inverted index ---


@pytest.mark.parametrize("word, wanted", [("caresses", "caress"), ("ponies", "poni"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("taxes", "tax"), ("sales", "sale"), ("rate", "rate"), ("probate", "probat"), ("cease", "ceas"), ("is", "is"), ("a", "a")])
def test_stems(spark, word, wanted):
    assert spark.range(1).select(inverted.stem(F.lit(word)).alias("s")).first().s == wanted


def test_parsed():
    word = lambda w: inverted.Item(((0, w),))
    groups = inverted.parsed('tax "state of the art" -"sales tax" or -x or well-being OR the', {"tax": "tax", "state": "state"})
    assert groups == [[word("tax"), inverted.Item(((0, "state"), (3, "art"))), inverted.Item(((0, "sales"), (1, "tax")), True)], [inverted.Item(((0, "well"), (1, "being")))]]
    assert inverted.parsed('the "of a" or', {}) == []


TEXTS = {1: "tax reform and growth", 2: "growth of the tax tax base, growth", 3: "sales taxes hurt growth", 4: "no match here", 5: None, 6: "growth growth", 7: "tax one two three four growth tax", 8: "state of the art taxes"}


def by_definition(groups, stems):
    """Scores by trying all stretches of each text."""
    out = {}
    for i, text in TEXTS.items():
        words = [(n, w) for n, w in enumerate(inverted.plain_words(text or ""), 1) if w not in inverted.X.STOPWORDS]
        at = {n: stems.get(w, w) for n, w in words}
        spots = lambda item: [(n, n + item.words[-1][0]) for n in at if all(at.get(n + d) == w for d, w in item.words)]  # noqa: B023, E731
        fits = [g for g in groups if all(bool(spots(x)) != x.negated for x in g)]
        stretches = set()
        last = max(at, default=0)
        for a in range(1, last + 1):
            for b in range(a, last + 1):
                if any(all(x.negated or any(a <= s and e <= b for s, e in spots(x)) for x in g) for g in fits):
                    stretches.add((a, b))
        least = [s for s in stretches if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in stretches)]
        asked = {w for g in groups for x in g if not x.negated for _, w in x.words}
        if least:
            out[i] = round(sum(0.1 / (1 + b - a - (sum(at.get(n) in asked for n in range(a, b + 1)) - 1)) for a, b in least), 6)
    return out


@pytest.mark.parametrize("query", ["tax growth", "growth", '"tax growth" or "sales tax"', "tax -sales", '"state of the art"', "tax or growth", 'growth tax or "growth growth" -state', "absent or tax", "growths -tax"])
def test_cover_density_by_definition(spark, tmp_path, query):
    rows = spark.createDataFrame(list(TEXTS.items()), "id long, t string")
    inverted.build_index(rows, F.col("t"), f"{tmp_path}/index")
    groups = inverted.understood(spark, query)
    terms = sorted({w for g in groups for i in g for _, w in i.words})
    found = inverted.cover_density(inverted.read_postings(spark, f"{tmp_path}/index", terms), groups)
    words = sorted({w for t in TEXTS.values() for w in inverted.plain_words(t or "")})
    stems = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", inverted.stem(F.col("w")).alias("s")).collect()}
    assert {r.id: r.fts for r in found.collect()} == by_definition(groups, stems)


def test_search_reads_postings_only(spark, small):
    read = plan(inverted.read_postings(spark, stored.index_path(spark, small), ["er", "ing"]))
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN", read) and "In(term, [er,ing])" in read
    searched = plan(stored.d06_websearch(spark, small))
    schemas = [s.splitlines()[0] for s in searched.split("ReadSchema: ")[1:]]
    assert schemas and not any("text:" in s for s in schemas)


def test_query_without_words(spark, small):
    assert inverted.index_top_k(works(spark, small), stored.index_path(spark, small), 'the or "of"').collect() == []


# --- cells ---


def test_cells_give_the_exact_top_k_and_prune(spark, tmp_path):
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centre[i % 12]]) for i in range(600)] + [(900, [0.0] * 16), (901, [1.0] * 3), (902, None), (903, []), (904, rows_copy := [float(x) for x in centre[0]]), (905, rows_copy)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    cells.build_cells(table, f"{tmp_path}/cells", 24)
    for i in (0, 7, 900):
        query = spark.createDataFrame([(rows[i][1] if i < 600 else centre[3],)], "q array<double>")
        vector = query.first().q
        for k, threshold in ((10, 0.0), (700, 0.0), (5, 0.9999999), (10, -1.0)):
            found = cells.index_cosine_top_k(spark, f"{tmp_path}/cells", query, k, threshold)
            scored = table.where("embedding is not null").select("id", F.round(cosine_to(F.col("embedding"), vector), 6).alias("c")).where(F.col("c") >= threshold).collect()
            wanted = sorted(((-r.c, r.id) for r in scored))[:k]
            assert [(-r.cosine, r.id) for r in sorted(found.collect(), key=lambda r: r["rank"])] == wanted
    ordered = cells.bounds(spark, f"{tmp_path}/cells", rows[0][1])
    found = cells.index_cosine_top_k(spark, f"{tmp_path}/cells", spark.createDataFrame([(rows[0][1],)], "q array<double>"), 10)
    read = {f.split("cell=")[1].split("/")[0] for f in found.inputFiles()} if "cell=" in "".join(found.inputFiles()) else set()
    assert "PartitionFilters: [" in plan(found) and len(ordered) > 10 and len(read) <= len(ordered)
    assert sum(b >= 0.9 for _, b, _ in ordered) < len(ordered) / 2


# --- keyed table ---


def test_replayed_and_killed_batches(spark, tmp_path, monkeypatch):
    kept = KeyedTable(spark, f"{tmp_path}/t", "id long, a string, n int", "id", 8)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, a string, n int")
    held = lambda: sorted(tuple(r) for r in kept.read().collect())
    assert held() == []
    assert kept.apply(rows((1, "x", 1), (2, "y", 2), (2, "y", 2), (None, "z", 3)), 0, "s")
    assert held() == [(1, "x", 1), (2, "y", 2)]
    assert not kept.apply(rows((1, "again", 9)), 0, "s")

    def killed(_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(kept, "_commit", killed)
        with pytest.raises(RuntimeError):
            kept.apply(rows((2, "new", None), (3, "w", 3)), 1, "s")
    assert held() == [(1, "x", 1), (2, "y", 2)]  # nothing of it is seen
    assert kept.apply(rows((2, "new", None), (3, "w", 3)), 1, "s", merge=True)
    assert held() == [(1, "x", 1), (2, "new", 2), (3, "w", 3)]
    assert kept.apply(rows((3, "late", 0), (4, "v", 4)), ignore=True)
    assert held() == [(1, "x", 1), (2, "new", 2), (3, "w", 3), (4, "v", 4)]
    assert kept.vacuum() > 0 and len(held()) == 4
    with pytest.raises(RuntimeError):  # a second writer of the same version
        kept._commit(kept.manifest())


def test_keyed_sink_of_a_stream(spark, tmp_path):
    kept = KeyedTable(spark, f"{tmp_path}/t", "id long, v long", "id", 4)
    for k in range(3):
        spark.range(k * 5, k * 5 + 10).select("id", F.lit(k).cast("long").alias("v")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(kept.sink("numbers")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    run()
    first = sorted(tuple(r) for r in kept.read().collect())
    assert [i for i, _ in first] == list(range(20))
    run()
    assert sorted(tuple(r) for r in kept.read().collect()) == first and kept.manifest()["batches"] == {"numbers": 2}


# --- order statistics ---


def test_numbers_and_percentiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.5, 7.0, 7.0, 9.25, None]), i) for i in range(400)] + [("one", 4.0, 1000)] + [("hot", 1.0, 2000 + i) for i in range(300)]
    table = spark.createDataFrame(rows, "g string, v double, id long").repartition(6)
    groups = defaultdict(list)
    for g, v, i in rows:
        groups[g].append((v is not None, v or 0.0, i))
    found = {(r.g, r.id): (r.before, r.total) for r in order.numbered(table, ["g"], [F.asc_nulls_first("v"), F.col("id")]).collect()}
    assert found == {(g, x[2]): (n, len(xs)) for g, xs in groups.items() for n, x in enumerate(sorted(xs))}
    whole = order.numbered(table, [], [F.col("id")]).collect()
    assert sorted(r.before for r in whole) == list(range(len(rows)))
    result = {r.g: r for r in order.percentiles(table, ["g"], "v", {"p": 0.37, "top": 1.0}).collect()}
    for g, xs in groups.items():
        values = sorted(v for ok, v, _ in xs if ok)
        at = 0.37 * (len(values) - 1)
        low, high = values[math.floor(at)], values[math.ceil(at)]
        assert result[g].p == pytest.approx(low + (high - low) * (at - math.floor(at))) and result[g].top == values[-1] and result[g].n == len(values)
    assert order.percentiles(table.limit(0), ["g"], "v", {"p": 0.5}).collect() == []


def test_percent_rank_of_single_rows(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 5, 2), ("b", 4, 3), ("b", 4, 4)], "g string, v int, id long")
    assert {r.id: r.pct for r in classify.percent_rank(rows, "v", "g").collect()} == {1: 1.0, 3: 0.0, 4: 0.5, 2: 1.0}


# --- one title of many rows ---


def test_best_ranked_equals_the_best_of_all_pairs(spark):
    rng = random.Random(1)
    title = "a rather long title that many rows have in common"
    rows = [(i, title if i % 3 else f"{title} {i % 5}", rng.choice([None, *range(1990, 2020)]), rng.choice(["journal_article", "working_paper", None]), "s") for i in range(150)]
    table = spark.createDataFrame(rows, "id long, title string, year int, publication_type string, surname string")
    pairs = defaultdict(list)
    for r in dedup.ranked_pairs(table).collect():
        pairs[r.shadow_id].append((r.r, r.canonical_id))
    assert {r.shadow_id: r.canonical_id for r in dedup.best_ranked(table).collect()} == {s: min(p)[1] for s, p in pairs.items()}


def test_a_title_of_many_rows_gives_linear_output(spark):
    table = spark.range(20_000).select("id", F.lit("one title that twenty thousand rows have in common").alias("title"), (1990 + F.col("id") % 30).cast("int").alias("year"), F.when(F.col("id") % 2 == 0, "working_paper").otherwise("journal_article").alias("publication_type"))
    assert dedup.best_ranked(table).count() == 10_000


# --- paged source ---


def pages_of(folder, partition, cursors, start=0):
    (folder / partition).mkdir(parents=True, exist_ok=True)
    for k, (cursor, following) in enumerate(zip(cursors, [*cursors[1:], None])):
        rows = [[f"{partition}-{start + k}-{i}", f"title {i}"] for i in range(3)]
        (folder / partition / f"{cursor}.json").write_text(json.dumps({"rows": rows, "next": following}))


def test_paged_batch_and_resumed_stream(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    pages_of(tmp_path / "pages", "j1", ["*", "c1", "c2", "c3", "c4"])
    pages_of(tmp_path / "pages", "j2", ["*", "d1"])
    options = {"path": str(tmp_path / "pages"), "partitions": "j1, j2"}
    whole = spark.read.format("kelpgrid_pages").options(**options).load()
    assert whole.count() == 21 and whole.rdd.getNumPartitions() == 2
    later = spark.read.format("kelpgrid_pages").options(**options, cursors='{"j1": "c3"}').load()
    assert sorted({(r.partition, r.cursor) for r in later.collect()}) == [("j1", "c3"), ("j1", "c4"), ("j2", "*"), ("j2", "d1")]

    def run(batches):
        stream = spark.readStream.format("kelpgrid_pages").options(**options, pages_per_batch="2").load()
        job = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        while not job.lastProgress or job.lastProgress["batchId"] < batches:
            if job.exception():
                raise job.exception()
            job.processAllAvailable()
        job.stop()

    run(0)
    run(1)
    got = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) == 21


# --- admitted hits and leases ---


def replayed(events, window, most):
    out, hits = {}, defaultdict(deque)
    for key, at, i in sorted(e for e in events if e[0] is not None and e[1] is not None):
        h = [t for t in hits[key] if t > at - window]
        out[i] = len(h) < most
        hits[key] = h + [at] if out[i] else h
    return out | {i: False for key, at, i in events if key is None or at is None}


def test_admitted_batch_and_stream_agree_with_a_replay(spark, tmp_path):
    rng = random.Random(9)
    events = [(rng.choice([1, 2, 3, 3, 3]), rng.randrange(1, 3000), i) for i in range(300)] + [(None, 5, 900), (1, None, 901), (2, 10, 902), (2, 10, 903), (2, 10, 904)]
    wanted = replayed(events, 60, 2)
    rows = spark.createDataFrame(events, "key int, s long, event_id long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    batch = state.admitted(rows, "key", 60, 2)
    assert {r.event_id: r.admitted for r in batch.collect()} == wanted
    assert all(r.retry_us is None or (r.retry_us == 0) == r.admitted for r in batch.collect())
    # The stream gets the events in the order of time and is started anew for each file.
    got = {}
    for k in range(3):
        rows.where((F.col("ts") >= F.timestamp_seconds(F.lit(k * 1000))) & (F.col("ts") < F.timestamp_seconds(F.lit((k + 1) * 1000)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        job = state.admitted(stream, "key", 60, 2).writeStream.foreachBatch(lambda d, _: got.update({r.event_id: r.admitted for r in d.collect()}))
        job.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert got == {i: a for i, a in wanted.items() if i < 900 or i in (902, 903, 904)}


START = 1_000_000  # a stream drops what is not after its first watermark, the epoch


def test_leases_batch_and_stream(spark, tmp_path):
    minute = 60
    events = [
        (1, 0, None, "enqueue"), (1, 10, "a", "claim"), (1, 11, "b", "claim"), (1, 12, "b", "complete"), (1, 13, "a", "complete"), (1, 14, "b", "claim"),
        (2, 0, None, "enqueue"), (2, 20, "a", "claim"), (2, 20 + 5 * minute, "a", "renew"), (2, 20 + 12 * minute, "b", "claim"), (2, 20 + 30 * minute, "b", "claim"),
        (3, 0, "a", "claim"), (3, 1, None, "enqueue"), (3, 1, "a", "claim"), (3, 1, "b", "claim"),
        (4, 0, None, "enqueue"), (4, 1, "a", "claim"), (4, 40 * minute, "b", "claim"), (4, 80 * minute, "a", "claim"), (5, 200 * minute, None, "enqueue"),
    ]
    wanted = {
        (1, 0): ["queued"], (1, 10): ["claimed"], (1, 11): ["refused"], (1, 12): ["refused"], (1, 13): ["done"], (1, 14): ["refused"],
        (2, 0): ["queued"], (2, 20): ["claimed"], (2, 320): ["renewed"], (2, 740): ["refused"], (2, 1820): ["claimed"],
        (3, 0): ["refused"], (3, 1): ["queued", "claimed", "refused"], (4, 0): ["queued"], (4, 1): ["claimed"], (4, 2400): ["claimed"], (4, 4800): ["refused"], (5, 12000): ["queued"],
    }
    rows = spark.createDataFrame(events, "job long, s long, worker string, kind string").withColumn("ts", F.timestamp_seconds(F.col("s") + START)).drop("s")
    found = defaultdict(list)
    for r in state.leases(rows, 10, 2).collect():
        found[r.job, r.at // 1_000_000 - START].append(r.outcome)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}

    times, got = [0, 400, 2000, 3000, 12001], []
    for a, b in zip(times, times[1:]):
        rows.where((F.col("ts") >= F.timestamp_seconds(F.lit(START + a))) & (F.col("ts") < F.timestamp_seconds(F.lit(START + b)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        job = state.leases(stream, 10, 2).writeStream.foreachBatch(lambda d, _: got.extend(tuple(r) for r in d.collect()))
        job.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    outcomes = defaultdict(list)
    for j, at, _, o in got:
        if o not in ("expired", "failed"):
            outcomes[j, at // 1_000_000 - START].append(o)
    assert {k: sorted(v) for k, v in outcomes.items()} == {k: sorted(v) for k, v in wanted.items()}
    assert {(j, o) for j, _, _, o in got if o in ("expired", "failed")} >= {(4, "expired"), (2, "failed")}
    claims = [(j, at) for j, at, _, o in got if o == "claimed"]
    assert len(claims) == len(set(claims))
