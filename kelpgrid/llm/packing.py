"""Packing documents into fixed windows with a controlled mixture of sources.

Deficit round-robin: in every window each source is credited with its target share of the tokens and
served, in turn, from the head of its queue while its credit lasts; documents are cut where a turn ends.
Credit is carried from window to window, and from one partition to the next: what a partition starts
with is the targets times all tokens of the partitions before it, less what these held of the source.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgrid.llm.staging import id_text, shuffle_partitions, stage, with_long_id
from kelpgrid.llm.tokens import word_tokenizer

NO_SOURCE = "￿"  # rows without a source form one queue, served last


def capacities(tokens: int, window: int) -> list[int]:
    """Lengths of the sequences that hold ``tokens`` without padding: full windows, then powers of two."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def deficit_round_robin(queues: dict[str, deque], credit: dict[str, float], share: dict[str, float], sizes: list[int], least: int, burst: float) -> Iterator[tuple[int, str, int, int, int, int]]:
    """``sequence, source, document, start, length, offset`` of the pieces that fill ``sizes``.

    queues: (document, start, end) by source, emptied here. A source is served once its credit reaches
    ``least`` tokens, by no more than its credit and ``burst`` shares of a window; the rest of a window goes to
    the sources with most credit.
    """
    order = sorted(queues)
    turn = 0

    def serve(source: str, most: int, number: int, offset: int) -> Iterator[tuple]:
        queue = queues[source]
        while most and queue:
            doc, start, end = queue[0]
            n = min(most, end - start)
            yield number, source, doc, start, n, offset
            offset, most = offset + n, most - n
            credit[source] -= n
            if start + n == end:
                queue.popleft()
            else:
                queue[0] = (doc, start + n, end)

    for number, size in enumerate(sizes):
        offset = 0
        for s in order:
            credit[s] = credit.get(s, 0.0) + share.get(s, 0.0) * size
        for s in order[turn:] + order[:turn]:
            most = int(min(credit[s], max(least, burst * share.get(s, 0.0) * size), size - offset))
            if most >= min(least, size - offset) > 0:
                for piece in serve(s, most, number, offset):
                    yield piece
                    offset += piece[4]
        while offset < size:  # what is left of the window goes to the sources furthest behind
            s = max((x for x in order if queues[x]), key=lambda x: (credit[x], x))
            for piece in serve(s, min(size - offset, max(least, int(credit[s]))), number, offset):
                yield piece
                offset += piece[4]
        turn = (turn + 1) % max(1, len(order))


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int = 1) -> DataFrame:
    """``source, doc_id, deal, n, ids`` of every row: its ids and the closing one; a null text is empty.

    ``deal`` is a hash that rows are dealt by; equal rows of one batch get one each, so that a row that is repeated often does not fill a lane.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = word_tokenizer(tokenizer_path)
        end, wide = np.array([end_id], tokenizer.dtype).tobytes(), tokenizer.dtype.itemsize == 4
        for rows in batches:
            ids = [d + end for d in tokenizer.encoded(rows.text.tolist())]
            deal, seen = [], {}
            for i, d in zip(rows.doc_id, ids):
                own = f"{i}:{zlib.crc32(d)}"
                nth = seen[own] = seen.get(own, -1) + 1
                deal.append(zlib.crc32(f"{own}:{nth}".encode()))
            n = [len(d) // tokenizer.dtype.itemsize for d in ids]
            yield pd.DataFrame({"source": rows.source, "doc_id": rows.doc_id, "deal": deal, "n": n, "ids": [b"\xff" + d for d in ids] if wide else ids})  # an odd length marks the wide form

    picked = docs.select(
        F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"),
        id_text(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    return with_long_id(picked.mapInPandas(run, "source string, doc_id string, deal long, n long, ids binary"))


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], "<u4") if len(data) % 2 else np.frombuffer(data, "<u2").astype("<u4")


def _starts(laned: DataFrame, window: int, shares: DataFrame) -> DataFrame:
    """``lane, sequence, credit``: the first sequence of each lane and what it starts with, ``source, share, credit``."""
    held = laned.groupBy("source", "lane").agg(F.sum("n").alias("n"))
    totals = held.groupBy("lane").agg(F.sum("n").alias("lane_n"))
    count = F.floor(F.col("lane_n") / window) + F.bit_count(F.col("lane_n") % window)
    before = "order by lane rows between unbounded preceding and 1 preceding"
    totals = totals.withColumn("sequences", count.cast("long"))  # a row for each lane
    totals = totals.select("lane", F.expr(f"coalesce(sum(lane_n) over ({before}), 0)").alias("tokens_before"), F.expr(f"coalesce(sum(sequences) over ({before}), 0)").alias("sequence"))
    own = held.withColumn("own_before", F.expr(f"coalesce(sum(n) over (partition by source {before}), 0)"))
    own = own.join(F.broadcast(shares), "source").join(totals, "lane")
    return own.groupBy("lane").agg(
        F.min("sequence").alias("sequence"),
        F.collect_list(F.struct("source", "share", (F.col("share") * F.col("tokens_before") - F.col("own_before")).alias("credit"))).alias("credit"),
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    targets: dict[str, float] | None = None,
    lanes: int | None = None,
    least: int = 128,
    burst: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = True,
    lane_tokens: int = 8_000_000,
    max_sources: int = 100_000,
) -> DataFrame:
    """The pieces that fill sequences of ``window`` tokens: ``doc_id, source, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids``.

    Every id of every row lies in exactly one piece. Documents are dealt to ``lanes`` by a hash: as many as the shuffle
    partitions, and more where a lane would hold over ``lane_tokens`` tokens; a lane is one task and holds its tokens.
    ``targets`` gives each source's weight (None as key: rows without source); by default the sources' shares of all
    tokens, so that all queues run dry together. All tokens are packed whatever the targets. The last sequences of a
    lane have powers of two as lengths, so that none needs padding. Null texts are empty documents of one token;
    repeated rows are packed each; an empty table gives an empty result; other columns are not read. A source's
    total is a row on the driver: more than ``max_sources`` raise.
    """
    spark = docs.sparkSession
    tokens = stage(tokenized(docs, tokenizer_path, id_col, text_col, source_col), "tokens")
    totals = tokens.groupBy("source").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    given = None if targets is None else {NO_SOURCE if s is None else s: float(w) for s, w in targets.items()}
    weights = {r.source: float(r.n) if given is None else given.get(r.source, 0.0) for r in totals}
    whole = sum(weights.values())
    shares = spark.createDataFrame([(s, w / whole if whole else 0.0) for s, w in weights.items()], "source string, share double")
    lanes = lanes or max(shuffle_partitions(spark), -(-sum(r.n for r in totals) // lane_tokens))
    laned = tokens.withColumn("lane", (F.col("deal") % lanes).cast("int"))
    # The head of a lane has credit and no ids; it is told by them, not by a null id.
    rows = laned.select("lane", "source", id_text("doc_id").alias("doc_id"), "deal", "ids", F.lit(None).cast("string").alias("sequence"), F.lit(None).cast("array<struct<source:string,share:double,credit:double>>").alias("credit"))
    none = F.lit(None).cast("string")
    heads = _starts(laned, window, shares).select("lane", none.alias("source"), none.alias("doc_id"), F.lit(-1).cast("long").alias("deal"), F.lit(None).cast("binary").alias("ids"), F.col("sequence").cast("string").alias("sequence"), "credit")
    dealt = rows.unionByName(heads).repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", F.col("ids").isNotNull(), "deal", "doc_id", "ids")

    def pieces(first: int, credit: dict, share: dict, queued: list[tuple]) -> Iterator[pd.DataFrame]:
        queues: dict[str, deque] = {s: deque() for s in share}
        for k, (source, _, data) in enumerate(queued):
            queues[source].append((k, 0, len(data) // 2 if len(data) % 2 == 0 else len(data) // 4))
        total = sum(end for q in queues.values() for _, _, end in q)
        opened: dict[int, np.ndarray] = {}
        out = []
        for number, source, k, start, n, offset in deficit_round_robin(queues, credit, share, capacities(total, window), least, burst):
            if k not in opened:
                opened[k] = _ids(queued[k][2])
            ids = opened[k][start : start + n].tobytes()
            size = len(opened[k])
            if start + n == size:
                del opened[k]
            name = None if source == NO_SOURCE else source
            out.append((queued[k][1], name, start, n, size, first + number, offset, zlib.crc32(ids), ids if with_ids else None))
            if len(out) == 20_000:
                yield _pieces(out)
                out = []
        yield _pieces(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, first, credit, share, queued = None, 0, {}, {}, []
        for rows in batches:
            for at, source, i, data, sequence, given_credit in zip(rows.lane, rows.source, rows.doc_id, rows.ids, rows.sequence, rows.credit):
                if at != lane:
                    if queued:
                        yield from pieces(first, credit, share, queued)
                    lane, first, queued = at, int(sequence), []
                    credit = {x["source"]: x["credit"] for x in given_credit}
                    share = {x["source"]: x["share"] for x in given_credit}
                else:
                    queued.append((source, i, data))
        if queued:
            yield from pieces(first, credit, share, queued)

    schema = "doc_id string, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"
    return with_long_id(dealt.select("lane", "source", "doc_id", "ids", "sequence", "credit").mapInPandas(run, schema))


def _pieces(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"])
    return out.astype({"doc_id": object, "source": object, "ids": object})
