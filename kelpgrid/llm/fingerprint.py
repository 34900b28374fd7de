"""Similarity digests of documents from improbable features.

Every window of bytes of a text has an entropy; windows whose entropy is rare in the corpus are
improbable. In every span of neighbouring windows the rarest (leftmost) one is counted, and windows
counted often enough are the text's features. Features are put into a chain of Bloom filters, each
holding a bounded number. Two digests are compared by the overlap of their filters' bits, normalised
between what chance gives and what the smaller filter allows.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgrid.llm.staging import id_text, shuffle_partitions, with_long_id

BINS_A_BIT = 64  # entropy is told apart in 1/64 of a bit
GRAIN = 1 << 16


@dataclass(frozen=True)
class Digester:
    """rank: how common each entropy bin is (0: rarest); the last bins give features only where a span has no others.

    Texts of up to ``short`` bytes are searched in shorter spans, as they would have too few features.
    """

    rank: tuple[int, ...]
    window: int = 32
    span: int = 64
    popular: int = 16
    short: int = 1024
    short_span: int = 16
    short_popular: int = 4
    bits: int = 2048
    hashes: int = 5
    capacity: int = 160
    batch_bytes: int = 1 << 18

    def digests(self, texts: Sequence[bytes]) -> list[str]:
        """One digest a text, as ``features:base64 of the filters``; the same bytes give the same digest."""
        out = [""] * len(texts)
        for span, popular, which in ((self.short_span, self.short_popular, lambda n: n <= self.short), (self.span, self.popular, lambda n: n > self.short)):
            at = [i for i, t in enumerate(texts) if which(len(t))]
            found = (d for part in batches_of([texts[i] for i in at], self.batch_bytes) for d in self._digests(part, span, popular))
            for i, d in zip(at, found):
                out[i] = d
        return out

    def _digests(self, texts: list[bytes], span: int, popular: int) -> list[str]:
        data, starts, lengths = joined(texts, self.window, span)
        valid, bins = entropy_bins(data, starts, lengths, self.window)
        key = np.where(valid, np.array(self.rank, np.int64)[bins] << 40, np.int64(1) << 60) | np.arange(len(bins))
        lowest = sliding_min(key, span)
        chosen = np.bincount(lowest[lowest < np.int64(1) << 60] & ((1 << 40) - 1), minlength=len(bins)) >= popular
        at = np.flatnonzero(chosen & valid)
        doc = np.searchsorted(starts, at, "right") - 1
        raw, w = data.tobytes(), self.window
        value = np.array([xxhash.xxh64_intdigest(raw[p : p + w]) for p in at.tolist()], np.uint64)
        order = np.lexsort((at, value, doc))  # a feature met again in a text is not inserted again
        first = np.ones(len(order), bool)
        first[1:] = (value[order][1:] != value[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        keep = np.sort(order[first])
        doc, value = doc[keep], value[keep]
        count = np.bincount(doc, minlength=len(texts))
        chain = -(-count // self.capacity)
        base = np.concatenate([[0], np.cumsum(chain)])
        nth = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(count)])[doc]
        filters = np.zeros((int(base[-1]), self.bits), bool)
        width = np.uint64(self.bits.bit_length() - 1)
        for h in range(self.hashes):
            filters[base[doc] + nth // self.capacity, (value >> np.uint64(h) * width & np.uint64(self.bits - 1)).astype(np.int64)] = True
        packed = np.packbits(filters, axis=1)
        return [f"{n}:{base64.b64encode(packed[a:b].tobytes()).decode()}" for n, a, b in zip(count.tolist(), base[:-1].tolist(), base[1:].tolist())]

    def parse(self, digest: str) -> tuple[np.ndarray, np.ndarray]:
        """Features in each filter, and the filters as rows of 64-bit words."""
        n, _, data = digest.partition(":")
        rows = np.frombuffer(base64.b64decode(data), np.uint64).reshape(-1, self.bits // 64)
        count = np.full(len(rows), self.capacity)
        if len(rows):
            count[-1] = int(n) - self.capacity * (len(rows) - 1)
        return count, rows

    def likeness(self, one: str, other: str) -> float:
        """0 to 1: mean over the filters of the shorter chain, by their features, of the best normalised overlap."""
        if one == other:
            return 1.0
        (ca, a), (cb, b) = sorted((self.parse(one), self.parse(other)), key=lambda x: int(x[0].sum()))
        if not len(a):
            return 0.0
        both = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(2, dtype=np.int64)
        na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
        q = 1 - 1 / self.bits
        ea, eb = q ** (self.hashes * ca)[:, None], q ** (self.hashes * cb)[None, :]
        chance = self.bits * (1 - ea - eb + ea * eb)
        room = np.minimum(na[:, None], nb[None, :]) - chance
        score = np.clip((both - chance) / np.maximum(room, 1e-9), 0, 1)
        return float((score.max(1) * ca).sum() / ca.sum())


def batches_of(texts: Sequence[bytes], most: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def joined(texts: list[bytes], window: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one array with ``span`` zero bytes between them (short ones filled up to a window), and where each starts and how long it is."""
    filled = [t.ljust(window, b"\0") if t else t for t in texts]
    lengths = np.fromiter(map(len, filled), np.int64, len(filled))
    gap = b"\0" * (span + window)
    starts = np.cumsum(np.concatenate([[0], lengths[:-1] + len(gap)]))
    return np.frombuffer(gap.join(filled) + gap, np.uint8), starts, lengths


def entropy_bins(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the array: whether it lies within a text, and the bin of its entropy.

    The sum of n log n over the byte counts is carried from window to window: the counts of the byte that comes
    and of the byte that goes are sums of comparisons with the bytes up to a window away.
    """
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, window):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    n = np.arange(window + 1)
    table = np.rint(n * np.log2(np.maximum(n, 1)) * GRAIN).astype(np.int64)
    step = np.diff(table)  # step[c]: one more of a byte of which there are c
    change = step[before[window:]] - step[after[:-window]]
    _, counts = np.unique(data[:window], return_counts=True)
    sums = table[counts].sum() + np.concatenate([[0], np.cumsum(change)])
    bits = np.log2(window) - sums / (window * GRAIN)
    valid = np.zeros(len(data) + 1, np.int64)
    some = lengths >= window
    np.add.at(valid, starts[some], 1)
    np.add.at(valid, (starts + lengths - window + 1)[some], -1)
    return np.cumsum(valid)[: len(sums)] > 0, np.clip(np.rint(bits * BINS_A_BIT), 0, None).astype(np.int64)


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbours, ends filled up: minima from both sides of blocks of that length."""
    big = np.int64(1) << 61
    n = len(x) + span - 1
    padded = np.full(-(-(n + span) // span) * span, big)
    padded[span - 1 : span - 1 + len(x)] = x
    rows = padded.reshape(-1, span)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[span - 1 : span - 1 + n])


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def entropy_ranks(docs: DataFrame, text_col: str = "text", window: int = 32, least_bits: float = 2.0) -> tuple[int, ...]:
    """How common every entropy is among all windows of all texts: 0 for the rarest bin; what is below ``least_bits`` comes last."""
    bins = int(np.log2(window) * BINS_A_BIT) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(bins, np.int64)
        for rows in batches:
            for part in batches_of([_bytes(t) for t in rows.text], 1 << 18):
                valid, found = entropy_bins(*joined(part, window, 0), window)
                total += np.bincount(found[valid], minlength=bins)
        yield pd.DataFrame({"bin": np.flatnonzero(total), "n": total[total > 0]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(bins, np.int64)
    for r in counted:
        count[r.bin] = r.n
    low = np.arange(bins) < least_bits * BINS_A_BIT
    order = np.lexsort((np.arange(bins), count, low))
    rank = np.empty(bins, np.int64)
    rank[order] = np.arange(bins)
    return tuple(rank.tolist())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, ahead, doc_id, text``: documents dealt to partitions by ranges of ids, in descending order of ids in each.

    After its own rows every partition has, marked ``ahead``, the row that follows its last one: the first of the
    next partition, and after the smallest id the first of all. The text is shuffled once; only the bounds of
    the partitions pass the driver. Rows without id come last; equal ids are in descending order of the signed
    xxhash64 of their texts, then by text, and an id (or none) that fills several partitions is cut by that hash.
    """
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    lowest = F.lit(-(2**63))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    found = Counter(rows.agg(F.percentile_approx("k", shares, F.lit(20 * parts + 1000))).first()[0] or [])
    cuts = sorted((k, int(2**64 * j / n) - 2**63 - (j == n)) for k, n in found.items() for j in range(1, n + 1))
    hot = [k for k, n in found.items() if n > 1]
    width = max(1, int(len(cuts) ** 0.5))

    def below(cuts_now, k, h):
        return F.size(F.filter(cuts_now, lambda c: (c.k < k) | (c.k == k) & (c.h < h)))

    pairs = lambda xs: F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in xs])
    rows = rows.withColumn("h", F.when(F.col("k").isin(hot), F.xxhash64("text")).otherwise(F.lit(0)) if hot else F.lit(0).cast("long"))
    group = below(pairs(cuts[width - 1 :: width]), F.col("k"), F.col("h"))  # in two steps, for many cuts
    part = (F.lit(len(cuts)) - group * width - below(F.slice(pairs(cuts), group * width + 1, F.lit(width)), F.col("k"), F.col("h"))).cast("int")
    rows = rows.withColumn("part", part if cuts else F.lit(0))
    firsts = sorted((r.part, r.first.k, r.first.h) for r in rows.groupBy("part").agg(F.max(F.struct("k", "h")).alias("first")).collect())
    ahead = [(k, h, firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)]
    bounds = F.broadcast(spark.createDataFrame(ahead, "k long, h long, before int"))  # a row for each partition
    # Of the rows of a first id the one that comes first, however many there are.
    order = F.struct(-F.xxhash64("text").cast("decimal(20,0)"), F.col("text"), F.col("doc_id"))
    nexts = rows.join(bounds, ["k", "h"]).groupBy("before").agg(F.min(F.struct(order.alias("order"), "k")).alias("row"))
    nexts = nexts.select(F.col("before").alias("part"), F.lit(True).alias("ahead"), "row.k", F.col("row.order.doc_id").alias("doc_id"), F.col("row.order.text").alias("text"))
    both = rows.select("part", F.lit(False).alias("ahead"), "k", "doc_id", "text").unionByName(nexts)
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", F.desc("k"), F.desc(F.xxhash64("text")), "text").drop("k")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every whole text, of its edited text, and the likenesses of the digest to that and to the next document's.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row;
    the next document has the next smaller doc_id (after the smallest the largest, alone the document itself).
    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document. A null text is empty; texts without features are like those of an equal digest only.
    """
    digester = Digester(entropy_ranks(docs, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row so far, which waits for the one that follows it: part, ahead, doc_id, text, digest
        for rows in batches:
            for a in range(0, len(rows), 512):
                new = rows.iloc[a : a + 512]
                own = digester.digests([_bytes(t) for t in new.text])
                now = list(zip(new.part.tolist(), new.ahead.tolist(), new.doc_id.tolist(), new.text.tolist(), own))
                now = [held, *now] if held is not None else now
                held = now[-1]
                pairs = [(x, y) for x, y in zip(now, now[1:]) if not x[1] and x[0] == y[0]]
                if not pairs:
                    continue
                edited = []
                for x, y in pairs:
                    n = len(x[3]) // 3
                    edited.append(_bytes(x[3][: len(x[3]) - n] + y[3][:n]))
                digests = digester.digests(edited)
                yield pd.DataFrame(
                    {
                        "doc_id": [x[2] for x, _ in pairs],
                        "n_chars": [len(x[3]) for x, _ in pairs],
                        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                        "fingerprint": [x[4] for x, _ in pairs],
                        "edited_fingerprint": digests,
                        "near_edited": [digester.likeness(x[4], d) for (x, _), d in zip(pairs, digests)],
                        "near_next": [digester.likeness(x[4], y[4]) for x, y in pairs],
                    }
                )

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_long_id(with_next(docs, id_col, text_col).withColumn("doc_id", id_text("doc_id")).mapInPandas(run, schema))
