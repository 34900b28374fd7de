"""Mixing sources to target weights, block by block.

The words of each source, document after document, are packed into blocks of a fixed length. A source
that is to give t words gives t / block slots: whole passes over all its blocks, and part of one more.
For every output shard the numbers of slots of the sources are drawn from a multinomial; the slots
of a source, counted through the shards, are mapped to blocks by a pseudorandom permutation of the
source's own, another one each pass, and joined with the blocks by index. Draws beyond a source's
slots are void, and what the draws leave open fills further shards, so that totals are met to the word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.llm.staging import shuffle_partitions, stage

WORDS = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORDS)
#: Rows that one task orders, and shards whose counts one task adds up.
ROWS_A_PART, SHARDS_A_PART = 100_000, 4096


def target_sizes(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """``share`` of all sizes by weight, each target at most ``most`` times its size, the excess reshared by weight."""
    caps = [most * n for n in sizes]
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if weights[i] > 0]
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > caps[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n-1 takes ``index``: a Feistel network walked until it falls below n."""
    half = np.uint64(max(1, -(-max(1, int(n - 1).bit_length()) // 2)))
    low = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        a, b = out[todo] >> half, out[todo] & low
        for r in range(4):
            a, b = b, a ^ (_mix(b, key * 4 + r) & low)
        out[todo] = a << half | b
        todo = out >= n
    return out.astype(np.int64)


class SourcePlan:
    """Slots of one source: ``passes`` over all blocks, ``blocks`` of one more and ``rest`` words of the next."""

    def __init__(self, number: int, size: int, target: float, block: int):
        self.number, self.size, self.full, self.tail = number, size, size // block, size % block
        words = min(int(target + 1e-6), 2**62)
        self.passes, left = divmod(words, size) if size else (0, 0)
        self.blocks, self.rest = divmod(left, block)
        self.a_pass = self.full + (self.tail > 0)
        self.slots = self.passes * self.a_pass + self.blocks + (self.rest > 0)

    def take(self, slots: np.ndarray, block: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and number of words of each slot.

        A whole pass permutes all blocks, the incomplete one among them; the part of a pass takes whole blocks only, so that
        its words come out right, and the incomplete one if all others are taken.
        """
        turn, i = slots // self.a_pass, slots % self.a_pass
        out = i.copy()
        for t in np.unique(turn).tolist():
            n = self.a_pass if t < self.passes else self.full
            mine = (turn == t) & (i < n)
            key = hashlib.blake2b(f"{seed}:{self.number}:{t}".encode(), digest_size=7).digest()
            out[mine] = permuted(i[mine], n, int.from_bytes(key, "big"))
        words = np.where(out == self.full, self.tail, block)
        return turn, out, np.where((slots == self.slots - 1) & (self.rest > 0), self.rest, words)


class Mixture:
    """Which words of which documents a mixture takes; the tables are made on construction."""

    def __init__(
        self,
        docs: DataFrame,
        weights: Sequence[float] = (5, 2, 1),
        share: float = 1.5,
        most: float = 2.0,
        block: int = 256,
        shard: int = 1024,
        seed: int = 17,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        max_sources: int = 100_000,
    ):
        """``weights`` repeat over the sources in code point order, null last. A source's total is a row on the driver: more than ``max_sources`` raise."""
        self.block, self.shard, self.seed = block, shard, seed
        self.columns = id_col, text_col, source_col
        spark = docs.sparkSession
        doc_id, text, source = self.places(docs)
        size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
        sized = self.keyed(docs).select(F.col("mix_key").alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))
        sized = stage(sized, "sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
        if len(totals) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        totals = sorted(totals, key=lambda r: (r.source is None, r.source or ""))
        targets = target_sizes([r.n for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
        self.plans = [SourcePlan(i, r.n, t, block) for i, (r, t) in enumerate(zip(totals, targets))]
        rows = [(i, r.source, r.n, float(t)) for i, (r, t) in enumerate(zip(totals, targets))]
        self.sources = spark.createDataFrame(rows, "source_no int, source string, source_size long, target double")
        self.placed = self._placed(sized, 256 + max((r.rows for r in totals), default=0) // ROWS_A_PART)

    def places(self, docs: DataFrame) -> list[str]:
        """The names that the id, text and source columns have in :meth:`keyed`."""
        return [f"c{docs.columns.index(c)}" for c in self.columns]

    def keyed(self, docs: DataFrame) -> DataFrame:
        """``mix_key`` (128 bits of hash of a row's id, source and text) before all columns of ``docs``, which are named c0, c1, ... whatever the table calls them."""
        doc_id, text, source = self.places(docs)
        columns = [F.col(doc_id).cast("long"), F.col(source).cast("string"), F.col(text)]
        numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        return numbered.select(F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b")).alias("mix_key"), "*")

    def _placed(self, sized: DataFrame, salts: int) -> DataFrame:
        """``key, doc_id, source_no, size, at``: where each document's words begin in its source.

        A source is ordered in ``salts`` parts; equal rows are counted before and stand one after the other.
        """
        numbered = sized.join(F.broadcast(self.sources.select("source_no", F.col("source").alias("name"))), F.col("source").eqNullSafe(F.col("name")))
        numbered = numbered.groupBy("source_no", "key", "doc_id", "size").agg(F.count("*").alias("copies"))
        numbered = numbered.withColumns({"salt": F.pmod("key.a", F.lit(salts)).cast("int"), "n": F.col("size") * F.col("copies")})
        parts = numbered.groupBy("source_no", "salt").agg(F.sum("n").alias("n"))
        before = Window.partitionBy("source_no").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("source_no", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        inner = Window.partitionBy("source_no", "salt").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        run = numbered.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(parts, ["source_no", "salt"])
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
        run = run.withColumn("copy", copy)
        return stage(run.select("key", "doc_id", "source_no", "size", (F.col("base") + F.col("inner") + F.col("copy") * F.col("size")).alias("at")), "placed")

    def _slots(self) -> DataFrame:
        """``source_no, turn, block, shard, slot, words`` of every slot of the mixture; turn is the pass over the source."""
        spark = self.sources.sparkSession
        plans, block, seed, size = self.plans, self.block, self.seed, self.shard
        total = sum(p.slots for p in plans)
        shards = -(-total // size)
        odds = np.array([p.slots for p in plans], float) / max(1, total)

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for s in rows.id.tolist():
                    counts = np.random.default_rng([seed, s]).multinomial(min(size, total - s * size), odds)
                    some = np.flatnonzero(counts)
                    yield pd.DataFrame({"shard": s, "source_no": some, "n": counts[some]})

        def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for no, own in rows.groupby("source_no"):
                    n, first, shard = (own[c].to_numpy(np.int64) for c in ("n", "first", "shard"))
                    ends = np.cumsum(n)
                    for a in range(0, int(ends[-1]), 1 << 17):  # however many slots a row stands for
                        i = np.arange(a, min(a + (1 << 17), int(ends[-1])))
                        row = np.searchsorted(ends, i, "right")
                        slots = first[row] + i - (ends[row] - n[row])
                        turn, blocks, words = plans[no].take(slots, block, seed)
                        yield pd.DataFrame({"source_no": no, "turn": turn, "block": blocks, "shard": shard[row], "slot": slots, "words": words})

        drawn = spark.range(shards).mapInPandas(draw, "shard long, source_no int, n long")
        group = F.floor(F.col("shard") / SHARDS_A_PART)  # the sums over shards are made in two steps
        drawn = stage(drawn.withColumn("group", group), "drawn")
        before = Window.partitionBy("source_no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        groups = drawn.groupBy("source_no", "group").agg(F.sum("n").alias("n"))
        groups = groups.select("source_no", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        inner = Window.partitionBy("source_no", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        wanted = F.broadcast(spark.createDataFrame([(p.number, p.slots) for p in plans], "source_no int, slots long"))
        placed = drawn.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(groups, ["source_no", "group"]).join(wanted, "source_no")
        placed = placed.withColumn("first", F.col("base") + F.col("inner"))
        placed = placed.select("shard", "source_no", "first", F.least("n", F.greatest(F.col("slots") - F.col("first"), F.lit(0))).alias("n"))
        had = drawn.groupBy("source_no").agg(F.sum("n").alias("had"))
        open_ = wanted.join(had, "source_no", "left").select("source_no", F.least("slots", F.coalesce("had", F.lit(0))).alias("first"), "slots")
        open_ = open_.withColumn("left", F.col("slots") - F.col("first")).where("left > 0")
        open_ = open_.withColumn("o", F.expr("coalesce(sum(left) over (order by source_no rows between unbounded preceding and 1 preceding), 0)"))  # a row for each source
        nth, width = F.col("nth"), F.lit(size)
        open_ = open_.withColumn("nth", F.explode(F.sequence(F.floor(F.col("o") / width), F.floor((F.col("o") + F.col("left") - 1) / width))))
        a, b = F.greatest("o", nth * width), F.least(F.col("o") + F.col("left"), (nth + 1) * width)
        last = open_.select((nth + shards).cast("long").alias("shard"), "source_no", (F.col("first") + a - F.col("o")).alias("first"), (b - a).alias("n"))
        both = placed.unionByName(last).where("n > 0")
        both = both.repartition(shuffle_partitions(spark), "source_no", "shard")  # few bytes, but many slots
        return both.mapInPandas(explode, "source_no int, turn long, block long, shard long, slot long, words long")

    def pieces(self) -> DataFrame:
        """``shard, slot, turn, source_no, at, key, doc_id, start, n``: n words from word ``start`` of a document, in a slot of a shard."""
        block, end = F.lit(self.block), F.col("at") + F.col("size")
        blocks = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))))
        a = F.greatest("at", F.col("block") * block)
        b = F.least(end, F.col("block") * block + F.col("words"))
        joined = blocks.join(self._slots(), ["source_no", "block"])
        return joined.select("shard", "slot", "turn", "source_no", "at", "key", "doc_id", (a - F.col("at")).alias("start"), (b - a).alias("n")).where("n > 0")

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every row; rows of no words take none."""
        sums = self.pieces().groupBy("source_no", "at").agg(F.sum("n").alias("taken")).withColumn("some", F.lit(True))
        rows = self.placed.withColumn("some", F.col("size") > 0).join(sums, ["source_no", "at", "some"], "left")
        named = rows.join(F.broadcast(self.sources), "source_no")
        return named.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """The documents that the mixture takes words of, with those words as text.

        A row has, pass after pass, the words taken of it in their order; words that follow each other in the document are cut
        out of it as one piece, with the white space between them, and pieces are parted by a line end. All columns
        of ``docs`` are kept; ``n_chars``, if there, is recounted. Repeated rows are rows of their own.
        """
        _, text, _ = self.places(docs)
        kept = docs.columns

        @F.pandas_udf("string")
        def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
            return pd.Series([cut_out(t, [(c["turn"], c["start"], c["n"]) for c in of]) for t, of in zip(texts, cuts)], dtype=object)

        lists = self.pieces().groupBy("key", "at").agg(F.array_sort(F.collect_list(F.struct("turn", "start", "n"))).alias("mix_cuts"))
        rows = self.keyed(docs).dropDuplicates(["mix_key"]).join(lists.withColumnRenamed("key", "mix_key"), "mix_key")
        out = rows.withColumn(text, cut(F.col(text), F.col("mix_cuts")))
        if "n_chars" in kept:
            out = out.withColumn(f"c{kept.index('n_chars')}", F.length(text).cast("long"))
        return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)])


def cut_out(text: str, cuts: list[tuple[int, int, int]]) -> str:
    """The words that ``cuts`` (pass, first word, number of words; in order) take of a text; a pass that takes all gives the text as it is."""
    runs: list[list[int]] = []
    for turn, start, n in cuts:
        if runs and runs[-1][0] == turn and runs[-1][2] == start:
            runs[-1][2] += n
        else:
            runs.append([turn, start, start + n])
    spans = [m.span() for m in WORD.finditer(text)]
    return "\n".join(text if a == 0 and b == len(spans) else text[spans[a][0] : spans[b - 1][1]] for _, a, b in runs)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``; see :class:`Mixture`.

    A null text has no words; null sources form one source, the last; repeated rows are rows of their own; an
    empty table gives an empty result; other columns are not read. The same table gives the same mixture.
    """
    return Mixture(docs, **options).taken()
