"""Alignment of two tokenizers' tokens by the bytes that they cover.

Both tokenizers run once over every text. Tokens of either never reach over a single space, so a text is a row of
chunks that begin at its spaces, and each distinct chunk of some megabytes of texts is encoded and aligned once, on arrays
of all their tokens: ends that both share cut the tokens into groups, and the ends of both, each once, are the links, as
two tokens that overlap share exactly the bytes between two neighbouring ends. What tasks hand on, some megabytes of texts
a row, is each text's counts and digest, the places of its chunks, and the links of each chunk. How many texts hold a link,
and which of a token's are held most, Spark counts and joins over the whole corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kelpgrid.llm.staging import stage
from kelpgrid.llm.tokens import _byte_of
from kelpgrid.operators.joins import broadcast_if_few

#: What pre-splits texts for the byte-level tokenizer (fixed values of its file's format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text some of whose chunks can't be told apart without their neighbours (RE2, whose own white space is ASCII only).
TANGLED = "^ | (?:[" + "".join(filter(str.isspace, map(chr, range(0x3001)))) + "]|$)"
EDGE = re.compile(r"^\s|\s$")
EDGES = re.compile(r"\s\x20|\x20\s")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Pair:
    """Both tokenizers: the ids of ``" " + text`` under a byte-level BPE, and of ``text`` under a model that adds the space itself."""

    def __init__(self, bpe_path: str, piece_path: str):
        coded = _byte_of()
        bpe = Tokenizer.from_file(bpe_path)
        special = {t.content for t in bpe.get_added_tokens_decoder().values()}
        vocabulary = {t: i for t, i in bpe.get_vocab().items() if t not in special}
        self.a_bytes = [b""] * (max(bpe.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(coded[c] for c in token)
        self.bpe = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks={self.a_bytes[i]: i for i in vocabulary.values()}, special_tokens={})
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.piece.id_to_piece(i) for i in range(self.piece.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.piece.is_byte(i) and (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        #: No piece goes on after a word, so the words of a text can be encoded alone.
        self.apart = not any(re.search("[^▁]▁", p) for p in names)
        #: Every id as text after each of the marks.
        self.marks, self.many = ",|;", max(len(self.a_bytes), len(self.b_bytes))
        self.names = pa.array([(mark + str(i)).encode() for mark in self.marks for i in range(self.many)], pa.large_binary())
        self.lengths = [np.array([len(x) for x in every], np.int64) for every in (self.a_bytes, self.b_bytes)]

    def one(self, text: str, runs: list[str] | None = None) -> list[np.ndarray] | None:
        """The ids of a text under both; none if the bytes of either are not the text's. ``runs`` are its parts between some of its single spaces."""
        raw, found = b" " + text.encode(), []
        for k, every in enumerate((self.a_bytes, self.b_bytes)):
            ids = chain.from_iterable(self.piece.encode(runs or [text], num_threads=1)) if k else self.bpe.encode_ordinary(" " + text)
            found.append(np.fromiter(ids, np.int32))
            if b"".join([every[i] for i in found[k].tolist()]) != raw:
                return None
        return found

    def chunks(self, words: list[str], sizes: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For both: the ids of all words, each with a space before it, one after the other, and each word's number of them; the words that have none.

        ``sizes`` are the words' bytes. Words with white space at an end are encoded alone, all others as one text.
        """
        joined = " ".join(words)
        apart = np.array([i for i, w in enumerate(words) if EDGE.search(w)] if EDGES.search(joined) or joined[:1].isspace() or joined[-1:].isspace() else [], np.int64)
        inside = np.ones(len(words), bool)
        inside[apart] = False
        kept = words if not len(apart) else [w for w, x in zip(words, inside.tolist()) if x]
        runs = [" ".join(kept[i : i + 256]) for i in range(0, len(kept), 256)]
        whole = self.one(" ".join(runs), runs) if kept else []
        if whole is None:  # the bytes of some words are not theirs
            inside[:] = False
        alone = {i: self.one(words[i]) for i in np.flatnonzero(~inside).tolist()}
        out = []
        for k in (0, 1):
            counts = np.zeros(len(words), np.int64)
            ids = np.zeros(0, np.int32)
            if inside.any():
                ends = np.searchsorted(np.cumsum(self.lengths[k][whole[k]]), np.cumsum(sizes[inside] + 1)) + 1
                counts[inside], ids = np.diff(ends, prepend=0), whole[k]
            if alone:
                starts = np.cumsum(counts) - counts
                parts = [ids[a : a + n] for a, n in zip(starts.tolist(), counts.tolist())]
                for i, found in alone.items():
                    parts[i] = np.zeros(0, np.int32) if found is None else found[k]
                    counts[i] = len(parts[i])
                ids = np.concatenate(parts)
            out.append((ids, counts))
        return out, np.array([i for i, found in alone.items() if found is None], np.int64)


@lru_cache(2)
def pair_of(bpe_path: str, piece_path: str) -> Pair:
    """One of each tokenizer a worker process."""
    return Pair(bpe_path, piece_path)


def _row(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays([0, len(values)], pa.array(values, kind))


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _forms(ends: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form of each chunk, and the first chunk of each form: chunks of one form have their tokens' ``ends``, counted from the chunk's start, at the same bytes.

    Those of up to 64 bytes are told apart by a bit for each byte where a token ends, longer ones are forms of their own.
    """
    form, many = np.zeros(len(sizes), np.int64), 1
    for e, n in zip(ends, counts):
        bits = np.left_shift(np.uint64(1), np.minimum(e - 1, 63).astype(np.uint64))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bits, dtype=np.uint64)])  # wraps around; differences are right
        last = np.cumsum(n)
        codes, found = pd.factorize(upto[last] - upto[last - n])
        form = form * max(1, len(found)) + codes
        many *= max(1, len(found))
    long = np.flatnonzero(sizes > 64)
    form[long] = many + np.arange(len(long))
    form = pd.factorize(form)[0]
    new = np.flatnonzero(np.diff(np.maximum.accumulate(form), prepend=-1))
    return form, new


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


class Tokens(NamedTuple):
    """Of both tokenizers the ids of all distinct chunks of some texts, one after the other, and each chunk's number of them; each chunk's bytes;
    the places of the chunks of all texts, and each text's number of them."""

    ids: list[np.ndarray]
    counts: list[np.ndarray]
    sizes: np.ndarray
    at: np.ndarray
    used: np.ndarray

    def of_texts(self, each: np.ndarray) -> pa.Array:
        """The sum of what each chunk has, text by text."""
        row_of = np.repeat(np.arange(len(self.used)), self.used)
        return pa.array(np.bincount(row_of, each[self.at], len(self.used)).astype(np.int64))


def _tokens(both: Pair, texts: pa.Array) -> Tokens:
    some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    tangled = pc.fill_null(pc.match_substring_regex(texts, TANGLED), False) if both.apart else some
    plain = pc.and_not(some, tangled)
    split = pc.split_pattern(texts.filter(plain).cast(pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    sizes = pc.binary_length(coded.dictionary).to_numpy().astype(np.int64)
    tokens, broken = both.chunks(coded.dictionary.to_pylist(), sizes)
    which, offsets = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
    sizes += 1
    places: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    for k, i in enumerate(np.flatnonzero(plain.to_numpy(zero_copy_only=False)).tolist()):
        places[i] = which[offsets[k] : offsets[k + 1]]
    more: list[list[np.ndarray]] = []
    for i in np.flatnonzero(some.to_numpy(zero_copy_only=False)).tolist():
        if not len(places[i]) or len(broken) and np.isin(places[i], broken).any():  # as one chunk
            found = both.one(texts[i].as_py())
            places[i] = np.zeros(0, np.int64) if found is None else np.array([len(sizes) + len(more)], np.int64)
            more += [] if found is None else [found]
    sizes[broken] = 0
    sizes = np.concatenate([sizes, [int(both.lengths[0][x[0]].sum()) for x in more]]).astype(np.int64)
    ids = [np.concatenate([found, *[x[k] for x in more]]) for k, (found, _) in enumerate(tokens)]
    counts = [np.concatenate([n, [len(x[k]) for x in more]]).astype(np.int64) for k, (_, n) in enumerate(tokens)]
    return Tokens(ids, counts, sizes, np.concatenate([np.zeros(0, np.int64), *places]), np.array([len(p) for p in places], np.int64))


def _batch(both: Pair, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row: the tokens of the distinct chunks of the texts, one after the other, and where the chunks stand in each text."""
    t = _tokens(both, texts)
    ids, every = t.ids, t.counts
    ends = [np.cumsum(both.lengths[k][ids[k]]) - np.repeat(np.cumsum(t.sizes) - t.sizes, every[k]) for k in (0, 1)]
    form, new = _forms(ends, every, t.sizes)
    starts = np.cumsum(every[0] + every[1]) - every[0] - every[1]
    together = np.empty(len(ids[0]) + len(ids[1]), np.int32)
    together[_spans(starts, every[0])], together[_spans(starts + every[0], every[1])] = ids
    docs = pa.StructArray.from_arrays([doc_ids, *map(t.of_texts, every)], ["doc_id", "n_a", "n_b"])
    columns = {"docs": pa.ListArray.from_arrays([0, len(docs)], docs), "chunks": pa.ListArray.from_arrays([0, len(texts)], _lists(t.at, t.used))}
    columns |= {"ids": _row(together, pa.int32()), "starts": _row(starts, pa.int32()), "form": _row(form, pa.int32())}
    for name, e, counts in zip(("a_ends", "b_ends"), ends, every):
        here = counts[new]
        columns[name] = pa.ListArray.from_arrays([0, len(new)], _lists(e[_spans(np.cumsum(counts)[new] - here, here)], here))
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _aligned_batch(both: Pair, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row of :func:`aligned`, without its number.

    Ends are counted over all chunks, which end at the same bytes under both, so that they are sorted as they come.
    """
    t = _tokens(both, texts)
    (a, b), (n_a, n_b) = t.ids, t.counts
    a_ends, b_ends = (np.cumsum(both.lengths[k][t.ids[k]]) for k in (0, 1))
    of_a, of_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)  # of each token the other's that holds its last byte
    shared = a_ends[of_b] == b_ends  # B's tokens that end a group
    groups = np.diff(_offsets(shared)[_offsets(n_b)])

    # The link of a shared end is that of A's token.
    pairs = (a.astype(np.int64) << 32) | b[of_a], (a[of_b[~shared]].astype(np.int64) << 32) | b[~shared]
    n_links = n_a + n_b - groups
    first = _offsets(n_links)[:-1]
    links = np.empty(len(pairs[0]) + len(pairs[1]), np.int64)
    links[_spans(first, n_a)], links[_spans(first + n_a, n_b - groups)] = pairs

    # Groups as text: of each A's tokens, then B's, a mark before every one.
    last_b = np.flatnonzero(shared)
    last_a = of_b[last_b]
    first_a, first_b = (np.concatenate([[0], x + 1]) for x in (last_a, last_b))
    ends_group = np.zeros(len(a), bool)
    ends_group[last_a] = True
    marked = np.empty(len(a) + len(b), np.int64)
    for own, group, others, mark, starts in ((a, ends_group, first_b, ";", first_a), (b, shared, first_a[1:], "|", first_b)):
        named = own + both.marks.index(",") * both.many
        named[starts[:-1]] += (both.marks.index(mark) - both.marks.index(",")) * both.many
        marked[np.arange(len(own)) + others[np.cumsum(group) - group]] = named
    names = both.names.take(pa.array(marked))
    chunk_ends = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1][_offsets(n_a + n_b)]
    written = pa.Array.from_buffers(pa.large_binary(), len(n_a), [None, pa.py_buffer(chunk_ends), names.buffers()[2]]).take(pa.array(t.at))
    text_ends = np.frombuffer(written.buffers()[1], np.int64)[: len(written) + 1][_offsets(t.used)].tolist()
    whole = memoryview(written.buffers()[2] or b"")
    digests = [sha256(whole[x + 1 : y]).hexdigest() if y > x else "" for x, y in zip(text_ends, text_ends[1:])]

    docs = pa.StructArray.from_arrays([doc_ids, *map(t.of_texts, (n_a, n_b, groups, n_links)), pa.array(digests, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    of_chunks = pa.ListArray.from_arrays(pa.array(_offsets(n_links).astype(np.int32)), pa.array(links))
    columns = {"docs": pa.ListArray.from_arrays([0, len(docs)], docs), "chunks": pa.ListArray.from_arrays([0, len(texts)], _lists(t.at, t.used)), "links": pa.ListArray.from_arrays([0, len(of_chunks)], of_chunks)}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


TOKENS = "docs array<struct<doc_id:long,n_a:long,n_b:long>>, chunks array<array<int>>, ids array<int>, starts array<int>, form array<int>, a_ends array<array<int>>, b_ends array<array<int>>"


def _by_batches(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str, text_col: str, batch_chars: int, batch: Callable[[Pair, pa.Array, pa.Array], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``batch`` makes of about ``batch_chars`` bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(bpe_path, piece_path)
        for rows in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(rows["text"]), 0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // batch_chars)) + 1).tolist(), len(rows)]
            for at, end in zip(cuts, cuts[1:]):
                if end > at:
                    part = rows.slice(at, end - at)
                    yield batch(both, pa.array(part["doc_id"].to_pylist(), pa.int64()), part["text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def both_tokens(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 22) -> DataFrame:
    """Rows of about ``batch_chars`` bytes of text, the tokens by themselves: ``docs``, and for each the places of its ``chunks`` in order; of all distinct chunks, one
    after the other, the token ``ids`` (A's of a chunk before B's), where those of each chunk start and its ``form``; of every form the bytes up to the end of each token
    of A and of B, counted from the chunk's start.

    A text that can't be cut at its spaces is one chunk. Null and empty texts, and those whose joined token bytes are
    not the text's under either, have no chunks.
    """
    return _by_batches(docs, bpe_path, piece_path, id_col, text_col, batch_chars, _batch, TOKENS)


ALIGNED = "docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, chunks array<array<int>>, links array<array<long>>"


def aligned(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 21) -> DataFrame:
    """``batch, docs, chunks, links``: rows of about ``batch_chars`` bytes of text.

    ``docs`` holds ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` of each text, ``chunks`` the places of its chunks as :func:`both_tokens` has them;
    ``links`` the id pair of every link of each of the chunks (A id in the upper, B id in the lower half of a long).
    """
    found = _by_batches(docs, bpe_path, piece_path, id_col, text_col, batch_chars, _aligned_batch, ALIGNED)
    return found.select(F.monotonically_increasing_id().alias("batch"), "docs", "chunks", "links")


def _linked(batches: DataFrame, once: bool) -> DataFrame:
    """``batch, place, pair``: the id pairs of the links of every text, all of them or each distinct one once."""

    def pairs(chunks: Column) -> Column:
        found = F.flatten(F.transform(F.array_distinct(chunks) if once else chunks, lambda k: F.col("links")[k]))
        return F.array_distinct(found) if once else found

    # Put together before rows are made: no row carries the batch's table. The outer forms keep Spark from filtering on the size of
    # what it would work out twice for that.
    each = batches.select("batch", F.posexplode_outer(F.transform("chunks", pairs)).alias("place", "pairs"))
    return each.select("batch", "place", F.explode_outer("pairs").alias("pair")).where("pair is not null")


def pair_counts(batches: DataFrame) -> DataFrame:
    """``pair, docs, best``: the texts that hold each id pair linked, and whether no other pair of its A id is held by more."""
    counted = stage(_linked(batches, True).groupBy("pair").agg(F.count("*").alias("docs")), "pair_counts")
    most = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    return counted.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = 1_000_000) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    n_best counts the links whose id pair is linked in as many rows as any pair of its A id, count_sum adds up the rows of
    every link's pair. The table of pairs is broadcast up to ``most_pairs`` rows, which are counted first; beyond, the
    pairs of every text are added up and joined by a shuffle. Rows are told apart by their place: repeated rows count
    each, null ids stay; null and empty texts have no tokens, only zeros and an empty digest; an empty table gives an
    empty result; other columns are not read.
    """
    batches = stage(aligned(docs, bpe_path, piece_path, id_col, text_col), "aligned", group_rows=1)
    counts = stage(pair_counts(batches), "pairs")
    known = broadcast_if_few(counts, most_pairs)
    each, times = _linked(batches, False), F.lit(1).cast("long")
    if known is counts:
        each, times = each.groupBy("batch", "place", "pair").agg(F.count("*").alias("times")), F.col("times")
    summed = each.join(known, "pair").groupBy("batch", "place").agg(F.sum(times * F.col("docs")).alias("count_sum"), F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"))
    none = F.lit(0).cast("long")
    rows = batches.select("batch", F.posexplode("docs").alias("place", "doc")).select("batch", "place", "doc.*")
    return rows.join(summed, ["batch", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
