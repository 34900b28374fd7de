"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments of equal width. Two fingerprints at no more than ``radius``
differing bits differ in at most ``radius // segments`` bits of some segment. Around every segment
value a Hamming ball of half that radius (rounded up) is enumerated on both sides; values within the
whole radius meet in a common ball member, so the table of ball members holds every match. What
meets is verified by the complete distance. Only distinct fingerprints are indexed, and a table
entry gives the edges of a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.llm.components import components
from kelpgrid.llm.staging import id_text, shuffle_partitions, stage, with_long_id


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> bytes:
    """The XXH64 of each shingle of a text, repeats included, as eight big-endian bytes; none for null and wordless texts.

    A-Z are lower-cased, words are split at space and U+0009-000D, shingles are ``words`` words joined
    by spaces (fewer words: all of them).
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return b""
    joined, digest = b" ".join(tokens), xxhash.xxh64_digest
    if len(tokens) <= words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())])


def majority(hashes: bytes) -> int:
    """The 64-bit fingerprint, as an unsigned integer: a bit is set if it is set in over half of the hashes; zero if there are none."""
    n, counts = len(hashes) // 8, np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 15):
        counts += np.unpackbits(rows[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of one whole text; null and wordless texts have zero."""
    return majority(shingle_hashes(text, words, seed))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of hash, as text, that tell rows apart, as ids may be null or repeated; equal rows share them."""
    columns = F.col(id_col).cast("long"), F.col(text_col)
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), *columns)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc_id, key, fp`` of each row, fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows.doc_id, "key": rows.key, "fp": np.array([_signed(simhash(t, words)) for t in rows.text], np.int64)})

    picked = docs.select(id_text(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return with_long_id(picked.mapInPandas(run, "doc_id string, key string, fp long"))


def ball_masks(width: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` bits within ``width``."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links at most ``radius`` apart: breadth first, each value leaves the rest once reached."""
    found, rest = [], np.unique(values)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                reached = rest[near]
                found += [(x, y) for y in reached]
                queue += list(reached)
                rest = rest[~near]
    return found


def links(distinct: DataFrame, radius: int = 4, segments: int = 2, fp_col: str = "fp") -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints at most ``radius`` bits apart: they connect every linked pair."""
    if 64 % segments:
        raise ValueError("segments must divide 64")
    width = 64 // segments
    masks = ball_masks(width, -(-(radius // segments) // 2))
    low = (1 << width) - 1 if width < 64 else -1

    def members(segment: int):
        part = F.shiftrightunsigned(F.col("fp"), segment * width).bitwiseAND(F.lit(_signed(low & (1 << 64) - 1)))
        return F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: F.struct(F.lit(segment).alias("segment"), part.bitwiseXOR(m).alias("key")))

    parts = shuffle_partitions(distinct.sparkSession)
    table = (
        distinct.select(F.col(fp_col).alias("fp"))
        .repartition(parts, "fp")  # few bytes, but each becomes many members
        .select("fp", F.explode(F.concat(*[members(s) for s in range(segments)])).alias("m"))
        .select("m.segment", "m.key", "fp")
        .repartition(parts, "segment", "key")
        .sortWithinPartitions("segment", "key")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        seen: set[tuple[int, int]] = set()

        def edges(segment: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (segment[1:] != segment[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            size, bits = ends - starts, fp.view(np.uint64)
            two = starts[size == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= radius]
            found = [np.stack([bits[two], bits[two + 1]], 1)]
            for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                found.append(np.array(_spanning(bits[a:b], radius), np.uint64).reshape(-1, 2))
            out = []
            for pair in map(tuple, np.concatenate(found).tolist()):
                if pair not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(pair)
                    out.append(pair)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

        for rows in batches:
            new = rows.segment.to_numpy(), rows.key.to_numpy(), rows.fp.to_numpy()
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            if not len(held[0]):
                continue
            whole = (held[1] != held[1][-1]) | (held[0] != held[0][-1])  # the last key may go on in the next batch
            if whole.any():
                yield edges(*(x[whole] for x in held))
            held = tuple(x[~whole] for x in held)
        if held is not None and len(held[0]):
            yield edges(*held)

    return table.mapInPandas(run, "u long, v long")


def _classes(marked: DataFrame, radius: int, segments: int) -> DataFrame:
    """``fp, root``: the node of the component's least doc_id, for every fingerprint.

    A node is a fingerprint with the least doc_id that has it (none comes last), so that the least node of a component
    names it, however many fingerprints it has.
    """
    least = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("id")).select("fp", F.struct(F.col("id").isNull().alias("none"), "id", "fp").alias("node")), "nodes")
    ends = links(least, radius, segments)
    for end in ("u", "v"):
        ends = ends.join(least.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")), end)
    roots = components(ends.select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))).withColumnRenamed("node", "from")
    return least.join(roots, F.col("node") == F.col("from"), "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, segments: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Rows link if their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    doc_id reachable. Null and empty texts have fingerprint zero and link like any other; repeated
    rows are returned each; a null doc_id never names a component (it is null if all its ids are).
    An empty table gives an empty result; other columns are not read.
    """
    marked = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    found = marked.join(_classes(marked, radius, segments), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("root.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, segments: int = 2) -> DataFrame:
    """One row of each component, that of the smallest id (rows without id last), with all columns of ``docs``."""
    marked = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    return keep_rows(docs, marked.join(_classes(marked, radius, segments), "fp"), id_col, text_col)


def keep_rows(docs: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` of the smallest id of each root, by ``doc_id, key, root`` of every row."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    chosen = rooted.groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias("row_key_"))
    columns = docs.columns
    keyed = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # whatever names the table has, the key's differs
    at = [f"c{columns.index(c)}" for c in (id_col, text_col)]
    kept = keyed.withColumn("row_key_", row_key(*at)).join(chosen, "row_key_", "left_semi").dropDuplicates(["row_key_"])
    return kept.drop("row_key_").toDF(*columns)
