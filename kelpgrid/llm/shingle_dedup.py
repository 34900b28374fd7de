"""The pipeline's form of the SimHash operator: near copies by the Jaccard similarity of word shingles.

Texts of one set of shingles are one node. Candidates are the links of the nodes' SimHash fingerprints found by
multi-index hashing, verified by the exact similarity of the whole sets. No radius of 64-bit
fingerprints covers a similarity of 0.8, so what they miss is completed: nodes that may be alike share a band
of their MinHash signature (of 240 minima in 48 bands of five, a pair at similarity 0.8 shares none with
probability 5e-9, a more similar pair with less). Neighbours within a band are verified first, which connects large groups
by a number of pairs that grows with their size; then, of the nodes that share a band with another component, the pairs that
share one of their rarest shingles, early enough in both sets that what follows can still make them alike (prefix and
positional filters of set similarity joins): texts with more words of their own than a match may have make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.llm.components import components
from kelpgrid.llm.simhash_dedup import keep_rows, links, majority, row_key, shingle_hashes
from kelpgrid.llm.staging import id_text, stage, with_long_id

BANDS, ROWS = 48, 5
FACTORS = np.random.default_rng(42).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles, as in :func:`shingle_hashes`; none for wordless texts."""
    return np.unique(np.frombuffer(shingle_hashes(text, words, seed), np.uint64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed key for each band of the MinHash signature; no keys for the empty set."""
    if not len(shingles):
        return []
    low, least = shingles.astype(np.uint32), np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        least = np.minimum(least, np.multiply.outer(FACTORS, low[at : at + 1024]).min(1))
    raw, width = least.tobytes(), 4 * ROWS
    return [_signed(xxhash.xxh64_intdigest(raw[b * width : (b + 1) * width], b)) for b in range(BANDS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _marked(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``doc_id, key, node, n, fp, bands`` of each row; a node is a 128-bit hash of a set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            hashes = [shingle_hashes(t, words) for t in rows.text]
            sets = [np.unique(np.frombuffer(h, np.uint64)) for h in hashes]
            yield pd.DataFrame(
                {
                    "doc_id": rows.doc_id,
                    "key": rows.key,
                    "node": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets],
                    "n": np.fromiter(map(len, sets), np.int64, len(sets)),
                    "fp": np.array([_signed(majority(h)) for h in hashes], np.int64),
                    "bands": list(map(band_keys, sets)),
                }
            )

    picked = docs.select(id_text(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return with_long_id(picked.mapInPandas(run, "doc_id string, key string, node binary, n long, fp long, bands array<long>"))


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node, shingles`` of the nodes, whose ``key`` is that of one of their rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 500):  # long texts make long lists
                some = rows.iloc[at : at + 500]
                yield pd.DataFrame({"node": some.node, "shingles": [shingle_set(t, words).view(np.int64) for t in some.text]})

    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return keyed.join(nodes, "key").select("node", "text").mapInPandas(run, "node binary, shingles array<long>").dropDuplicates(["node"])


def _by_fingerprint(nodes: DataFrame, radius: int) -> DataFrame:
    """``u, v``: each node with the least one of its fingerprint, and the least ones of linked fingerprints."""
    least = stage(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    found = links(least, radius)
    for end in ("u", "v"):
        found = found.join(least.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end)
    same = nodes.join(least, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    return found.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).unionByName(same)


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs ``u, v`` whose sets are at least as alike as ``least``."""
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("us")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("vs"))
    both = F.size(F.array_intersect("us", "vs"))
    alike = both * (least.numerator + least.denominator) >= (F.size("us") + F.size("vs")) * least.numerator
    return pairs.join(a, "u").join(b, "v").where(alike).select("u", "v")


def _edges(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, words: int, least: Fraction, radius: int) -> DataFrame:
    """``u, v``: verified pairs of nodes that connect all pairs at least as alike as ``least``."""
    nodes = marked.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp"), F.min("key").alias("key"))
    table = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = table.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    table = stage(table.join(shared, "band"), "bands")
    near = stage(_by_fingerprint(nodes.select("node", "fp"), radius), "near")
    some = table.select("node").unionByName(near.select(F.col("u").alias("node"))).unionByName(near.select(F.col("v").alias("node"))).distinct()
    wanted = nodes.select("node", "key").join(some, "node")
    sets = stage(_sets(docs, wanted, id_col, text_col, words), "sets")

    def fits(m: str, n: str):  # sets of sizes further apart than this cannot be as alike
        return (F.least(m, n) * least.denominator) >= (F.greatest(m, n) * least.numerator)

    order = Window.partitionBy("band").orderBy("n", "node")
    after = table.withColumns({"v": F.lead("node").over(order), "vn": F.lead("n").over(order)}).where(F.col("v").isNotNull() & fits("n", "vn"))
    ends = lambda u, v: (F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    pairs = after.select(*ends("node", "v")).unionByName(near.select(*ends("u", "v"))).distinct()
    first = stage(_verified(pairs, sets, least), "pairs")

    rooted = table.join(components(first), "node", "left").select("band", "n", "node", F.coalesce("root", "node").alias("root"))
    parted = rooted.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("band")
    # What is left are nodes that share a band with another component. Of two sets as alike as asked for, the rarest
    # shingles have one in common (as many of each as it may lack, and one more): a passage that many texts share brings no pairs.
    # At the first shingle that both have, what is left of either set bounds what they share.
    open_nodes = rooted.join(parted, "band").select("node", "root", "n").distinct()
    each = sets.join(open_nodes, "node").select("node", "root", "n", F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("df"), F.min("root").alias("least"), F.max("root").alias("most"))
    need = F.col("n") - F.ceil(F.col("n") * least.numerator / least.denominator - 1e-9) + 1
    rarest = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))
    keys = each.join(counts, "s").withColumn("nth", rarest).where((F.col("nth") <= need) & (F.col("least") < F.col("most")))
    keys = stage(keys.select("s", "node", "root", "n", (F.col("n") - F.col("nth") + 1).alias("left")), "rarest")
    a, b = keys.alias("a"), keys.alias("b")
    enough = F.least("a.left", "b.left") * (least.numerator + least.denominator) >= (F.col("a.n") + F.col("b.n")) * least.numerator
    rest = a.join(b, "s").where((F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & fits("a.n", "b.n") & enough)
    rest = rest.select(*ends("a.node", "b.node")).distinct()
    return first.unionByName(_verified(rest, sets, least))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: str = "0.8", radius: int = 4) -> DataFrame:
    """One row of each component, that of the smallest id (rows without id last), with all columns of ``docs``.

    Rows link if the sets of their shingles have a Jaccard similarity of ``least`` or more; rows without words link to
    each other only. Equal rows are one; null texts have no words; an empty table gives an empty result.
    """
    marked = stage(_marked(docs, id_col, text_col, words), "signatures")
    roots = components(_edges(docs, marked, id_col, text_col, words, Fraction(least), radius)).withColumnRenamed("node", "node_")
    rooted = marked.select("doc_id", "key", "node").join(roots, F.col("node") == F.col("node_"), "left")
    return keep_rows(docs, rooted.select("doc_id", "key", F.coalesce("root", "node").alias("root")), id_col, text_col)
