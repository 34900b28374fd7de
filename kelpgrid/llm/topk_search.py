"""Exact top-k search by inner product with a table of distances to pivots.

Vectors are scaled to integers. Every row keeps its distances to ``n_pivots`` pivots; for a query q
and a row x, max over pivots p of |d(q, p) - d(x, p)| bounds d(q, x) from below, and so
(|q|^2 + |x|^2 - bound^2) / 2 bounds the inner product from above. The table of distances is made once and travels
with the rows. Rows and queries meet in a grid of lanes, each pair once; a lane is sorted by nearest pivot and
distance to it and read as chunks, of which some are held at a time and visited in the order of their intervals' bounds.
A chunk whose intervals exclude it is passed over for a query; of the others the rows of the highest
bounds are evaluated first, then all that the k-th best score so far does not exclude.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpgrid.llm.staging import bounded_sample, shuffle_partitions, stage

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)


def scaled(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null if the vector holds a null, NaN or infinity."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of b with a; saturates at the limits of a long."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[-1])
    if most < 2**52:
        return (b.astype(np.float64) @ a.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return b @ a.T
    return np.clip(b.astype(object) @ a.T.astype(object), LONG_MIN, LONG_MAX).astype(np.int64)


def choose_pivots(sample: np.ndarray, n_pivots: int) -> np.ndarray:
    """Farthest-first traversal of the sample, starting from its first row."""
    x = sample.astype(np.float64)
    chosen, nearest = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n_pivots, len(x)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * (x @ p.T), 0))


class Searcher:
    """The k best (score, smaller id) other rows of each query among the rows shown to it; counts what it evaluates."""

    def __init__(self, k: int, ids: np.ndarray, q: np.ndarray, dist: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, block: int = 256):
        self.k, self.ids, self.q, self.dist, self.block = k, ids, q, dist.astype(np.float32), block
        self.norm = (q.astype(np.float64) ** 2).sum(1)
        self.found = [np.zeros(0, np.int64)] * 3  # query, score, id
        self.floor = np.full(len(ids), -1e300)  # what a k-th best score is at least
        self.pairs = self.evaluated = 0
        for a in range(0, len(ids), block) if len(sample) >= k + 1 else ():
            known = _exact_scores(sample, q[a : a + block]).astype(np.float64)
            known[ids[a : a + block, None] == sample_ids[None, :]] = -np.inf
            self.floor[a : a + block] = np.partition(known, -k, axis=1)[:, -k]

    def _add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        every = [np.concatenate(x) for x in zip(self.found, (query, score, vec))]
        order = np.lexsort((every[2], -every[1], every[0]))
        query = every[0][order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        self.found = [x[order][nth < self.k] for x in every]
        last = nth == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], every[1][order][last])

    def show(self, chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """``ids, vectors, distances`` of chunks of rows; each block of queries visits them in the order of their bounds."""
        least = np.stack([d.min(0) for _, _, d in chunks])
        most = np.stack([d.max(0) for _, _, d in chunks])
        norms = [(x.astype(np.float64) ** 2).sum(1) for _, x, _ in chunks]
        top = np.array([n.max() for n in norms])
        error = 2.5e-7 * (self.dist.max(0, initial=0) + most.max(0))  # above the rounding of single-precision distances to each pivot
        for a in range(0, len(self.ids), self.block):
            mine = np.arange(a, min(a + self.block, len(self.ids)))
            apart = (np.maximum(self.dist[mine, None, :] - most, least - self.dist[mine, None, :]) - error).max(2).clip(0).astype(np.float64)
            slack = 2e-6 * (1 + self.norm[mine].max(initial=0) + top.max())  # above the rounding of the squares
            upper = (self.norm[mine, None] + top - apart**2) / 2 + slack
            for c in np.argsort(-upper.max(0), kind="stable").tolist():
                self.pairs += len(mine) * len(chunks[c][0])
                near = mine[upper[:, c] >= self.floor[mine]]
                if len(near):
                    self._chunk(near, *chunks[c], norms[c], slack, error)

    def _chunk(self, near: np.ndarray, ids: np.ndarray, x: np.ndarray, dist: np.ndarray, norm: np.ndarray, slack: float, error: np.ndarray, first: int = 16) -> None:
        bound, step = np.zeros((len(near), len(ids)), np.float32), np.empty((len(near), len(ids)), np.float32)
        across = np.ascontiguousarray(dist.T)
        for p in range(dist.shape[1]):
            np.subtract(self.dist[near, p][:, None], across[p][None, :], out=step)
            np.abs(step, out=step)
            np.subtract(step, error[p], out=step)
            np.maximum(bound, step, out=bound)
        bound = np.square(bound, dtype=np.float32 if self.dist.max(initial=0) + dist.max() < 1e18 else np.float64)
        upper = (self.norm[near, None] + norm[None, :] - bound) / 2 + slack
        upper[self.ids[near][:, None] == ids[None, :]] = -np.inf
        if len(ids) > 4 * first:
            best = np.argpartition(-upper, first, axis=1)[:, :first]
            open_ = np.take_along_axis(upper, best, 1) >= self.floor[near][:, None]
            row, col = np.nonzero(open_)
            self._evaluate(near[row], best[row, col], ids, x)
            upper[row, best[row, col]] = -np.inf
        open_ = upper >= self.floor[near][:, None]
        some = np.flatnonzero(open_.any(0))
        for at in range(0, len(some), 512):  # dense products of the columns that some query leaves open
            part = some[at : at + 512]
            scores, mask = _exact_scores(x[part], self.q[near]), open_[:, part]
            self.evaluated += int(mask.sum())
            row, col = np.nonzero(mask & (scores >= self.floor[near][:, None]))
            self._add(near[row], scores[row, col], ids[part[col]])

    def _evaluate(self, query: np.ndarray, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.evaluated += len(query)
        for a in range(0, len(query), 1 << 14):
            one, row = query[a : a + (1 << 14)], at[a : a + (1 << 14)]
            scores = _paired_scores(self.q[one], x[row])
            good = scores >= self.floor[one]
            self._add(one[good], scores[good], ids[row[good]])

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.found[0]], "vec_id": self.found[2], "score": self.found[1]}).astype(np.int64)


def _paired_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b, one by one; saturates at the limits of a long."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[-1])
    if most < 2**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.clip((a.astype(object) * b.astype(object)).sum(1), LONG_MIN, LONG_MAX).astype(np.int64)


def _index_rows(pivots: np.ndarray, dtype: np.dtype) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The table: each row's vector, distances to the pivots, nearest pivot and distance to that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x = np.stack(rows.vec.to_numpy())
                d = _distances(x, pivots)
                data = {"vec": [v.tobytes() for v in x.astype(dtype)], "dist": [v.tobytes() for v in d.astype(np.float32)]}
                yield pd.DataFrame({"vec_id": rows.vec_id, **data, "cell": d.argmin(1).astype(np.int32), "ring": d.min(1)})

    return run


def _search(dim: int, n_pivots: int, dtype: np.dtype, k: int, sample_ids: np.ndarray, sample: np.ndarray, chunk_rows: int, held_chunks: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(rows.vec), dtype).reshape(len(rows), dim)  # vectors without components score 0
        return rows.vec_id.to_numpy(np.int64), x.astype(np.int64), np.frombuffer(b"".join(rows.dist), np.float32).reshape(-1, n_pivots)

    def chunks(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of rows of one cell, of at most ``chunk_rows``."""
        ids, x, d = arrays(rows)
        cell = rows.cell.to_numpy()
        starts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(ids)]
        cuts = [(i, min(i + chunk_rows, b)) for a, b in zip(starts, starts[1:]) for i in range(a, b, chunk_rows)]
        return [(ids[a:b], x[a:b], d[a:b]) for a, b in cuts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, searcher, asked, held, size = None, None, [], [], 0

        def show() -> None:
            nonlocal searcher, held, size
            if searcher is None:
                ids, q, d = arrays(pd.concat(asked)) if asked else (np.zeros(0, np.int64), np.zeros((0, dim), np.int64), np.zeros((0, n_pivots), np.float32))
                searcher = Searcher(k, ids, q, d, sample_ids, sample)
            if held and len(searcher.ids):
                searcher.show(chunks(pd.concat(held)))
            held, size = [], 0

        for every in batches:
            for at, rows in every.groupby("lane", sort=True):
                if at != lane:
                    if lane is not None:
                        show()
                        yield searcher.frame()
                    lane, searcher, asked = at, None, []
                ask = (rows.kind == 0).to_numpy()
                if ask.any():
                    asked.append(rows[ask])
                if not ask.all():
                    held.append(rows[~ask])
                    size += int((~ask).sum())
                    if size >= held_chunks * chunk_rows:
                        show()
        if lane is not None:
            show()
            yield searcher.frame()

    return run


def top_k(
    embeddings: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    n_pivots: int = 32,
    sample_rows: int = 1024,
    chunk_rows: int = 2048,
    held_chunks: int = 16,
    lane_queries: int = 8192,
    max_lengths: int = 64,
) -> DataFrame:
    """The k best other rows of each query row: ``query_id, rank, vec_id, score``, ties to the smaller id.

    ``is_query`` marks the query rows by their id. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; repeated rows of an id count once (the
    smallest vector). Vectors are compared within one length (more than ``max_lengths`` raise); scores beyond a long saturate. An empty
    table gives an empty result; other columns are not read. Pivots come from a sample bounded by
    ``sample_rows`` (least hashes of the id); every row is indexed and the result is exact. A task holds
    ``lane_queries`` queries and ``held_chunks`` chunks at a time, whatever the size of the table.
    """
    spark = embeddings.sparkSession
    rows = (
        embeddings.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("vec"))
        .where("vec_id is not null and vec is not null")
        .groupBy("vec_id")
        .agg(F.min("vec").alias("vec"))
    )
    rows = stage(rows, "vectors")
    largest = F.max(F.aggregate("vec", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double")))))
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.sum(is_query(F.col("vec_id")).cast("long")).alias("asked"), largest.alias("largest")).limit(max_lengths + 1).collect()
    if len(lengths) > max_lengths:
        raise ValueError(f"vectors of more than {max_lengths} different lengths")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    found = spark.createDataFrame([], schema)
    for r in sorted(lengths, key=lambda r: r.dim):
        if r.asked:
            dtype = np.dtype(next((t for t, most in (("<i2", 2**15), ("<i4", 2**31)) if r.largest < most), "<i8"))
            down = max(1, -(-r.asked // lane_queries), round((shuffle_partitions(spark) / 50) ** 0.5))
            found = found.unionByName(_top_k_of_length(rows.where(F.size("vec") == r.dim), r.dim, dtype, is_query, k, n_pivots, sample_rows, chunk_rows, held_chunks, down))
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top_k_of_length(rows: DataFrame, dim: int, dtype: np.dtype, is_query, k: int, n_pivots: int, sample_rows: int, chunk_rows: int, held_chunks: int, down: int) -> DataFrame:
    """A grid of ``down`` rows of lanes: a row of the table goes to one column in every row, a query to one row in every column."""
    tasks = shuffle_partitions(rows.sparkSession)
    sample = bounded_sample(rows, "vec_id", sample_rows).collect()
    values = np.array([list(r.vec) for r in sample], np.int64).reshape(len(sample), dim)
    pivots = choose_pivots(values, n_pivots)
    across = max(1, -(-tasks // down))
    indexed = rows.mapInPandas(_index_rows(pivots, dtype), "vec_id long, vec binary, dist binary, cell int, ring double")
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id")), F.lit(n)).cast("int")
    lanes = lambda n, lane, kind: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(lane(i).alias("lane"), F.lit(kind).alias("kind")))
    own = lanes(down, lambda i: i * across + place(across, "column"), 1)
    asked = lanes(across, lambda i: place(down, "row") * across + i, 0)
    roles = F.explode(F.concat(own, F.when(is_query(F.col("vec_id")), asked).otherwise(F.slice(own, 1, 0))))
    dealt = indexed.withColumn("role", roles).select("role.lane", "role.kind", "cell", "ring", "vec_id", "vec", "dist")
    dealt = dealt.repartitionById(down * across, F.col("lane")).sortWithinPartitions("lane", "kind", "cell", "ring", "vec_id")
    run = _search(dim, len(pivots), dtype, k, np.array([r.vec_id for r in sample], np.int64), values, chunk_rows, held_chunks)
    return dealt.select("lane", "kind", "cell", "vec_id", "vec", "dist").mapInPandas(run, "query_id long, vec_id long, score long")
