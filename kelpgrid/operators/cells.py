"""A stored vector index: a table in cells, which an exact search reads only as far as their bounds demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.functions.vector import cosine, cosine_to, literal, only_row
from kelpgrid.operators.search import ranked

ROUNDED = 1e-6  # scores are rounded; a bound this much below the floor still counts


def build_cells(rows: DataFrame, path: str, cells: int = 64, vector_col: str = "embedding") -> None:
    """Writes ``path/rows``, in folders by cell, and ``path/cells`` (cell, centre, angle, n).

    Centres are the ``cells`` vectors of the least hashes of their ids, a bounded sample; every row goes to the centre of the
    largest cosine (ties to the first), and a cell's angle is that of its farthest row. Rows without a vector, or with one
    of another length, are in cell -1, which is always read.
    """
    spark = rows.sparkSession
    sized = rows.where(F.col(vector_col).isNotNull())
    sample = sized.select("id", F.col(vector_col).alias("v"), F.xxhash64("id").alias("h")).orderBy("h", "id").limit(cells).collect()
    width = max((len(r.v) for r in sample), default=0)
    centres = [[float(x) for x in r.v] for r in sample if len(r.v) == width and any(r.v)]
    found = sized.withColumn("cell", F.lit(-1)).withColumn("near", F.lit(0.0))
    if centres:
        every = F.array(*[literal(c) for c in centres])
        near = F.transform(every, lambda c: cosine(F.col(vector_col), c))
        placed = sized.withColumn("nears", near)
        inside = (F.size(vector_col) == width) & (F.array_max("nears") != 0)
        cell = F.when(inside, F.array_position("nears", F.array_max("nears")).cast("int") - 1).otherwise(-1)
        found = placed.withColumn("cell", cell).withColumn("near", F.array_max("nears")).drop("nears")
    found.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.acos(F.least(F.min("near"), F.lit(1.0))).alias("angle"), F.count("*").alias("n"))
    named = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    held.join(named, "cell", "left").write.parquet(f"{path}/cells")


def bounds(spark: SparkSession, path: str, vector: list[float]) -> list[tuple[int, float, int]]:
    """``cell, bound, n`` of the cells, best first: no row of a cell has a larger cosine than its bound."""
    apart = F.acos(F.greatest(F.least(cosine_to(F.col("centre"), vector), F.lit(1.0)), F.lit(-1.0)))
    bound = F.coalesce(F.cos(F.greatest(apart - F.col("angle"), F.lit(0.0))), F.lit(1.0))
    found = spark.read.parquet(f"{path}/cells").select("cell", bound.alias("bound"), "n").collect()  # a row for each cell
    return sorted(((r.cell, r.bound, r.n) for r in found), key=lambda x: (-x[1], x[0]))


def cell_rows(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(cells))


def index_cosine_top_k(spark: SparkSession, path: str, query: DataFrame, k: int = 20, threshold: float = 0.0, vector_col: str = "embedding") -> DataFrame:
    """``id, cosine, rank``: the k rows of the largest cosine of at least ``threshold``, exactly.

    The cells of the best bounds that hold k rows give a floor; then all cells whose bound reaches the floor are
    read, and no other. Both reads name their cells, so that only their folders are listed.
    """
    vectors = only_row(query)
    if not vectors:
        return cell_rows(spark, path, [-2]).select("id", F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"))
    vector = [float(x) for x in vectors[0].q]
    scored = lambda cells: cell_rows(spark, path, cells).select("id", F.round(cosine_to(F.col(vector_col), vector), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    order = bounds(spark, path, vector)
    first, rows = [], 0
    for cell, _, n in order:
        if rows >= k:
            break
        first.append(cell)
        rows += n
    best = scored(first).orderBy(F.desc("cosine")).limit(k).agg(F.min("cosine").alias("floor"), F.count("*").alias("n")).first()
    floor = max(threshold, best.floor) if best.n == k else threshold
    return ranked(scored([c for c, b, _ in order if b >= floor - ROUNDED]), "cosine", k)
