"""The ``works`` table of research documents, as a view over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.sources.tables import table


def works(spark: SparkSession, sf_dir: str, **derived: Column) -> DataFrame:
    """One row per document with bibliographic columns derived from its id, and its embedding if it has one.

    The title, and what else is ``derived`` from title and abstract, is made where the documents are read, so that no
    text goes through the joins for them.
    """
    docs = table(spark, sf_dir, "documents").withColumns({"title": F.substring("text", 1, 60), "abstract": F.col("text")}).withColumns(derived)
    noise = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    i = F.col("doc_id")
    return (
        docs.join(noise, "doc_id", "left")
        .join(vectors, "doc_id", "left")
        .select(
            i.alias("id"),
            "title",
            "abstract",
            F.col("source").alias("venue"),
            "lang",
            (1985 + i % 41).cast("int").alias("year"),
            F.when(i % 11 != 0, (i * 37) % 600).cast("int").alias("citation_count"),
            F.when(i % 7 != 6, i % 6).cast("int").alias("sms_level"),
            F.when(i % 3 == 0, "journal_article").when(i % 3 == 1, "working_paper").alias("publication_type"),
            F.when(i % 5 == 1, "4*").when(i % 5 == 2, "4").when(i % 5 == 3, "3").when(i % 5 == 4, "2").alias("abs_rating"),
            F.when(i % 9 != 0, (i * 13) % 100).cast("int").alias("repec_percentile"),
            F.when(i % 4 == 0, "LAC").when(i % 4 == 1, "MENA").when(i % 4 == 2, "Europe & Central Asia").alias("region"),
            F.concat(F.lit("topic"), (i % 5).cast("string")).alias("topic"),
            F.concat(F.lit("surname"), (i % 23).cast("string")).alias("surname"),
            (i % 29 == 0).alias("excluded"),
            (F.coalesce("toxic", F.lit(0)) == 1).alias("is_noise"),
            F.when((i % 17 == 0) & (i > 0), i - 1).alias("canonical_work_id"),
            "embedding",
            *derived,
        )
    )


def is_searchable() -> Column:
    """Rows that searches may return: embedded, neither excluded nor noise, and no shadow of another row."""
    flagged = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.col("embedding").isNotNull() & ~flagged("excluded") & ~flagged("is_noise") & F.col("canonical_work_id").isNull()


def searchable(rows: DataFrame) -> DataFrame:
    return rows.where(is_searchable())


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the vector that stands for the embedded query."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


#: The same view in SQL, to be put after WITH.
WORKS_SQL = """
works AS (
  SELECT d.doc_id AS id, substr(d.text, 1, 60) AS title, d.text AS abstract, d.source AS venue, d.lang,
    CAST(1985 + d.doc_id % 41 AS INTEGER) AS year,
    CASE WHEN d.doc_id % 11 <> 0 THEN CAST((d.doc_id * 37) % 600 AS INTEGER) END AS citation_count,
    CASE WHEN d.doc_id % 7 <> 6 THEN CAST(d.doc_id % 6 AS INTEGER) END AS sms_level,
    CASE d.doc_id % 3 WHEN 0 THEN 'journal_article' WHEN 1 THEN 'working_paper' END AS publication_type,
    CASE d.doc_id % 5 WHEN 1 THEN '4*' WHEN 2 THEN '4' WHEN 3 THEN '3' WHEN 4 THEN '2' END AS abs_rating,
    CASE WHEN d.doc_id % 9 <> 0 THEN CAST((d.doc_id * 13) % 100 AS INTEGER) END AS repec_percentile,
    CASE d.doc_id % 4 WHEN 0 THEN 'LAC' WHEN 1 THEN 'MENA' WHEN 2 THEN 'Europe & Central Asia' END AS region,
    'topic' || (d.doc_id % 5) AS topic, 'surname' || (d.doc_id % 23) AS surname,
    d.doc_id % 29 = 0 AS excluded, coalesce(l.toxic, 0) = 1 AS is_noise,
    CASE WHEN d.doc_id % 17 = 0 AND d.doc_id > 0 THEN d.doc_id - 1 END AS canonical_work_id,
    CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id
), searchable AS (
  SELECT * FROM works WHERE embedding IS NOT NULL AND NOT excluded AND NOT is_noise AND canonical_work_id IS NULL
), scored AS (
  SELECT s.*, round(list_cosine_similarity(s.embedding, q.q), 6) AS cosine
  FROM searchable s, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) q
)
"""
