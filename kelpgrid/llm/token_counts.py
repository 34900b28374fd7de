"""Exact token counts for every context limit from the histogram of encoded lengths.

Documents are aggregated by their encoded length. Sums over the lengths from a limit on (suffix sums) then
answer, for every limit, how many documents are longer, how many tokens there are in all, how many remain
when each document is cut at the limit, and which share of the documents fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.llm.staging import id_text, stage, with_long_id
from kelpgrid.llm.tokens import word_tokenizer

BUCKET = 1024


def encoded_lengths(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, length`` of every row: the number of ids of its whole text; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = word_tokenizer(tokenizer_path)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows.doc_id, "length": [len(d) // tokenizer.dtype.itemsize for d in tokenizer.encoded(rows.text.tolist())]})

    picked = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_long_id(picked.mapInPandas(run, "doc_id string, length long"))


def histogram(lengths: DataFrame) -> DataFrame:
    """``length, docs``: documents of each length."""
    return lengths.groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """``length, docs, docs_longer, tokens_longer, total_docs, total_tokens, truncated_total, fits`` for every length as the limit.

    docs_longer and tokens_longer are of the documents longer than the limit, truncated_total the tokens left if
    every document is cut at the limit, fits the share of the documents that it holds whole. Sums run over
    buckets of lengths first and then within each, so that no task orders all lengths.
    """
    marked = hist.withColumn("bucket", F.floor(F.col("length") / BUCKET)).withColumn("tokens", F.col("length") * F.col("docs"))
    after = Window.partitionBy("one").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("one")
    buckets = marked.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).withColumn("one", F.lit(1))
    none = F.lit(0).cast("long")
    buckets = buckets.select(
        "bucket",
        F.coalesce(F.sum("d").over(after), none).alias("d_after"),
        F.coalesce(F.sum("t").over(after), none).alias("t_after"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    inner = Window.partitionBy("bucket").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    inside = marked.withColumns({"d_in": F.coalesce(F.sum("docs").over(inner), none), "t_in": F.coalesce(F.sum("tokens").over(inner), none)})
    joined = inside.join(buckets, "bucket")
    longer, tokens = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    return joined.select(
        "length",
        "docs",
        longer.alias("docs_longer"),
        tokens.alias("tokens_longer"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens + longer * F.col("length")).alias("truncated_total"),
        F.round(1 - longer / F.col("total_docs"), 9).alias("fits"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_longer, truncated_total`` for any limits: the largest length up to a limit has its sums."""
    each = F.explode(F.array(*[F.lit(x).cast("long") for x in sorted(set(limits))]))
    asked = sums.select("length", "docs_longer", "tokens_longer", "total_docs", "total_tokens", each.alias("context_limit"))
    inside = F.col("length") <= F.col("context_limit")
    last = F.max(F.when(inside, F.struct("length", "docs_longer", "tokens_longer"))).alias("last")
    grouped = asked.groupBy("context_limit").agg(last, F.first("total_docs").alias("n"), F.first("total_tokens").alias("t"))
    longer, tokens = F.coalesce(F.col("last.docs_longer"), F.col("n")), F.coalesce(F.col("last.tokens_longer"), F.col("t"))
    return grouped.select("context_limit", longer.alias("docs_longer"), (F.col("t") - tokens + longer * F.col("context_limit")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the least length that holds at least each share of the documents whole."""
    each = F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(shares))]))
    asked = sums.select("length", "docs_longer", "total_docs", each.alias("share"))
    fits = F.col("total_docs") - F.col("docs_longer") >= F.ceil(F.col("share") * F.col("total_docs"))
    return asked.where(fits).groupBy("share").agg(F.min("length").alias("length"))


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`suffix_sums` of all rows of ``docs``, one row for each length that occurs.

    Repeated rows count each, ids are not looked at; an empty table gives an empty result; other columns are not read.
    """
    counted = histogram(encoded_lengths(docs, tokenizer_path, id_col, text_col))
    return suffix_sums(stage(counted, "histogram"))  # a row for each length; the sums read it more than once, the texts are encoded once
