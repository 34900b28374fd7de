"""Duplicates by exact keys, by fuzzy titles among candidates of one block, and across sources."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.sources.stored import written


def first_of_each(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows without a key are all kept, and never meet in one task."""
    keyed = rows.withColumn("key_", key)
    nth = F.row_number().over(Window.partitionBy("key_").orderBy(*order))
    first = keyed.where("key_ is not null").withColumn("nth_", nth).where("nth_ = 1").drop("nth_")
    return first.unionByName(keyed.where("key_ is null")).drop("key_")


def duplicate_pairs(rows: DataFrame, key: Column) -> DataFrame:
    """``first_id, other_id``: every row of a key against the one of the smallest id."""
    keyed = rows.select("id", key.alias("key")).where("key is not null")
    first = keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, "key").where("id > first_id").select("first_id", F.col("id").alias("other_id"))


def with_provenance(rows: DataFrame, key: Column) -> DataFrame:
    """One row per key, that of the first source order, with all sources that had it."""
    keyed = rows.withColumn("key", key)
    return keyed.groupBy("key").agg(F.min(F.struct("source_order", "id")).alias("f"), F.array_join(F.array_sort(F.collect_set("source_name")), ",").alias("sources"), F.count("*").alias("n")).select("key", F.col("f.id").alias("id"), "sources", "n")


def edit_pieces(least: float = 90.0):
    """Pieces by which texts within an edit distance of (100 - least) percent of the longer one's length meet.

    A text of n characters is cut into one piece more than it may have edits, one of which the other text then holds
    unchanged. The other text, as long or longer, shows for every length that it may meet the substrings that can be such
    a piece: an unchanged piece lies no further off than the edits before and after it allow. Two functions of a text
    that yield (length of the cut text, number of the piece, piece).
    """
    share = (100.0 - least) / 100.0

    def cuts(n: int) -> list[int]:
        parts = min(n, int(n * share / (1 - share) + 1e-9) + 1)
        return [n * i // parts for i in range(parts + 1)]

    def own(t: str) -> Iterator[tuple[int, int, str]]:
        n, marks = len(t), cuts(len(t))
        for i, (a, b) in enumerate(zip(marks, marks[1:])):
            yield n, i, t[a:b]

    def met(t: str) -> Iterator[tuple[int, int, str]]:
        n = len(t)
        most = int(n * share + 1e-9)
        for m in range(max(1, n - most), n + 1):
            more = n - m
            left, right, marks = (most - more) // 2, (most + more) // 2, cuts(m)
            for i, (a, b) in enumerate(zip(marks[: most + 1], marks[1:])):
                low, high = max(-left, -i, more - (most - i)), min(right, i, more + most - i)
                for part in {t[at : at + b - a] for at in range(max(0, a + low), min(a + high, n - (b - a)) + 1)}:
                    yield m, i, part

    return own, met


def fuzzy_first(rows: DataFrame, least: float = 90.0) -> DataFrame:
    """``id, kept_id``: each row and the smallest id among itself and the rows of a near equal title and the same or no year.

    Titles are near if the edit distance of their words in order is at most (100 - least) percent of the longer one's length.
    Equal ones of a year are one before anything is compared; of the others those meet that share a year and a piece which so
    few edits must leave unchanged (:func:`edit_pieces`), and are then compared whole. No near pair is lost; a null title is empty.
    """
    title = F.coalesce(F.array_join(F.array_sort(X.tokens(F.col("title"))), " "), F.lit(""))
    ready = written(rows.select("id", F.coalesce("year", F.lit(0)).alias("year"), title.alias("t")), "titles")
    each = written(ready.groupBy("t", "year").agg(F.min("id").alias("first")), "distinct-titles")  # ``first`` tells them apart
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    titles = each.where("t <> ''").repartition(parts)  # few bytes, but many pieces
    some_without = each.where("year = 0").limit(1).count() > 0

    def pieces(of, name: str, groups: Column) -> DataFrame:
        """``name, piece, group``: a piece as a number, by which equal ones meet; what else meets by it is told apart by the whole titles."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 200):
                    block = batch.iloc[at : at + 200]
                    found = [(first, year, n << 40 | i << 32 | zlib.crc32(part.encode())) for first, year, t in zip(block["first"], block["year"], block["t"]) for n, i, part in of(t)]
                    yield pd.DataFrame(found, columns=[name, "year", "piece"])

        return titles.mapInPandas(run, f"{name} long, year int, piece long").select(name, "piece", F.explode(groups).alias("group"))

    own, met = edit_pieces(least)
    # Titles meet within their year. Those without one meet all: as 0 where they are cut, as -1 where they show their substrings.
    year = F.col("year")
    own_groups = F.array(year, F.lit(-1)) if some_without else F.array(year)
    met_groups = F.when(year == 0, F.array(F.lit(-1))).otherwise(F.array(year, F.lit(0))) if some_without else F.array(year)
    # The size of what Python makes is not estimated: both sides are shuffled, whatever the titles' size.
    met_by = pieces(own, "a", own_groups).hint("merge").join(pieces(met, "b", met_groups), ["group", "piece"]).where("a <> b")
    pairs = met_by.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    text = lambda c: each.select(F.col("first").alias(c), F.col("t").alias(f"{c}_t"))
    longer = F.greatest(F.length("lo_t"), F.length("hi_t"))
    near = pairs.join(text("lo"), "lo").join(text("hi"), "hi").where((longer > 0) & (100.0 * (1 - F.levenshtein("lo_t", "hi_t") / longer) >= least))
    earlier = near.groupBy(F.col("hi").alias("first")).agg(F.min("lo").alias("earlier"))
    kept = each.join(earlier, "first", "left").select("t", "year", F.coalesce("earlier", "first").alias("kept_id"))
    return ready.join(kept, ["t", "year"]).select("id", "kept_id")


def ranked_pairs(works: DataFrame, least_length: int = 30, years: int = 8, same_surname: bool = False) -> DataFrame:
    """``shadow_id, canonical_id, r``: rows of one long title near in years, the second of a higher publication rank r."""
    from kelpgrid.functions.numeric import publication_rank

    keyed = works.withColumn("t", X.normalize_title(F.col("title"))).withColumn("r", publication_rank(F.col("publication_type"))).where(F.length("t") >= least_length).select("id", "t", "r", "year", "surname")
    a, b = keyed.alias("a"), keyed.alias("b")
    near = (F.col("a.r") > F.col("b.r")) & (F.abs(F.col("a.year") - F.col("b.year")) <= years)
    if same_surname:
        near = near & F.coalesce(F.col("a.surname") == F.col("b.surname"), F.lit(True))
    return a.join(b, F.col("a.t") == F.col("b.t")).where(near).select(F.col("a.id").alias("shadow_id"), F.col("b.id").alias("canonical_id"), F.col("b.r").alias("r"))


def best_ranked(works: DataFrame, least_length: int = 30, years: int = 8) -> DataFrame:
    """``shadow_id, canonical_id``: for each row the best of :func:`ranked_pairs`, the smallest rank and then id, without the pairs.

    Of the rows of one title, year and rank only the smallest id can be best. These few representatives of a title are
    all that a row of it looks at: the work is in proportion to the rows however many have one title. A column ``t`` is
    the normalised title, if there is one.
    """
    from kelpgrid.functions.numeric import publication_rank

    t = F.col("t") if "t" in works.columns else X.normalize_title(F.col("title")).alias("t")
    keyed = works.select("id", "year", t, publication_rank(F.col("publication_type")).alias("r")).where(F.length("t") >= least_length)
    first = keyed.groupBy("t", "r", "year").agg(F.min("id").alias("id")).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("r", "id", "year"))).alias("first"))
    near = F.filter("first", lambda b: (b.r < F.col("r")) & (F.abs(b.year - F.col("year")) <= years))
    return keyed.join(first, "t").select(F.col("id").alias("shadow_id"), F.get(near, F.lit(0)).id.alias("canonical_id")).where("canonical_id is not null")


def merge_shadows(works: DataFrame, pairs: DataFrame) -> DataFrame:
    """Works with ``shadow_of``; a canonical row takes its shadow's larger citation count, and its region where it has none."""
    from kelpgrid.operators.joins import fill_from

    given = pairs.select(F.col("shadow_id").alias("source_id"), F.col("canonical_id").alias("id"))
    merged = fill_from(works, works, given, ["citation_count", "region"], ("citation_count",))
    return merged.join(pairs.select(F.col("shadow_id").alias("id"), F.col("canonical_id").alias("shadow_of")), "id", "left")


def cross_source_shadows(works: DataFrame, years: int = 8) -> DataFrame:
    """``shadow_id, canonical_id``: a working paper and the one article of the same title near its year, both unique to each other."""
    from kelpgrid.operators.joins import mutual_pairs

    keyed = works.withColumn("t", X.normalize_title(F.col("title"))).where("length(t) > 0")
    papers, articles = keyed.where("publication_type = 'working_paper'"), keyed.where("publication_type = 'journal_article'")
    near = F.abs(F.col("l.year") - F.col("r.year")) <= years
    return mutual_pairs(papers, articles, "t", near).select(F.col("left_id").alias("shadow_id"), F.col("right_id").alias("canonical_id"))


def fuzzy_shadows(works: DataFrame, least_length: int = 30, years: int = 8) -> DataFrame:
    """``shadow_id, canonical_id``: for each row the best-ranked other row of the same long title near its year; chains are left out."""
    best = written(best_ranked(works, least_length, years), "best-ranked")
    return best.join(best.select(F.col("shadow_id").alias("canonical_id")), "canonical_id", "left_anti").select("shadow_id", "canonical_id")
