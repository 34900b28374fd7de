"""Exact divergence of sources by inclusion and exclusion over their supports.

A term's part in the divergence of two groups is ``f(p, q)``. Most terms of a large vocabulary occur in one of two groups or
in neither, and there f depends on a count only. So a histogram of each group's counts prices its terms as if the
other group had none, constants price the terms that neither has, and only terms that both have are met one by one, by a
join of postings, which corrects their price. Nothing has a row for each term and group that does not occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.llm.staging import stage

#: What parts terms: everything in ASCII that is no letter.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000


def terms(text: Column) -> Column:
    """The terms of a text in order: runs of letters and of anything beyond ASCII, only A-Z lower-cased."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN), "")


def price(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` of longs up to a billion and one."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (total + 2 kept))``, exact for any long."""
    wide = lambda x: x.cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(2 * kept)))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a group and the documents that hold it, texts read once."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    words = docs.select(lang.alias("lang"), source.alias("source"), terms(text).alias("w"))
    # All occurrences, and each distinct term of a document once more. The outer forms keep Spark from putting a filter on the
    # size of the arrays before, which would split every text twice.
    both = words.select("lang", "source", F.posexplode_outer(F.array("w", F.array_distinct("w"))).alias("once", "terms"))
    each = both.select("lang", "source", "once", F.explode_outer("terms").alias("term")).where("term is not null")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def audit(docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: every group's divergence from the other sources of its language, and the terms that it overuses.

    Kept are the terms in at least ``least`` documents of a language. Part ``pair`` has each other source; part ``term`` the
    ``top`` terms of a group with the largest price against its language. Null texts, languages and sources are empty strings;
    repeated rows count each; groups without terms have pairs and no terms; without kept terms values are 0; an
    empty table gives an empty result; other columns are not read.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    occurring = docs.select(lang.alias("lang"), source.alias("source")).distinct()
    counts = stage(term_counts(docs, text_col, lang_col, source_col), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    postings = stage(counts.where("n > 0").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "postings")
    langs = postings.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_total"))
    held = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    zero = F.lit(0).cast("long")
    sized = occurring.join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "support", "v", "lang_total"])
    groups = stage(sized.withColumn("p0", share(zero, F.col("total"), F.col("v"))), "groups")  # a row for each group

    side = lambda x: groups.select("lang", *[F.col(c).alias(c + x) for c in ("source", "total", "support", "p0")], "v")
    ordered = side("_g").join(side("_h").drop("v"), "lang").where(F.col("source_g") != F.col("source_h"))  # the result has a row for each
    # One-sided prices of g's terms against h, all terms of one count at once.
    histogram = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).withColumnRenamed("source", "source_g")
    prices = ordered.join(histogram, ["lang", "source_g"]).groupBy("lang", "source_g", "source_h").agg(F.sum(F.col("terms") * price(share(F.col("n"), F.col("total_g"), F.col("v")), F.col("p0_h"))).alias("one_sided"))
    # Corrections of the terms that both have.
    sources = groups.select("lang", "source", "total", "v", "p0")
    priced = postings.join(sources, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0")
    left = priced.select("lang", "term", F.col("source").alias("source_g"), F.col("p").alias("p_g"), F.col("p0").alias("p0_g"))
    right = priced.select("lang", "term", F.col("source").alias("source_h"), F.col("p").alias("p_h"), F.col("p0").alias("p0_h"))
    p_g, p_h, p0_g, p0_h = (F.col(c) for c in ("p_g", "p_h", "p0_g", "p0_h"))
    correction = price(p_g, p_h) - price(p_g, p0_h) - price(p0_g, p_h) + price(p0_g, p0_h)
    both = left.join(right, ["lang", "term"]).where("source_g < source_h").groupBy("lang", "source_g", "source_h").agg(F.sum(correction).alias("overlap"))
    swapped = lambda rows: rows.select("lang", F.col("source_h").alias("source_g"), F.col("source_g").alias("source_h"), rows.columns[-1])
    back = swapped(prices).withColumnRenamed("one_sided", "other_sided")
    key = ["lang", "source_g", "source_h"]
    joined = ordered.join(prices, key, "left").join(back, key, "left").join(both.unionByName(swapped(both)), key, "left")
    neither = (F.col("v") - F.col("support_g") - F.col("support_h")) * price(F.col("p0_g"), F.col("p0_h"))
    value = sum((F.coalesce(c, zero) for c in (F.col("one_sided"), F.col("other_sided"), F.col("overlap"), neither)), zero)
    pairs = joined.select("lang", F.col("source_g").alias("source"), F.lit("pair").alias("part"), F.col("source_h").alias("item"), value.alias("value"))

    own = postings.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    own = own.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    overused = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = overused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # each task keeps its own before the shuffle
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
