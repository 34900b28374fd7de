"""Vector, lexical and hybrid search over works, and the recall channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.functions.numeric import rounded
from kelpgrid.functions.vector import cosine_to, only_row, with_cosine
from kelpgrid.operators.predicates import SearchFilters
from kelpgrid.plans.works import searchable


def ranked(rows: DataFrame, score: str, k: int, name: str = "rank") -> DataFrame:
    """The k rows of the largest score with their rank from 1, ties to the smaller id.

    The rows are cut to k by a top-k on every task before a single task numbers them.
    """
    return top(rows, [F.desc(score), F.asc("id")], k, name)


def top(rows: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows in an order, numbered from 1."""
    return rows.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """``size`` rows after the first ``offset`` in an order; partitions, not pages, are for reading a whole table."""
    return rows.orderBy(*order).offset(offset).limit(size)


def after_key(rows: DataFrame, key: str, last: int, size: int) -> DataFrame:
    """The next ``size`` rows by key after the last one seen; stable while rows before it change."""
    return rows.where(F.col(key) > last).orderBy(key).limit(size)


def cosine_top_k(works: DataFrame, query: DataFrame, k: int = 20, threshold: float = 0.0, strict: bool = False, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """Searchable rows by exact cosine to the query vector; the threshold itself counts unless ``strict``."""
    rows = with_cosine(searchable(works).where(filters.column()), query)
    rows = rows.where(F.col("cosine") > threshold if strict else F.col("cosine") >= threshold)
    return ranked(rows, "cosine", k)


def lexical_score(text: Column, terms: list[str]) -> Column:
    """Share of the words that are a term, times 100; 0 unless every term occurs."""
    wanted = F.array(*[F.lit(t) for t in terms])

    def score(words: Column) -> Column:
        every = F.size(F.array_except(wanted, words)) == 0
        hits = F.size(F.filter(words, lambda w: w.isin(*terms)))
        return F.when(every & (F.size(words) > 0), F.round(100.0 * hits / F.size(words), 6)).otherwise(0.0)

    return F.transform(F.array(X.tokens(text)), score)[0]  # bound once: the text is not split again for each use


def lexical_top_k(works: DataFrame, terms: list[str], k: int = 20, filters: SearchFilters = SearchFilters()) -> DataFrame:
    rows = searchable(works).where(filters.column()).withColumn("fts", lexical_score(F.concat_ws(" ", "title", "abstract"), terms))
    return ranked(rows.where("fts > 0"), "fts", k)


def rrf(*ranks: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion: the sum of 1 / (k + rank), a missing rank counts nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks])


def hybrid_search(works: DataFrame, query: DataFrame, terms: list[str], k: int = 20, threshold: float = 0.0, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """Both arms are filtered before their top 2k, fused by reciprocal rank, joined with the works again and cut to k."""
    vector = cosine_top_k(works, query, 2 * k, threshold, True, filters).select("id", "cosine", F.col("rank").alias("vector_rank"))
    lexical = lexical_top_k(works, terms, 2 * k, filters).select("id", "fts", F.col("rank").alias("fts_rank"))
    fused = vector.join(lexical, "id", "full").withColumn("score", F.round(rrf(F.col("vector_rank"), F.col("fts_rank")), 6))
    top = ranked(fused, "score", k)
    return top.join(works.drop("cosine"), "id").select("rank", "id", "title", "year", "cosine", "fts", "vector_rank", "fts_rank", "score")


def cosine_for_ids(works: DataFrame, query: DataFrame, ids: DataFrame) -> DataFrame:
    return with_cosine(works.join(ids.select("id").distinct(), "id", "left_semi").where("embedding is not null"), query).select("id", "cosine")


def multi_facet(works: DataFrame, facets: DataFrame, k: int = 200, threshold: float = 0.0) -> DataFrame:
    """``id, similarity, channels, gm``: the best of each facet's top k, united; the rows most facets found come first.

    ``facets`` is (facet, q), a row for each of the at most 64 facets of one query.
    """
    wanted = only_row(facets, 64)
    each = F.array(*[F.struct(F.lit(f.facet).alias("facet"), F.round(cosine_to(F.col("embedding"), f.q), 6).alias("sim")) for f in wanted])
    rows = searchable(works).select("id", each.alias("sims"))
    sims = rows.select("id", F.explode("sims").alias("x")).select("id", "x.facet", "x.sim").where(F.col("sim") >= threshold)
    w = Window.partitionBy("facet").orderBy(F.desc("sim"), "id")
    best = sims.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)  # each task keeps its own k before the shuffle
    found = best.groupBy("id").agg(F.max("sim").alias("similarity"), F.count("*").alias("channels"))
    logs = F.transform("sims", lambda x: F.log(F.greatest(x.sim, F.lit(0.01))))
    gm = F.exp(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size("sims"))
    return rows.join(F.broadcast(found), "id").select("id", "similarity", "channels", F.round(gm, 6).alias("gm"))  # 64 k rows at most are broadcast


def facet_order(found: DataFrame, most: int = 12_800) -> DataFrame:
    """Rows of :func:`multi_facet` with their ``pos``: most facets first, then the geometric mean (64 facets of 200 rows at most)."""
    return top(found, [F.desc("channels"), F.desc("gm"), F.asc("id")], most, "pos")


def escalated(works: DataFrame, query: DataFrame, facets: DataFrame, enough: int = 200, threshold: float = 0.0) -> DataFrame:
    """``id, stage, similarity``: the best rows of one vector, or if there are not ``enough``, those of all facets.

    Which stage counts is decided within the plan, by a one-row count that both arms are joined with.
    """
    one = cosine_top_k(works, query, enough, threshold).select("id", F.lit("single").alias("stage"), F.col("cosine").alias("similarity"))
    more = multi_facet(works, facets, enough, threshold).select("id", F.lit("facets").alias("stage"), "similarity")
    held = one.agg(F.count("*").alias("held"))
    both = one.unionByName(more).join(F.broadcast(held))  # one row
    return both.where((F.col("stage") == "single") == (F.col("held") >= enough)).select("id", "stage", "similarity")


def channel(works: DataFrame, name: str, condition: Column, order: list[Column], k: int, similarity: float | None = None) -> DataFrame:
    """``id, channel, similarity``: the first k searchable rows that meet a condition, in an order that ends with the id."""
    rows = searchable(works).where(condition).orderBy(*order, "id").limit(k)
    return rows.select("id", F.lit(name).alias("channel"), F.lit(similarity).cast("double").alias("similarity"))


def topic_geo_channel(works: DataFrame, topics: list[str], regions: list[str], k: int = 100) -> DataFrame:
    return channel(works, "topic_geo", F.col("topic").isin(*topics) & F.col("region").isin(*regions) & F.col("abstract").isNotNull(), [], k, 0.55)


def causal_channel(works: DataFrame, terms: list[str], k: int = 60) -> DataFrame:
    found = lexical_score(F.concat_ws(" ", "title", "abstract"), terms) > 0
    return channel(works, "causal", found & (F.col("sms_level") >= 4), [F.desc("sms_level"), F.desc_nulls_last("citation_count")], k, 0.44)


def recent_channel(works: DataFrame, terms: list[str], since: int = 2020, k: int = 50) -> DataFrame:
    found = lexical_score(F.concat_ws(" ", "title", "abstract"), terms) > 0
    return channel(works, "recent", found & (F.col("year") >= since), [F.desc("year"), F.desc_nulls_last("citation_count")], k, 0.42)


def foundational_channel(works: DataFrame, query: DataFrame, terms: list[str], before: int = 2019, cited: int = 75, k: int = 50) -> DataFrame:
    """Near rows of a second vector, well-cited older rows of all terms, and of the longest term alone; the best similarity each."""
    near = with_cosine(searchable(works), query).where("cosine >= 0.72").orderBy(F.desc("cosine"), "id").limit(k).select("id", F.lit("foundational").alias("channel"), F.col("cosine").alias("similarity"))
    text = F.concat_ws(" ", "title", "abstract")
    older = (F.col("year") <= before) & (F.col("citation_count") >= cited)
    order = [F.desc_nulls_last("citation_count")]
    by_terms = channel(works, "foundational", older & (lexical_score(text, terms) > 0), order, k, 0.72)
    by_word = channel(works, "foundational", older & (lexical_score(text, [max(terms, key=len)]) > 0), order, 30, 0.45)
    return near.unionByName(by_terms).unionByName(by_word).groupBy("id", "channel").agg(F.max("similarity").alias("similarity"))


def channel_union(*channels: DataFrame) -> DataFrame:
    """``id, channels, similarity, first``: rows of all channels once, with the channels that found them; earlier channels come first."""
    parts = [c.select("id", "channel", "similarity", F.lit(i).alias("order")) for i, c in enumerate(channels)]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), F.max("similarity").alias("similarity"), F.min("order").alias("first"))


def relaxed_candidates(works: DataFrame, terms: list[str], k: int = 120) -> DataFrame:
    """Rows whose title or abstract holds any of the first eight terms, by citations."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    some = reduce(lambda a, b: a | b, [F.contains(text, F.lit(t.lower())) for t in terms[:8]])
    return works.where(some).orderBy(F.desc_nulls_last("citation_count"), "id").limit(k).select("id", "citation_count")


def probe(works: DataFrame, query: DataFrame, terms: list[str], threshold: float) -> DataFrame:
    """Exact counts behind both arms of a search, without limits."""
    rows = with_cosine(searchable(works), query).withColumn("fts", lexical_score(F.concat_ws(" ", "title", "abstract"), terms))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("cosine") >= threshold).alias("above"),
        F.count_if(F.col("fts") > 0).alias("matched"),
        F.max("cosine").alias("best"),
        rounded(F.avg(F.when(F.col("cosine") > 0, F.col("cosine")))).alias("mean_positive"),
    )


def pick_terms(query: Column, most: int = 3, boosted: list[str] = ()) -> Column:
    """Distinct content words of a query, longest first, then in their order; boosted words count ten characters more."""
    words = F.filter(X.content_tokens(query), lambda w: F.length(w) > 2)
    extra = lambda w: F.when(w.isin(*boosted), 10).otherwise(0) if boosted else F.lit(0)
    keyed = F.transform(F.array_distinct(words), lambda w: F.struct((-(F.length(w) + extra(w))).alias("n"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x.w)


def expand_synonyms(query: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The query with the terms of every rule whose pattern it matches, terms that it holds by then left out."""
    out, low = query, F.lower(query)
    for pattern, terms in rules:
        before = F.lower(out)
        new = F.concat_ws(" ", *[F.when(~F.contains(before, F.lit(t.lower())), F.lit(t)) for t in terms])
        out = F.concat_ws(" ", out, F.when(low.rlike(pattern) & (new != ""), new))
    return out


def query_variants(query: Column) -> Column:
    """One to three wordings of a query: its content words, with developing countries, as a review."""
    stop = F.array(*[F.lit(w) for w in X.STOPWORDS])
    bare = F.array_join(F.filter(X.tokens(query), lambda w: ~F.array_contains(stop, w)), " ")
    more = [F.when(~F.contains(bare, F.lit("countr")), F.concat(bare, F.lit(" developing countries"))), F.when(~bare.rlike("review|meta"), F.concat(bare, F.lit(" systematic review")))]
    return F.array_compact(F.array(bare, *more))


def matched_facets(query: Column, facets: dict[str, tuple[list[str], list[str]]]) -> Column:
    """Names of the facets that a query matches: by a trigger (a word as such, a phrase as part of the text) or by all of some words."""
    words, low = X.tokens(query), F.lower(query)
    marks = []
    for name, (triggers, every) in facets.items():
        hits = [F.contains(low, F.lit(t)) if " " in t else F.array_contains(words, t) for t in triggers]
        if every:
            hits.append(F.size(F.array_except(F.array(*[F.lit(w) for w in every]), words)) == 0)
        marks.append(F.when(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*marks))
