"""The registered queries over the driver's tables: search, filters, joins and reranking, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.operators import dedup, joins, predicates, rerank, search
from kelpgrid.plans.works import WORKS_SQL, query_vector, searchable, works
from kelpgrid.sources.tables import table

NOW = 2025
TERMS = ["and", "is"]
QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}
NO_SQL: set[str] = set()


def query(sql: str | None = None, with_works: bool = True):
    """Registers a function of (spark, sf_dir) under its name, with its SQL; ``with_works`` puts the works view before it."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = f"WITH {WORKS_SQL.strip()} {sql.strip()}" if with_works else sql.strip()
        else:
            NO_SQL.add(function.__name__)
        return function

    return put


def words_sql(text: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower(translate({text}, '{X.ACCENTED}', '{X.FOLDED}')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 1)"


def title_sql(title: str) -> str:
    stripped = f"regexp_replace(lower(trim({title})), ' *\\((en|es|pt|fr)\\) *$', '')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({stripped}, '[-–—]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def cites_sql(citations: str = "citation_count", year: str = "year") -> str:
    return f"CASE WHEN {citations} IS NULL OR {citations} <= 0 OR {year} < 1900 THEN 0.0 ELSE least(greatest(ln(1 + {citations} / CAST(greatest(1, {NOW} - {year} + 1) AS DOUBLE)) / ln(501.0), 0.0), 1.0) END"


ARMS_SQL = f"""
, words AS (SELECT *, {words_sql("concat_ws(' ', title, abstract)")} AS ws FROM scored)
, lex AS (
  SELECT *, CASE WHEN len(ws) > 0 AND list_has_all(ws, ['and', 'is'])
    THEN round(100.0 * len(list_filter(ws, lambda w: w IN ('and', 'is'))) / len(ws), 6) ELSE 0.0 END AS fts
  FROM words
)
"""


# --- search -----------------------------------------------------------------------------------------------------------


@query("SELECT id, CAST(rank AS INTEGER) AS rank, cosine FROM (SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS rank FROM scored WHERE cosine >= 0.0) WHERE rank <= 50")
def d01_cosine_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return search.cosine_top_k(works(spark, sf), query_vector(spark, sf), 50).select("id", "rank", "cosine")


HYBRID_SQL = ARMS_SQL + """
, v AS (SELECT * FROM (SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS vector_rank FROM lex WHERE {where} AND cosine > 0.0) WHERE vector_rank <= 40)
, f AS (SELECT * FROM (SELECT id, fts, row_number() OVER (ORDER BY fts DESC, id) AS fts_rank FROM lex WHERE {where} AND fts > 0) WHERE fts_rank <= 40)
, u AS (
  SELECT coalesce(v.id, f.id) AS id, cosine, fts, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(fts_rank AS INTEGER) AS fts_rank,
    round(coalesce(1.0 / (60 + vector_rank), 0.0) + coalesce(1.0 / (60 + fts_rank), 0.0), 6) AS score
  FROM v FULL JOIN f ON v.id = f.id
), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM u)
SELECT CAST(r.rank AS INTEGER) AS rank, r.id, w.title, w.year, r.cosine, r.fts, r.vector_rank, r.fts_rank, r.score
FROM r JOIN works w ON w.id = r.id WHERE r.rank <= 20
"""


@query(HYBRID_SQL.format(where="true"))
def d03_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid_search(works(spark, sf), query_vector(spark, sf), TERMS)


FILTERS = predicates.SearchFilters(year_min=1995, types=("journal_article",), regions=("LAC", "MENA"), sms_levels=(0, 1, 2, 3, 4), abs_ratings=("4*", "4", "3"), repec_max=90)
FILTERS_SQL = """year >= 1995 AND (publication_type = 'journal_article' OR publication_type IS NULL) AND (region IN ('LAC', 'MENA') OR region IS NULL)
 AND (sms_level IN (0, 1, 2, 3, 4) OR sms_level IS NULL) AND (abs_rating IN ('4*', '4', '3') OR abs_rating IS NULL) AND (repec_percentile <= 90 OR repec_percentile IS NULL)"""


@query(HYBRID_SQL.format(where=FILTERS_SQL))
def d04_hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid_search(works(spark, sf), query_vector(spark, sf), TERMS, filters=FILTERS)


@query(ARMS_SQL + "SELECT id, fts, CAST(rank AS INTEGER) AS rank FROM (SELECT id, fts, row_number() OVER (ORDER BY fts DESC, id) AS rank FROM lex WHERE fts > 0) WHERE rank <= 50")
def d06_lexical_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return search.lexical_top_k(works(spark, sf), TERMS, 50).select("id", "fts", "rank")


@query("SELECT w.id, round(list_cosine_similarity(w.embedding, q.q), 6) AS cosine FROM works w, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) q WHERE w.embedding IS NOT NULL AND w.id IN (SELECT l_partkey FROM lineitem)")
def d08_cosine_for_ids(spark: SparkSession, sf: str) -> DataFrame:
    return search.cosine_for_ids(works(spark, sf), query_vector(spark, sf), table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")))


FACETS_SQL = """
, facets AS (SELECT vec_id AS facet, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (0, 1, 2))
, sims AS (SELECT s.id, facet, round(list_cosine_similarity(s.embedding, q), 6) AS sim FROM searchable s, facets)
, hit AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY sim DESC, id) <= 100 AND sim >= 0.05 AS hit FROM sims)
SELECT id, max(CASE WHEN hit THEN sim END) AS similarity, count(*) FILTER (hit) AS channels, round(exp(avg(ln(greatest(sim, 0.01)))), 6) AS gm
FROM hit GROUP BY id HAVING count(*) FILTER (hit) > 0
"""


@query(FACETS_SQL)
def d09_multi_facet(spark: SparkSession, sf: str) -> DataFrame:
    facets = table(spark, sf, "embeddings").where("vec_id in (0, 1, 2)").select(F.col("vec_id").alias("facet"), F.col("embedding").alias("q"))
    return search.multi_facet(works(spark, sf), facets, 100, 0.05)


CHANNELS_SQL = ARMS_SQL + """
, topic_geo AS (SELECT id, 'topic_geo' AS channel, 0.55 AS similarity, 0 AS o FROM lex WHERE topic IN ('topic1', 'topic2') AND region IN ('LAC') AND abstract IS NOT NULL ORDER BY id LIMIT 100)
, causal AS (SELECT id, 'causal' AS channel, 0.44 AS similarity, 1 AS o FROM lex WHERE fts > 0 AND sms_level >= 4 ORDER BY sms_level DESC, citation_count DESC NULLS LAST, id LIMIT 60)
, recent AS (SELECT id, 'recent' AS channel, 0.42 AS similarity, 2 AS o FROM lex WHERE fts > 0 AND year >= 2020 ORDER BY year DESC, citation_count DESC NULLS LAST, id LIMIT 50)
, fv AS (SELECT id, cosine AS similarity FROM lex WHERE cosine >= 0.72 ORDER BY cosine DESC, id LIMIT 50)
, ft AS (SELECT id, 0.72 AS similarity FROM lex WHERE fts > 0 AND year <= 2019 AND citation_count >= 75 ORDER BY citation_count DESC NULLS LAST, id LIMIT 50)
, fw AS (SELECT id, 0.45 AS similarity FROM lex WHERE list_contains(ws, 'and') AND year <= 2019 AND citation_count >= 75 ORDER BY citation_count DESC NULLS LAST, id LIMIT 30)
, foundational AS (SELECT id, 'foundational' AS channel, CAST(max(similarity) AS DOUBLE) AS similarity, 3 AS o FROM (SELECT * FROM fv UNION ALL SELECT * FROM ft UNION ALL SELECT * FROM fw) GROUP BY id)
, hits AS (SELECT id, channel, CAST(similarity AS DOUBLE) AS similarity, o FROM topic_geo UNION ALL SELECT id, channel, CAST(similarity AS DOUBLE), o FROM causal UNION ALL SELECT id, channel, CAST(similarity AS DOUBLE), o FROM recent UNION ALL SELECT id, channel, similarity, o FROM foundational)
"""


def _channels(spark: SparkSession, sf: str) -> list[DataFrame]:
    w = works(spark, sf)
    return [search.topic_geo_channel(w, ["topic1", "topic2"], ["LAC"]), search.causal_channel(w, TERMS), search.recent_channel(w, TERMS), search.foundational_channel(w, query_vector(spark, sf), TERMS)]


@query(CHANNELS_SQL + "SELECT id, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels, max(similarity) AS similarity, CAST(min(o) AS INTEGER) AS first FROM hits GROUP BY id")
def d20_channel_union(spark: SparkSession, sf: str) -> DataFrame:
    return search.channel_union(*_channels(spark, sf))


@query(CHANNELS_SQL + """
, k AS (SELECT DISTINCT id, channel FROM hits), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS width FROM k)
SELECT channel, count(*) AS n, count(*) FILTER (width = 1) AS exclusive, count(*) FILTER (width > 1) AS shared FROM n GROUP BY channel""")
def e28_channel_overlap(spark: SparkSession, sf: str) -> DataFrame:
    from functools import reduce

    from kelpgrid.operators.analytics import channel_overlap

    return channel_overlap(reduce(lambda a, b: a.unionByName(b), _channels(spark, sf)))


@query(CHANNELS_SQL + """
, d AS (SELECT id, channel, round(row_number() OVER (PARTITION BY channel ORDER BY similarity DESC, id) / CASE channel WHEN 'causal' THEN 0.5 WHEN 'recent' THEN 0.3 WHEN 'foundational' THEN 0.2 END, 6) AS due FROM hits WHERE channel <> 'topic_geo')
, f AS (SELECT id, min({'due': due, 'channel': channel}) AS f FROM d GROUP BY id)
, r AS (SELECT id, f.due AS due, f.channel AS channel, row_number() OVER (ORDER BY f.due, f.channel, id) AS slot FROM f)
SELECT id, due, channel, CAST(slot AS INTEGER) AS slot FROM r WHERE slot <= 20""")
def g10_interleave(spark: SparkSession, sf: str) -> DataFrame:
    _, causal, recent, old = _channels(spark, sf)
    return rerank.interleave(causal.unionByName(recent).unionByName(old), {"causal": 0.5, "recent": 0.3, "foundational": 0.2})


@query("SELECT id, citation_count FROM works WHERE contains(lower(concat_ws(' ', title, abstract)), 'license') OR contains(lower(concat_ws(' ', title, abstract)), 'reserved') ORDER BY citation_count DESC NULLS LAST, id LIMIT 120")
def d25_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    return search.relaxed_candidates(works(spark, sf), ["license", "reserved"])


@query(ARMS_SQL + "SELECT count(*) AS n, count(*) FILTER (cosine >= 0.2) AS above, count(*) FILTER (fts > 0) AS matched, max(cosine) AS best, round(avg(cosine) FILTER (cosine > 0) + 1e-10, 6) AS mean_positive FROM lex")
def d26_probe(spark: SparkSession, sf: str) -> DataFrame:
    return search.probe(works(spark, sf), query_vector(spark, sf), TERMS, 0.2)


# --- filters ----------------------------------------------------------------------------------------------------------


@query(f"SELECT id FROM works WHERE {FILTERS_SQL}")
def b01_filters(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).where(FILTERS.column()).select("id")


@query("SELECT id, venue FROM works WHERE venue IN ('src1', 'src2') OR venue ILIKE '%5' OR (abs_rating IS NULL AND publication_type = 'journal_article')")
def b03_source_gate(spark: SparkSession, sf: str) -> DataFrame:
    f = predicates.SearchFilters(venues=("src1", "src2"), venue_patterns=("%5",), include_unranked=True)
    return works(spark, sf).where(f.column()).select("id", "venue")


@query("SELECT id FROM works WHERE year >= 2020")
def b06_recent_server(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).where(predicates.period_filters("recent", NOW).column()).select("id")


@query(f"SELECT id FROM works WHERE year >= {NOW - 4}")
def b09_recent_client(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).where(predicates.period_filters("recent", NOW, server=False).column()).select("id")


@query("SELECT w.id, coalesce(s.tier, 5) AS tier FROM works w LEFT JOIN (SELECT 'src' || s_suppkey AS name, CAST(min(1 + s_nationkey % 4) AS INTEGER) AS tier FROM supplier GROUP BY s_suppkey) s ON s.name = w.venue")
def b10_journal_tier(spark: SparkSession, sf: str) -> DataFrame:
    tiers = table(spark, sf, "supplier").select(F.concat(F.lit("Src"), F.col("s_suppkey").cast("string")).alias("name"), (1 + F.col("s_nationkey") % 4).cast("int").alias("tier"))
    return predicates.journal_tier(works(spark, sf), tiers).select("id", "tier")


@query("SELECT id FROM works WHERE venue NOT IN (SELECT 'src' || s_suppkey FROM supplier WHERE s_nationkey < 12) AND year >= 1961")
def b11_denied_venues(spark: SparkSession, sf: str) -> DataFrame:
    denied = table(spark, sf, "supplier").where("s_nationkey < 12").select(F.concat(F.lit("The SRC "), F.col("s_suppkey").cast("string"), F.lit(" (series)")).alias("name"))
    kept = predicates.without_denied_venues(works(spark, sf), denied)
    return kept.where(predicates.old_enough(F.col("year"))).select("id")


@query(f"SELECT id FROM works WHERE {title_sql('title')} IN ({', '.join(repr(t) for t in predicates.GENERIC_TITLES)}) OR regexp_matches({title_sql('title')}, '^(volume|issue|chapter|part) [0-9ivx]+$')")
def b13_generic_titles(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).where(predicates.is_generic_title(F.col("title"))).select("id")


NOISE_SQL = "CASE " + " ".join("WHEN regexp_matches(lower(trim(title)), '{}'){} THEN '{}'".format(p.replace("'", "''"), "" if n is None else f" AND length(title) < {n}", r) for r, p, n in predicates.NOISE) + " END"


@query(f"SELECT noise_reason, count(*) AS n FROM (SELECT {NOISE_SQL} AS noise_reason FROM works) GROUP BY noise_reason")
def b14_noise_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).groupBy(predicates.noise_reason(F.col("title")).alias("noise_reason")).agg(F.count("*").alias("n"))


REAL_SQL = "length(trim(abstract)) >= 60 AND NOT (" + " OR ".join(f"regexp_matches(lower(trim(abstract)), '{p}')" for p in ("^https?://", "^(no abstract|abstract not available|n/a|none)", "^highlights", "</?[a-z]+>", "(cookies|all rights reserved|javascript)")) + ")"


@query(f"SELECT id FROM works WHERE coalesce({REAL_SQL}, false)")
def b15_real_abstracts(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).where(predicates.is_real_abstract(F.col("abstract"))).select("id")


@query("""SELECT id, coalesce(year < 2000, false) AS bad_year, coalesce(sms_level < 2, false) AS bad_sms, coalesce(region NOT IN ('LAC'), false) AS bad_region,
 coalesce(year < 2000, false) OR coalesce(sms_level < 2, false) OR coalesce(region NOT IN ('LAC'), false) AS bad_any FROM works""")
def b19_violations(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).select("id", *[c.alias(n) for n, c in predicates.violations(2000, 2, ["LAC"]).items()])


@query("""SELECT CAST(step AS INTEGER) AS step, name, kept, round(100.0 * (n - kept) / n, 2) AS reduction FROM (
 SELECT 1 AS step, 'year' AS name, count(*) FILTER (year >= 2000) AS kept, count(*) AS n FROM works
 UNION ALL SELECT 2, 'level', count(*) FILTER (year >= 2000 AND sms_level >= 2), count(*) FROM works
 UNION ALL SELECT 3, 'region', count(*) FILTER (year >= 2000 AND sms_level >= 2 AND region = 'LAC'), count(*) FROM works)""")
def e33_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.funnel(works(spark, sf), [("year", F.col("year") >= 2000), ("level", F.col("sms_level") >= 2), ("region", F.col("region") == "LAC")])


# --- joins and duplicates -----------------------------------------------------------------------------------------------

EDGES_SQL = "edges AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem)"


def _citations(spark: SparkSession, sf: str) -> DataFrame:
    """The edges, some more than once."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return joins.distinct_rows(_citations(spark, sf))


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id")).distinct()


SEEDS_SQL = "seeds AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(f"WITH {EDGES_SQL}, {SEEDS_SQL} SELECT cited AS id, count(DISTINCT citing) AS n FROM edges WHERE citing IN (SELECT id FROM seeds) AND cited NOT IN (SELECT id FROM seeds) GROUP BY cited", False)
def c14_co_cited(spark: SparkSession, sf: str) -> DataFrame:
    return joins.co_cited(_citations(spark, sf), _seeds(spark, sf))


@query(f"""WITH {EDGES_SQL}, {SEEDS_SQL}, b AS (
 SELECT citing AS seed, cited AS id, 'references' AS direction FROM edges WHERE citing IN (SELECT id FROM seeds)
 UNION SELECT cited, citing, 'citations' FROM edges WHERE cited IN (SELECT id FROM seeds)
), c AS (SELECT cited AS id, count(*) AS citations FROM edges GROUP BY cited), k AS (SELECT b.*, coalesce(citations, 0) AS citations FROM b LEFT JOIN c USING (id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY seed, direction ORDER BY citations DESC, id) AS n FROM k)
SELECT id, count(DISTINCT seed) AS seeds, max(citations) AS citations FROM r WHERE n <= 20 AND citations >= 3 AND id NOT IN (SELECT id FROM seeds) GROUP BY id""", False)
def c15_crawl(spark: SparkSession, sf: str) -> DataFrame:
    seeds = _seeds(spark, sf)
    return joins.crawl(_citations(spark, sf), seeds, seeds)


@query(f"""SELECT p.id AS left_id, a.id AS right_id FROM
 (SELECT *, {title_sql('title')} AS t FROM works WHERE publication_type = 'working_paper') p JOIN (SELECT *, {title_sql('title')} AS t FROM works WHERE publication_type = 'journal_article') a
 ON p.t = a.t AND length(p.t) > 0 AND abs(p.year - a.year) <= 8
 QUALIFY count(*) OVER (PARTITION BY p.id) = 1 AND count(*) OVER (PARTITION BY a.id) = 1""")
def c06_mutual_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.cross_source_shadows(works(spark, sf)).select(F.col("shadow_id").alias("left_id"), F.col("canonical_id").alias("right_id"))


@query("SELECT s.id, w.title, CAST(s.pos AS INTEGER) AS pos FROM (SELECT l_partkey AS id, row_number() OVER (ORDER BY q DESC, l_partkey) AS pos FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey)) s JOIN works w ON w.id = s.id WHERE pos <= 500")
def c10_in_order(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    ids = parts.orderBy(F.desc("q"), "id").limit(500).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("q"), "id"))).drop("q")
    return joins.in_order(ids, works(spark, sf)).select("id", "title", "pos")


@query("SELECT c.c_custkey, coalesce(o.n, 0) AS n, coalesce(o.total, 0.0) AS total FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey", False)
def c11_left_with_defaults(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))
    c = table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", False)
def c08_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("""SELECT t.id, coalesce(t.citation_count, s.citation_count) AS citation_count, coalesce(t.region, s.region) AS region FROM works t LEFT JOIN
 (SELECT canonical_work_id AS id, max(citation_count) AS citation_count, max(region) AS region FROM works WHERE canonical_work_id IS NOT NULL GROUP BY 1) s ON s.id = t.id""")
def c12_fill_from_shadows(spark: SparkSession, sf: str) -> DataFrame:
    w = works(spark, sf)
    pairs = w.where("canonical_work_id is not null").select(F.col("id").alias("source_id"), F.col("canonical_work_id").alias("id"))
    return joins.fill_from(w.select("id", "citation_count", "region"), w, pairs, ["citation_count", "region"])


@query("SELECT min(id) OVER (PARTITION BY abstract) AS first_id, id AS other_id FROM works QUALIFY id > min(id) OVER (PARTITION BY abstract)")
def h09_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_pairs(works(spark, sf), F.col("abstract"))


@query(f"""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {title_sql('title')}, surname, year ORDER BY citation_count DESC NULLS LAST, id) AS n FROM works) WHERE n = 1""")
def h02_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    w = works(spark, sf)
    key = F.concat_ws("|", X.normalize_title(F.col("title")), "surname", F.col("year").cast("string"))
    return dedup.first_of_each(w, key, [F.desc_nulls_last("citation_count"), F.asc("id")]).select("id")


@query(f"""
, r AS (SELECT id, coalesce(year, 0) AS year, array_to_string(list_sort({words_sql('title')}), ' ') AS t FROM works)
, e AS (SELECT t, year, min(id) AS first FROM r GROUP BY ALL)
, m AS (SELECT a.t, a.year, min(b.first) AS earlier FROM e a JOIN e b ON b.first < a.first AND (a.year = b.year OR a.year = 0 OR b.year = 0)
   AND greatest(length(a.t), length(b.t)) > 0 AND 100.0 * (1 - levenshtein(a.t, b.t) / CAST(greatest(length(a.t), length(b.t)) AS DOUBLE)) >= 90 GROUP BY ALL)
SELECT r.id, least(e.first, coalesce(m.earlier, e.first)) AS kept_id FROM r JOIN e USING (t, year) LEFT JOIN m USING (t, year)""")
def h02_fuzzy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.fuzzy_first(works(spark, sf))


@query(f"""
, k AS (SELECT id, {title_sql('title')} AS t, CASE publication_type WHEN 'journal_article' THEN 1 WHEN 'working_paper' THEN 2 ELSE 9 END AS r, year FROM works)
, b AS (SELECT a.id AS shadow_id, min({{'r': b.r, 'id': b.id}}).id AS canonical_id FROM k a JOIN k b ON a.t = b.t AND length(a.t) >= 30 AND a.r > b.r AND abs(a.year - b.year) <= 8 GROUP BY a.id)
SELECT shadow_id, canonical_id FROM b WHERE canonical_id NOT IN (SELECT shadow_id FROM b)""")
def h07_fuzzy_shadows(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.fuzzy_shadows(works(spark, sf, t=X.normalize_title(F.col("title"))))


@query("""SELECT abstract_hash AS key, min({'o': o, 'id': id}).id AS id, array_to_string(list_sort(list_distinct(list(venue))), ',') AS sources, count(*) AS n
 FROM (SELECT md5(abstract) AS abstract_hash, CASE WHEN publication_type = 'journal_article' THEN 0 ELSE 1 END AS o, id, venue FROM works) GROUP BY abstract_hash""")
def h01_provenance(spark: SparkSession, sf: str) -> DataFrame:
    w = works(spark, sf).withColumn("source_order", F.when(F.col("publication_type") == "journal_article", 0).otherwise(1)).withColumn("source_name", F.col("venue"))
    return dedup.with_provenance(w, F.md5("abstract"))


# --- reranking --------------------------------------------------------------------------------------------------------

POOL_SQL = f"""
, boosted AS (
  SELECT *, round(cosine * (1 + 0.5 * least(coalesce(sms_level, 0), 5) / 5.0 + 0.3 * ({cites_sql()})
    + 0.6 * coalesce(CAST(region = 'LAC' AS DOUBLE), 0.0) * least(greatest((cosine - 0.5) / (0.65 - 0.5), 0.0), 1.0)) + 1e-10, 6) AS score FROM scored
), pool AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM boosted) WHERE pos <= 200)
"""


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    from kelpgrid.functions.vector import with_cosine

    rows = with_cosine(searchable(works(spark, sf)), query_vector(spark, sf))
    return rerank.pool(rerank.rerank_unified(rows, NOW, "LAC", "moderate"), "score", 200)


@query(POOL_SQL + "SELECT id, cosine, score, CAST(pos AS INTEGER) AS pos FROM pool")
def g02_rerank_unified(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).select("id", "cosine", "score", "pos")


MERGED_SQL = f"""SELECT id, round(0.428 * least(greatest(cosine, 0.0), 1.0) + 0.157 * least(greatest(coalesce(sms_level, 0) / 5.0, 0.0), 1.0)
 + 0.160 * ({cites_sql()}) * (0.2 + 0.8 * least(greatest(cosine, 0.0), 1.0)) + 0.021 * greatest(0.0, 1 - ({NOW} - year) / 25.0)
 + 0.147 * CASE WHEN cosine >= 0.3 THEN 1.0 WHEN cosine >= 0.1 THEN 0.7 ELSE 0.0 END + CASE WHEN regexp_matches(lower(title), 'review|meta') THEN 0.025 ELSE 0.0 END + 1e-10, 6) AS score FROM scored"""


@query(MERGED_SQL)
def g08_rerank_merged(spark: SparkSession, sf: str) -> DataFrame:
    from kelpgrid.functions.vector import with_cosine

    return rerank.rerank_merged(with_cosine(searchable(works(spark, sf)), query_vector(spark, sf)), NOW).select("id", "score")


@query(f"""SELECT id, round(CASE WHEN cosine >= 0.1 THEN cosine * (1 + 0.5 * least(greatest(coalesce(sms_level, 0) / 5.0, 0.0), 1.0))
 * greatest(1 + 0.2 * greatest(0.0, 1 - ({NOW} - year) / 25.0), 1 + 0.3 * ({cites_sql()})) * (1 + 0.6 * coalesce(CAST(region = 'LAC' AS DOUBLE), 0.0)) ELSE 0.0 END + 1e-10, 6) AS score FROM scored""")
def g11_hybrid_product(spark: SparkSession, sf: str) -> DataFrame:
    from kelpgrid.functions.vector import with_cosine

    return rerank.hybrid_product(with_cosine(searchable(works(spark, sf)), query_vector(spark, sf)), NOW, "LAC", 0.1).select("id", "score")


@query(POOL_SQL + """
, h AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, id) <= 25 OR row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) <= 12 AS head FROM pool)
SELECT id, head, CAST(row_number() OVER (ORDER BY head DESC, score DESC, id) AS INTEGER) AS pos FROM h""")
def g12_quota(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.quota_reorder(_pool(spark, sf).drop("pos").withColumn("channel", F.col("topic"))).select("id", "head", "pos")


@query(POOL_SQL + f"""
, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {title_sql('title')} ORDER BY score DESC, id) AS nk FROM pool) WHERE nk = 1)
, w AS (SELECT *, coalesce(sms_level <= 2, true) AS weak FROM b)
, n AS (SELECT *, row_number() OVER (PARTITION BY weak ORDER BY score DESC, id) - 1 AS nth FROM w)
, a AS (SELECT *, round(score - CASE WHEN weak AND nth >= 3 THEN least(0.015 * (nth - 2), 0.06) ELSE 0.0 END, 6) AS adjusted FROM n)
, p AS (SELECT id, adjusted, row_number() OVER (ORDER BY adjusted DESC, score DESC, id) AS pick FROM a)
SELECT id, adjusted, CAST(pick AS INTEGER) AS pick FROM p WHERE pick <= 50""")
def g13_diverse(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.select_diverse(_pool(spark, sf), X.normalize_title(F.col("title"))).select("id", "adjusted", "pick")


@query(POOL_SQL + """
, m AS (SELECT *, max(cosine) OVER () AS top, row_number() OVER (ORDER BY cosine DESC, id) AS best FROM pool)
, f AS (SELECT *, cosine >= greatest(0.05, round(top - 0.6, 6)) AS above FROM m), n AS (SELECT *, count(*) FILTER (above) OVER () AS k FROM f)
SELECT id, cosine FROM n WHERE CASE WHEN k >= 8 THEN above ELSE best <= 8 END""")
def g15_relevance_floor(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.relevance_floor(_pool(spark, sf), 0.05, 0.6).select("id", "cosine")


GATE_SQL = "round(least(greatest(max(cosine) OVER () - 0.18, 0.32), 0.50), 6)"


@query(POOL_SQL + f"""
, g AS (SELECT *, {GATE_SQL} AS gate FROM pool)
SELECT id, gate, (cosine IS NULL OR cosine <= 0) OR cosine >= gate OR coalesce(citation_count >= 75 AND year >= 1900 AND year < 2020 AND cosine >= round(gate - 0.10, 6), false) AS passes,
 CASE WHEN cosine >= gate THEN CASE WHEN region = 'LAC' THEN 'direct-lac' ELSE 'direct-global' END WHEN cosine >= round(gate - 0.08, 6) THEN 'indirect' ELSE 'excluded' END AS label FROM g""")
def g16_gate_and_label(spark: SparkSession, sf: str) -> DataFrame:
    gated = _pool(spark, sf).withColumn("gate", rerank.cosine_gate(F.max("cosine").over(Window.partitionBy())))
    passes = rerank.passes_gate(F.col("cosine"), F.col("citation_count"), F.col("year"), F.col("gate"))
    return gated.select("id", "gate", passes.alias("passes"), rerank.topicality(F.col("cosine"), F.col("gate"), F.coalesce(F.col("region") == "LAC", F.lit(False))).alias("label"))


@query(POOL_SQL + """
, m AS (SELECT *, coalesce(region = 'LAC', false) AS wanted, pos <= 50 AS inside FROM pool)
, n AS (SELECT *, count(*) FILTER (wanted AND inside) OVER () AS n_in, count(*) FILTER (wanted AND NOT inside) OVER () AS spare,
  row_number() OVER (PARTITION BY wanted, inside ORDER BY pos) AS up, row_number() OVER (PARTITION BY wanted, inside ORDER BY pos DESC) AS down FROM m)
, s AS (SELECT *, greatest(0, least(20 - n_in, spare)) AS swaps FROM n)
SELECT id FROM s WHERE CASE WHEN inside THEN wanted OR down > swaps ELSE wanted AND up <= swaps END""")
def g18_region_floor(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.evidence_floor(_pool(spark, sf), 50, F.col("region") == "LAC", 20).select("id")


@query(POOL_SQL + """
, j AS (SELECT p.id, p.pos, l.quality * 0.4 + 0.35 AS judged FROM pool p LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = p.id)
, b AS (SELECT *, CASE WHEN judged IS NULL THEN 3 WHEN judged >= 0.7 THEN 0 WHEN judged >= 0.5 THEN 1 ELSE 2 END AS band FROM j)
SELECT id, CAST(band AS INTEGER) AS band, CAST(row_number() OVER (ORDER BY band, judged DESC NULLS LAST, pos) AS INTEGER) AS judged_pos FROM b""")
def g19_cross_encoder(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") * 0.4 + 0.35).alias("judged"))
    return rerank.cross_encoder_order(_pool(spark, sf), scores).select("id", "band", "judged_pos")


@query(POOL_SQL + "SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN pos <= 30 AND regexp_matches(lower(title), 'review|meta') THEN 0 WHEN pos <= 30 THEN 1 ELSE 2 END, pos) AS INTEGER) AS promoted_pos FROM pool")
def g21_promote_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.promote_reviews(_pool(spark, sf)).select("id", "promoted_pos")


@query(f"""SELECT id, round(CASE abs_rating WHEN '4*' THEN 5.0 WHEN '4' THEN 4.0 WHEN '3' THEN 3.0 ELSE 0.0 END * 2 + coalesce(sms_level, 0) * 3.0
 + log10(coalesce(citation_count, 0) + 1.0) * 2 + CASE WHEN region = 'LAC' THEN 3.0 ELSE 0.0 END + greatest(0.0, 5 - ({NOW} - year) / 5.0), 6) AS priority FROM works""")
def g25_priority(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).select("id", rerank.priority_score(NOW).alias("priority"))


@query(POOL_SQL + """SELECT id, CAST(round(greatest(1.0, 20 - 0.1 * pos) + coalesce(sms_level, 0) + CASE WHEN citation_count >= 100 THEN 2.0 WHEN citation_count >= 25 THEN 1.0 ELSE 0.0 END, 3) AS DOUBLE) AS priority FROM pool""")
def g27_card_priority(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).select("id", rerank.lazy_card_priority(F.col("pos")).alias("priority"))


@query(POOL_SQL + "SELECT id, CAST(n AS INTEGER) AS n FROM (SELECT id, row_number() OVER (ORDER BY sms_level DESC NULLS LAST, score DESC, id) AS n FROM pool) WHERE n <= 40")
def g14_by_level(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.orderBy(*rerank.by_channel_order("causal")))
    return _pool(spark, sf).withColumn("n", n).where("n <= 40").select("id", "n")
