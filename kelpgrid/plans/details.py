"""Registered queries of single operators: scans, filters, joins, channels, keys, scores and labels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.functions import numeric as N
from kelpgrid.functions import text as X
from kelpgrid.functions.vector import with_cosine
from kelpgrid.operators import analytics, classify, dedup, evaluation, feedback, joins, predicates, rerank, search
from kelpgrid.operators.order import numbered, percentiles
from kelpgrid.plans.catalog import ARMS_SQL, CHANNELS_SQL, EDGES_SQL, FACETS_SQL, NOW, POOL_SQL, TERMS, _edges, _pool, cites_sql, query, title_sql, words_sql
from kelpgrid.plans.works import query_vector, searchable, works
from kelpgrid.sources import files
from kelpgrid.sources.tables import table

# --- scans and exports --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en'", False)
def a01_columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "lang", "source").where("lang = 'en'")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100", False)
def a02_page(spark: SparkSession, sf: str) -> DataFrame:
    return search.page(table(spark, sf, "documents", "doc_id", "lang"), ["doc_id"], 100, 50)


@query("SELECT doc_id, lang FROM documents WHERE doc_id > 77 ORDER BY doc_id LIMIT 60", False)
def a03_keyset(spark: SparkSession, sf: str) -> DataFrame:
    return search.after_key(table(spark, sf, "documents", "doc_id", "lang"), "doc_id", 77, 60)


@query("SELECT id, venue, year FROM works WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def a04_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return joins.with_ids(works(spark, sf), ids).select("id", "venue", "year")


@query("SELECT id, venue, replace(replace(title, chr(10), ' '), chr(13), ' ') AS title, year FROM works")
def a13_csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the export, parsed again."""
    rows = works(spark, sf).select("id", "venue", F.translate("title", "\n\r", "  ").alias("title"), "year")
    lines = files.csv_lines(rows, ["id", "venue", "title", "year"], mark_empty=True)
    r = F.col("r")
    return lines.select(files.csv_values(F.col("line")).alias("r")).select(r[0].cast("long").alias("id"), r[1].alias("venue"), r[2].alias("title"), r[3].cast("int").alias("year"))


@query("""SELECT venue, n, to_json(list({'id': id, 'year': year} ORDER BY n_top)) AS works FROM
 (SELECT venue, id, year, row_number() OVER (PARTITION BY venue ORDER BY citation_count DESC NULLS LAST, id) AS n_top, count(*) OVER (PARTITION BY venue) AS n FROM works) WHERE n_top <= 5 GROUP BY venue, n""")
def a14_json_sections(spark: SparkSession, sf: str) -> DataFrame:
    w = works(spark, sf)
    top = evaluation.per_group_top(w, "venue", [F.desc_nulls_last("citation_count"), F.asc("id")], 5)
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "year"))), lambda x: F.struct(x["id"].alias("id"), x["year"].alias("year"))))
    return w.groupBy("venue").agg(F.count("*").alias("n")).join(top.groupBy("venue").agg(listed.alias("works")), "venue")


# --- filters ------------------------------------------------------------------------------------------------------------


@query("SELECT coalesce(publication_type, 'none') AS kind, count(*) AS n FROM works WHERE (publication_type = 'journal_article' OR publication_type IS NULL) AND (topic = 'topic1' OR topic IS NULL) AND year >= 1990 GROUP BY 1")
def b02_null_pass(spark: SparkSession, sf: str) -> DataFrame:
    kept = works(spark, sf).where(predicates.SearchFilters(types=("journal_article",), topics=("topic1",), year_min=1990).column())
    return kept.groupBy(F.coalesce("publication_type", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT id, list_has_any(tags, ['LAC', 'topic1']) AS some, list_has_all(tags, ['LAC', 'topic1']) AS every
 FROM (SELECT id, list_filter([region, topic, publication_type], lambda x: x IS NOT NULL) AS tags FROM works)""")
def b04_arrays(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array_compact(F.array("region", "topic", "publication_type"))
    return works(spark, sf).select("id", predicates.overlaps(tags, ["LAC", "topic1"]).alias("some"), predicates.contains_all(tags, ["LAC", "topic1"]).alias("every"))


@query("SELECT id, repec_percentile FROM works WHERE repec_percentile <= 25 OR repec_percentile IS NULL")
def b05_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).where(predicates.SearchFilters(repec_max=25).column()).select("id", "repec_percentile")


TIER_SQL = "CASE abs_rating WHEN '4*' THEN 1 WHEN '4' THEN 2 WHEN '3' THEN 3 WHEN '2' THEN 4 END"
INSTITUTION_SQL = "CASE venue WHEN 'src0' THEN 'IADB' WHEN 'src1' THEN 'WB' WHEN 'src2' THEN 'BIS' END"
SERIES_SQL = "CASE WHEN publication_type = 'working_paper' THEN CASE venue WHEN 'src3' THEN 'NBER' WHEN 'src4' THEN 'SSRN' WHEN 'src5' THEN 'MPRA' END END"


@query(f""", s AS (SELECT {TIER_SQL} AS tier, {INSTITUTION_SQL} AS institution, {SERIES_SQL} AS series FROM works)
SELECT 'nothing named' AS name, count(*) FILTER (tier IN (1, 2, 3) OR institution IN ('IADB', 'WB', 'IMF', 'OECD') OR series IN ('NBER', 'IZA', 'CEPR_REPEC', 'SSRN')) AS n FROM s
UNION ALL SELECT 'first tier', count(*) FILTER (tier = 1) FROM s UNION ALL SELECT 'no series', count(*) FILTER (false) FROM s UNION ALL SELECT 'one series', count(*) FILTER (series = 'NBER') FROM s""")
def b07_default_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Works that the sources of a search let pass: the default ones where none are named, else what is named."""
    asked = {"nothing named": predicates.Sources(), "first tier": predicates.Sources(journal_tiers=(1,)), "no series": predicates.Sources(series=()), "one series": predicates.Sources(series=("NBER",))}
    columns = [F.expr(x) for x in (TIER_SQL, INSTITUTION_SQL, SERIES_SQL)]
    return predicates.kept_by(works(spark, sf), {name: s.column(*columns) for name, s in asked.items()})


@query("SELECT id, year FROM works WHERE year IS NULL OR year >= 1995")
def b12_years(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).where(predicates.old_enough(F.col("year"), 1995)).select("id", "year")


@query("""SELECT 'none' AS name, false AS active, count(*) AS n FROM works UNION ALL SELECT 'year', true, count(*) FILTER (year >= 2000) FROM works
 UNION ALL SELECT 'venues', true, count(*) FILTER (venue IN ('src1', 'src2')) FROM works
 UNION ALL SELECT 'unranked', true, count(*) FILTER (venue = 'src1' OR abs_rating IS NULL AND publication_type = 'journal_article') FROM works""")
def b20_active(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each of some filter sets narrows a search at all, and how many works pass it."""
    f = predicates.SearchFilters
    asked = {"none": f(), "year": f(year_min=2000), "venues": f(venues=("src1", "src2")), "unranked": f(venues=("src1",), include_unranked=True)}
    active = F.create_map(*[x for k, v in asked.items() for x in (F.lit(k), F.lit(v.active))])
    return predicates.kept_by(works(spark, sf), {k: v.column() for k, v in asked.items()}).select("name", active[F.col("name")].alias("active"), "n")


# --- joins and duplicates -----------------------------------------------------------------------------------------------


@query("SELECT r.id, r.rank, w.title FROM (SELECT vec_id AS id, CAST(row_number() OVER (ORDER BY vec_id DESC) AS INTEGER) AS rank FROM embeddings) r JOIN works w ON w.id = r.id")
def c01_rehydrate(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked ids joined with their works."""
    placed = numbered(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), [], [F.desc("id")])
    ids = placed.select("id", (F.col("before") + 1).cast("int").alias("rank"))
    return ids.join(works(spark, sf), "id").select("id", "rank", "title")


@query("""SELECT coalesce(c.cust, s.cust) AS cust, c.n, s.total FROM (SELECT o_custkey AS cust, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) c
 FULL JOIN (SELECT o_custkey AS cust, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) s ON c.cust = s.cust""", False)
def c02_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("cust", F.col("o_custkey"))
    done = o.where("o_orderstatus = 'F'").groupBy("cust").agg(F.count("*").alias("n"))
    urgent = o.where("o_orderpriority = '1-URGENT'").groupBy("cust").agg(F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))
    return done.join(urgent, "cust", "full")


@query(f", {EDGES_SQL} SELECT w.id, coalesce(c.n, 0) AS cited FROM works w LEFT JOIN (SELECT cited AS id, count(*) AS n FROM edges GROUP BY cited) c ON c.id = w.id")
def c03_left_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    cited = _edges(spark, sf).groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("cited"))
    return works(spark, sf).select("id").join(cited, "id", "left").na.fill(0, ["cited"])


@query(f"""SELECT a.id AS shadow_id, b.id AS canonical_id FROM (SELECT *, {title_sql('title')} AS t FROM works) a JOIN (SELECT *, {title_sql('title')} AS t FROM works) b
 ON a.t = b.t AND length(a.t) >= 30 AND abs(a.year - b.year) <= 8 AND (a.surname = b.surname OR a.surname IS NULL OR b.surname IS NULL)
 AND CASE a.publication_type WHEN 'journal_article' THEN 1 WHEN 'working_paper' THEN 2 ELSE 9 END > CASE b.publication_type WHEN 'journal_article' THEN 1 WHEN 'working_paper' THEN 2 ELSE 9 END""")
def c05_key_self_join(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.ranked_pairs(works(spark, sf), same_surname=True).select("shadow_id", "canonical_id")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", False)
def c07_semi(spark: SparkSession, sf: str) -> DataFrame:
    late = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(late, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


SIGNATURE_SQL = "CASE WHEN len({ws}) >= 4 THEN array_to_string({ws}, ' ') END"


@query(f"""
, k AS (SELECT id, year, embedding, surname, list_sort(list_distinct(list_filter({words_sql('title')}, lambda w: length(w) >= 4 AND w NOT IN ({", ".join(map(repr, X.STOPWORDS))})))) AS ws FROM works)
, g AS (SELECT *, {SIGNATURE_SQL.format(ws='ws')} AS sig FROM k)
, s AS (SELECT a.id AS left_id, b.id AS right_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine FROM g a JOIN g b ON a.sig = b.sig AND abs(a.year - b.year) <= 50 AND a.id <> b.id)
, m AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY cosine DESC NULLS LAST, right_id) AS n FROM s)
SELECT left_id, right_id, cosine, CASE WHEN cosine >= 0.82 THEN 'match' ELSE 'low' END AS verdict FROM m WHERE n = 1""")
def c18_insights(spark: SparkSession, sf: str) -> DataFrame:
    w = works(spark, sf).withColumn("authors", F.array(F.lit("a")))
    return joins.signature_matches(w, w, 50, 0.6, 0.82, 0.82)


@query("""SELECT DISTINCT a.ask, w.id FROM (SELECT doc_id AS ask, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS id FROM documents WHERE doc_id % 2 = 0) a
 JOIN works w ON w.id = a.id OR '10.1/' || CASE WHEN w.id % 5 <> 0 THEN w.id END = a.doi""")
def c20_exact_match(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    asked = table(spark, sf, "documents").where(i % 2 == 0).select(i.alias("ask"), F.concat(F.lit("https://doi.org/10.1/"), i.cast("string")).alias("doi"), F.when(i % 3 == 0, i).alias("id"))
    known = works(spark, sf).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("10.1/"), F.col("id").cast("string"))).alias("doi"))
    return joins.exact_match(asked, known)


@query(f"SELECT min(id) AS id, {title_sql('title')} AS t FROM works WHERE length({title_sql('title')}) > 0 GROUP BY 2")
def f02_distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    rows = works(spark, sf).select("id", X.normalize_title(F.col("title")).alias("t")).where("length(t) > 0")
    return dedup.first_of_each(rows, F.col("t"), [F.asc("id")])


@query("SELECT id FROM works WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def h04_except(spark: SparkSession, sf: str) -> DataFrame:
    return joins.without_ids(works(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))).select("id")


@query(f"""
, k AS (SELECT *, {title_sql('title')} AS t FROM works)
, p AS (SELECT p.id AS shadow_id, a.id AS canonical_id FROM k p JOIN k a ON p.publication_type = 'working_paper' AND a.publication_type = 'journal_article' AND p.t = a.t AND length(p.t) > 0 AND abs(p.year - a.year) <= 8
 QUALIFY count(*) OVER (PARTITION BY p.id) = 1 AND count(*) OVER (PARTITION BY a.id) = 1)
SELECT w.id, greatest(coalesce(w.citation_count, s.citation_count), coalesce(s.citation_count, w.citation_count)) AS citation_count, coalesce(w.region, s.region) AS region, q.canonical_id AS shadow_of
FROM works w LEFT JOIN p ON p.canonical_id = w.id LEFT JOIN works s ON s.id = p.shadow_id LEFT JOIN p q ON q.shadow_id = w.id""")
def h06_cross_source(spark: SparkSession, sf: str) -> DataFrame:
    w = works(spark, sf)
    return dedup.merge_shadows(w, dedup.cross_source_shadows(w)).select("id", "citation_count", "region", "shadow_of")


# --- search -------------------------------------------------------------------------------------------------------------


@query(ARMS_SQL + """
, v AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY cosine DESC, id) AS r FROM lex WHERE cosine > 0.1) WHERE r <= 40)
, f AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY fts DESC, id) AS r FROM lex WHERE fts > 0) WHERE r <= 40)
, u AS (SELECT coalesce(v.id, f.id) AS id, round(coalesce(1.0 / (60 + v.r), 0.0) + coalesce(1.0 / (60 + f.r), 0.0), 6) AS score FROM v FULL JOIN f ON v.id = f.id)
SELECT CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= 20""")
def d02_hybrid_plain(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid_search(works(spark, sf), query_vector(spark, sf), TERMS, 20, 0.1).select("rank", "id", "score")


@query("SELECT id, round(coalesce(1.0 / (60 + a), 0.0) + coalesce(1.0 / (60 + b), 0.0), 6) AS score FROM (SELECT id, CASE WHEN id % 3 <> 0 THEN id + 1 END AS a, CASE WHEN id % 2 = 0 THEN id // 2 + 1 END AS b FROM works)")
def d05_rrf(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    a, b = F.when(i % 3 != 0, i + 1), F.when(i % 2 == 0, F.floor(i / 2) + 1)
    return works(spark, sf).select("id", F.round(search.rrf(a, b), 6).alias("score"))


@query(FACETS_SQL.replace("SELECT id, max(CASE WHEN hit", "SELECT id, CAST(row_number() OVER (ORDER BY count(*) FILTER (hit) DESC, round(exp(avg(ln(greatest(sim, 0.01)))), 6) DESC, id) AS INTEGER) AS pos, max(CASE WHEN hit"))
def d11_facet_order(spark: SparkSession, sf: str) -> DataFrame:
    facets = table(spark, sf, "embeddings").where("vec_id in (0, 1, 2)").select(F.col("vec_id").alias("facet"), F.col("embedding").alias("q"))
    return search.facet_order(search.multi_facet(works(spark, sf), facets, 100, 0.05))


@query("""
, one AS (SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS r FROM scored WHERE cosine >= 0.05)
, n AS (SELECT count(*) FILTER (r <= 200) AS n FROM one)
, facets AS (SELECT vec_id AS facet, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (0, 1, 2))
, sims AS (SELECT s.id, facet, round(list_cosine_similarity(s.embedding, q), 6) AS sim FROM searchable s, facets)
, hit AS (SELECT id, max(sim) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY sim DESC, id) AS r FROM sims) WHERE r <= 200 AND sim >= 0.05 GROUP BY id)
SELECT id, 'single' AS stage, cosine AS similarity FROM one, n WHERE r <= 200 AND n >= 200
UNION ALL SELECT id, 'facets', sim FROM hit, n WHERE n < 200""")
def d14_escalation(spark: SparkSession, sf: str) -> DataFrame:
    facets = table(spark, sf, "embeddings").where("vec_id in (0, 1, 2)").select(F.col("vec_id").alias("facet"), F.col("embedding").alias("q"))
    return search.escalated(works(spark, sf), query_vector(spark, sf), facets, 200, 0.05)


SYNONYMS = [("en|is", ["english", "The"]), ("le|la", ["french"]), ("der|und", ["german", "and"])]


@query("""SELECT conv_id, turn, concat_ws(' ', s2, CASE WHEN regexp_matches(low, 'der|und') THEN nullif(concat_ws(' ', CASE WHEN NOT contains(lower(s2), 'german') THEN 'german' END, CASE WHEN NOT contains(lower(s2), 'and') THEN 'and' END), '') END) AS query
 FROM (SELECT *, concat_ws(' ', s1, CASE WHEN regexp_matches(low, 'le|la') AND NOT contains(lower(s1), 'french') THEN 'french' END) AS s2
  FROM (SELECT conv_id, turn, lower(text) AS low, concat_ws(' ', text, CASE WHEN regexp_matches(lower(text), 'en|is') THEN nullif(concat_ws(' ', CASE WHEN NOT contains(lower(text), 'english') THEN 'english' END, CASE WHEN NOT contains(lower(text), 'the') THEN 'The' END), '') END) AS s1
   FROM conversations WHERE text IS NOT NULL))""", False)
def d15_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", search.expand_synonyms(F.col("text"), SYNONYMS).alias("query"))


STOP_SQL = ", ".join(map(repr, X.STOPWORDS))


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter({words_sql('text')}, lambda w: length(w) > 2 AND w NOT IN ({STOP_SQL}))),
 lambda w: {{'n': -(length(w) + CASE WHEN w IN ('thing', 'user') THEN 10 ELSE 0 END), 'w': w}}))[1:3], lambda x: x.w), ' ') AS terms FROM conversations""", False)
def d16_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(search.pick_terms(F.col("text"), 3, ["thing", "user"]), " ").alias("terms"))


def _channel_sql(name: str) -> str:
    return CHANNELS_SQL + f"SELECT id, similarity FROM hits WHERE channel = '{name}'"


@query(_channel_sql("causal"))
def d21_causal(spark: SparkSession, sf: str) -> DataFrame:
    return search.causal_channel(works(spark, sf), TERMS).select("id", "similarity")


@query(_channel_sql("recent"))
def d22_recent(spark: SparkSession, sf: str) -> DataFrame:
    return search.recent_channel(works(spark, sf), TERMS).select("id", "similarity")


@query(_channel_sql("foundational"))
def d23_foundational(spark: SparkSession, sf: str) -> DataFrame:
    return search.foundational_channel(works(spark, sf), query_vector(spark, sf), TERMS).select("id", "similarity")


@query(f"""SELECT conv_id, turn, b AS variant FROM (SELECT conv_id, turn, array_to_string(list_filter({words_sql('text')}, lambda w: w NOT IN ({STOP_SQL})), ' ') AS b FROM conversations) q
 UNION ALL SELECT conv_id, turn, b || ' developing countries' FROM (SELECT conv_id, turn, array_to_string(list_filter({words_sql('text')}, lambda w: w NOT IN ({STOP_SQL})), ' ') AS b FROM conversations) WHERE NOT contains(b, 'countr')
 UNION ALL SELECT conv_id, turn, b || ' systematic review' FROM (SELECT conv_id, turn, array_to_string(list_filter({words_sql('text')}, lambda w: w NOT IN ({STOP_SQL})), ' ') AS b FROM conversations) WHERE NOT regexp_matches(b, 'review|meta')""", False)
def d27_variants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(search.query_variants(F.col("text"))).alias("variant"))


@query(f"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN list_contains(ws, 'the') THEN 'article' END, CASE WHEN contains(lower(text), 'of the') THEN 'phrase' END, CASE WHEN list_has_all(ws, ['and', 'to']) THEN 'both' END], lambda x: x IS NOT NULL), ',') AS facets
 FROM (SELECT *, {words_sql('text')} AS ws FROM conversations) WHERE text IS NOT NULL""", False)
def d28_facets(spark: SparkSession, sf: str) -> DataFrame:
    facets = {"article": (["the"], []), "phrase": (["of the"], []), "both": ([], ["and", "to"])}
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.array_join(search.matched_facets(F.col("text"), facets), ",").alias("facets"))


# --- reports ------------------------------------------------------------------------------------------------------------


@query(f", {EDGES_SQL} SELECT e.cited AS id, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, max(w.citation_count) DESC NULLS LAST, e.cited) AS INTEGER) AS rank FROM edges e JOIN works w ON w.id = e.cited GROUP BY e.cited QUALIFY rank <= 100")
def e03_cocitations(spark: SparkSession, sf: str) -> DataFrame:
    counted = joins.with_ids(_edges(spark, sf).withColumnRenamed("cited", "id"), works(spark, sf)).groupBy("id").agg(F.count("*").alias("n"))
    return search.top(counted.join(works(spark, sf).select("id", "citation_count"), "id"), [F.desc("n"), F.desc_nulls_last("citation_count"), F.asc("id")], 100).select("id", "n", "rank")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type", False)
def e11_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    found = percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT venue, CAST(floor(100.0 * count(*) FILTER (sms_level >= 4) / count(*) + 0.5) AS INTEGER) AS strong_share, count(*) FILTER (region = 'LAC') AS lac FROM works GROUP BY venue")
def e21_so_what(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.so_what(works(spark, sf), "venue")


SIGNALS_SQL = """
s AS (SELECT user_id, event_id % 3 AS domain, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS signal FROM events),
g AS (SELECT user_id, domain, count(*) FILTER (signal > 0) AS pos, count(*) FILTER (signal < 0) AS neg FROM s GROUP BY ALL HAVING count(*) FILTER (signal <> 0) >= 8)
"""


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    kind = analytics.mapped("event_type", analytics.FEEDBACK)
    return table(spark, sf, "events").select("user_id", (F.col("event_id") % 3).alias("domain"), feedback.signal(F.coalesce(kind, F.lit(""))).alias("signal"))


@query(f"WITH {SIGNALS_SQL} SELECT * FROM g", False)
def e27_signals(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.signal_counts(_signals(spark, sf))


@query(f"WITH {SIGNALS_SQL} SELECT user_id, domain, round(least(greatest(least(greatest(0.5 + 1.5 * (pos + 1) / (pos + neg + 2), 0.85), 1.15), 0.5), 2.0), 6) AS weight FROM g", False)
def l04_clamped(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.beta_weights(_signals(spark, sf)).select("user_id", "domain", "weight")


@query(POOL_SQL + "SELECT sms_level, count(*) AS n, round(100.0 * sum(CASE WHEN region = 'LAC' THEN 1 ELSE 0 END) / count(*), 1) AS lac_rate, round(avg(sms_level), 2) AS mean FROM pool WHERE pos <= 20 GROUP BY GROUPING SETS ((sms_level), ()) ")
def n08_levels_of_top(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.level_distribution(_pool(spark, sf), 20)


# --- ranks and scores ---------------------------------------------------------------------------------------------------


@query("SELECT id, CAST(row_number() OVER (ORDER BY cosine DESC, id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 300")
def f01_row_number(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked(with_cosine(searchable(works(spark, sf)), query_vector(spark, sf)), "cosine", 300).select("id", "rank")


@query(POOL_SQL + "SELECT id, CAST(count(*) FILTER (coalesce(sms_level <= 2, true)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS weak_before FROM pool")
def f07_running_count(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.weak_before(_pool(spark, sf)).select("id", "weak_before")


@query("SELECT id, CAST(row_number() OVER (ORDER BY sms_level DESC NULLS LAST, year DESC, citation_count DESC NULLS LAST, id) AS INTEGER) AS rank FROM works QUALIFY rank <= 120")
def g01_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc_nulls_last("sms_level"), F.desc("year"), F.desc_nulls_last("citation_count"), F.asc("id")]
    return search.top(works(spark, sf), order, 120).select("id", "rank")


@query("SELECT id, round(least(greatest((cosine - 0.5) / (0.65 - 0.5), 0.0), 1.0), 6) AS ramp, CAST(1.0 AS DOUBLE) AS off FROM scored")
def g04_ramp(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_cosine(searchable(works(spark, sf)), query_vector(spark, sf))
    return rows.select("id", F.round(N.region_ramp(F.col("cosine")), 6).alias("ramp"), N.region_ramp(F.col("cosine"), 0.6, 0.6).alias("off"))


REVIEW_SQL = f"regexp_matches(lower(title), '{rerank.REVIEW_TITLE}')"


@query(POOL_SQL + f"""
, l AS (SELECT *, round(least(greatest(max(cosine) OVER () - 0.18, 0.32), 0.50), 6) AS gate FROM pool)
SELECT id, CAST(directness AS DOUBLE) AS directness, CAST(bonus AS DOUBLE) AS bonus FROM (SELECT id, CASE WHEN cosine >= gate THEN CASE WHEN region = 'LAC' THEN 0.10 ELSE 0.07 END WHEN cosine >= round(gate - 0.08, 6) THEN 0.0 ELSE -0.15 END AS directness, CASE WHEN topic = 'topic1' OR {REVIEW_SQL} THEN 0.025 ELSE 0.0 END AS bonus FROM l)""")
def g07_directness(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    gated = _pool(spark, sf).withColumn("gate", rerank.cosine_gate(F.max("cosine").over(Window.partitionBy())))
    label = rerank.topicality(F.col("cosine"), F.col("gate"), F.coalesce(F.col("region") == "LAC", F.lit(False)))
    design = F.when(F.col("topic") == "topic1", "Review")
    return gated.select("id", rerank.directness(label).alias("directness"), rerank.review_bonus(design, F.col("title")).alias("bonus"))


@query(f"""SELECT id, round(0.282 * least(greatest(cosine, 0.0), 1.0) + 0.046 * ({cites_sql()}) + 0.400 * least(greatest(coalesce(sms_level, 0) / 5.0, 0.0), 1.0)
 + 0.021 * greatest(0.0, 1 - ({NOW} - year) / 25.0) + 0.146 * coalesce(CAST(region = 'LAC' AS DOUBLE), 0.0) + 1e-10, 6) AS score FROM scored""")
def g09_channel_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_cosine(searchable(works(spark, sf)), query_vector(spark, sf))
    return rerank.channel_score(rows, "causal", NOW, "LAC").select("id", "score")


@query(POOL_SQL + """, g AS (SELECT *, round(least(greatest(max(cosine) OVER () - 0.18, 0.32), 0.50), 6) AS gate FROM pool)
SELECT CASE WHEN cosine >= gate THEN CASE WHEN region = 'LAC' THEN 'direct-lac' ELSE 'direct-global' END WHEN cosine >= round(gate - 0.08, 6) THEN 'indirect' ELSE 'excluded' END AS label, count(*) AS n FROM g GROUP BY 1""")
def g17_topicality(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    gated = _pool(spark, sf).withColumn("gate", rerank.cosine_gate(F.max("cosine").over(Window.partitionBy())))
    return gated.groupBy(rerank.topicality(F.col("cosine"), F.col("gate"), F.coalesce(F.col("region") == "LAC", F.lit(False))).alias("label")).agg(F.count("*").alias("n"))


@query(POOL_SQL + "SELECT id, CAST(pos AS INTEGER) AS pos, pos <= 40 AS shown FROM pool WHERE pos <= 60")
def g29_load_more(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.load_more(_pool(spark, sf), pages=2, size=20, ahead=1).select("id", "pos", "shown")


# --- keys and text ------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, regexp_replace(lower(CASE WHEN c_custkey % 2 = 0 THEN split_part(c_name || ', ' || c_mktsegment, ',', 1) ELSE list_last(string_split_regex(trim(c_name || ' ' || c_mktsegment), ' +')) END), '[^a-z0-9]', '', 'g') AS surname FROM customer", False)
def i03_surnames(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(", "), "c_mktsegment")).otherwise(F.concat("c_name", F.lit(" "), "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", X.surname(name).alias("surname"))


@query(f"SELECT id, CASE WHEN length({title_sql('title')}) > 0 AND CASE WHEN id % 7 <> 0 THEN year END IS NOT NULL THEN {title_sql('title')} || '|' || surname || '|' || year END AS key FROM works")
def i04_canonical_keys(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).select("id", X.canonical_key(X.normalize_title(F.col("title")), F.col("surname"), F.when(F.col("id") % 7 != 0, F.col("year"))).alias("key"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '10.1/ab' || page_id WHEN 1 THEN '10.1/ab' || page_id ELSE 'http://dx.doi.org/10.1/ab' || page_id END AS only_doi, '10.1/ab' || page_id AS both FROM pages", False)
def i06_dois(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    doi = F.concat(F.when(i % 3 == 0, "").when(i % 3 == 1, "https://doi.org/").otherwise("http://dx.doi.org/"), F.lit("10.1/AB"), i.cast("string"))
    return table(spark, sf, "pages").select("page_id", X.normalize_doi(doi, dx=False).alias("only_doi"), X.normalize_doi(doi).alias("both"))


@query("SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(replace(lower('The ' || s_name || ' & Sons (series)'), '&', ' and '), ' *\\([^)]*\\) *$', ''), '^the ', ''), '[^a-z0-9]', '', 'g') AS key FROM supplier", False)
def i07_venue_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", X.venue_key(F.concat(F.lit("The "), "s_name", F.lit(" & Sons (series)"))).alias("key"))


def _token_sets(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (F.array_distinct(X.tokens(F.col(c))) for c in ("title", "abstract"))
    return works(spark, sf).select("id", a.alias("a"), b.alias("b"))


SETS_SQL = f"(SELECT id, list_distinct({words_sql('title')}) AS a, list_distinct({words_sql('abstract')}) AS b FROM works)"


def _share_sql(under: str) -> str:
    return f"SELECT id, round(CASE WHEN {under} > 0 THEN len(list_intersect(a, b)) / CAST({under} AS DOUBLE) ELSE 0.0 END, 6) AS share FROM {SETS_SQL}"


@query(_share_sql("greatest(len(a), len(b))"))
def i09_token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _token_sets(spark, sf).select("id", F.round(X.overlap(F.col("a"), F.col("b"), "max"), 6).alias("share"))


@query(_share_sql("least(len(a), len(b))"))
def i10_overlap_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    return _token_sets(spark, sf).select("id", F.round(X.overlap(F.col("a"), F.col("b"), "min"), 6).alias("share"))


@query(_share_sql("len(a)"))
def i11_author_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _token_sets(spark, sf).select("id", F.round(X.author_overlap(F.col("a"), F.col("b")), 6).alias("share"))


CITING_SQL = "'[' || replace(text, ' ', '] [') || '] [' || doc_id || ']'"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_filter(['er', 'ing', 'license', 'zz', CAST(doc_id AS VARCHAR)], lambda x: contains(t, '[' || x || ']'))), ',') AS ids FROM (SELECT doc_id, {CITING_SQL} AS t FROM documents)""", False)
def i15_cited_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids cited in whole texts: every word of a document stands in brackets, as citations do, and its own id at the end."""
    t = F.concat(F.lit("["), F.replace("text", F.lit(" "), F.lit("] [")), F.lit("] ["), F.col("doc_id").cast("string"), F.lit("]"))
    known = F.array(F.lit("er"), F.lit("ing"), F.lit("license"), F.lit("zz"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.array_intersect(known, X.cited_ids(t))), ",").alias("ids"))


@query(f"SELECT id, translate(title, '{X.ACCENTED}', '{X.FOLDED}') AS folded FROM works")
def i23_folded(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).select("id", X.fold(F.col("title")).alias("folded"))


@query("SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS last, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages", False)
def i27_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.last_path_segment(F.col("url")).alias("last"), X.url_parameter(F.col("url"), "page").alias("page"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '10.1234/abc.' || doc_id ELSE nullif(regexp_replace(lower(regexp_extract(text, '(10\\.[0-9]{4,9}/[A-Za-z0-9./_()-]+)', 1)), '[.,;)]+$', ''), '') END AS doi FROM documents""", False)
def i28_found_dois(spark: SparkSession, sf: str) -> DataFrame:
    """The first DOI of whole texts, half of which have one put before them."""
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("(see doi:10.1234/ABC."), F.col("doc_id").cast("string"), F.lit(".) "), "text")).otherwise(F.concat(F.lit("no identifier, 10.12/x "), "text"))
    return table(spark, sf, "documents").select("doc_id", X.find_doi(t).alias("doi"))


# --- numbers ------------------------------------------------------------------------------------------------------------


@query("SELECT id, CAST(floor(year / 10.0) * 10 AS INTEGER) AS decade FROM works")
def j02_decades(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).select("id", N.decade(F.col("year")).alias("decade"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events", False)
def j03_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""SELECT id, round(ln(1 + c), 6) AS log1p, round(log10(c + 1), 6) AS log10, round(sqrt(c), 6) AS root, round(exp(-c / 100.0), 6) AS decay, round(pow(c / 600.0, 1.5), 6) AS power,
 CASE WHEN c IS NOT NULL THEN CAST(least(greatest(c, 50), 400) AS DOUBLE) END AS clamped FROM (SELECT id, citation_count AS c FROM works)""")
def j04_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("citation_count")
    r = lambda x: F.round(x, 6)
    return works(spark, sf).select("id", r(F.log1p(c)).alias("log1p"), r(F.log10(c + 1)).alias("log10"), r(F.sqrt(c)).alias("root"), r(F.exp(-c / 100.0)).alias("decay"), r(F.pow(c / 600.0, F.lit(1.5))).alias("power"), N.clamp(c.cast("double"), 50.0, 400.0).alias("clamped"))


@query("SELECT id, round(CASE WHEN a <= 0 OR b <= 0 THEN 0.0 ELSE 2 / (1.0 / a + 1.0 / b) END, 6) AS mean FROM (SELECT id, id % 5 AS a, id % 7 + 1 AS b FROM works)")
def j06_harmonic(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    values = F.array((i % 5).cast("double"), (i % 7 + 1).cast("double"))
    return works(spark, sf).select("id", F.round(N.harmonic_mean(values), 6).alias("mean"))


@query("SELECT id, CAST(id % 4 AS INTEGER) AS n, CASE WHEN id % 4 > 0 THEN 'author 0 of ' || id END AS first FROM works")
def j08_json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    names = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (i % 4).cast("int")), lambda k: F.concat(F.lit("author "), k.cast("string"), F.lit(" of "), i.cast("string")))
    parsed = X.json_array(F.to_json(names))
    return works(spark, sf).select("id", F.size(parsed).alias("n"), F.get(parsed, F.lit(0)).alias("first"))


@query(f"SELECT id, CAST(len(ws) AS INTEGER) AS n, list_contains(ws, 'the') AS has, list_has_any(ws, ['and', 'der']) AS some, split_part(title, ' ', 2) AS second FROM (SELECT id, title, {words_sql('title')} AS ws FROM works)")
def j09_arrays(spark: SparkSession, sf: str) -> DataFrame:
    rows = works(spark, sf).select("id", "title", X.tokens(F.col("title")).alias("ws"))
    return rows.select("id", F.size("ws").alias("n"), F.array_contains("ws", "the").alias("has"), predicates.overlaps(F.col("ws"), ["and", "der"]).alias("some"), F.split_part("title", F.lit(" "), F.lit(2)).alias("second"))


@query("SELECT id, CASE WHEN repec_percentile >= 95 THEN 'top5' WHEN repec_percentile >= 90 THEN 'top10' WHEN repec_percentile >= 75 THEN 'top25' WHEN repec_percentile >= 50 THEN 'top50' WHEN repec_percentile IS NOT NULL THEN 'other' END AS band FROM works")
def j12_bands(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).select("id", N.percentile_band(F.col("repec_percentile")).alias("band"))


@query("SELECT id, CASE publication_type WHEN 'journal_article' THEN 1 WHEN 'working_paper' THEN 2 ELSE 9 END AS rank FROM works")
def j13_type_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).select("id", N.publication_rank(F.col("publication_type")).alias("rank"))


# --- labels -------------------------------------------------------------------------------------------------------------


@query("""SELECT id, CASE WHEN up AND down THEN 'mixed' WHEN up THEN 'positive' WHEN down THEN 'negative' WHEN regexp_matches(t, 'no effect|insignificant|null') THEN 'null' ELSE 'unclear' END AS direction,
 array_to_string(list_filter([CASE WHEN citation_count IS NULL THEN 'citation_count' END, CASE WHEN sms_level IS NULL THEN 'sms_level' END, CASE WHEN region IS NULL THEN 'region' END], lambda x: x IS NOT NULL), ',') AS missing
 FROM (SELECT *, lower(abstract) AS t, regexp_matches(lower(abstract), 'increas|improv|positive|rise') AS up, regexp_matches(lower(abstract), 'decreas|reduc|negative|declin') AS down FROM works)""")
def k11_critical_fields(spark: SparkSession, sf: str) -> DataFrame:
    missing = F.array_join(classify.missing_fields(["citation_count", "sms_level", "region"]), ",")
    return works(spark, sf).select("id", classify.effect_direction(F.col("abstract")).alias("direction"), missing.alias("missing"))


VENUE_RULES = [("%1%", {"venue": "Series of ones", "publication_type": "working_paper"}), ("src_", {"venue": "Short source", "publication_type": "journal_article"})]


@query("""SELECT id, CASE WHEN venue ILIKE '%1%' THEN 'Series of ones' WHEN venue ILIKE 'src_' THEN 'Short source' ELSE venue END AS venue,
 CASE WHEN venue ILIKE '%1%' THEN 'working_paper' WHEN venue ILIKE 'src_' THEN 'journal_article' ELSE publication_type END AS publication_type FROM works""")
def k17_venues(spark: SparkSession, sf: str) -> DataFrame:
    return classify.normalised(works(spark, sf), "venue", VENUE_RULES).select("id", "venue", "publication_type")


@query("""SELECT id, array_to_string(CASE WHEN id % 6 = 0 THEN ['recent'] ELSE list_filter([CASE WHEN sms_level >= 4 THEN 'causal' END, CASE WHEN citation_count >= 75 AND year < 2020 THEN 'foundational' END, CASE WHEN year >= 2020 THEN 'recent' END, CASE WHEN region = 'LAC' THEN 'lac' END], lambda x: x IS NOT NULL) END, ',') AS channels FROM scored""")
def k20_row_channels(spark: SparkSession, sf: str) -> DataFrame:
    """What retrieval recorded counts; without a record the channels are worked out again."""
    rows = with_cosine(searchable(works(spark, sf)), query_vector(spark, sf))
    known = F.when(F.col("id") % 6 == 0, F.array(F.lit("recent")))
    again = classify.paper_channels(F.col("cosine"), F.col("sms_level"), F.col("citation_count"), F.col("year"), F.col("region"))
    return rows.select("id", F.array_join(F.coalesce(known, again), ",").alias("channels"))
