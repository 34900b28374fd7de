"""Queries over tables that are derived once: the inverted index, the vector cells, keyed tables; and over state of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.operators import cells, classifier, inverted
from kelpgrid.plans.catalog import FILTERS, FILTERS_SQL, NOW, query, words_sql
from kelpgrid.plans.works import query_vector, searchable, works
from kelpgrid.sources.keyed import KeyedTable
from kelpgrid.sources.stored import built_once, new_path, written
from kelpgrid.sources.tables import table
from kelpgrid.streaming import state

WEB_QUERY = '"anea eriner" attion -thble or thon er or inging'


def index_path(spark: SparkSession, sf: str) -> str:
    """The inverted index of titles and abstracts, built on first use."""
    text = F.concat_ws(" ", "title", "abstract")
    return built_once(spark, "inverted", sf, lambda path: inverted.build_index(works(spark, sf).select("id", "title", "abstract"), text, path))


def cells_path(spark: SparkSession, sf: str) -> str:
    """The cells of the vectors that searches may return, built on first use."""
    return built_once(spark, "cells", sf, lambda path: cells.build_cells(searchable(works(spark, sf)).select("id", "embedding"), path))


# The stemmer's rules as replacements, one after the other.
STEM_SQL = """
stem1 AS (SELECT id, pos, word, CASE WHEN length(word) < 3 THEN word WHEN regexp_matches(word, '(sses|ies)$') THEN word[:-3] WHEN regexp_matches(word, '[^s]s$') THEN word[:-2] ELSE word END AS a FROM toks),
stem2 AS (SELECT *, CASE WHEN length(word) < 3 THEN NULL WHEN regexp_matches(a, '([aeiou]|[^aeiou]y).*[^e]ed$') OR regexp_matches(a, '([aeiou]|[^aeiou]y)ed$') AND a NOT LIKE '%eed' THEN a[:-3] WHEN regexp_matches(a, '([aeiou]|[^aeiou]y).*ing$') THEN a[:-4] END AS cut FROM stem1),
stem3 AS (SELECT *, CASE WHEN cut IS NULL THEN CASE WHEN length(word) > 2 AND regexp_matches(a, '[aeiouy][^aeiouy].*eed$') THEN a[:-2] ELSE a END
   WHEN regexp_matches(cut, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN cut[:-2]
   WHEN regexp_matches(cut, '(at|bl|iz)$') OR regexp_matches(cut, '^[^aeiouy]*[aeiouy][^aeiouywx]$') THEN cut || 'e' ELSE cut END AS b FROM stem2),
stem4 AS (SELECT id, pos, word, CASE WHEN length(word) > 2 AND regexp_matches(b, '([aeiou]|[^aeiou]y).*y$') THEN b[:-2] || 'i' ELSE b END AS d FROM stem3),
terms AS (SELECT id, pos, CASE WHEN length(word) > 2 AND d LIKE '%e' AND (regexp_matches(d[:-2], '^[^aeiouy]*([aeiouy]+[^aeiouy]+){2}') OR regexp_matches(d[:-2], '[aeiouy][^aeiouy]') AND NOT regexp_matches(d[:-2], '[^aeiouy][aeiouy][^aeiouywx]$')) THEN d[:-2] ELSE d END AS term FROM stem4)
"""
STOP_SQL = ", ".join(f"'{w}'" for w in X.STOPWORDS)
LEXICAL_SQL = f"""
, toks AS (SELECT * FROM (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT id, {words_sql("concat_ws(' ', title, abstract)")} AS ws FROM works)) WHERE word NOT IN ({STOP_SQL}))
, {STEM_SQL.strip()}
, spans AS (
  SELECT a.id, 0 AS item, a.pos AS s, b.pos AS e FROM terms a JOIN terms b ON a.id = b.id AND b.pos = a.pos + 1 AND a.term = 'anea' AND b.term = 'eriner'
  UNION ALL SELECT id, CASE term WHEN 'attion' THEN 1 WHEN 'thble' THEN 2 WHEN 'thon' THEN 3 WHEN 'er' THEN 4 ELSE 5 END, pos, pos FROM terms WHERE term IN ('attion', 'thble', 'thon', 'er', 'ing')
), matched AS (
  SELECT id, bool_or(item = 0) AND bool_or(item = 1) AND NOT bool_or(item = 2) AS g0, bool_or(item = 3) AND bool_or(item = 4) AS g1, bool_or(item = 5) AS g2 FROM spans GROUP BY id
), reached AS (
  SELECT spans.id, e, g0, g1, g2, max(s) FILTER (item = 0) OVER w AS l0, max(s) FILTER (item = 1) OVER w AS l1, max(s) FILTER (item = 3) OVER w AS l3, max(s) FILTER (item = 4) OVER w AS l4, max(s) FILTER (item = 5) OVER w AS l5
  FROM spans JOIN matched USING (id) WHERE g0 OR g1 OR g2 WINDOW w AS (PARTITION BY spans.id ORDER BY e RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), begun AS (
  SELECT id, e, greatest(CASE WHEN g0 AND l0 IS NOT NULL AND l1 IS NOT NULL THEN least(l0, l1) END, CASE WHEN g1 AND l3 IS NOT NULL AND l4 IS NOT NULL THEN least(l3, l4) END, CASE WHEN g2 THEN l5 END) AS b FROM reached
), covers AS (SELECT id, b, min(e) AS e FROM begun WHERE b IS NOT NULL GROUP BY id, b)
, places AS (SELECT DISTINCT id, pos FROM terms WHERE term IN ('anea', 'eriner', 'attion', 'thon', 'er', 'ing'))
, priced AS (SELECT c.id, c.b, 0.1::DOUBLE / (1 + (c.e - c.b) - (count(*) - 1)) AS x FROM covers c JOIN places p ON p.id = c.id AND p.pos BETWEEN c.b AND c.e GROUP BY c.id, c.b, c.e)
, lex AS (SELECT id, round(sum(x), 6) AS fts FROM priced GROUP BY id)
"""


@query(LEXICAL_SQL + "SELECT id, fts, CAST(rank AS INTEGER) AS rank FROM (SELECT id, fts, row_number() OVER (ORDER BY fts DESC, id) AS rank FROM lex JOIN searchable USING (id)) WHERE rank <= 50")
def d06_websearch(spark: SparkSession, sf: str) -> DataFrame:
    return inverted.index_top_k(works(spark, sf), index_path(spark, sf), WEB_QUERY, 50).select("id", "fts", "rank")


@query(LEXICAL_SQL + f"""
, v AS (SELECT * FROM (SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS vector_rank FROM scored WHERE cosine >= 0.0) WHERE vector_rank <= 40)
, f AS (SELECT * FROM (SELECT id, fts, row_number() OVER (ORDER BY fts DESC, id) AS fts_rank FROM lex JOIN searchable USING (id) WHERE {FILTERS_SQL}) WHERE fts_rank <= 40)
, u AS (SELECT coalesce(v.id, f.id) AS id, cosine, fts, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(fts_rank AS INTEGER) AS fts_rank,
    round(coalesce(1.0 / (60 + vector_rank), 0.0) + coalesce(1.0 / (60 + fts_rank), 0.0), 6) AS score FROM v FULL JOIN f ON v.id = f.id)
SELECT CAST(rank AS INTEGER) AS rank, id, cosine, fts, vector_rank, fts_rank, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= 20""")
def d04_hybrid_stored(spark: SparkSession, sf: str) -> DataFrame:
    near = cells.index_cosine_top_k(spark, cells_path(spark, sf), query_vector(spark, sf), 40)
    return inverted.hybrid_index_search(near, works(spark, sf), index_path(spark, sf), WEB_QUERY, 20, FILTERS)


@query("SELECT id, CAST(rank AS INTEGER) AS rank, cosine FROM (SELECT id, cosine, row_number() OVER (ORDER BY cosine DESC, id) AS rank FROM scored WHERE cosine >= 0.0) WHERE rank <= 50")
def d01_stored_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells.index_cosine_top_k(spark, cells_path(spark, sf), query_vector(spark, sf), 50).select("id", "rank", "cosine")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (
  SELECT user_id, event_id, n, us, true AS admitted, [us] AS hits FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, us, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, us) ELSE kept END
  FROM (SELECT e.user_id, e.event_id, e.n, e.us, list_filter(r.hits, lambda h: h > e.us - 172800000000) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
 ) SELECT event_id, admitted FROM r""", False)
def m08_admitted(spark: SparkSession, sf: str) -> DataFrame:
    return state.admitted(table(spark, sf, "events"), "user_id", 172_800, 2).select("event_id", "admitted")


#: Four events of every job in turn: put in the queue, claimed by a worker, claimed by another, ended.
LEASE_KINDS = {"signup": "enqueue", "view": "claim", "click": "claim", "purchase": "complete", "error": "renew"}


@query(None)
def m04_leases(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in LEASE_KINDS.items() for x in kv])[F.col("event_type")]
    events = table(spark, sf, "events").select((F.col("user_id") % 97).alias("job"), "ts", F.concat(F.lit("w"), F.col("event_id") % 3).alias("worker"), kind.alias("kind"))
    return state.leases(events, 12 * 60, 50).select("job", "at", "worker", "outcome")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'second' WHEN doc_id % 2 = 0 THEN 'first' END AS origin,
 CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""", False)
def a10_keyed_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches written into a keyed table, the second merged over the first and sent twice, as after a failure."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))
    kept = KeyedTable(spark, new_path(spark, "keyed"), "id long, origin string, n long", "id", 16)
    kept.apply(docs.where("id % 2 = 0").withColumn("origin", F.lit("first")), 0, "docs")
    second = docs.where("id % 3 = 0").select("id", F.lit("second").alias("origin"), F.lit(None).cast("long").alias("n"))
    for _ in range(2):
        kept.apply(second, 1, "docs", merge=True)
    return kept.read()


# --- classifier -------------------------------------------------------------------------------------------------------

FLOOR = 0.1


def labelled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Works with labels, each paired with the query of its topic and language; toxic ones are irrelevant, good ones relevant."""
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return works(spark, sf).where("embedding is not null").join(labels, "id").withColumn("label", label).withColumn("qid", F.concat_ws("-", "topic", "lang"))


def topic_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty queries: five topics in four languages, with three facets and a vector each of the first twenty embeddings."""
    vectors = table(spark, sf, "embeddings").where("vec_id < 20").select((F.col("vec_id") % 5).alias("t"), F.floor(F.col("vec_id") / 5).alias("n"), F.col("embedding").cast("array<double>").alias("v"))
    by_topic = vectors.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") < 3, F.struct("n", "v")))), lambda x: x.v).alias("facets"), F.max_by("v", "n").alias("vector"))
    langs = table(spark, sf, "documents").select("lang").distinct()
    return by_topic.join(F.broadcast(langs)).select(F.concat_ws("-", F.concat(F.lit("topic"), F.col("t").cast("string")), "lang").alias("qid"), "facets", "vector")


def training_set(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.features(labelled_pairs(spark, sf), topic_queries(spark, sf), NOW, FLOOR)


@query(f"""
, l AS (SELECT doc_id AS id, CASE WHEN max(toxic) = 1 THEN 0 WHEN max(quality) = 1 THEN 2 ELSE 1 END AS label FROM labels GROUP BY doc_id)
, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 20)
, s AS (SELECT w.*, l.label, list_cosine_similarity(w.embedding, a.v) AS s0, list_cosine_similarity(w.embedding, b.v) AS s1, list_cosine_similarity(w.embedding, c.v) AS s2, list_cosine_similarity(w.embedding, d.v) AS sv
  FROM works w JOIN l USING (id) JOIN v a ON a.vec_id = w.id % 5 JOIN v b ON b.vec_id = w.id % 5 + 5 JOIN v c ON c.vec_id = w.id % 5 + 10 JOIN v d ON d.vec_id = w.id % 5 + 15 WHERE w.embedding IS NOT NULL)
, g AS (SELECT *, list_filter([s0, s1, s2], lambda x: x >= {FLOOR}) AS up, lower(translate(coalesce(title, '') || ' ' || substr(coalesce(abstract, ''), 1, 300), '{X.ACCENTED}', '{X.FOLDED}')) AS hay FROM s)
SELECT concat_ws('-', topic, lang) AS qid, id, label, round(s0, 6) AS facet_sim_0, round(s1, 6) AS facet_sim_1, round(s2, 6) AS facet_sim_2,
 CAST(s0 >= {FLOOR} AS DOUBLE) AS facet_sim_0_above_floor, CAST(s1 >= {FLOOR} AS DOUBLE) AS facet_sim_1_above_floor, CAST(s2 >= {FLOOR} AS DOUBLE) AS facet_sim_2_above_floor,
 round(CASE WHEN len(up) > 0 THEN exp(list_sum(list_transform(up, lambda x: ln(greatest(x, 0.000001)))) / len(up)) ELSE 0.0 END, 6) AS facet_sims_geometric_mean, round(sv, 6) AS single_vector_sim,
 CAST(regexp_matches(hay, '{classifier.REGION}') AS DOUBLE) AS geography_hit, CAST(year AS DOUBLE) AS year, CAST(greatest(0, {NOW} - year) AS DOUBLE) AS age_years, CAST(coalesce(citation_count, 0) AS DOUBLE) AS citation_count,
 round(coalesce(citation_count, 0) / CAST(greatest(1, greatest(0, {NOW} - year) + 1) AS DOUBLE), 6) AS citation_rate, CAST(coalesce(sms_level, 0) AS DOUBLE) AS sms_level, CAST(length(abstract) > 0 AS DOUBLE) AS has_abstract,
 CAST(length(abstract) AS DOUBLE) AS abstract_length, CASE abs_rating WHEN '4*' THEN 5.0::DOUBLE WHEN '4' THEN 4.0 WHEN '3' THEN 3.0 WHEN '2' THEN 2.0 ELSE 0.0 END AS abs_rating_numeric, round(coalesce(repec_percentile, 50) / 100.0, 6) AS repec_percentile FROM g""")
def n09_training_set(spark: SparkSession, sf: str) -> DataFrame:
    return training_set(spark, sf).select("qid", "id", "label", *[F.round(c, 6).alias(c) for c in classifier.FEATURES])


@query(None)
def k18_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(training_set(spark, sf), "training")
    return classifier.fold_scores(classifier.cross_validated(rows, 4))


@query(None)
def k18_trained_labels(spark: SparkSession, sf: str) -> DataFrame:
    """All works with a vector, labelled by a model of the labelled pairs."""
    model = classifier.trained(written(training_set(spark, sf), "training"))
    pairs = works(spark, sf).where("embedding is not null").withColumn("label", F.lit(None).cast("int")).withColumn("qid", F.concat_ws("-", "topic", "lang"))
    return classifier.scored(model, classifier.features(pairs, topic_queries(spark, sf), NOW, FLOOR)).select("id", "predicted", F.round("probability", 6).alias("probability"))
