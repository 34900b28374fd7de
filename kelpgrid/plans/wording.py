"""The registered queries of drafted prose, wording of queries, payloads, findings and due subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.operators import joins, wording
from kelpgrid.plans.catalog import NO_SQL, _pool, query, words_sql  # noqa: F401  (each choice of ``g30`` depends on the choices before it)
from kelpgrid.plans.more import _scored
from kelpgrid.plans.works import works
from kelpgrid.sources.tables import table

LETTERS = "abcdefghij"


def _lettered(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", LETTERS)


@query(f""", k AS (SELECT venue, year, id, 'surname' || translate(CAST(id % 23 AS VARCHAR), '0123456789', '{LETTERS}') AS nm FROM works)
, n AS (SELECT venue AS id, count(*) FILTER (year = 1990 AND contains('surnamebc', nm)) AS a, min(id) FILTER (year = 1990 AND contains('surnamebc', nm)) AS ia,
  count(*) FILTER (year = 1991 AND contains('surnamed', nm)) AS b, min(id) FILTER (year = 1991 AND contains('surnamed', nm)) AS ib FROM k GROUP BY venue)
SELECT id, 'As Surnamebc (1990)' || CASE WHEN a = 1 THEN ' [' || ia || ']' ELSE '' END || ' found' || CASE WHEN b = 1 THEN ' (Surnamed 1991) [' || ib || ']' WHEN b = 0 THEN '' ELSE ' (Surnamed 1991)' END || ' and.' AS text,
 CAST((a = 1)::INT + (b = 1)::INT AS BIGINT) AS linked, CAST(1 + (b = 0)::INT AS BIGINT) AS removed, CAST((a <> 1)::INT + (b > 1)::INT AS BIGINT) AS unresolved FROM n""")
def i18_linked_citations(spark: SparkSession, sf: str) -> DataFrame:
    w = works(spark, sf)
    papers = w.select(F.col("venue").alias("id"), F.col("id").alias("paper"), F.array(F.concat(F.lit("Surname"), _lettered(F.col("id") % 23))).alias("authors"), "year")
    bodies = w.select(F.col("venue").alias("id")).distinct().withColumn("text", F.lit("As Surnamebc (1990) found (Surnamed 1991) and (Nobody 1992)."))
    return wording.link_citations(bodies, papers)


@query("SELECT p_partkey AS id, (p_partkey % 7) || ' of 40 papers, ' || CASE WHEN abs(p_partkey % 60 - 30) > 3 THEN 30 ELSE p_partkey % 60 END || '% are SMS 4-5 and 5 LAC papers' AS text FROM part", False)
def i19_verified_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    said = F.concat((k % 7).cast("string"), F.lit(" of "), (k % 50).cast("string"), F.lit(" papers, "), (k % 60).cast("string"), F.lit("% are SMS 4-5 and "), (k % 9).cast("string"), F.lit(" LAC papers"))
    return table(spark, sf, "part").select(k.alias("id"), wording.verified_numbers(said, F.lit(40), F.lit(30), F.lit(5)).alias("text"))


@query("SELECT doc_id, 'a ' || CASE WHEN doc_id % 3 < 2 THEN '[k' || (doc_id % 3) || ']' ELSE '' END || ' b ' || CASE WHEN doc_id % 5 < 2 THEN '[k' || (doc_id % 5) || ']' ELSE '' END AS text FROM documents", False)
def i16_citation_fence(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    said = F.concat(F.lit("a [k"), (i % 3).cast("string"), F.lit("] b [k"), (i % 5).cast("string"), F.lit("]"))
    return table(spark, sf, "documents").select(i, X.citation_fence(said, F.array(F.lit("k0"), F.lit("k1"))).alias("text"))


@query("SELECT doc_id, length(substr(text, 1, 40 + doc_id % 400)) >= 0.7 * length(text) AND regexp_matches(substr(text, 1, 40 + doc_id % 400), '[.!?]\\s*$') AS accepted FROM documents", False)
def i22_accepted_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    rewrite = F.substr("text", F.lit(1), (40 + F.col("doc_id") % 400).cast("int"))
    return table(spark, sf, "documents").select("doc_id", X.ends_cleanly(F.col("text"), rewrite).alias("accepted"))


GROUPS_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(text), '\\b({'|'.join(words)})') THEN '{name}' END" for name, words in wording.POPULATIONS.items())


@query(f"SELECT conv_id, turn, array_to_string(list_filter([{GROUPS_SQL}], lambda x: x IS NOT NULL), ',') AS groups FROM conversations", False)
def i24_populations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(wording.populations(F.col("text")), ",").alias("groups"))


@query("SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('The NBER Working Paper No. 12 ' || title), '(nber|iza|ssrn|cesifo|cepr) (working paper|discussion paper|dp|wp)?( no\\.?)? ?[0-9]+', ' ', 'g'), '\\(preprint\\)', ' ', 'g'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM works")
def i05_series_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = X.series_title_key(F.concat(F.lit("The The NBER Working Paper No. 12 "), F.col("title")))
    return works(spark, sf).select("id", key.alias("key"))


FILLERS_SQL = ", ".join(repr(w) for w in wording.FILLERS)


@query(f"SELECT conv_id, turn, array_to_string(list_filter({words_sql('text')}, lambda w: length(w) >= 3 AND w NOT IN ({FILLERS_SQL})), ' ') AS query FROM conversations", False)
def d17_query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(wording.query_tokens(F.col("text")), " ").alias("query"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1990 WHEN p_partkey % 3 = 1 THEN greatest(CAST(1950 + p_partkey % 70 AS INTEGER) - 5, 1980) END AS since FROM part", False)
def d18_historical(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    asked = F.when(k % 3 == 0, "Long-run growth").when(k % 3 == 1, F.concat(F.lit("growth since the "), (1950 + k % 70).cast("string"), F.lit("s"))).otherwise("growth")
    return table(spark, sf, "part").select(k.alias("id"), wording.historical_from(asked).alias("since"))


@query("SELECT s_suppkey AS id, 'wages ' || CASE s_suppkey % 3 WHEN 0 THEN 'of women' WHEN 1 THEN 'and trade' ELSE 'fell' END AS query FROM supplier", False)
def d29_stripped_queries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    topic = F.when(k % 3 == 0, "of women").when(k % 3 == 1, "and trade").otherwise("fell")
    asked = F.concat(F.lit("Wages in Latin America "), topic, F.lit(" since 19"), (10 + k % 90).cast("string"), F.lit(" in Brazil recently"))
    return table(spark, sf, "supplier").select(k.alias("id"), wording.without_place_and_time(asked).alias("query"))


@query("SELECT id, id % 4 < 2 AS apparatus FROM works")
def b16_apparatus_titles(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    title = F.when(i % 4 == 0, "Figure 3").when(i % 4 == 1, " Supplementary material").when(i % 4 == 2, "Tabletop games").otherwise("Growth: an appendix")
    return works(spark, sf).select("id", wording.is_apparatus_title(title).alias("apparatus"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events", False)
def j10_lenient_json(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise("No object.")
    return table(spark, sf, "events").select("event_id", wording.lenient_json(answer, "k long").k.alias("k"))


@query("SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN NOT coalesce(role IN ('user', 'assistant'), false) THEN 'role' END, CASE WHEN NOT coalesce(length(trim(text)) BETWEEN 1 AND 200, false) THEN 'text' END], lambda x: x IS NOT NULL), ',') AS problems FROM conversations", False)
def j11_payload_problems(spark: SparkSession, sf: str) -> DataFrame:
    checks = {"role": F.col("role").isin("user", "assistant"), "text": F.length(F.trim("text")).between(1, 200)}
    return table(spark, sf, "conversations").select("conv_id", "turn", wording.problems(checks).alias("problems"))


@query("""WITH f AS (SELECT d.lang AS section, 'unsupported' AS kind, l.doc_id AS ref FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1
 UNION ALL SELECT d.lang, 'offTopic', l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 0)
SELECT section, count(*) AS n, array_to_string(list_sort(list_distinct(list(kind || ':' || ref))), ',') AS issues FROM f WHERE section <> '' GROUP BY section""", False)
def e31_grouped_findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    report = lambda where, kind, section: rows.where(where).select(section.alias("section"), F.lit(kind).alias("kind"), F.col("doc_id").alias("ref"))
    return wording.grouped_findings(report("toxic = 1", "unsupported", F.concat(F.lit("§"), "lang")), report("quality = 0", "offTopic", F.col("lang")))


@query("SELECT id, round(CASE WHEN sms_level >= 4 AND least(0.45, 1.8 * f) > 0 THEN 0.60 ELSE least(0.45, 1.8 * f) END, 6) AS similarity FROM (SELECT id, sms_level, CAST(id % 40 AS DOUBLE) / 100 AS f FROM works)")
def g06_lexical_proxy(spark: SparkSession, sf: str) -> DataFrame:
    return works(spark, sf).select("id", wording.lexical_proxy((F.col("id") % 40).cast("double") / 100, F.col("sms_level")).alias("similarity"))


@query("SELECT id, round(1 / log2(row_number() OVER (PARTITION BY venue ORDER BY cosine DESC, id) + 2), 6) AS gain FROM scored")
def f06_discounted(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("venue").orderBy(F.desc("cosine"), "id"))
    return _scored(spark, sf).withColumn("rank", rank).select("id", F.round(1 / F.log2(F.col("rank") + 2), 6).alias("gain"))


@query("SELECT c_custkey AS sub_id FROM customer WHERE c_custkey % 10 = 0 OR DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 7 END <= DATE '2024-01-15'", False)
def m05_due_digests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    last = F.when(k % 10 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int")))
    return table(spark, sf, "customer").where(wording.due(last, F.when(k % 2 == 0, 1).otherwise(7), "2024-01-15")).select(k.alias("sub_id"))


WORDS4_SQL = f"list_distinct(list_filter({words_sql('text')}, lambda w: length(w) >= 4))"


@query(f"""WITH s AS (SELECT item_id AS section, {WORDS4_SQL} AS sw FROM benchmark), p AS (SELECT doc_id AS paper, {WORDS4_SQL} AS pw FROM documents),
 o AS (SELECT section, paper, round(len(list_intersect(sw, pw)) / CAST(least(len(sw), len(pw)) AS DOUBLE), 6) AS overlap FROM s, p WHERE len(list_intersect(sw, pw)) > 0)
SELECT section, paper, overlap, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY overlap DESC, paper) AS place FROM o) WHERE place <= 8""", False)
def g23_candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    sections = table(spark, sf, "benchmark").select(F.col("item_id").alias("section"), "text")
    return wording.candidate_pool(sections, table(spark, sf, "documents").select(F.col("doc_id").alias("paper"), "text"))


@query("""SELECT l.id AS left_id, r.id AS right_id FROM (SELECT * FROM works WHERE publication_type = 'working_paper') l JOIN (SELECT * FROM works WHERE publication_type = 'journal_article') r
 ON md5(l.abstract) = md5(r.abstract) AND l.lang = r.lang AND abs(l.year - r.year) <= 40 QUALIFY count(*) OVER (PARTITION BY l.id) = 1 AND count(*) OVER (PARTITION BY r.id) = 1""")
def h12_republished(spark: SparkSession, sf: str) -> DataFrame:
    w = works(spark, sf).withColumn("key", F.md5("abstract"))
    same = (F.col("l.lang") == F.col("r.lang")) & (F.abs(F.col("l.year") - F.col("r.year")) <= 40)
    return joins.mutual_pairs(w.where("publication_type = 'working_paper'"), w.where("publication_type = 'journal_article'"), "key", same)


@query()
def g30_same_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The reranked pool, each pick dearer by the same findings picked before it."""
    pool = _pool(spark, sf).select(F.col("lang").alias("query"), "id", "score", F.substring("abstract", 1, 80).alias("intervention"), F.substring("abstract", 81, 80).alias("outcome"))
    return wording.select_with_findings(pool, 50)
