"""Hand-computed cases: nulls, ties, empty inputs and the reference vectors of gates, caps and prices."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kelpgrid.functions import numeric as N
from kelpgrid.functions import text as X
from kelpgrid.functions.vector import cosine, literal, only_row, parse_vector
from kelpgrid.operators import analytics, classify, dedup, drafts, evaluation, feedback, joins, predicates, rerank, search
from kelpgrid.sources import files
from kelpgrid.streaming import jobs


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


WORKS = "id long, year int, publication_type string, topic string, region string, sms_level int, abs_rating string, repec_percentile int, venue string"


def works(spark):
    rows = [(1, 2000, "journal_article", "a", "LAC", 5, "4", 10, "V1"), (2, None, "thesis", "b", "MENA", 1, "2", 99, "V2"), (3, 2020, None, None, None, None, None, None, None), (4, 1990, "journal_article", "a", "LAC", 0, None, 50, "Other")]
    return spark.createDataFrame(rows, WORKS)


@pytest.mark.parametrize(
    "filters,ids",
    [
        ({}, [1, 2, 3, 4]),
        ({"year_min": 2000}, [1, 3]),  # a null year does not pass
        ({"year_max": 1995}, [4]),
        ({"types": ("journal_article",)}, [1, 3, 4]),  # a null type passes
        ({"regions": ("MENA",)}, [2, 3]),
        ({"sms_levels": (0, 1)}, [2, 3, 4]),
        ({"repec_max": 50}, [1, 3, 4]),
        ({"venues": ("V1",)}, [1]),
        ({"venues": (), "venue_patterns": ("v%",), "include_unranked": True}, [1, 2, 4]),
    ],
)
def test_filters(spark, filters, ids):
    f = predicates.SearchFilters(**filters)
    assert f.active == bool(filters)
    assert sorted(r.id for r in works(spark).where(f.column()).collect()) == ids


def test_periods():
    assert predicates.period_filters("recent", 2025).year_min == 2020
    assert predicates.period_filters("recent", 2025, server=False).year_min == 2021
    assert predicates.period_filters("custom", 2025, custom=(1, 2)).year_max == 2
    assert not predicates.period_filters("all", 2025).active


def test_array_predicates(spark):
    a = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, predicates.contains_all(a, ["x"])) and not one(spark, predicates.contains_all(a, ["x", "z"]))
    assert one(spark, predicates.overlaps(a, ["z", "y"])) and not one(spark, predicates.overlaps(a, ["z"]))


def test_quality_gates(spark):
    assert one(spark, predicates.noise_reason(F.lit("A book review"))) == "book_review"
    assert one(spark, predicates.noise_reason(F.lit(None).cast("string"))) is None
    assert not one(spark, predicates.is_real_abstract(F.lit(None).cast("string")))
    assert one(spark, predicates.is_real_abstract(F.lit("A study of things " * 5)))
    assert not one(spark, predicates.is_real_abstract(F.lit("https://x.y " * 10)))
    assert one(spark, predicates.is_generic_title(F.lit("Table of Contents"))) and one(spark, predicates.is_generic_title(F.lit("Volume 12")))
    assert one(spark, predicates.old_enough(F.lit(None).cast("int"))) and not one(spark, predicates.old_enough(F.lit(1960)))


@pytest.mark.parametrize("cos,cites,year,passes", [(0.5, 0, 2021, True), (0.31, 0, 2021, False), (0.31, 100, 1999, True), (0.31, 100, 2021, False), (0.25, 100, 1999, False), (0.0, 0, 2021, True), (None, 0, None, True), (0.31, None, None, False)])
def test_gate(spark, cos, cites, year, passes):
    gate = rerank.cosine_gate(F.lit(0.58))
    assert one(spark, gate) == 0.4
    c, n, y = F.lit(cos).cast("double"), F.lit(cites).cast("int"), F.lit(year).cast("int")
    assert one(spark, rerank.passes_gate(c, n, y, gate)) is passes


def test_gate_bounds_and_labels(spark):
    assert one(spark, rerank.cosine_gate(F.lit(0.9))) == 0.5 and one(spark, rerank.cosine_gate(F.lit(0.2))) == 0.32
    label = lambda c, lac: one(spark, rerank.topicality(F.lit(c), F.lit(0.4), F.lit(lac)))
    assert [label(0.4, True), label(0.4, False), label(0.33, True), label(0.3, True)] == ["direct-lac", "direct-global", "indirect", "excluded"]


def test_profiles():
    assert rerank.profile(None)["causal"] == 0.3 and rerank.profile("unknown")["causal"] == 0.5 and rerank.profile("aggressive")["region"] == 1.0


def test_numbers(spark):
    assert one(spark, N.citation_score(F.lit(500), F.lit(2025), 2025)) == pytest.approx(1.0)
    assert one(spark, N.citation_score(F.lit(0), F.lit(2000), 2025)) == 0 and one(spark, N.citation_score(F.lit(10), F.lit(1800), 2025)) == 0
    assert one(spark, N.region_ramp(F.lit(0.575))) == pytest.approx(0.5) and one(spark, N.region_ramp(F.lit(0.1), 0.6, 0.5)) == 1.0
    assert one(spark, N.harmonic_mean(F.array(F.lit(1.0), F.lit(0.0)))) == 0
    assert one(spark, N.geometric_mean(F.array(F.lit(4.0), F.lit(9.0)))) == pytest.approx(6)
    assert one(spark, N.decade(F.lit(1999))) == 1990


def pool(spark, rows):
    return spark.createDataFrame(rows, "id long, cosine double, score double, sms_level int, title string, pos int")


def test_relevance_floor(spark):
    rows = pool(spark, [(i, 0.7 - 0.02 * i, 0.0, 3, "t", i) for i in range(20)])
    assert [r.id for r in rerank.relevance_floor(rows).orderBy("id").collect()] == list(range(8))  # 0.70 to 0.56 reach 0.55
    assert rerank.relevance_floor(rows, keep=12).count() == 12  # too few above: the best by cosine
    assert rerank.relevance_floor(rows, keep=12, strict=True).count() == 8


def greedy(rows, k):
    left, weak, out = sorted(rows, key=lambda r: (-r[2], r[0])), 0, []
    while left and len(out) < k:
        cost = lambda r: min(0.015 * (weak - 2), 0.06) if (r[3] is None or r[3] <= 2) and weak >= 3 else 0.0
        best = max(left, key=lambda r: (round(r[2] - cost(r), 6), r[2], -r[0]))
        left.remove(best)
        weak += best[3] is None or best[3] <= 2
        out.append(best[0])
    return out


def test_diverse_selection_is_greedy(spark):
    import random

    rng = random.Random(4)
    rows = [(i, 0.0, round(rng.uniform(0.3, 0.6), 3), rng.choice([None, 1, 2, 3, 5]), f"t{i}", i) for i in range(60)]
    got = rerank.select_diverse(pool(spark, rows), F.col("title"), 30).orderBy("pick").collect()
    assert [r.id for r in got] == greedy(rows, 30)


def test_evidence_floor(spark):
    rows = pool(spark, [(i, 0.0, 0.0, 5 if i in (3, 12, 15) else 1, "t", i) for i in range(1, 21)])
    got = sorted(r.id for r in rerank.evidence_floor(rows, 10, F.col("sms_level") >= 4, 2).collect())
    assert got == [1, 2, 3, 4, 5, 6, 7, 8, 9, 12]


def test_fusion_only_holds_rows_of_its_arms(spark):
    assert one(spark, search.rrf(F.lit(1), F.lit(None).cast("int"))) == pytest.approx(1 / 61)


def test_query_helpers(spark):
    assert one(spark, search.pick_terms(F.lit("the impact of early schooling on wages"), 2)) == ["schooling", "impact"]
    assert one(spark, search.pick_terms(F.lit("wages and schooling"), 1, ["wages"])) == ["wages"]
    assert one(spark, search.expand_synonyms(F.lit("women at work"), [("women", ["gender", "Women"]), ("gender", ["sex"])])) == "women at work gender"
    assert one(spark, search.query_variants(F.lit("effect of schools"))) == ["effect schools", "effect schools developing countries", "effect schools systematic review"]
    assert one(spark, search.query_variants(F.lit("review of countries"))) == ["review countries"]


def test_text(spark):
    t = lambda c: one(spark, c)
    assert t(X.normalize_title(F.lit(" The Big–Idea: a study (EN) "))) == "the big idea a study"
    assert t(X.dedup_title(F.lit("The Économie of a   School"))) == "economie of school"
    assert t(X.series_title_key(F.lit("The Wage Gap, NBER Working Paper No. 1234 (preprint)"))) == "wage gap"
    assert t(X.surname(F.lit("Pérez, Juan"))) == "perez" and t(X.surname(F.lit("Juan Pérez"))) == "perez"
    assert t(X.canonical_key(F.lit("a"), F.lit(None).cast("string"))) is None and t(X.canonical_key(F.lit("a"), F.lit(1))) == "a|1"
    assert t(X.normalize_doi(F.lit("https://dx.doi.org/10.1/AB"))) == "10.1/ab" and t(X.normalize_doi(F.lit("https://dx.doi.org/10.1/AB"), dx=False)) == "https://dx.doi.org/10.1/ab"
    assert t(X.find_doi(F.lit("see 10.1234/Ab.c). Then"))) == "10.1234/ab.c" and t(X.find_doi(F.lit("none"))) is None
    assert t(X.venue_key(F.lit("The Journal of A & B (online)"))) == "journalofaandb"
    assert t(X.token_sort_ratio(F.lit("b a c"), F.lit("a b c"))) == 100.0
    assert t(X.dice(X.bigrams(X.tokens(F.lit("a b c"))), X.bigrams(X.tokens(F.lit("a b d"))))) == 0.5
    assert t(X.word_count(F.lit(None).cast("string"))) == 0 and t(X.word_count(F.lit(" a  b "))) == 2
    assert t(X.citation_fence(F.lit("x [a1] y [b2]"), F.array(F.lit("a1")))) == "x [a1] y "
    assert t(X.strip_markup(F.lit("<![CDATA[<b>a</b>&nbsp;&amp;lt;]]>"))) == "a &lt;"
    assert t(X.url_domain(F.lit("https://www.News.org:80/a"))) == "news.org" and t(X.last_path_segment(F.lit("http://a/b/c/?q"))) == "c"


def test_vectors(spark):
    c = lambda a, b: one(spark, cosine(literal(a), literal(b)))
    assert c([1, 0], [1, 1]) == pytest.approx(0.70710678) and c([0, 0], [1, 1]) == 0 and c([1], [1, 1]) == 0
    assert one(spark, parse_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, parse_vector(F.lit("[1,NaN]"))) is None and one(spark, parse_vector(F.lit("[1,x]"))) is None
    with pytest.raises(ValueError):
        only_row(spark.range(2))


def test_levels(spark):
    level = lambda title, text, known=None: one(spark, classify.sms_level(F.lit(title), F.lit(text).cast("string"), F.lit(known).cast("int")))
    assert level("A randomized experiment", "we did") == 3 and level("A randomized experiment", None) == 2 and level("x", "y") is None and level("a survey", "b", 5) == 5
    cap = lambda n, how, text: one(spark, classify.capped_level(F.lit(n), F.lit(how), F.lit(text)))
    assert [cap(5, "keyword", "x"), cap(5, "keyword", ""), cap(5, "manual", ""), cap(1, "keyword", "")] == [3, 2, 5, 1]


def test_prices(spark):
    calls = spark.createDataFrame([("m", 1000, 10, 300, 200, 5), ("m", 100, 0, 300, 0, 0), ("other", 5, 5, 5, 5, 5)], "model string, tokens_in long, tokens_out long, cache_read long, cache_write long, thinking long")
    rates = spark.createDataFrame([("m", 2.0, 10.0)], "model string, rate_in double, rate_out double")
    got = sorted(r.usd for r in analytics.call_price(rates, calls).collect())
    assert got == [0.0, pytest.approx(6e-05), pytest.approx(0.00171)]


def test_budget_and_percentiles(spark):
    b = {k: one(spark, c) for k, c in analytics.budget(F.lit(0.0), 100.0, 10, 31).items()}
    assert b == {"remaining": 100.0, "pct": 0.0, "burn": 0.0, "eta_days": None}
    e = spark.createDataFrame([("a", "completed", float(v)) for v in (1, 2, 3, 4)] + [("a", "failed", None)], "act string, status string, latency double")
    row = analytics.completion_health(e, "act").first()
    assert (row.attempts, row.success, row.p95) == (5, 0.8, pytest.approx(3.85))
    assert analytics.floor_percentile(e, "act", "latency", 0.95).first().value == 3.0


def test_feedback(spark):
    rows = [("u", 1, 1)] * 9 + [("u", 2, -1)] * 9 + [("v", 1, 1)] * 7
    w = {(r.user_id, r.domain): (r.raw, r.weight) for r in feedback.beta_weights(spark.createDataFrame(rows, "user_id string, domain int, signal int")).collect()}
    assert w == {("u", 1): (pytest.approx(1.863636), 1.15), ("u", 2): (pytest.approx(0.636364), 0.85)}
    weights = spark.createDataFrame([("u", 1, 1.0), ("u", 3, 1.0)], "user_id string, domain int, weight double")
    proposals = spark.createDataFrame([("u", 1, 1.15, True), ("u", 3, 0.9, False), ("u", 4, 1.1, True)], "user_id string, domain int, weight double, approved boolean")
    assert {(r.domain, r.weight) for r in feedback.approve(weights, proposals).collect()} == {(1, 1.15), (3, 1.0), (4, 1.1)}


def test_joins_and_dedup(spark):
    schema = "id long, title string, year int, surname string, publication_type string"
    rows = [(1, "On Wages", 2000, "a", "working_paper"), (2, "On wages!", 2003, "a", "journal_article"), (3, "On Prices", 2000, "b", "working_paper"), (4, "On prices", 2001, "b", "journal_article"), (5, "on prices", 2002, "b", "journal_article"), (6, None, None, None, None)]
    w = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in dedup.cross_source_shadows(w).collect()] == [(1, 2)]  # prices are ambiguous
    key = X.normalize_title(F.col("title"))
    assert sorted(r.id for r in dedup.first_of_each(w, key, [F.asc("id")]).collect()) == [1, 3, 6]
    again = dedup.first_of_each(dedup.first_of_each(w, key, [F.asc("id")]), key, [F.asc("id")])
    assert again.count() == 3
    assert {tuple(r) for r in dedup.fuzzy_first(w).collect()} >= {(1, 1), (2, 2), (4, 4), (5, 5), (6, 6)}
    assert [tuple(r)[:2] for r in joins.match_gate(w.where("id = 3"), w.where("id = 4")).collect()] == [(3, 4)]
    edges = spark.createDataFrame([(1, 10), (2, 10), (1, 2), (2, 11)], "citing long, cited long")
    seeds = spark.createDataFrame([(1,), (2,)], "id long")
    assert {tuple(r) for r in joins.co_cited(edges, seeds).collect()} == {(10, 2), (11, 1)}


def test_sources(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k long, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "k long, v string, w string")
    assert {tuple(r) for r in files.merge_fields(old, new, "k", frozen=("w",)).collect()} == {(1, "a", None), (2, "b", "x"), (3, "c", "z")}
    assert {(r.k, r.v) for r in files.upsert(old, new, "k").collect()} == {(1, "a"), (2, None), (3, "c")}
    assert {(r.k, r.v) for r in files.upsert(old, new, "k", ignore=True).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert one(spark, files.csv_field(F.lit('a"b,c'))) == '"a""b,c"' and one(spark, files.csv_field(F.lit(None).cast("string"))) == ""
    assert one(spark, files.repaired_array(F.lit('["a","b"]'))) == ["a", "b"] and one(spark, files.repaired_array(F.lit("a; b"))) == ["a", "b"]
    feed = spark.createDataFrame([(1, "<rss><item><title>T &amp; U</title><link>http://x</link><description><![CDATA[<p>d</p>]]></description></item></rss>"), (2, None)], "id long, t string")
    assert [tuple(r) for r in files.feed_items(feed, "t", "id").collect()] == [(1, 0, "T & U", "http://x", "d")]
    words = spark.createDataFrame([(1, {"b": [1], "a": [0, 2]})], "id long, m map<string,array<int>>")
    assert files.inverted_abstract(words, "id", "m").first().abstract == "a b a"


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "truth string, said string")
    got = {r.label: (r.tp, r.fp, r.fn, r.f1) for r in evaluation.class_scores(rows).collect()}
    assert got == {"a": (1, 1, 1, 0.5), "b": (1, 1, 0, pytest.approx(0.666667)), "c": (0, 0, 1, 0.0)}


def test_section_of_a_gap(spark):
    gaps = spark.createDataFrame([("g", "wages schooling trade"), ("h", "nothing shared")], "gap string, text string")
    sections = spark.createDataFrame([("s1", "schooling and wages"), ("s2", "trade")], "section string, text string")
    assert [tuple(r) for r in drafts.best_section(gaps, sections).collect()] == [("g", "s1", 1.0)]


def test_claims(spark):
    q = spark.createDataFrame([(1, "queued", 1.0, 5, None), (2, "processing", 9.0, 1, "2024-01-31 23:00:00"), (3, "processing", 9.0, 0, "2024-01-31 23:55:00"), (4, "queued", 9.0, 2, None), (5, "done", 9.0, 0, None)], "id long, state string, priority double, enqueued_at int, s string")
    q = q.withColumn("started_at", F.col("s").cast("timestamp_ntz"))
    assert [r.id for r in jobs.claim(q, "2024-02-01 00:00:00", 2).collect()] == [2, 4]


def test_fuzzy_titles_against_all_pairs(spark):
    """Edits anywhere, words in another order, another case, missing years: no near pair is lost."""
    import random

    rng = random.Random(3)
    base = [" ".join(rng.choices("income school water trade growth policy labour market rural urban firm export".split(), k=rng.randint(1, 8))) for _ in range(25)]
    rows = []
    for t in base:
        rows.append(t)
        for _ in range(3):
            words = t.upper().split()
            rng.shuffle(words)
            chars = list(" ".join(words))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(chars))
                chars[at] = rng.choice(["", "x", chars[at] + "y"])
            rows.append("".join(chars))
    rows = [(i, t, rng.choice([None, 2000, 2001])) for i, t in enumerate([*rows, None, "", "a"])]

    def key(t):
        return " ".join(sorted(x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()))

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
        return line[-1]

    first = {}
    for i, t, y in rows:
        first.setdefault((key(t), y or 0), i)
    want = set()
    for i, t, y in rows:
        best = first[key(t), y or 0]
        for (k, z), j in first.items():
            longer = max(len(k), len(key(t)))
            if j < first[key(t), y or 0] and longer and 100 * (1 - distance(k, key(t)) / longer) >= 90 and (z == (y or 0) or not z or not y):
                best = min(best, j)
        want.add((i, best))
    df = spark.createDataFrame(rows, "id long, title string, year int")
    assert {tuple(r) for r in dedup.fuzzy_first(df).collect()} == want


def test_methods_of_titles_and_abstracts(spark):
    def label(title, abstract):
        t, a = F.lit(title).cast("string"), F.lit(abstract).cast("string")
        return one(spark, classify.sms_level(t, a)), one(spark, classify.method(classify.method_text(t, a)).design)

    assert label("Effects of a program", "We run a randomized controlled trial with treatment and control groups.") == (3, "RCT")
    assert label("Policy shock", "Using a difference-in-differences design across states, we estimate...") == (3, "DiD")
    assert label("A natural experiment on earthquakes and regression discontinuity", None) == (2, "RDD")
    assert label("Panel data evidence on fixed effects estimation", "")[0] == 2
    assert label("A qualitative study", "This qualitative case study describes interviews with officials.") == (1, "Qualitative")
    assert label("Determinants of spending", "We document a correlation using OLS cross-sectional regression.")[0] == 2
    assert label("An essay", "Some thoughts on policy.") == (None, None)
    assert label(None, "the RCT of 2009") == (3, "RCT") and label(None, "a didactic arctic diverse text") == (None, None)


def test_countries_and_regions(spark):
    tags = lambda t: one(spark, classify.countries(F.lit(t)))
    assert tags("Schools in México, Costa Rica and the Dominican Republic") == ["Caribbean", "Central America", "Costa Rica", "Dominican Republic", "LAC", "Mexico"]
    assert tags("GERMAN and South African firms in South Africa") == ["Germany", "OECD", "South Africa"]
    assert tags("Indiana and Peruse") == []
    region = lambda t: one(spark, classify.regions(classify.countries(F.lit(t))))
    assert region("Chinese trade") == ["Global"] and region("Haiti and Egypt") == ["LAC", "MENA"] and region("nothing") == ["Global"]


@pytest.mark.parametrize(
    "title,reason",
    [
        ("Book Review: Trade", "book_review"),
        ("Some book reviews", "book_review"),
        ("A long title that speaks of book reviews in passing", None),
        ("Errata", "correction_retraction"),
        ("Retracted: Growth", "correction_retraction"),
        ("In Memoriam", "obituary_award"),
        ("Call for papers", "vacancy_announcement"),
        ("Index to Volume 3", "index_front_matter"),
        ("Editors' Summary", "generic_section_header"),
        ("Introduction to trade", None),
        ("Forthcoming Papers", "forthcoming"),
    ],
)
def test_noise(spark, title, reason):
    assert one(spark, predicates.noise_reason(F.lit(title))) == reason


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text', None), (2, "plain", 3)], "id long, text string, n int")
    files.write_csv(df, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(df.schema).csv(f"{tmp_path}/csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    files.write_json_lines(df, f"{tmp_path}/json")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/json").collect())) == sorted(map(tuple, df.collect()))


def test_upsert_of_several_rows_of_one_key(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (1, "d")], "k int, v string")
    assert len({tuple(files.upsert(old, new.repartition(n), "k").first()) for n in (1, 2, 3)}) == 1


def test_scrub(spark):
    raw = '{"title": "secret words", "channel": "rss", "props": {"message": "hello", "n": 3, "deeper": {"text": "no"}}, "ids": [1, 2, 3], "urls": ["a"]}'
    got = one(spark, files.scrubbed_json(F.lit(raw)))
    assert got == {"title_len": "12", "channel": "rss", "props.message_len": "5", "props.n": "3", "ids_count": "3", "urls_len": "5"}
    assert one(spark, files.scrubbed_json(F.lit(None).cast("string"))) is None
