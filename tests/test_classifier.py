"""Features by hand, training on separable pairs, folds by query."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kelpgrid.operators import classifier as C
from kelpgrid.operators import drafts

SCHEMA = "qid string, id long, label int, title string, abstract string, year int, citation_count int, sms_level int, abs_rating string, repec_percentile int, embedding array<double>"


def test_features_by_hand(spark):
    rows = [
        ("q", 1, 2, "On Perú", "Growth", 2015, 22, 3, "4*", 90, [1.0, 0.0]),
        ("q", 2, 0, None, None, None, None, None, None, None, [0.0, 0.0]),
        ("q", 3, 1, "Peruse", "x" * 300 + " brazil", 2030, 5, 0, "4", 0, [0.6, 0.8]),
    ]
    queries = spark.createDataFrame([("q", [[1.0, 0.0], [0.0, 1.0]], [1.0, 1.0])], "qid string, facets array<array<double>>, vector array<double>")
    found = {r.id: r for r in C.features(spark.createDataFrame(rows, SCHEMA), queries, 2025, 0.35).collect()}
    a, b, c = found[1], found[2], found[3]
    assert (a.facet_sim_0, a.facet_sim_1, a.facet_sim_2) == (1.0, 0.0, 0.0) and (a.facet_sim_0_above_floor, a.facet_sim_1_above_floor) == (1.0, 0.0)
    assert a.facet_sims_geometric_mean == 1.0 and a.single_vector_sim == pytest.approx(math.sqrt(0.5)) and a.geography_hit == 1.0
    assert (a.age_years, a.citation_rate, a.abs_rating_numeric, a.repec_percentile, a.abstract_length, a.has_abstract) == (10.0, 2.0, 5.0, 0.9, 6.0, 1.0)
    assert all(b[n] == (0.5 if n == "repec_percentile" else 0.0) for n in C.FEATURES)
    assert c.facet_sims_geometric_mean == pytest.approx(math.sqrt(0.48)) and c.geography_hit == 0.0 and (c.age_years, c.citation_rate) == (0.0, 5.0)


def pairs_of(spark, n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        label = rng.choice([0, 1, 1, 2, 2, 2])
        values = {name: rng.random() for name in C.FEATURES} | {"single_vector_sim": label / 3 + rng.random() * 0.2, "citation_count": 100.0 * label}
        rows.append((f"q{i % 12}", i, label, *[values[name] for name in C.FEATURES]))
    return spark.createDataFrame(rows, "qid string, id long, label int, " + ", ".join(f"{n} double" for n in C.FEATURES))


def test_cross_validation_keeps_queries_together(spark):
    rows = pairs_of(spark)
    found = C.cross_validated(rows, 3).cache()
    folds = defaultdict(set)
    for r in found.collect():
        folds[r.qid].add(r.fold)
    assert found.count() == 240 and all(len(f) == 1 for f in folds.values())
    scores = {r.fold: r for r in C.fold_scores(found).collect()}
    assert scores[None].accuracy > 0.95 and scores[None].macro_f1 > 0.95 and scores[None].n == 240
    hits = sum(r.label == r.predicted for r in found.collect())
    assert scores[None].accuracy == round(hits / 240, 6)
    weights = C.balanced(rows).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert len(weights) == 3 and all(r.w == pytest.approx(80.0) for r in weights)


def test_forest(spark):
    rows = pairs_of(spark, 120)
    found = C.scored(C.trained(rows, "forest"), rows).collect()
    assert sum(r.label == r.predicted for r in found) > 110 and all(0 < r.probability <= 1 for r in found)


def test_core_tiers_and_channels(spark):
    assert drafts.core_words("The effect of minimum wages on youth, and WAGES 2") == ["minimum", "wages", "youth"]
    cases = [("RCT", 3, 0, 2010, None, ""), (None, 5, 80, 2019, None, ""), ("DiD", 2, 75, 2020, None, "x"), (None, 3, None, 2021, "LAC", "x"), ("OLS", 5, 74, 2000, "LAC", "")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id long, design string, level int, cited int, year int, region string, content string")
    got = {r.id: r.c for r in rows.select("id", drafts.credible_channels(*[F.col(c) for c in ("design", "level", "cited", "year", "region", "content")]).alias("c")).collect()}
    assert got == {0: ["causal"], 1: ["foundational"], 2: [], 3: ["recent", "lac"], 4: []}
    pool = [(i, "few" if i < 10 else "many", i / 50, "wages youth" if i % 2 else "wages", "", ["recent"] if i % 5 else []) for i in range(40)]
    tiers = {r.id: r for r in drafts.core_tier(spark.createDataFrame(pool, "id long, topic string, cosine double, title string, abstract string, channels array<string>"), ["wages", "youth"]).collect()}
    for name, ids, cut in (("few", range(10), 0.2), ("many", range(10, 40), 0.5)):
        by_words = sorted(ids, key=lambda i: (i % 2, i))
        for i in ids:
            place = max((i - ids[0]) / (len(ids) - 1), by_words.index(i) / (len(ids) - 1))
            assert tiers[i].relevant == (place >= cut) and tiers[i].core == (place >= cut and i % 5 > 0), name


def test_twins_by_number(spark):
    rows = [(1, "Wages (NBER Working Paper No. 12345)", 2010, "working_paper", None), (2, "Other words", 2011, "journal_article", "https://doi.org/10.3386/W12345"), (3, "Other words", 2019, "journal_article", "10.3386/w12345"), (4, "about w777777", None, "working_paper", None), (5, "", 2000, "journal_article", "10.3386/w777777"), (6, "about xw12345 no. 12", 2010, "working_paper", None)]
    found = drafts.twins(spark.createDataFrame(rows, "id long, title string, year int, publication_type string, doi string"))
    assert sorted((r.left_id, r.right_id, r.how) for r in found.collect()) == [(1, 2, "number"), (4, 5, "number")]
