"""Relevance of works to queries: eighteen features, a model trained on labelled pairs, and cross-validation by query."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.functions.vector import cosine
from kelpgrid.operators.rules import COUNTRIES

FEATURES = [
    "facet_sim_0", "facet_sim_1", "facet_sim_2", "facet_sim_0_above_floor", "facet_sim_1_above_floor", "facet_sim_2_above_floor", "facet_sims_geometric_mean", "single_vector_sim",
    "geography_hit", "year", "age_years", "citation_count", "citation_rate", "sms_level", "has_abstract", "abstract_length", "abs_rating_numeric", "repec_percentile",
]
CLASSES = ["irrelevant", "partial", "relevant"]
REGION = r"(?:^|[^a-z])(?:" + "|".join(["latin america", "caribbean", *COUNTRIES["LAC"].values()]) + r")(?:[^a-z]|$)"
# Ratings as numbers; what is not rated is 0.
RATINGS = {"4*": 5, "4": 4, "3": 3, "2": 2, "1": 1}


def features(pairs: DataFrame, queries: DataFrame, now: int, floor: float = 0.35, facets: int = 3, region: str = REGION) -> DataFrame:
    """``qid, id, label`` and the :data:`FEATURES` of works paired with queries, as doubles without nulls.

    ``pairs`` has ``qid, id, label``, the columns of works and ``embedding``; ``queries`` a row for each query with ``qid``, its
    ``facets`` (vectors, the first three count, missing ones are 0) and ``vector``. A similarity below the floor is not above it and
    leaves the geometric mean, which is 0 without any.
    """
    asked = queries.select("qid", F.col("facets").alias("facets_"), F.col("vector").alias("vector_"))
    rows = pairs.join(asked, "qid")
    zero = F.lit(0.0)
    sims = F.transform(F.sequence(F.lit(1), F.lit(facets)), lambda i: F.coalesce(cosine(F.col("embedding"), F.try_element_at("facets_", i)), zero))
    rows = rows.withColumn("sims_", sims).withColumn("above_", F.filter("sims_", lambda s: s >= floor))
    logs = F.aggregate("above_", zero, lambda a, s: a + F.log(F.greatest(s, F.lit(1e-6))))
    text = F.lower(X.fold(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("abstract", F.lit("")), 1, 300))))  # the first 300 characters are the feature
    age = F.greatest(F.lit(0), F.lit(now) - F.col("year"))
    cited = F.coalesce("citation_count", F.lit(0))
    rating = F.create_map(*[F.lit(x) for kv in RATINGS.items() for x in kv])[F.col("abs_rating")]
    length = F.coalesce(F.length("abstract"), F.lit(0))
    values = {
        **{f"facet_sim_{i}": F.col("sims_")[i] for i in range(facets)},
        **{f"facet_sim_{i}_above_floor": F.col("sims_")[i] >= floor for i in range(facets)},
        "facet_sims_geometric_mean": F.when(F.size("above_") > 0, F.exp(logs / F.size("above_"))).otherwise(zero),
        "single_vector_sim": cosine(F.col("embedding"), F.col("vector_")),
        "geography_hit": text.rlike(region),
        "year": F.col("year"),
        "age_years": age,
        "citation_count": cited,
        "citation_rate": F.when(age.isNotNull(), cited / F.greatest(F.lit(1), age + 1)),
        "sms_level": F.col("sms_level"),
        "has_abstract": length > 0,
        "abstract_length": length,
        "abs_rating_numeric": rating,
        "repec_percentile": F.coalesce("repec_percentile", F.lit(50)) / 100,
    }
    return rows.select("qid", "id", "label", *[F.coalesce(c.cast("double"), zero).alias(n) for n, c in values.items()])


def balanced(rows: DataFrame) -> DataFrame:
    """``weight``: rows of rare labels weigh more, so that every label weighs the same and all weigh as many as the rows."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n_"))  # one row for each label
    whole = counts.agg(F.sum("n_").alias("all_"), F.count("*").alias("labels_"))
    weights = counts.join(F.broadcast(whole)).select("label", (F.col("all_") / (F.col("labels_") * F.col("n_"))).alias("weight"))
    return rows.join(F.broadcast(weights), "label")


def trained(rows: DataFrame, kind: str = "logistic", seed: int = 42) -> PipelineModel:
    """A model of :func:`features` with balanced labels: standardised multinomial logistic regression with an L2 penalty of 1, or a forest of 200 trees of depth 8."""
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="raw_")
    if kind == "forest":
        steps = [assembled, RandomForestClassifier(featuresCol="raw_", labelCol="label", weightCol="weight", numTrees=200, maxDepth=8, minInstancesPerNode=3, seed=seed)]
    else:
        scaled = StandardScaler(inputCol="raw_", outputCol="scaled_", withMean=True, withStd=True)
        steps = [assembled, scaled, LogisticRegression(featuresCol="scaled_", labelCol="label", weightCol="weight", family="multinomial", maxIter=1000, regParam=1.0 / max(1, rows.count()), standardization=False)]
    return Pipeline(stages=steps).fit(balanced(rows))


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``qid, id, label, predicted, probability`` (of the predicted label) of rows of :func:`features`."""
    chances = vector_to_array("probability")
    return model.transform(rows).select("qid", "id", "label", F.col("prediction").cast("int").alias("predicted"), F.array_max(chances).alias("probability"))


def fold_of(qid: Column, folds: int) -> Column:
    return F.pmod(F.crc32(qid.cast("string")), F.lit(folds)).cast("int")


def cross_validated(rows: DataFrame, folds: int = 5, kind: str = "logistic", seed: int = 42) -> DataFrame:
    """``fold, qid, id, label, predicted, probability``: every row scored by a model of the other folds. All rows of a query are in one fold."""
    marked = rows.withColumn("fold", fold_of(F.col("qid"), folds))
    out = []
    for k in sorted(r.fold for r in marked.select("fold").distinct().collect()):  # at most ``folds``
        model = trained(marked.where(F.col("fold") != k), kind, seed)
        out.append(scored(model, marked.where(F.col("fold") == k)).select(F.lit(k).alias("fold"), "*"))
    return reduce(lambda a, b: a.unionByName(b), out)


def fold_scores(predicted: DataFrame, classes: int = 3) -> DataFrame:
    """``fold, n, accuracy, macro_f1, f1`` of each fold and of all (fold null); the F1 of a class that neither occurs nor is predicted is 0."""
    hit = lambda c: F.count_if((F.col("label") == c) & (F.col("predicted") == c))
    either = lambda c: F.count_if(F.col("label") == c) + F.count_if(F.col("predicted") == c)
    f1 = [F.when(either(c) > 0, 2.0 * hit(c) / either(c)).otherwise(0.0) for c in range(classes)]
    grouped = predicted.groupingSets([[F.col("fold")], []], "fold").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.array(*f1).alias("f1"))
    mean = F.aggregate("f1", F.lit(0.0), lambda a, x: a + x) / classes
    return grouped.select("fold", "n", F.round("accuracy", 6).alias("accuracy"), F.round(mean, 6).alias("macro_f1"), F.transform("f1", lambda x: F.round(x, 6)).alias("f1"))
