"""Rule-driven labels of works: methods, types, regions, topics and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.operators import rules as R
from kelpgrid.operators.order import numbered


def first_match(text: Column, rules: list[tuple], result: int) -> Column:
    """The ``result``-th field of the first rule whose last field matches the lower-cased text."""
    low = F.lower(text)
    out = F.lit(None)
    for rule in reversed(rules):
        out = F.when(low.rlike(rule[-1]), F.lit(rule[result])).otherwise(out)
    return out


def method(text: Column, rules: list[tuple] = R.METHODS) -> Column:
    """``level, design`` of the first rule one of whose patterns the text matches, null if none does.

    The text is lower-cased once, and a pattern is tried only on texts that hold one of the words it requires.
    """

    def hit(x: Column, pattern: str) -> Column:
        matches, words = x.text.rlike(R.plain_bounds(pattern)), R.required_words(pattern)
        return reduce(lambda a, b: a | b, [F.contains(x.low, F.lit(w)) for w in words]) & matches if words else matches

    def first(x: Column) -> Column:
        out = F.lit(None).cast("struct<level:int,design:string>")
        for level, design, patterns in reversed(rules):
            some = reduce(lambda a, b: a | b, [hit(x, p) for p in patterns])
            out = F.when(some, F.struct(F.lit(level).alias("level"), F.lit(design).alias("design"))).otherwise(out)
        return out

    return F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), first)[0]


def method_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(abstract, F.lit("")), F.coalesce(title, F.lit("")))


def sms_level(title: Column, abstract: Column, known: Column | None = None) -> Column:
    """Level of evidence by keywords, at most 3, at most 2 without an abstract; a known level wins."""
    found = method(method_text(title, abstract)).level
    capped = F.when(found.isNotNull(), F.least(found, F.when(F.coalesce(F.length(abstract), F.lit(0)) > 0, 3).otherwise(2)))
    return F.coalesce(known, capped) if known is not None else capped


def capped_level(level: Column, method: Column, abstract: Column) -> Column:
    """Lowered levels of keyword labels: 4 and more to 3, 3 and more without an abstract to 2; never raised."""
    empty = F.coalesce(F.length(F.trim(abstract)), F.lit(0)) == 0
    return F.when((method == "keyword") & (level >= 3) & empty, F.least(level, F.lit(2))).when((method == "keyword") & (level >= 4), F.least(level, F.lit(3))).otherwise(level)


# Publication types by patterns, in order.
TYPE_RULES = [
    ("review", "systematic review|meta.analysis|literature review"),
    ("working_paper", "working paper|discussion paper|preprint"),
    ("thesis", "thesis|dissertation"),
    ("report", "report|policy brief"),
    ("book_chapter", "chapter"),
]


def publication_type(text: Column, known: Column) -> Column:
    return F.coalesce(first_match(text, TYPE_RULES, 0), known, F.lit("unknown"))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for kv in pairs.items() for x in kv])


def countries(text: Column) -> Column:
    """Distinct tags of a text in order: the countries it names, in one pass, and the groups these belong to; accents are folded."""
    named = F.array_distinct(F.regexp_extract_all(F.lower(X.fold(text)), F.lit(R.COUNTRY_PATTERN), F.lit(1)))
    tags = F.flatten(F.transform(named, lambda w: _map(R.TAGS_OF)[_map(R.COUNTRY_OF)[w]]))
    return F.array_sort(F.array_distinct(tags))


def regions(tags: Column) -> Column:
    """Distinct buckets of tags in order, Global if there are none."""
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(tags, lambda t: _map(R.REGION_OF)[t]))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Global")))


def lac_mismatch(text: Column, tags: Column) -> Column:
    """Whether a text names the region and its tags do not."""
    return F.lower(X.fold(text)).rlike("latin america|caribbean|brazil|mexic|peru") & ~F.array_contains(regions(tags), "LAC")


# Topics and the substrings that mark them.
TOPICS = {"labour": ["work", "labour", "wage"], "schooling": ["school", "education"], "health": ["health", "heal"], "trade": ["trade", "export"], "other": ["the ", "of "]}


def topics(text: Column, rules: dict[str, list[str]] = TOPICS) -> Column:
    """Topics whose keywords the text holds; a corpus gives its own ``rules``."""
    low = F.lower(text)
    marks = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(t)) for t, words in rules.items()]
    return F.array_sort(F.array_compact(F.array(*marks)))


def confidence(level: Column, sample: Column, text: Column) -> Column:
    """high, medium or low from the design, the sample's size, and words on effect and control."""
    low = F.lower(text)
    score = F.when(level >= 4, 3).when(level == 3, 2).when(level >= 1, 1).otherwise(0) + F.when(sample >= 1000, 2).when(sample >= 100, 1).otherwise(0) + F.when(low.rlike("effect|impact"), 1).otherwise(0) + F.when(low.rlike("control|compar"), 1).otherwise(0)
    return F.when(score >= 5, "high").when(score >= 2, "medium").otherwise("low")


def effect_direction(text: Column) -> Column:
    low = F.lower(text)
    up, down = low.rlike("increas|improv|positive|rise"), low.rlike("decreas|reduc|negative|declin")
    return F.when(up & down, "mixed").when(up, "positive").when(down, "negative").when(low.rlike("no effect|insignificant|null"), "null").otherwise("unclear")


def missing_fields(names: list[str]) -> Column:
    """The names of the critical fields that a row has no value for."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in names]))


def normalised(rows: DataFrame, column: str, rules: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """Rows with several columns set by the first rule whose pattern (as of ILIKE) their ``column`` matches."""
    names = sorted({c for _, values in rules for c in values})
    new = {}
    for c in names:
        out = F.col(c)
        for pattern, values in reversed(rules):
            out = F.when(F.col(column).ilike(pattern), F.lit(values[c]) if c in values else F.col(c)).otherwise(out)
        new[c] = out
    return rows.withColumns(new)


def paper_channels(cosine: Column, sms: Column, cited: Column, year: Column, region: Column) -> Column:
    """Channels that a row belongs to, in a fixed order."""
    return F.array_compact(F.array(F.when(sms >= 4, F.lit("causal")), F.when((cited >= 75) & (year < 2020), F.lit("foundational")), F.when(year >= 2020, F.lit("recent")), F.when(region == "LAC", F.lit("lac"))))


def percent_rank(rows: DataFrame, value: str, by: str | None = None, name: str = "pct") -> DataFrame:
    """(position - 1) / (n - 1) by value, ties in the order of ids; 1 for a single row."""
    placed = numbered(rows, [by] if by else [], [F.col(value), F.col("id")], before="before_", total="total_")
    return placed.withColumn(name, F.when(F.col("total_") == 1, 1.0).otherwise(F.col("before_") / (F.col("total_") - 1))).drop("before_", "total_")


def facet_label(sims: Column, geo: Column, floor: float = 0.35, gm: float = 0.35) -> Column:
    """direct if all facets reach the floor and their geometric mean gm, indirect if any does."""
    from kelpgrid.functions.numeric import geometric_mean

    every, some = F.forall(sims, lambda s: s >= floor), F.exists(sims, lambda s: s >= floor)
    return F.when(every & (geometric_mean(sims) >= gm), F.when(geo, "direct-lac").otherwise("direct-global")).when(some, "indirect").otherwise("excluded")


def token_share_label(text: Column, terms: list[str]) -> Column:
    """direct from a share of .45 of the terms on, indirect from .2."""
    wanted = F.array(*[F.lit(t) for t in terms])
    share = F.size(F.array_intersect(wanted, X.tokens(text))) / F.size(wanted)
    return F.when(share >= 0.45, "direct").when(share >= 0.2, "indirect").otherwise("excluded")


def softmax_label(features: list[Column], means: list[float], scales: list[float], weights: dict[str, list[float]], bias: dict[str, float]) -> tuple[Column, Column]:
    """Label and probability of a linear classifier given as plain numbers; of equal labels the one that ``weights`` names first."""
    z = [(x - m) / s for x, m, s in zip(features, means, scales)]
    logit = {k: reduce(lambda a, b: a + b, [v * w for v, w in zip(z, ws)], F.lit(bias[k])) for k, ws in weights.items()}
    total = reduce(lambda a, b: a + b, [F.exp(v) for v in logit.values()])
    best = F.greatest(*logit.values())
    label = F.lit(list(logit)[-1])
    for k, v in reversed(list(logit.items())[:-1]):
        label = F.when(v >= best, F.lit(k)).otherwise(label)
    return label, F.round(F.exp(best) / total, 6)


def impact_verdict(canary: Column, relevant: Column) -> Column:
    """hurts, helps or neutral, from the change of canary recall and of relevant rows."""
    return F.when((canary < 0) | (relevant <= -3), "hurts").when((canary > 0) | (relevant >= 3), "helps").otherwise("neutral")
