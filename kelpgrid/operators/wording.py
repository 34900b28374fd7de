"""Repairs of drafted prose, wording of queries, payload checks, grouped findings and selection with same findings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions import text as X

NAME = r"\p{Lu}[\p{L}'’-]+"
YEAR = r"(?:19|20)[0-9]{2}"
#: "Name (2022)", "Name and Other (2022)", "Name et al. (2022)" that no bracket follows.
NARRATIVE = rf"({NAME}(?: (?:and|&) {NAME})?(?: et al\.?)? ?\({YEAR}[a-z]?\))(?! ?\[)"
#: "(Name 2022)" that no bracket follows.
PARENTHETICAL = rf"(\({NAME}[^()\[\];=%0-9]{{0,90}} {YEAR}[a-z]?\))(?! ?\[)"


def link_citations(bodies: DataFrame, papers: DataFrame) -> DataFrame:
    """``id, text, linked, removed, unresolved``: citations by name and year joined with the papers of their draft.

    bodies: ``id, text``; papers: ``id, paper, authors, year``. A citation that fits one paper gets its id in brackets, a
    parenthetical one that fits none is taken out, an ambiguous one stays. Where a paper of the same draft and year has no
    authors nothing is taken out. Null texts stay null; a draft without papers stays as it is.
    """
    def mentioned(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("mention")))

    found = F.concat(mentioned("narrative", NARRATIVE), mentioned("parenthetical", PARENTHETICAL))
    mentions = bodies.select("id", F.explode(found).alias("m")).select("id", "m.kind", "m.mention")
    mentions = mentions.withColumns({"year": F.regexp_extract("mention", rf"({YEAR})[a-z]?\)$", 1).cast("int"), "who": F.lower(X.fold(F.col("mention")))})
    known = papers.select("id", "year", "paper", F.transform(F.coalesce("authors", F.array().cast("array<string>")), X.surname).alias("names"))
    fits = F.exists("names", lambda n: (n != "") & F.contains(F.col("who"), n))
    first = (F.size("names") > 0) & (F.get("names", F.lit(0)) != "") & F.contains(F.col("who"), F.get("names", F.lit(0)))
    judged = (
        mentions.join(known, ["id", "year"], "left")
        .groupBy("id", "kind", "mention")
        .agg(
            F.count_if(first).alias("n_first"),
            F.count_if(fits).alias("n_any"),
            F.count_if(F.col("paper").isNotNull() & (F.size("names") == 0)).alias("nameless"),
            F.min(F.when(first, F.col("paper"))).alias("by_first"),
            F.min(F.when(fits, F.col("paper"))).alias("by_any"),
        )
        .join(papers.select("id").distinct().withColumn("has_papers", F.lit(True)), "id")
    )
    n = F.when(F.col("n_first") > 0, F.col("n_first")).otherwise(F.col("n_any"))
    hit = F.when(F.col("n_first") == 1, F.col("by_first")).when((F.col("n_first") == 0) & (F.col("n_any") == 1), F.col("by_any"))
    deed = F.when(hit.isNotNull(), "linked").when((F.col("kind") == "parenthetical") & (n == 0) & (F.col("nameless") == 0), "removed").otherwise("unresolved")
    deeds = judged.withColumns({"deed": deed, "hit": hit.cast("string")}).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("mention", "deed", "hit"))).alias("deeds"))
    joined = bodies.select("id", "text").join(deeds, "id", "left")
    new = lambda d: F.when(d.deed == "linked", F.concat(d.mention, F.lit(" ["), d.hit, F.lit("]"))).otherwise(F.lit(""))
    # what already has a bracket is set aside by its opening, so that only bare mentions are replaced
    edit = lambda t, d: F.when(d.deed == "unresolved", t).otherwise(F.replace(F.replace(F.replace(t, F.concat(d.mention, F.lit(" [")), F.concat(F.lit("\u0001"), F.sha2(d.mention, 256))), d.mention, new(d)), F.concat(F.lit("\u0001"), F.sha2(d.mention, 256)), F.concat(d.mention, F.lit(" ["))))
    text = F.when(F.col("deeds").isNull(), F.col("text")).otherwise(F.aggregate("deeds", F.col("text"), edit))
    tidy = F.regexp_replace(F.regexp_replace(text, r"[ \t]+([.,;:!?])", "$1"), r"[ \t]{2,}", " ")
    count = lambda k: F.coalesce(F.size(F.filter("deeds", lambda d: d.deed == k)), F.lit(0)).cast("long")
    counted = [F.when(F.col("deeds").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(k) for k in ("linked", "removed", "unresolved")]
    return joined.select("id", F.when(F.col("deeds").isNull(), F.col("text")).otherwise(tidy).alias("text"), *counted)


def verified_numbers(text: Column, total: Column, share: Column, lac: Column) -> Column:
    """The text with its totals ("3 of 40 papers", "3/40 papers"), shares of levels 4-5 and LAC counts put right; shares within 3 points stay."""
    said = total.cast("string")
    out = F.regexp_replace(text, F.lit(r"(?i)([0-9]+\s+of\s+)[0-9]+(\s+papers)"), F.concat(F.lit("$1"), said, F.lit("$2")))
    out = F.regexp_replace(out, F.lit(r"(?i)([0-9]+/)[0-9]+(\s+papers)"), F.concat(F.lit("$1"), said, F.lit("$2")))
    shares = F.array_distinct(F.regexp_extract_all(out, F.lit(r"(?i)([0-9]+\s*%\s*(?:of\s+papers\s*)?(?:are|reach|at|meet)?\s*SMS\s*4[-–\s]*(?:to\s*)?5)"), F.lit(1)))
    off = F.filter(shares, lambda m: F.abs(F.regexp_extract(m, r"^([0-9]+)", 1).cast("int") - share) > 3)
    out = F.aggregate(off, out, lambda t, m: F.replace(t, m, F.regexp_replace(m, F.lit(r"^[0-9]+"), share.cast("string"))))
    return F.regexp_replace(out, F.lit(r"(?i)[0-9]+(\s+(?:are\s+)?LAC(?:-based)?\b)"), F.concat(lac.cast("string"), F.lit("$1")))


# Words of questions and times that say nothing about a topic.
FILLERS = ["please", "can", "could", "you", "tell", "what", "does", "are", "the", "how", "about", "say", "with", "from", "that", "this", "evidence", "studies", "study", "research", "papers", "paper"]
TIMES = r"\b(since|after|before|during|in)? ?(the )?(19|20)[0-9]{2}s?\b|\b(recent|recently|latest|last (decade|years?))\b"
PLACES = ["latin america", "brazil", "mexico", "peru", "germany", "france", "europe"]


def query_tokens(text: Column) -> Column:
    """Content words of a question, longer than two letters."""
    return F.filter(X.tokens(text, 3), lambda w: ~F.array_contains(F.array(*[F.lit(x) for x in FILLERS]), w))


def historical_from(text: Column) -> Column:
    """The year that a question about the past reaches back to: five before the year it names, 1980 at least; 1990 for the long run."""
    year = F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})s?\b", 1)
    return F.when(year != "", F.greatest(year.cast("int") - 5, F.lit(1980))).when(F.lower(text).rlike(r"long[- ]run|historical"), 1990)


def without_place_and_time(text: Column) -> Column:
    """A question without places, the longest first, and times, in lower case."""
    low = F.lower(X.fold(text))
    for p in sorted(PLACES, key=len, reverse=True):
        low = F.regexp_replace(low, rf"\b(in |of |from )?{p}\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, TIMES, " "), r" +", " "))


# Groups of people and the beginnings of the words for them.
POPULATIONS = {"children": ["child", "kid", "pupil"], "women": ["wom", "female", "girl"], "workers": ["worker", "employee", "labour"], "students": ["student", "school"]}


def populations(text: Column) -> Column:
    """Which groups of people a text names, in order of the list."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(rf"\b({'|'.join(words)})"), F.lit(name)) for name, words in POPULATIONS.items()]))


def is_apparatus_title(title: Column) -> Column:
    """Titles of figures, tables, appendices and the like."""
    return F.lower(F.trim(title)).rlike(r"^(figure|table|appendix|supplement(ary)?|online appendix|replication)\b")


def lenient_json(text: Column, schema: str) -> Column:
    """The object between the outermost braces of an answer, whatever stands around it; null if it cannot be read."""
    inner = F.regexp_extract(F.regexp_replace(text, r"```[a-z]*", ""), r"(?s)(\{.*\})", 1)
    return F.when(inner != "", F.from_json(inner, schema))


def problems(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails, unknown ones included, joined by commas; empty if it is valid."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])), ",")


def grouped_findings(*sources: DataFrame) -> DataFrame:
    """``section, n, issues``: findings of several reports (``section, kind, ref``) by section; a section's mark is dropped, empty ones are left out."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    rows = rows.withColumn("section", F.trim(F.regexp_replace("section", "^§", ""))).where("section <> ''")
    issue = F.concat_ws(":", "kind", F.col("ref").cast("string"))
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(issue)), ",").alias("issues"))


def lexical_proxy(fts: Column, level: Column) -> Column:
    """Similarity of a row without vector: 1.8 times its lexical score, 0.45 at most; 0.60 for high levels with a hit."""
    base = F.least(F.lit(0.45), 1.8 * fts)
    return F.round(F.when((level >= 4) & (base > 0) & (base <= 0.46), 0.60).otherwise(base), 6)


def due(last: Column, cadence_days: Column, as_of: str) -> Column:
    """Whether a subscription is to be sent: never sent before, or its cadence has gone by."""
    return last.isNull() | (F.date_add(last, cadence_days) <= F.lit(as_of).cast("date"))


def candidate_pool(sections: DataFrame, papers: DataFrame, k: int = 8) -> DataFrame:
    """``section, paper, overlap, place``: papers that share most longer words with each section, by shared words only."""
    words = lambda df, i, n: df.select(i, F.array_distinct(X.tokens(F.col("text"), 4)).alias("ws")).select(i, F.size("ws").alias(n), F.explode("ws").alias("w"))
    common = words(sections, "section", "sn").join(words(papers, "paper", "pn"), "w")
    scored = common.groupBy("section", "paper", "sn", "pn").agg(F.count("*").alias("k")).withColumn("overlap", F.round(F.col("k") / F.least("sn", "pn"), 6))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("overlap"), "paper"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("section", "paper", "overlap", "place")


def select_with_findings(pool: DataFrame, k: int = 50, by: str = "query", most: int = 1000) -> DataFrame:
    """``query, id, adjusted, pick``: greedy choice in which a row loses by each same finding chosen before it.

    pool: ``query, id, score, intervention, outcome``. Two rows are the same finding if their interventions and
    their outcomes share half their words; m of them cost min(0.04 + 0.02 (m - 1), 0.10). What a pick costs depends
    on the picks before, so a query's pool is one task: more than ``most`` rows raise.
    """
    words = lambda c: F.array_distinct(X.tokens(F.coalesce(F.col(c), F.lit("")), 3)).alias(c)

    def same(a: set, b: set) -> bool:
        return bool(a and b) and len(a & b) >= 0.5 * len(a | b)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"a pool of more than {most} rows")
        left = [(float(r.score), int(r.id), set(r.intervention), set(r.outcome)) for r in rows.sort_values(["score", "id"], ascending=[False, True]).itertuples()]
        met, out = [0] * len(left), []
        cost = lambda m: min(0.04 + 0.02 * (m - 1), 0.10) if m else 0.0
        open_ = list(range(len(left)))
        while open_ and len(out) < k:
            best = max(open_, key=lambda i: (round(left[i][0] - cost(met[i]), 6), -i))
            open_.remove(best)
            out.append((rows[by].iloc[0], left[best][1], round(left[best][0] - cost(met[best]), 6), len(out) + 1))
            for i in open_:
                met[i] += same(left[i][2], left[best][2]) and same(left[i][3], left[best][3])
        return pd.DataFrame(out, columns=["query", "id", "adjusted", "pick"])

    picked = pool.select(F.col(by).cast("string").alias(by), "id", "score", words("intervention"), words("outcome"))
    return picked.groupBy(by).applyInPandas(run, "query string, id long, adjusted double, pick int")
