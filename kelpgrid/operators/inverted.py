"""A positional inverted index as a table, and web-style searches that read only the postings of their terms.

The table has a row for each word of a document, under the word's stem and with its positions, in folders by the stem's hash; the
rows of a frequent term are dealt over several files. A search reads the folders of its terms, puts phrases together
from neighbouring positions and ranks by cover density: every least stretch of text that holds what a search asks
for counts, the more the fewer other words it has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.operators.predicates import SearchFilters
from kelpgrid.operators.search import ranked, rrf
from kelpgrid.plans.works import searchable
from kelpgrid.sources.stored import written

BUCKETS = 64
WEIGHT = 0.1  # of every word; fixed value
VOWEL = "([aeiou]|[^aeiou]y)"


def _ends(word: Column, *ends: str) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(word, F.lit(e)) for e in ends])


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def stem(word: Column) -> Column:
    """A word without plural, -ed and -ing, its last y as i, and a last e dropped: steps 1 and 5a of Porter's stemmer. Words of one or two letters stay."""
    plural = F.when(_ends(word, "sses", "ies"), _cut(word, 2)).when(_ends(word, "s") & ~_ends(word, "ss"), _cut(word, 1)).otherwise(word)

    def past(w: Column) -> Column:
        bare = F.when(_ends(w, "ed") & ~_ends(w, "eed") & _cut(w, 2).rlike(VOWEL), _cut(w, 2)).when(_ends(w, "ing") & _cut(w, 3).rlike(VOWEL), _cut(w, 3))
        whole = F.when(_ends(w, "eed") & _cut(w, 3).rlike("[aeiouy][^aeiouy]"), _cut(w, 1)).otherwise(w)
        return F.transform(F.array(bare), lambda b: F.when(b.isNull(), whole).otherwise(mended(b)))[0]

    def mended(b: Column) -> Column:
        more = _ends(b, "at", "bl", "iz") | (b.rlike("^[^aeiouy]*[aeiouy][^aeiouywx]$"))
        return F.when(b.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(b, 1)).when(more, F.concat(b, F.lit("e"))).otherwise(b)

    last = lambda w: F.when(_ends(w, "y") & _cut(w, 1).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)

    def without_e(w: Column) -> Column:
        rest = _cut(w, 1)
        long = rest.rlike("^[^aeiouy]*([aeiouy]+[^aeiouy]+){2}")
        open_ = rest.rlike("[aeiouy][^aeiouy]") & ~rest.rlike("[^aeiouy][aeiouy][^aeiouywx]$")
        return F.when(_ends(w, "e") & (long | open_), rest).otherwise(w)

    stemmed = F.transform(F.transform(F.transform(F.array(plural), past), last), without_e)[0]
    return F.when(F.length(word) > 2, stemmed).otherwise(word)


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, text: Column, id_col: str = "id") -> DataFrame:
    """``term, id, positions``: the words of each text but stopwords, stemmed, with their places among all words from 1.

    A word's places are put together within its row, by sorting, and not in a shuffle; words of one stem are rows of their own.
    """
    placed = lambda words: F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), (i + 1).alias("at"))), lambda p: ~p.word.isin(X.STOPWORDS))

    def grouped(p: Column) -> Column:
        """Runs of one word in sorted places; each run ends where the next begins."""
        begins = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == 1) | (F.get(p, i - 1).word != F.get(p, i - 2).word))
        run = lambda b, i, k: F.transform(F.slice(p, i, F.coalesce(F.get(b, k + 1), F.size(p) + 1) - i), lambda x: x["at"])
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: F.struct(F.get(p, i - 1).word.alias("word"), run(b, i, k).alias("positions"))))[0]

    # What lambdas bind is made once.
    words = F.transform(F.array(X.tokens(text)), lambda w: F.array_sort(placed(w)))
    groups = F.transform(words, lambda p: F.when(F.size(p) > 0, grouped(p)))[0]
    return rows.select(F.col(id_col).alias("id"), F.inline(groups)).select(stem(F.col("word")).alias("term"), "id", "positions")


def build_index(rows: DataFrame, text: Column, path: str, id_col: str = "id") -> None:
    """Writes the index of a text column. Buckets are split into files by size, so a frequent term fills several; each file is in the order of terms."""
    table = postings(rows, text, id_col).withColumn("bucket", bucket(F.col("term")))
    table.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class Item:
    """A word, or the words of a phrase, each with its distance from the first."""

    words: tuple[tuple[int, str], ...]
    negated: bool = False


def parsed(query: str, stems: dict[str, str]) -> list[list[Item]]:
    """Alternatives of a search, each a list of items that must, or if negated must not, occur.

    Quotes make phrases, ``or`` between items parts alternatives, a minus before an item negates it, anything else is required.
    Words of several parts are phrases. Stopwords are dropped but keep their place in phrases; items of stopwords only are dropped.
    """
    groups: list[list[Item]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        parts = [(i, w) for i, w in enumerate(plain_words(phrase or word)) if w not in X.STOPWORDS]
        if parts:
            groups[-1].append(Item(tuple((i - parts[0][0], stems.get(w, w)) for i, w in parts), bool(minus)))
    return [g for g in groups if any(not i.negated for i in g)]


def plain_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(X.ACCENTED, X.FOLDED)).lower()).split()


def understood(spark: SparkSession, query: str) -> list[list[Item]]:
    """:func:`parsed` with the stems of the query's words."""
    words = sorted(set(plain_words(query)))
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("stem")).collect() if words else []
    return parsed(query, {r.w: r.stem for r in found})


def read_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """``term, id, positions`` of some terms: only their folders are read, and in these only row groups that may hold them."""
    buckets = sorted({r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket(F.col("t")).alias("b")).collect()})
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).select("term", "id", "positions")


def cover_density(found: DataFrame, groups: list[list[Item]]) -> DataFrame:
    """``id, fts`` of the documents that match one of the alternatives; ``found`` has the postings of all their terms.

    A stretch counts ``WEIGHT / (1 + other words within)``; stretches are least: none holds another.
    """
    items = list(dict.fromkeys(Item(i.words) for g in groups for i in g))
    number = {i: n for n, i in enumerate(items)}
    spots = written(found.select("id", "term", F.explode("positions").alias("pos")), "spots")  # of the terms of one search
    # What a term is in the items: their number, its distance from their start, and the item's length.
    parts: dict[str, list[Column]] = {}
    for n, item in enumerate(items):
        for d, w in item.words:
            parts.setdefault(w, []).append(F.struct(F.lit(n).alias("item"), F.lit(d).alias("d"), F.lit(len(item.words)).alias("size"), F.lit(item.words[-1][0]).alias("reach")))
    roles = F.create_map(*[x for w, p in parts.items() for x in (F.lit(w), F.array(*p))])
    each = spots.select("id", "pos", F.explode(roles[F.col("term")]).alias("r"))
    whole = each.groupBy("id", "r.item", (F.col("pos") - F.col("r.d")).alias("start"), "r.size", "r.reach").agg(F.count_distinct("r.d").alias("held")).where(F.col("held") == F.col("size"))
    by_id = Window.partitionBy("id")
    spans = whole.select("id", "item", "start", (F.col("start") + F.col("reach")).alias("end"), F.collect_set("item").over(by_id).alias("items"))  # the items of one search at most
    has = lambda i: F.array_contains("items", number[Item(i.words)])
    holds = [reduce(lambda a, b: a & b, [~has(i) if i.negated else has(i) for i in g]) for g in groups]
    rows = spans.select("id", "item", "start", "end", *[h.alias(f"g{n}") for n, h in enumerate(holds)]).where(reduce(lambda a, b: a | b, [F.col(f"g{n}") for n in range(len(holds))]))
    upto = by_id.orderBy("end").rangeBetween(Window.unboundedPreceding, 0)  # the spots of one search in one text
    last = {i: F.max(F.when(F.col("item") == number[i], F.col("start"))).over(upto) for i in items}
    begins = []
    for n, g in enumerate(groups):
        needed = [last[Item(i.words)] for i in g if not i.negated]
        every = reduce(lambda a, b: a & b, [c.isNotNull() for c in needed])
        begins.append(F.when(F.col(f"g{n}") & every, F.least(*needed) if len(needed) > 1 else needed[0]))
    begin = F.greatest(*begins) if len(begins) > 1 else begins[0]
    covers = rows.select("id", "end", begin.alias("begin")).where("begin is not null").groupBy("id", "begin").agg(F.min("end").alias("end"))
    asked = {w for g in groups for i in g if not i.negated for _, w in i.words}
    places = spots.where(F.col("term").isin(sorted(asked))).select("id", "pos").distinct()
    order = F.row_number().over(Window.partitionBy("id").orderBy("pos")).alias("nth")
    nth = places.select("id", "pos", order)
    first = nth.select("id", F.col("pos").alias("begin"), F.col("nth").alias("first"))
    final = nth.select("id", F.col("pos").alias("end"), F.col("nth").alias("final"))
    other = (F.col("end") - F.col("begin")) - (F.col("final") - F.col("first"))
    priced = covers.join(first, ["id", "begin"]).join(final, ["id", "end"]).select("id", (WEIGHT / (1 + other)).alias("x"))
    return priced.groupBy("id").agg(F.round(F.sum("x"), 6).alias("fts"))


def index_top_k(works: DataFrame, path: str, query: str, k: int = 20, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """``id, fts, rank``: the searchable rows of the highest cover density; nothing if the search has no words. Texts are not read."""
    spark = works.sparkSession
    groups = understood(spark, query)
    if not groups:
        return works.select("id", F.lit(0.0).alias("fts"), F.lit(0).alias("rank")).limit(0)
    terms = sorted({w for g in groups for i in g for _, w in i.words})
    scored = cover_density(read_postings(spark, path, terms), groups)
    return ranked(scored.join(searchable(works).where(filters.column()).select("id"), "id"), "fts", k)


def hybrid_index_search(vectors: DataFrame, works: DataFrame, path: str, query: str, k: int = 20, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """Rank fusion of ``vectors`` (``id, cosine, rank``, the first 2k) and the 2k rows of the index; both arms filtered before they are cut."""
    lexical = index_top_k(works, path, query, 2 * k, filters).select("id", "fts", F.col("rank").alias("fts_rank"))
    near = vectors.where(F.col("rank") <= 2 * k).select("id", "cosine", F.col("rank").alias("vector_rank"))
    fused = near.join(lexical, "id", "full").withColumn("score", F.round(rrf(F.col("vector_rank"), F.col("fts_rank")), 6))
    return ranked(fused, "score", k).select("rank", "id", "cosine", "fts", "vector_rank", "fts_rank", "score")
