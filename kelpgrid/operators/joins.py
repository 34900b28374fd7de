"""Joins that resolve entities and walk the citation graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.functions.vector import dot, norm
from kelpgrid.sources.stored import written

SIGNATURE_BLOCK = 256  # rows of one signature that are compared at a time
STRIPE_ROWS = 2048  # rows of one pair of words that meet as many others at a time
DISTINCT_ROWS = 500_000  # rows of a task that looks for distinct ones


def in_order(ids: DataFrame, works: DataFrame) -> DataFrame:
    """Rows of ``works`` in the order of (pos, id)."""
    return ids.join(works, "id").orderBy("pos")


def broadcast_if_few(rows: DataFrame, most: int) -> DataFrame:
    """Marked to be broadcast if a count finds at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``: one semi-join, however many ids."""
    return rows.join(ids.select("id"), "id", "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def exact_match(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``ask, id``: the known rows of the same DOI or the same id, each once."""
    doi = lambda rows: X.normalize_doi(rows.doi)
    by_doi = asked.select("ask", doi(asked).alias("d")).join(known.select("id", doi(known).alias("d")), "d").select("ask", "id")
    by_id = asked.select("ask", "id").join(known.select("id"), "id").select("ask", "id")
    return by_doi.unionByName(by_id).distinct()


def mutual_pairs(left: DataFrame, right: DataFrame, key: str, condition: Column) -> DataFrame:
    """Pairs of the aliases ``l`` and ``r`` with equal keys that meet a condition, where each side occurs in one pair only."""
    pairs = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}")).where(condition)
    pairs = pairs.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"))
    once = lambda c: F.count("*").over(Window.partitionBy(c))
    return pairs.withColumns({"nl": once("left_id"), "nr": once("right_id")}).where("nl = 1 and nr = 1").select("left_id", "right_id")


def fill_from(target: DataFrame, source: DataFrame, pairs: DataFrame, columns: list[str], largest: tuple[str, ...] = ()) -> DataFrame:
    """Target rows with nulls filled from their paired source row; the columns in ``largest`` take the larger value."""
    given = pairs.join(source.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"from_{c}") for c in columns]), "source_id").drop("source_id")
    given = given.groupBy("id").agg(*[F.max(f"from_{c}").alias(f"from_{c}") for c in columns])
    joined = target.join(given, "id", "left")
    new = {c: (F.greatest(c, f"from_{c}") if c in largest else F.coalesce(c, f"from_{c}")) for c in columns}
    return joined.withColumns(new).drop(*[f"from_{c}" for c in columns])


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Partitions of about ``DISTINCT_ROWS`` rows by keys, however much one task reads: what looks for distinct rows may hold nearly all of its partition."""
    return rows.repartition(rows.count() // DISTINCT_ROWS + 1, *keys)


def distinct_rows(rows: DataFrame) -> DataFrame:
    return spread(rows, *rows.columns).distinct()


def co_cited(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id, n``: works cited by the seeds that are no seeds themselves, and by how many seeds."""
    cited = edges.join(seeds.select(F.col("id").alias("citing")), "citing").select("citing", F.col("cited").alias("id")).distinct()
    return cited.join(seeds.select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n"))


def crawl(edges: DataFrame, seeds: DataFrame, known: DataFrame, each: int = 20, least: int = 3) -> DataFrame:
    """``id, seeds, citations``: neighbours of the seeds in both directions, the ``each`` most cited of a seed and direction.

    Known works, and those cited less than ``least`` times, are left out after that; ties go to the smaller id. Repeated edges count once.
    """
    edges = edges.select("citing", "cited")
    out = spread(edges, "citing").join(seeds.select(F.col("id").alias("citing")), "citing").select(F.col("citing").alias("seed"), F.col("cited").alias("id"), F.lit("references").alias("direction"))
    back = spread(edges, "cited").join(seeds.select(F.col("id").alias("cited")), "cited").select(F.col("cited").alias("seed"), F.col("citing").alias("id"), F.lit("citations").alias("direction"))
    counts = distinct_rows(edges).groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("citations"))
    near = out.unionByName(back).distinct().join(counts, "id", "left").na.fill(0, ["citations"])
    w = Window.partitionBy("seed", "direction").orderBy(F.desc("citations"), "id")
    near = near.withColumn("n", F.row_number().over(w)).where((F.col("n") <= each) & (F.col("citations") >= least))  # each task keeps its own before the shuffle
    return near.join(known.select("id"), "id", "left_anti").groupBy("id").agg(F.count_distinct("seed").alias("seeds"), F.max("citations").alias("citations"))


def _wordings(rows: DataFrame) -> DataFrame:
    """``id, key``: all that the match gate compares of a row, the year, the surname and the distinct pairs of neighbouring words of its title."""
    pairs = F.array_sort(F.filter(X.bigrams(X.tokens(X.normalize_title(F.col("title")))), lambda p: p != ""))
    return written(rows.select("id", F.struct("year", F.lower("surname").alias("surname"), pairs.alias("pairs")).alias("key")), "wordings")


def _wording_classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))


def _near_wordings(left: DataFrame, right: DataFrame | None, least: float, years: int) -> DataFrame:
    """``left_id, right_id, similarity, left_n, right_n``: the classes of :func:`_wording_classes` that pass the gate, a class and itself too.

    Without ``right`` those of one table, each pair once and none of a class and itself. Classes meet by the rarest of their
    pairs of words, as many of each as one that is alike must share one of, and count where they meet by the rarest that they
    share, if what follows it can still make them alike. The classes of a pair of words are dealt to stripes, and two stripes
    meet in a cell of their own.
    """
    tables = [left] if right is None else [left, right]
    flat = lambda d: d.where(F.size("key.pairs") > 0).select("class_id", "n", "key.*")
    each = lambda d: flat(d).select("class_id", "n", "year", "surname", F.explode("pairs").alias("p"))
    counts = reduce(DataFrame.unionByName, [each(d).select("p") for d in tables]).groupBy("p").agg(F.count("*").alias("df"))
    counts = written(counts.withColumn("number", F.monotonically_increasing_id()), "word-pairs")  # numbers are compared faster than texts
    size = F.size("pairs")
    enough = (size - F.ceil(size * (least / (2 - least)) - 1e-9) + 1).cast("int")

    def keys(d: DataFrame) -> DataFrame:
        ordered = each(d).join(counts, "p").groupBy("class_id", "n", "year", "surname").agg(F.array_sort(F.collect_list(F.struct("df", "number"))).number.alias("pairs"))
        return written(ordered.select("class_id", "n", "year", "surname", "pairs", size.alias("size"), F.posexplode(F.slice("pairs", F.lit(1), enough)).alias("at", "p")), "word-pair-keys")

    found = [keys(d) for d in tables]
    stripes = lambda d, c: d.groupBy("p").agg(F.count("*").alias("of"), F.ceil(F.count("*") / STRIPE_ROWS).cast("int").alias(c))
    grid = stripes(found[0], "rows").where("of > 1").withColumn("columns", F.col("rows")) if right is None else stripes(found[0], "rows").drop("of").join(stripes(found[1], "columns").drop("of"), "p")
    stripe = lambda of: F.pmod(F.xxhash64("class_id"), F.col(of)).cast("int")
    l, r = (d.join(grid.select("p", "rows", "columns"), "p") for d in (found[0], found[-1]))
    l = l.withColumn("i", stripe("rows")).withColumn("j", F.explode(F.sequence(F.col("i") if right is None else F.lit(0), F.col("columns") - 1))).alias("l")
    r = r.withColumn("j", stripe("columns")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") if right is None else F.col("rows") - 1))).alias("r")
    names = F.contains(F.col("l.surname"), F.col("r.surname")) | F.contains(F.col("r.surname"), F.col("l.surname"))
    near = F.coalesce(F.abs(F.col("l.year") - F.col("r.year")) <= years, F.lit(True)) & F.coalesce(names, F.lit(True))
    once = (F.col("l.i") < F.col("l.j")) | (F.col("l.class_id") < F.col("r.class_id")) if right is None else F.lit(True)
    both = F.col("l.size") + F.col("r.size")
    reach = F.least(F.col("l.size") - F.col("l.at"), F.col("r.size") - F.col("r.at")) * 2 >= both * least - 1e-6
    common = F.array_intersect("l.pairs", "r.pairs")  # in the order of l: the rarest first
    similarity = F.round(2.0 * F.size(common) / both, 6)
    # In the order of their price; a filter after the join would come first of all.
    passes = once & reach & near & (F.get(common, F.lit(0)) == F.col("l.p")) & (similarity >= least)
    met = l.join(r, (F.col("l.p") == F.col("r.p")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j")) & passes)
    return met.select(F.col("l.class_id").alias("left_id"), F.col("r.class_id").alias("right_id"), similarity.alias("similarity"), F.col("l.n").alias("left_n"), F.col("r.n").alias("right_n"))


def match_gate(left: DataFrame, right: DataFrame, least: float = 0.92, years: int = 1) -> DataFrame:
    """``left_id, right_id, similarity``: titles of a near equal wording, of years at most ``years`` apart and of one surname.

    The wording is alike if the Dice similarity of the pairs of neighbouring words is at least ``least``. A missing year or
    surname passes, and so does a surname that holds the other. Titles without words match nothing. Rows of one wording,
    year and surname are compared once; the pairs of all of them are as many as there are.
    """
    l, r = _wordings(left), _wordings(right)
    lc, rc = _wording_classes(l), _wording_classes(r)
    members = lambda rows, classes, side: rows.join(classes, "key").select(F.col("class_id").alias(f"{side}_class"), F.col("id").alias(f"{side}_id"))
    near = _near_wordings(lc, rc, least, years).select(F.col("left_id").alias("left_class"), F.col("right_id").alias("right_class"), "similarity")
    pairs = near.join(members(l, lc, "left"), "left_class").join(members(r, rc, "right"), "right_class")
    return pairs.where("left_id <> right_id").select("left_id", "right_id", "similarity")


def match_links(rows: DataFrame, least: float = 0.92, years: int = 1) -> DataFrame:
    """``id, class_id, links``: for each row the smallest id of its wording, year and surname, and how many other rows :func:`match_gate` pairs it with.

    Rows of one class have the same links; only classes are compared, so copies make no pairs.
    """
    r = _wordings(rows)
    classes = written(_wording_classes(r), "wording-classes")
    near = _near_wordings(classes, None, least, years)
    ends = F.array(F.struct(F.col("left_id").alias("class_id"), F.col("right_n").alias("n")), F.struct(F.col("right_id").alias("class_id"), F.col("left_n").alias("n")))
    links = near.select(F.inline(ends)).groupBy("class_id").agg(F.sum("n").alias("links"))
    own = F.when(F.size("key.pairs") > 0, F.col("n") - 1).otherwise(0)  # without the row itself
    return r.join(classes.join(links, "class_id", "left").withColumn("own", own), "key").select("id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("own")).alias("links"))


def signature_matches(left: DataFrame, right: DataFrame, years: int = 8, authors: float = 0.5, match: float = 0.90, review: float = 0.85) -> DataFrame:
    """``left_id, right_id, cosine, verdict``: for each left row the right one of the same title signature that is closest by cosine.

    Rows need ``id, title, year, authors, embedding``; authors must overlap and years lie near. Ties go to the smaller id, which
    also decides where no cosine is known. No single pair leaves a task: what is sorted is one row for a left row and a block of
    the right ones, and the blocks of a frequent signature are tasks of their own.
    """
    keyed = lambda d: d.select("id", X.title_signature(F.col("title")).alias("signature"), "year", "authors", "embedding").where("signature is not null")
    l, r = written(keyed(left), "signatures"), written(keyed(right), "signatures")
    near = lambda x, y: (F.abs(x.year - y.year) <= years) & (X.overlap(x.authors, y.authors, "first") >= authors) & (x.id != y.id)

    # By cosine: the right vectors of a signature are dealt to blocks, and each left vector brings one row out of each block.
    with_norm = lambda d: d.where("embedding is not null").withColumn("norm", norm(F.col("embedding")))
    lv, rv = with_norm(l), with_norm(r)
    blocks = rv.groupBy("signature").agg(F.ceil(F.count("*") / SIGNATURE_BLOCK).cast("int").alias("blocks"))
    dealt = rv.join(blocks, "signature").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    held = dealt.groupBy("signature", "block").agg(F.collect_list(F.struct("id", "year", "authors", "embedding", "norm")).alias("rights"))
    asking = lv.join(blocks, "signature").select("signature", F.struct("id", "year", "authors", "embedding", "norm").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def closest(x: Column, rights: Column) -> Column:
        size = lambda y: x.norm * y.norm
        alike = lambda y: F.when((F.size(x.embedding) != F.size(y.embedding)) | (size(y) == 0), 0.0).otherwise(dot(x.embedding, y.embedding) / size(y))
        scored = F.transform(F.filter(rights, lambda y: near(x, y)), lambda y: F.struct(F.round(alike(y), 6).alias("cosine"), (-y.id).alias("back")))
        return F.array_max(F.filter(scored, lambda s: s.cosine.isNotNull()))

    met = asking.join(held.hint("merge"), ["signature", "block"]).select(F.col("x.id").alias("left_id"), closest(F.col("x"), F.col("rights")).alias("best"))
    by_cosine = met.where("best is not null").groupBy("left_id").agg(F.max("best").alias("best"))

    # Without a cosine the smallest id is first: the two smallest of a signature, year and authors are all that can be.
    least = r.groupBy("signature", "year", "authors").agg(F.min("id").alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("signature", "year", "authors")]
    second = r.alias("r").join(least.alias("f"), same[0] & same[1] & same[2]).where("r.id <> f.first").groupBy("r.signature", "r.year", "r.authors").agg(F.min("r.id").alias("id"))
    few = least.withColumnRenamed("first", "id").unionByName(second).select("signature", F.struct("id", "year", "authors").alias("y"))
    by_id = l.select("signature", F.struct("id", "year", "authors").alias("x")).join(few, "signature").where(near(F.col("x"), F.col("y")))
    by_id = by_id.groupBy(F.col("x.id").alias("left_id")).agg(F.min("y.id").alias("smallest"))

    found = by_id.join(by_cosine, "left_id", "left")
    best = found.select("left_id", F.coalesce(-F.col("best.back"), "smallest").alias("right_id"), F.col("best.cosine").alias("cosine"))
    return best.withColumn("verdict", F.when(F.col("cosine") >= match, "match").when(F.col("cosine") >= review, "review").otherwise("low"))


def unique_match(asked: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """``ask_id, id``: what each row of (ask_id, keys) stands for in (id, keys); null if no or several rows fit."""
    counts = known.groupBy(*on).agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    joined = asked.join(counts, on, "left")
    return joined.select("ask_id", F.when(F.col("n") == 1, F.col("id")).alias("id"))


def staged_match(asked: DataFrame, known: DataFrame, least: int = 20) -> DataFrame:
    """``ask_id, id, stage`` of (ask_id, doi, title): by DOI, else by the title in any case if it is long enough."""
    dois = known.where("doi is not null").groupBy("doi").agg(F.min("id").alias("by_doi"))
    titles = known.where(F.length("title") >= least).groupBy(F.lower("title").alias("title_key")).agg(F.min("id").alias("by_title"))
    joined = asked.withColumn("title_key", F.when(F.length("title") >= least, F.lower("title"))).join(dois, "doi", "left").join(titles, "title_key", "left")
    stage = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_title").isNotNull(), "title").otherwise("none")
    return joined.select("ask_id", F.coalesce("by_doi", "by_title").alias("id"), stage.alias("stage"))


def suffix_match(asked: DataFrame, known: DataFrame, length: int = 6) -> DataFrame:
    """``ask_id, id``: the only known id that ends with the same ``length`` characters; null if none or several do."""
    tail = lambda c: F.substring(c.cast("string"), -length, length)
    return unique_match(asked.withColumn("tail", tail(F.col("text"))), known.withColumn("tail", tail(F.col("id"))), ["tail"])


def filter_harm(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """``id, dropped_by``: the first filter that a row fails, null if it passes all."""
    reason = F.lit(None).cast("string")
    for name, keeps in reversed(list(filters.items())):
        reason = F.when(~F.coalesce(keeps, F.lit(False)), F.lit(name)).otherwise(reason)
    return rows.select("id", reason.alias("dropped_by"))
