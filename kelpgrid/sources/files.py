"""Feeds, exports, upserts and repairs around the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgrid.functions import text as X


def feed_items(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``item, title, link, body`` of every <item> or <entry> of a feed text, with the columns in ``keep``."""
    items = F.regexp_extract_all(F.col(text_col), F.lit(r"(?is)<(?:item|entry)[ >](.*?)</(?:item|entry)>"), F.lit(1))
    rows = docs.select(*keep, F.posexplode(items).alias("item", "x"))
    part = lambda tag: X.strip_markup(F.regexp_extract("x", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    link = F.coalesce(F.nullif(part("link"), F.lit("")), F.regexp_extract("x", r"(?i)<link[^>]*href=\"([^\"]*)\"", 1))
    return rows.select(*keep, "item", part("title").alias("title"), link.alias("link"), F.coalesce(F.nullif(part("description"), F.lit("")), part("summary")).alias("body"))


def inverted_abstract(rows: DataFrame, id_col: str, index_col: str) -> DataFrame:
    """Text of a {word: [positions]} map, the words by position, put together within the row; rows of no words are left out."""
    entries = F.map_entries(index_col)
    placed = F.flatten(F.transform(entries, lambda e: F.transform(e.value, lambda p: F.struct(p.alias("pos"), e.key.alias("word")))))
    joined = F.array_join(F.transform(F.array_sort(placed), lambda x: x.word), " ")
    return rows.where(F.size(placed) > 0).select(id_col, joined.alias("abstract"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, ignore: bool = False) -> DataFrame:
    """One row per key: the incoming one, or with ``ignore`` the existing one; of several of one side the one with the least hash of its values."""
    both = existing.withColumn("order_", F.lit(0 if ignore else 1)).unionByName(incoming.withColumn("order_", F.lit(1 if ignore else 0)), allowMissingColumns=True)
    values = [c for c in both.columns if c != "order_"]
    nth = F.row_number().over(Window.partitionBy(key).orderBy("order_", F.xxhash64(*values)))
    return both.withColumn("nth_", nth).where("nth_ = 1").drop("nth_", "order_")


def merge_fields(existing: DataFrame, incoming: DataFrame, key: str, frozen: tuple[str, ...] = ()) -> DataFrame:
    """Incoming values over existing ones, but never a null over a value; ``frozen`` columns keep what they have."""
    new = incoming.select(key, *[F.col(c).alias(f"new_{c}") for c in incoming.columns if c != key])
    joined = existing.join(new, key, "full")
    value = lambda c: F.coalesce(c, f"new_{c}") if c in frozen else F.coalesce(f"new_{c}", c)
    return joined.select(key, *[value(c).alias(c) if f"new_{c}" in new.columns else F.col(c) for c in existing.columns if c != key])


def csv_field(value: Column, mark_empty: bool = False) -> Column:
    """A field quoted if it holds a comma, a quote or a line end, and with ``mark_empty`` if it is empty; null is nothing."""
    text = value.cast("string")
    return F.when(text.rlike("[,\"\n\r]" + "|^$" * mark_empty), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def csv_lines(rows: DataFrame, columns: list[str], mark_empty: bool = False) -> DataFrame:
    return rows.select(F.concat_ws(",", *[csv_field(F.col(c), mark_empty) for c in columns]).alias("line"))


def csv_values(line: Column) -> Column:
    """The fields of a line of :func:`csv_lines`, character by character as they were; nothing is null, a quoted nothing is empty.

    ``from_csv`` keeps neither apart, and loses null characters in quotes and what follows U+FFFF.
    """
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',((?:"[^"]*+")*+[^,"]*+)'), F.lit(1))  # possessive: no stack, however long a field
    inside = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), inside(x)).when(x != "", x))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def json_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("line"))


def repaired_array(value: Column) -> Column:
    """An array from its JSON, or from a list of words parted by semicolons; null stays null."""
    parsed = F.from_json(F.when(F.trim(value).startswith("["), value), "array<string>")
    return F.coalesce(parsed, F.transform(F.split(value, ";"), lambda x: F.trim(x)))


# Parts of the names of fields that may hold personal data or text that people wrote.
PERSONAL = "(?i)query|question|prompt|text|instruction|abstract|title|body|content|email|answer|message|doi|url|paste|name|phone|address|token"


def scrubbed_json(payload: Column, most: int = 64) -> Column:
    """A JSON object in text without personal fields, as a map of text.

    Each personal field is replaced by its length; lists are kept as their number of entries only; objects within are
    scrubbed the same way, one level deep, their fields named ``outer.inner``, and anything deeper is dropped.
    """
    is_object, is_list = (lambda v: F.trim(v).startswith("{")), (lambda v: F.trim(v).startswith("["))

    def flattened(top: Column) -> Column:
        nested = F.map_filter(top, lambda k, v: is_object(v) & ~k.rlike(PERSONAL))
        inner = F.flatten(F.transform(F.map_entries(nested), lambda e: F.transform(F.map_entries(F.from_json(e.value, "map<string,string>")), lambda f: F.struct(F.concat(e.key, F.lit("."), f.key).alias("key"), f.value.alias("value")))))
        inner = F.map_filter(F.map_from_entries(inner), lambda k, v: ~is_object(v))
        return F.map_concat(F.map_filter(top, lambda k, v: ~is_object(v) | k.rlike(PERSONAL)), inner)

    def cleaned(flat: Column) -> Column:
        lists = F.map_filter(flat, lambda k, v: is_list(v) & ~k.rlike(PERSONAL))
        sizes = F.transform_keys(F.transform_values(lists, lambda k, v: F.json_array_length(v).cast("string")), lambda k, v: F.concat(k, F.lit("_count")))
        return F.map_concat(scrubbed(F.map_filter(flat, lambda k, v: ~is_list(v) | k.rlike(PERSONAL)), most), sizes)

    # What lambdas bind is parsed and put together once.
    return F.transform(F.transform(F.array(F.from_json(payload, "map<string,string>")), flattened), cleaned)[0]


def scrubbed(payload: Column, most: int = 64) -> Column:
    """A map payload without personal fields, each replaced by its length, other values cut to ``most`` characters."""
    keep = F.map_filter(payload, lambda k, v: ~k.rlike(PERSONAL))
    kept = F.transform_values(keep, lambda k, v: F.substring(v, 1, most))
    lengths = F.map_filter(payload, lambda k, v: k.rlike(PERSONAL))
    renamed = F.transform_keys(F.transform_values(lengths, lambda k, v: F.length(v).cast("string")), lambda k, v: F.concat(k, F.lit("_len")))
    return F.map_concat(kept, renamed)
