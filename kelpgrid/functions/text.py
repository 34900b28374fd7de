"""Text normalisation and similarity as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
FOLDED = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"

# Words too common to match on.
STOPWORDS = ["the", "a", "an", "of", "and", "or", "in", "on", "for", "to", "with", "by", "from", "at", "is", "are", "was", "were", "be", "that", "this", "it", "as", "than"]


def fold(text: Column) -> Column:
    """Accents removed."""
    return F.translate(text, ACCENTED, FOLDED)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def normalize_title(title: Column) -> Column:
    """Lower case, language suffix dropped, dashes to spaces, only letters, digits and single spaces."""
    t = F.regexp_replace(F.lower(F.trim(title)), r" *\((en|es|pt|fr)\) *$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[-–—]", " "), r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(t, r" +", " "))


def dedup_title(title: Column) -> Column:
    """Accent-folded lower case, punctuation to spaces, articles dropped."""
    t = F.regexp_replace(F.lower(fold(title)), r"[^a-z0-9 ]", " ")
    t = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(t, r" +", "  "), F.lit(" ")), r" (the|a|an) ", " ")
    return F.trim(F.regexp_replace(t, r" +", " "))


def series_title_key(title: Column) -> Column:
    """Title without working-paper series numbers, preprint marks and a leading article."""
    t = F.lower(title)
    t = F.regexp_replace(t, r"(nber|iza|ssrn|cesifo|cepr) (working paper|discussion paper|dp|wp)?( no\.?)? ?[0-9]+", " ")
    t = F.regexp_replace(t, r"\(preprint\)", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]", " "), r" +", " "))
    return F.regexp_replace(t, r"^the ", "")


def surname(author: Column) -> Column:
    """The part before a comma, else the last word; letters and digits only."""
    name = F.when(F.instr(author, ",") > 0, F.split_part(author, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(author), " +"), -1))
    return F.regexp_replace(F.lower(fold(name)), r"[^a-z0-9]", "")


def canonical_key(*parts: Column) -> Column:
    """Parts joined by a bar; null if one is missing or empty."""
    whole = parts[0].isNotNull()
    for p in parts:
        whole = whole & p.isNotNull() & (p.cast("string") != "")
    return F.when(whole, F.concat_ws("|", *[p.cast("string") for p in parts]))


def normalize_doi(doi: Column, dx: bool = True) -> Column:
    """A DOI without its resolver, in lower case."""
    return F.lower(F.trim(F.regexp_replace(doi, r"^https?://(dx\.)?doi\.org/" if dx else r"^https?://doi\.org/", "")))


def find_doi(text: Column) -> Column:
    """The first DOI of a free text, trailing punctuation dropped; null if none."""
    found = F.lower(F.regexp_extract(text, r"(10\.[0-9]{4,9}/[A-Za-z0-9./_()-]+)", 1))
    return F.when(found != "", F.regexp_replace(found, r"[.,;)]+$", ""))


def venue_key(venue: Column) -> Column:
    """Letters and digits of a venue, & as and, trailing parenthetical and leading article dropped."""
    v = F.regexp_replace(F.lower(fold(venue)), "&", " and ")
    v = F.regexp_replace(F.regexp_replace(v, r" *\([^)]*\) *$", ""), r"^the ", "")
    return F.regexp_replace(v, r"[^a-z0-9]", "")


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case ASCII words of at least ``least`` characters, accents folded."""
    words = F.split(F.trim(F.regexp_replace(F.lower(fold(text)), r"[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: F.length(w) >= least)


def content_tokens(text: Column, least: int = 3) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens(text, least), lambda w: ~F.array_contains(stop, w))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+"), lambda w: w != ""))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word is its own."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    # Bound by a lambda, the words are made once and not for every pair.
    return F.array_distinct(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(w))[0])


def dice(a: Column, b: Column) -> Column:
    """2|A∩B| / (|A|+|B|) of two sets; 0 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def overlap(a: Column, b: Column, by: str = "max") -> Column:
    """|A∩B| over the larger set ('max'), the smaller one ('min'), the first ('first') or the union ('union')."""
    common = F.size(F.array_intersect(a, b))
    under = {"max": F.greatest(F.size(a), F.size(b)), "min": F.least(F.size(a), F.size(b)), "first": F.size(a), "union": F.size(F.array_union(a, b))}[by]
    return F.when(under > 0, common / under).otherwise(0.0)


def author_overlap(a: Column, b: Column) -> Column:
    """Which share of the first list of authors the second one has."""
    return overlap(a, b, "first")


def json_array(text: Column) -> Column:
    """A JSON array of strings; null if it is none."""
    return F.from_json(text, "array<string>")


def url_parameter(url: Column, name: str) -> Column:
    """The value of a parameter of a URL; null if it has none."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def title_signature(title: Column, least: int = 4) -> Column:
    """Distinct longer words without stop words, in order; null if there are fewer than ``least``."""
    words = F.array_sort(F.array_distinct(content_tokens(title, 4)))
    return F.when(F.size(words) >= least, F.array_join(words, " "))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 (1 - edit distance / longer length) of the two texts with their words in order."""
    x, y = (F.array_join(F.array_sort(tokens(c)), " ") for c in (a, b))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer > 0, 100.0 * (1 - F.levenshtein(x, y) / longer)).otherwise(100.0)


def strip_markup(text: Column) -> Column:
    """CDATA marks, tags and the common entities removed, white space squeezed."""
    t = F.regexp_replace(F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", ""), r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeeze(t)


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")


def last_path_segment(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    return F.regexp_extract(path, r"([^/]*)$", 1)


def source_class(domain: Column) -> Column:
    """x, news, blog or other, by the domain."""
    return F.when(domain.isin("x.com", "twitter.com"), "x").when(domain.rlike(r"news|times|post"), "news").when(domain.rlike(r"blog|medium|substack"), "blog").otherwise("other")


def cited_ids(text: Column) -> Column:
    """Distinct ids in square brackets, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([A-Za-z0-9_-]+)\]"), F.lit(1)))


def citation_fence(text: Column, valid: Column) -> Column:
    """The text without bracketed ids that are not in ``valid``."""
    bad = F.array_except(cited_ids(text), valid)
    return F.aggregate(bad, text, lambda t, i: F.replace(t, F.concat(F.lit("["), i, F.lit("]")), F.lit("")))


def ends_cleanly(before: Column, after: Column, least: float = 0.7) -> Column:
    """Whether a rewrite keeps enough of the text and ends with a full stop or the like."""
    return (F.length(after) >= least * F.length(before)) & after.rlike(r"[.!?]\s*$")
