"""Filters on works: optional parameters, null-pass semantics, quality gates and denylists."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpgrid.functions import text as X
from kelpgrid.operators.rules import NOISE


@dataclass(frozen=True)
class SearchFilters:
    """What a search may be narrowed to; None leaves a filter out.

    Rows with a null type, region, rating, level or percentile pass those filters; a null year does not.
    """

    year_min: int | None = None
    year_max: int | None = None
    types: tuple[str, ...] | None = None
    topics: tuple[str, ...] | None = None
    regions: tuple[str, ...] | None = None
    sms_levels: tuple[int, ...] | None = None
    abs_ratings: tuple[str, ...] | None = None
    repec_max: int | None = None
    venues: tuple[str, ...] | None = None
    venue_patterns: tuple[str, ...] | None = None
    include_unranked: bool = False

    @property
    def active(self) -> bool:
        return self != SearchFilters()

    def column(self) -> Column:
        or_null = lambda name, allowed: None if allowed is None else F.col(name).isin(*allowed) | F.col(name).isNull()
        parts = [
            None if self.year_min is None else F.coalesce(F.col("year") >= self.year_min, F.lit(False)),
            None if self.year_max is None else F.coalesce(F.col("year") <= self.year_max, F.lit(False)),
            or_null("publication_type", self.types),
            or_null("topic", self.topics),
            or_null("region", self.regions),
            or_null("sms_level", self.sms_levels),
            or_null("abs_rating", self.abs_ratings),
            None if self.repec_max is None else (F.col("repec_percentile") <= self.repec_max) | F.col("repec_percentile").isNull(),
            self.source_gate(),
        ]
        return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))

    def source_gate(self) -> Column | None:
        """Named venues, venue patterns, or unranked journal articles where these are let in."""
        if self.venues is None and self.venue_patterns is None:
            return None
        gate = F.col("venue").isin(*(self.venues or ()))
        for p in self.venue_patterns or ():
            gate = gate | F.col("venue").ilike(p)
        if self.include_unranked:
            gate = gate | (F.col("abs_rating").isNull() & (F.col("publication_type") == "journal_article"))
        return F.coalesce(gate, F.lit(False))


# The sources that a search takes where none are named.
DEFAULT_TIERS = (1, 2, 3)
DEFAULT_INSTITUTIONS = ("IADB", "WB", "IMF", "OECD")
DEFAULT_SERIES = ("NBER", "IZA", "CEPR_REPEC", "SSRN")


@dataclass(frozen=True)
class Sources:
    """Named sources; None has not been asked for, an empty tuple has been asked to be none."""

    journal_tiers: tuple[int, ...] | None = None
    institutions: tuple[str, ...] | None = None
    series: tuple[str, ...] | None = None

    def resolved(self) -> Sources:
        """The default universe where nothing is named; any choice is taken as it is."""
        if self.journal_tiers or self.institutions is not None or self.series is not None:
            return self
        return Sources(DEFAULT_TIERS, DEFAULT_INSTITUTIONS, DEFAULT_SERIES)

    def column(self, tier: Column, institution: Column, series: Column) -> Column:
        """Rows of any of the resolved sources; a null source is none of them."""
        named = self.resolved()
        some = [c.isin(*allowed) for c, allowed in ((tier, named.journal_tiers), (institution, named.institutions), (series, named.series)) if allowed]
        return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), some, F.lit(False)), F.lit(False))


def kept_by(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """``name, n``: how many rows each of some named filters lets pass, counted in one pass."""
    counted = rows.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(filters.values())])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, name in enumerate(filters)])).alias("x")).select("x.*")


def period_filters(period: str, now: int, server: bool = True, custom: tuple[int, int] | None = None) -> SearchFilters:
    """Year bounds of a named period; ``recent`` starts in 2020 on the server and four years back in the client."""
    starts = {"recent": 2020 if server else now - 4, "2000+": 2000, "last-5": now - 5}
    if period == "custom" and custom:
        return SearchFilters(year_min=custom[0], year_max=custom[1])
    return SearchFilters(year_min=starts.get(period))


def contains_all(column: Column, wanted: list) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), column)) == 0


def overlaps(column: Column, wanted: list) -> Column:
    return F.arrays_overlap(column, F.array(*[F.lit(w) for w in wanted]))


def journal_tier(works: DataFrame, tiers: DataFrame) -> DataFrame:
    """``tier`` of every row from (name, tier) by the normalised venue; 5 if unknown."""
    named = tiers.groupBy(X.venue_key(F.col("name")).alias("venue_key")).agg(F.min("tier").alias("tier"))
    return works.withColumn("venue_key", X.venue_key(F.col("venue"))).join(named, "venue_key", "left").withColumn("tier", F.coalesce("tier", F.lit(5))).drop("venue_key")


def without_denied_venues(works: DataFrame, denied: DataFrame) -> DataFrame:
    """Rows whose normalised venue is not among the names of ``denied``."""
    keys = denied.select(X.venue_key(F.col("name")).alias("venue_key")).distinct()
    return works.withColumn("venue_key", X.venue_key(F.col("venue"))).join(keys, "venue_key", "left_anti").drop("venue_key")


def old_enough(year: Column, least: int = 1961) -> Column:
    return year.isNull() | (year >= least)


# Titles that name a part of an issue, not a work.
GENERIC_TITLES = ["editorial", "introduction", "book review", "book reviews", "preface", "foreword", "index", "contents", "table of contents", "erratum", "corrigendum", "announcements", "front matter", "back matter", "untitled", "abstracts", "conclusion", "references", "acknowledgements", "notes"]


def is_generic_title(title: Column) -> Column:
    return X.normalize_title(title).isin(*GENERIC_TITLES) | X.normalize_title(title).rlike(r"^(volume|issue|chapter|part) [0-9ivx]+$")


def noise_reason(title: Column) -> Column:
    """The first noise rule that a title matches, null if none does."""
    low = F.lower(F.trim(title))
    out = F.lit(None).cast("string")
    for reason, pattern, below in reversed(NOISE):
        hit = low.rlike(pattern)
        out = F.when(hit if below is None else hit & (F.length(title) < below), F.lit(reason)).otherwise(out)
    return out


def is_real_abstract(text: Column) -> Column:
    """Long enough, and no URL, placeholder, highlights, markup or page furniture."""
    low = F.lower(F.trim(text))
    bad = low.rlike(r"^https?://") | low.rlike(r"^(no abstract|abstract not available|n/a|none)") | low.rlike(r"^highlights") | low.rlike(r"</?[a-z]+>") | low.rlike(r"(cookies|all rights reserved|javascript)")
    return F.coalesce((F.length(F.trim(text)) >= 60) & ~bad, F.lit(False))


def working_paper_source(venue: Column, families: list[str], hints: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(venue), F.lit(h.lower())) for h in hints], venue.isin(*families))


def violations(year_min: int, sms_min: int, regions: list[str]) -> dict[str, Column]:
    """Whether a row breaks a filter that it should have met, by filter, and whether it breaks any."""
    parts = {
        "bad_year": F.coalesce(F.col("year") < year_min, F.lit(False)),
        "bad_sms": F.coalesce(F.col("sms_level") < sms_min, F.lit(False)),
        "bad_region": F.coalesce(~F.col("region").isin(*regions), F.lit(False)),
    }
    return parts | {"bad_any": reduce(lambda a, b: a | b, parts.values())}


def funnel(works: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """``step, kept, reduction``: rows left after each filter and the percent taken off the whole, in one pass."""
    so_far, counts = F.lit(True), []
    for _, condition in steps:
        so_far = so_far & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(so_far))
    one = works.agg(F.count("*").alias("all"), F.array(*counts).alias("kept"))
    names = F.array(*[F.lit(n) for n, _ in steps])
    rows = one.select("all", F.posexplode(F.arrays_zip(names.alias("name"), F.col("kept"))).alias("pos", "x"))
    kept = F.col("x.kept")
    return rows.select((F.col("pos") + 1).alias("step"), F.col("x.name").alias("name"), kept.alias("kept"), F.round(F.when(F.col("all") > 0, 100.0 * (F.col("all") - kept) / F.col("all")), 2).alias("reduction"))
