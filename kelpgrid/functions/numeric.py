"""Arithmetic on years, scores and means as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """x within low and high; null stays null, which least and greatest alone would pass over."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rounded(x: Column, digits: int = 6) -> Column:
    """x to some digits; what lies within 1e-10 below a tie is one, so that the order of a sum or product does not decide."""
    return F.round(x + 1e-10, digits)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def citation_score(citations: Column, year: Column, now: int) -> Column:
    """ln(1 + citations a year) / ln 501 within 0 and 1; 0 without citations or a plausible year."""
    rate = citations / F.greatest(F.lit(1), F.lit(now) - year + 1)
    return F.when((citations <= 0) | (year < 1900) | citations.isNull() | year.isNull(), 0.0).otherwise(clamp(F.log1p(rate) / F.log(F.lit(501.0)), 0.0, 1.0))


def recency_score(year: Column, now: int) -> Column:
    return F.when(year.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.lit(now) - year) / 25.0))


def rigor_score(sms: Column) -> Column:
    return F.coalesce(clamp(sms / 5.0, 0.0, 1.0), F.lit(0.0))


def region_ramp(cosine: Column, low: float = 0.5, high: float = 0.65) -> Column:
    """0 below ``low``, 1 above ``high``, a line between; 1 if the ends are not in order."""
    return clamp((cosine - low) / (high - low), 0.0, 1.0) if high > low else F.lit(1.0)


def geometric_mean(values: Column, floor: float = 0.01) -> Column:
    logs = F.transform(values, lambda x: F.log(F.greatest(x, F.lit(floor))))
    return F.exp(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def harmonic_mean(values: Column) -> Column:
    """0 if any value is not positive."""
    inverse = F.aggregate(F.transform(values, lambda x: 1.0 / x), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.exists(values, lambda x: x <= 0), 0.0).otherwise(F.size(values) / inverse)


def percentile_band(pct: Column) -> Column:
    """Bands of a percentile: 95, 90, 75, 50 and below."""
    return F.when(pct >= 95, "top5").when(pct >= 90, "top10").when(pct >= 75, "top25").when(pct >= 50, "top50").when(pct.isNotNull(), "other")


def publication_rank(kind: Column) -> Column:
    return F.when(kind == "journal_article", 1).when(kind == "working_paper", 2).otherwise(9)
