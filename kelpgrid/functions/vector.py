"""Vector arithmetic as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; 0 for a zero vector or unequal lengths, null if either is null. ``norm_b`` saves that of a constant."""
    size = norm(a) * (norm(b) if norm_b is None else norm_b)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def parse_vector(text: Column) -> Column:
    """``[a,b,...]`` as an array of doubles; null if any part is no finite number."""
    parts = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, parts)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine to one given vector, whose norm is worked out once."""
    size = 0.0
    for x in vector:
        size += float(x) * float(x)
    return cosine(a, literal(vector), F.lit(math.sqrt(size)))


def only_row(rows: DataFrame, most: int = 1) -> list:
    """The rows of a table that holds parameters, such as one query vector; more than ``most`` are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"expected at most {most} rows of parameters")
    return found


def with_cosine(rows: DataFrame, query: DataFrame, vector_col: str = "embedding", digits: int = 6, name: str = "cosine") -> DataFrame:
    """Adds the cosine to the one vector ``q`` of ``query``; null if there is no query."""
    found = only_row(query)
    if not found or found[0].q is None:
        return rows.withColumn(name, F.lit(None).cast("double"))
    return rows.withColumn(name, F.round(cosine_to(F.col(vector_col), found[0].q), digits))
