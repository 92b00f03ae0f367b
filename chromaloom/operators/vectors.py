"""Template vectors and normalised similarity on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centred(a) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.transform(a, lambda x: x - mean)


def ncc(a, b) -> Column:
    """Normalised cross-correlation: cosine of the centred vectors."""
    return cosine(centred(a), centred(b))


def templates(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Mean vector per group: partial sums per (group, element), so no group meets in one task."""
    parts = vectors.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    # one row per vector element of a template
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("template"))


def similarity_to_template(vectors: DataFrame, template: DataFrame, by: list[str], ident: str) -> DataFrame:
    return vectors.join(template, by).select(ident, *by, cosine("v", "template").alias("similarity"))
