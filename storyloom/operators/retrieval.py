"""Vector and keyword search, and the assembly of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def usable(vector: str, dimension: int) -> Column:
    """The expected dimension, all components finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return (F.size(vector) == dimension) & F.forall(vector, fine)


def vector_top_k(scenes: DataFrame, query: list[float], k: int, tie: list[str], vector: str = "embedding") -> DataFrame:
    """The k scenes closest by cosine; filters of scope belong before it. Plans as one scan and a bounded top-k."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return scenes.where(usable(vector, len(query))).withColumn("similarity", cosine(F.col(vector), asked)).orderBy(F.desc("similarity"), *tie).limit(k)


def keyword_score(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text."""
    low = F.lower(text)
    return sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))


def keyword_top_k(items: DataFrame, terms: list[str], k: int, ident: str, text: str) -> DataFrame:
    return items.withColumn("score", keyword_score(F.col(text), terms)).where("score > 0").orderBy(F.desc("score"), ident).limit(k)
