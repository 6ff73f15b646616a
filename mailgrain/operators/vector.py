"""Nearest vectors by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "message_id", vector: str = "embedding") -> DataFrame:
    """key, similarity of the k nearest, exact: one pass with a bounded heap per task (``TakeOrderedAndProject``)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine(F.col(vector), q), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def similar_to(vectors: DataFrame, seed, k: int, key: str = "message_id", vector: str = "embedding", include_seed: bool = False) -> DataFrame:
    """The k nearest to a row's own vector; the seed is one row and is broadcast."""
    own = vectors.filter(F.col(key) == seed).select(F.col(vector).alias("_q")).limit(1)
    rows = vectors if include_seed else vectors.filter(F.col(key) != seed)
    return rows.crossJoin(F.broadcast(own)).select(key, F.round(cosine(F.col(vector), F.col("_q")), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)
