"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _minima(edges: DataFrame, at: str, other: str) -> DataFrame:
    return edges.groupBy(at).agg(F.min(other).alias("m"))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """v, component (smallest v reachable) for each end of an edge. The minima are pre-aggregated before they are shuffled,
    so a vertex with very many edges meets in no task; joins on such a vertex are left to adaptive skew handling. Each round
    is written, and the rounds grow with the logarithm of the longest path."""
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = scratch.write(e, "edges")
    last = None
    for round_ in range(max_rounds):
        # Large star: each larger neighbour of u goes to the least vertex next to u, or to u.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _minima(both, "u", "v").withColumn("m", F.least("m", "u"))
        large = both.filter(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.filter("u != v").distinct(), f"large{round_ % 2}")
        # Small star: u and its smaller neighbours go to the least of them.
        m = _minima(large, "u", "v")
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        e = scratch.write(small.filter("u != v").distinct(), f"small{round_ % 2}")
        if round_:
            for name in ("large", "small"):  # of the round before: nothing reads them any more
                scratch.drop(f"{name}{(round_ - 1) % 2}")
        # Equal counts and sums of hashes over two rounds: nothing has moved.
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if state == last:
            return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(
                e.select("v", F.col("v").alias("component")).distinct()
            )
        last = state
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
