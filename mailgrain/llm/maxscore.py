"""Exact inner-product top-k by MaxScore over shards.

A component of an integer vector is a term with a weight. Rows are dealt by hash to shards of bounded size; a shard's
postings are columns: of each term, the weights of all rows, and their least and greatest. Rows with one vector become one
posting that keeps its smallest ids. For a query, a term's bound is the most that it can add to any score of the shard.
With a threshold, the k-th best score so far, the terms with the smallest bounds are non-essential as long as their bounds
together stay below it: a row that nothing but these speak for can't reach it. The essential terms' postings are
traversed; the others are probed one after another, greatest bound first, for the rows alone whose sum and remaining bounds
still reach the threshold, which rises as scores are known. Equal scores stay in, so ties go to the smaller id.

Shards and groups of queries meet by their numbers, block against block, and each block's best k go to one ranking for each
query; ``WindowGroupLimit`` cuts them before they are shuffled.

Defined results: vectors that are null or hold null or non-finite components, and rows of a null id, take no part; a vector
that is shorter has zeros in the other's further components, so an empty one scores 0 everywhere. Integers beyond 2^24
count as 2^24. A query is a row, not an id: of repeated rows each is a candidate for the other, and each query row has its
own ranks. Fewer than k candidates: all of them. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

LIMIT = 1 << 24
SHARD_ROWS, QUERY_ROWS = 8192, 4096
#: Non-essential terms probed at once.
PROBED = 4


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return vectors.filter(sound & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = lists.combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row[at < dims], at[at < dims]] = flat[at < dims]
    return out


class Shard:
    """Distinct vectors of a shard as columns, and for each its rows in the order of their ids."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rid, ids))
        self.rid, self.ids = rid[order], ids[order]
        distinct, self.of = np.unique(vectors[order], axis=0, return_inverse=True)
        self.of = self.of.ravel()
        self.rows = np.argsort(self.of, kind="stable")
        self.begin = np.searchsorted(self.of[self.rows], np.arange(len(distinct) + 1))
        self.columns = np.ascontiguousarray(distinct.T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best k rows but ``own``; all within rounding-free arithmetic."""
        columns, n = self.columns, self.columns.shape[1]
        bound = np.maximum(q * self.low, q * self.high)  # of each term, over the shard
        by = np.argsort(-(bound - np.minimum(q * self.low, q * self.high)), kind="stable")  # what tells rows apart first
        bound = bound[by]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # of the terms from each on
        # A first threshold: the k-th best of the rows that the greatest term favours most. One row may be the query's own.
        term = q[by[0]] * columns[by[0]] if len(by) else np.zeros(n)
        some = np.argpartition(-term, 8 * (k + 1))[: 8 * (k + 1)] if n > 8 * (k + 1) else np.arange(n)
        threshold = self.kth(q @ columns[:, some], k)
        # Terms from ``split`` on can't reach the threshold together.
        split = int(np.argmax(rest < threshold)) if (rest < threshold).any() else len(by)
        essential = by[:split]
        score = q[essential] @ columns[essential]
        alive = np.flatnonzero(score + rest[split] >= threshold)
        score = score[alive]
        while split < len(by):
            more = by[split : split + PROBED]
            score = score + q[more] @ columns[np.ix_(more, alive)]
            split += PROBED
            left = by[split:]
            least = np.minimum(q[left] * self.low[left], q[left] * self.high[left]).sum()
            threshold = max(threshold, self.kth(score, k) + least)
            keep = score + rest[min(split, len(by))] >= threshold
            alive, score = alive[keep], score[keep]
        # Of each vector the k + 1 smallest ids are enough: one may be the query's own.
        count = np.minimum(np.diff(self.begin)[alive], k + 1)
        at = np.repeat(self.begin[alive] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        rows, score = self.rows[at], np.repeat(score, count)
        other = self.rid[rows] != own
        rows, score = rows[other], score[other]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]

    @staticmethod
    def kth(scores: np.ndarray, k: int):
        """The k-th best without the best one, which may be the query's own row; nothing may be below it for few scores."""
        return np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if len(scores) > k else -np.inf


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, the id of the candidate under ``key``, score: of each row for which ``is_query`` (over the id, named
    ``id``) holds, the k best other rows."""
    scratch = Scratch(vectors.sparkSession)
    # Written once, so that a row's number is the same wherever it is read.
    rows = scratch.write(integers(vectors, key, vector, scale).withColumn("rid", F.monotonically_increasing_id()), "rows")
    n, n_queries, dims = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    shards, groups, dims = -(-n // shard_rows) or 1, -(-n_queries // query_rows) or 1, dims or 1
    mixed = F.xxhash64("rid")
    candidates = rows.select("*", F.pmod(mixed, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    queries = rows.filter(is_query).select("*", F.pmod(mixed, F.lit(groups)).cast("int").alias("group"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(left) and len(right):
            ids = left.column("id").to_numpy()
            shard = Shard(left.column("rid").to_numpy(), ids, matrix(left.column("v"), dims))
            q = matrix(right.column("v"), dims)
            largest = int(max(np.abs(shard.columns).max(initial=0), np.abs(q).max(initial=0)))
            if largest * largest * dims < 1 << 52:  # sums in floating point are exact
                q = q.astype(np.float64)
                shard.columns, shard.low, shard.high = (x.astype(np.float64) for x in (shard.columns, shard.low, shard.high))
            for v, rid, qid in zip(q, right.column("rid").to_numpy(), right.column("id").to_numpy(), strict=True):
                found, score = shard.top(v, rid, k)
                for column, part in zip(out, (np.full(len(found), rid), np.full(len(found), qid), found, score.astype(np.int64)), strict=True):
                    column.append(part)
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["rid", "query_id", "id", "score"])

    by = ("shard", "group")
    found = candidates.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(run, "rid bigint, query_id bigint, id bigint, score bigint")
    place = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
