"""Connected components, and the graph of replies and references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import items
from ..lineage import written

#: Edges that one task joins: what the rounds leave, whatever the input.
FEW = 500_000


def links(m: DataFrame, *carry: str) -> DataFrame:
    """a, b and carried columns: a message and each id that it names in In-Reply-To or References, there or not."""
    ids = F.array_distinct(F.concat(F.array("in_reply_to"), items("references")))
    named = F.filter(ids, lambda x: F.coalesce(x != "", F.lit(False)))
    return m.select(F.col("message_id").alias("a"), F.explode(named).alias("b"), *carry).filter("a != b").distinct()


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one that it hangs together with: the larger end of an edge goes to the smaller one, and
    pointers jump to their ends, until no edge is left between two of these."""
    up = np.arange(n)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return up


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, up: of all edges of a partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    ends = pa.concat_arrays([x for c in ("a", "b") for x in edges[c].chunks])
    code = ends.field("id").dictionary_encode().indices.to_numpy()
    _, first = np.unique(code, return_index=True)
    up = joined(code[: edges.num_rows], code[edges.num_rows :], len(first))
    yield pa.RecordBatch.from_arrays([ends.take(pa.array(first)), ends.take(pa.array(first[up]))], names=["node", "up"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, label: the least id that each end of an edge (a, b) hangs together with. Nodes are ordered by their
    hashes, so that none of a chain's runs is long. In a round every node points to the least of itself and its neighbours,
    pointers jump once, and edges go on between what their ends point to; those within one node go. A round leaves about half of a chain's nodes or fewer, so all rounds together cost a few times the first; once ``few`` edges
    or fewer are left, one task joins them. Only minima are shuffled, and they are combined
    before: a node with very many neighbours meets in no task. Nothing is broadcast: labels are as many as nodes.
    Tables are written, as a checkpoint hands its plan's constraints on, and these double with each round."""
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")).alias(c)
    e = written(edges.select(key("a"), key("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    for _ in range(max_rounds):
        left = e.count()
        if left <= few or not left:
            break
        both = e.select("a", "b").union(e.select("b", "a"))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")), "up")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("next")).hint("merge")
        maps.append(written(up.join(over, "up").select("node", F.col("next").alias("up")), "map"))
        for end in ("a", "b"):
            e = e.join(maps[-1].toDF(end, "up").hint("merge"), end).drop(end).withColumnRenamed("up", end)
        e = written(e.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    kind = e.schema["a"].dataType.simpleString()
    labels = written(e.coalesce(1).mapInArrow(_at_once, f"node {kind}, up {kind}"), "labels").toDF("node", "label")
    for m in reversed(maps):
        found = m.join(labels.toDF("up", "label").hint("merge"), "up", "left")
        labels = written(found.select("node", F.coalesce("label", "up").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("node.id").alias("least"))
    return labels.join(least.hint("merge"), "label").select(F.col("node.id").alias("node"), F.col("least").alias("label"))
