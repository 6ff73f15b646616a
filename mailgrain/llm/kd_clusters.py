"""Exact integer k-means by kd-tree filtering.

Vectors become integers, floor(scale * x). Each Arrow batch is built into kd-trees of bounded size, split at the median of
the widest dimension; a node holds its box and its count and sums of points. The trees are written once and every round
reads them. A round starts at each root with all centroids as candidates: of a node's candidates the one nearest to the
middle of the box stands, and each other one goes if the whole box is strictly nearer to that one. The extreme corner
decides this: a difference of two squared distances is linear in the point. A node with one candidate left is assigned
whole, by its count and sums; what reaches a leaf is compared with the candidates left. All of it is integer arithmetic, in
floating point only where every sum is below 2^53, so results are exact and don't depend on how the rows lie.

A task sends one row of sums for each centroid; the driver holds the centroids alone, whatever the input.

Defined results: vectors that are null, of another length, or with null or non-finite components are not kept. Integers
beyond 2^24 count as 2^24, so distances and sums stay longs. Equal distances go to the smaller number. Of vectors with one
hash (a repeated id) the lesser vector is the earlier start. Rows of a null id start no centroid, but are clustered. Fewer
vectors than centroids: so many centroids. Repeated rows count each time. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Points of one tree at most: it bounds a row of the table of trees, and what a task works on at once.
TREE_ROWS = 4096
LEAF_ROWS = 32
LIMIT = 1 << 24
TREE = (
    "ids array<bigint>, points array<int>, first array<int>, last array<int>, left array<int>, right array<int>, "
    "low array<int>, high array<int>, sums array<bigint>"
)


def integers(vectors: DataFrame, key: str, vector: str, scale: int, dims: int) -> DataFrame:
    """id and integer vector of the rows that are kept."""
    x = F.col(vector)
    # A quiet comparison: NaN is greater than every number in Spark.
    sound = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return vectors.filter((F.size(x) == dims) & sound).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def built(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points in the tree, and its nodes; children stand after their parent."""
    order = np.arange(len(points))
    nodes: list[list[int]] = [[0, len(points), -1, -1]]
    boxes = []
    for node in nodes:  # grows while it is walked
        first, last = node[:2]
        own = points[order[first:last]]
        low, high = own.min(axis=0), own.max(axis=0)
        boxes.append((low, high, own.sum(axis=0)))
        wide = int(np.argmax(high - low))
        if last - first <= LEAF_ROWS or high[wide] == low[wide]:
            continue
        middle = (last - first) // 2
        order[first:last] = order[first:last][np.argpartition(own[:, wide], middle)]
        node[2:] = len(nodes), len(nodes) + 1
        nodes += [[first, first + middle, -1, -1], [first + middle, last, -1, -1]]
    table = np.array(nodes)
    low, high, sums = (np.array(x) for x in zip(*boxes, strict=True))
    return order, dict(first=table[:, 0], last=table[:, 1], left=table[:, 2], right=table[:, 3], low=low, high=high, sums=sums)


def trees(kept: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TREE_ROWS):
                b = whole.slice(at, TREE_ROWS)
                points = b.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dims)
                order, nodes = built(points)
                one = {"ids": b.column("id").take(pa.array(order)), "points": points[order].ravel(), **nodes}
                kinds = {"ids": pa.int64(), "sums": pa.int64()}
                yield pa.RecordBatch.from_pydict(
                    {k: pa.array([v if k == "ids" else v.ravel()], pa.list_(kinds.get(k, pa.int32()))) for k, v in one.items()}
                )

    return kept.mapInArrow(run, TREE)


def trees_of(batch: pa.RecordBatch, dims: int) -> Iterator[dict[str, np.ndarray]]:
    for i in range(batch.num_rows):
        t = {k: batch.column(k)[i].values for k in batch.schema.names}
        ids = t.pop("ids")
        t = {k: v.to_numpy().astype(np.int64) for k, v in t.items()}
        t |= {k: t[k].reshape(-1, dims) for k in ("points", "low", "high", "sums")}
        yield t | {"ids": ids}


def assign(tree: dict, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Centroid number of each point; count and sums of each centroid; how many points no whole node decided."""
    k = len(centers)
    largest = int(max(np.abs(centers).max(), np.abs(tree["low"]).max(), np.abs(tree["high"]).max()))
    kind = np.float64 if 4 * largest * largest * centers.shape[1] < 1 << 51 else np.int64
    z, low, high = centers.astype(kind), tree["low"].astype(kind), tree["high"].astype(kind)
    norm = (z * z).sum(axis=1)
    far = np.array(1 << 62, np.int64).astype(kind)
    owner = np.full(len(tree["points"]), -1)
    count, sums = np.zeros(k, np.int64), np.zeros(centers.shape, np.int64)
    node, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    open_rows, open_alive = [], []
    while len(node):
        lo, hi = low[node], high[node]
        # Twice the distance to the middle, without what all candidates share.
        standing = np.argmin(np.where(alive, norm - (lo + hi) @ z.T, far), axis=1)
        for s in np.unique(standing):
            at = standing == s
            u = z - z[s]
            most = hi[at] @ np.maximum(u, 0).T + lo[at] @ np.minimum(u, 0).T  # of u * point in the box
            alive[at] &= ~(norm - norm[s] - 2 * most > 0)
        whole = alive.sum(axis=1) == 1
        to = standing[whole]
        first, last = tree["first"][node], tree["last"][node]
        np.add.at(count, to, (last - first)[whole])
        np.add.at(sums, to, tree["sums"][node[whole]])
        for a, b, c in zip(first[whole], last[whole], to, strict=True):
            owner[a:b] = c
        leaf = ~whole & (tree["left"][node] < 0)
        for a, b, c in zip(first[leaf], last[leaf], alive[leaf], strict=True):
            open_rows.append(np.arange(a, b))
            open_alive.append(np.broadcast_to(c, (b - a, k)))
        inner = ~whole & ~leaf
        node, alive = np.concatenate([tree["left"][node[inner]], tree["right"][node[inner]]]), np.concatenate([alive[inner]] * 2)
    rows = np.concatenate(open_rows) if open_rows else np.zeros(0, np.int64)
    if len(rows):
        points = tree["points"][rows]
        near = np.where(np.concatenate(open_alive), norm - 2 * (points.astype(kind) @ z.T), far)
        owner[rows] = np.argmin(near, axis=1)  # the first of equal ones
        count += np.bincount(owner[rows], minlength=k)
        np.add.at(sums, owner[rows], points)
    return owner, count, sums, len(rows)


def moved(table: DataFrame, centers: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round."""
    z = np.array(centers, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(z), np.int64), np.zeros(z.shape, np.int64)
        for b in batches:
            for tree in trees_of(b, dims):
                _, n, s, _ = assign(tree, z)
                count += n
                sums += s
        parts = [pa.array(range(len(z)), pa.int32()), pa.array(count), pa.array(list(sums), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(parts, ["cluster", "n", "sums"])

    part = table.mapInArrow(run, "cluster int, n bigint, sums array<bigint>").filter("n > 0")
    part = part.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
    total = part.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [list(c) for c in centers]
    for r in total.collect():  # one number for each component of a centroid
        out[r["cluster"]][r["place"]] = int(r["s"]) // r["n"]
    return out


def first_centers(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    hashed = kept.filter("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return [list(r["v"]) for r in hashed.orderBy("h", "v").limit(k).collect()]


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance: squared, of each kept vector) as written, and the final centroids."""
    scratch = Scratch(vectors.sparkSession)
    kept = integers(vectors, key, vector, scale, dims)
    centers = first_centers(kept, k, seed)
    schema = f"`{key}` bigint, cluster int, distance bigint"
    if not centers:  # no vectors but those without an id
        return vectors.sparkSession.createDataFrame([], schema), []
    table = scratch.write(trees(kept, dims), "trees")
    for _ in range(rounds):
        centers = moved(table, centers, dims)
    z = np.array(centers, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree in trees_of(b, dims):
                owner = assign(tree, z)[0]
                gap = tree["points"] - z[owner]
                yield pa.RecordBatch.from_arrays([tree["ids"], pa.array(owner, pa.int32()), pa.array((gap * gap).sum(axis=1))], [key, "cluster", "distance"])

    return scratch.write(table.mapInArrow(run, schema), "assigned"), centers


def with_inertia(assigned: DataFrame, centers: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256: a row for each centroid, so they are literals."""
    if not centers:
        return assigned.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    of = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    each = [of.get(c, 0) for c in range(len(centers))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]

    def look(values: list, kind: str):
        return F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), F.col("cluster"))

    return assigned.select(
        "*",
        look(each, "bigint").alias("cluster_inertia"),
        F.lit(sum(each)).cast("long").alias("inertia"),
        look(names, "string").alias("centroid_sha256"),
    )
