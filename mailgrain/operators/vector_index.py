"""A table of vectors by cells: centroids trained in rounds, quantised codes, a few cells probed, exact ranking at the end.

Every vector goes to the cell of the centroid that it has the greatest cosine with, and is written there with one byte for
each component of its unit vector, the length of what that leaves out, and itself. A search reads the codes of the probed
cells alone; a code's cosine is off by no more than the length left out, so what may be among the best ``k`` is known and
only those vectors are read and compared. ``probes`` cells answer approximately. With ``exact`` the search goes on: a cell's
least cosine with its centroid bounds what any of its vectors can reach, and all cells that can still hold a better one are
read as well.

The centroids are the one thing that driver and tasks hold whole: ``cells`` times the vector's length, whatever the input.
They are trained on the rows with the smallest hashes of their ids, about ``sample`` of them; all rows are indexed.

Vectors that are null, zero, of another length than ``dims``, or with null or non-finite components have no direction and
are left out. An id that occurs more than once is found as often. An empty table makes an index without cells.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import checkpointed
from .vector import cosine

#: About so many rows at most train the centroids.
SAMPLE = 100_000
MAX_CELLS = 4096
#: Rows and queries of one block of a search.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Vectors compared at once with all centroids, or queries with the rows of a block: what a task holds is this times those.
AT_ONCE = 128
#: Of candidates, how many may be broadcast to find their vectors; beyond it they are joined by shuffling.
MAX_BROADCAST = 500_000
ROWS = "key {}, vector {}, cell int, near double, code binary, scale double, left double"


def sound(v: DataFrame, vector: str, dims: int) -> DataFrame:
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return v.filter((F.size(x) == dims) & finite & F.exists(x, lambda c: c != 0))


def units(column: pa.Array, dims: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=1e-300)  # squares of very large or small numbers
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def train(vectors: DataFrame, n: int, cells: int, rounds: int, dims: int, key: str, vector: str, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of spherical k-means: rows of a round are summed in each task, and the sums, a row for each centroid,
    meet on the driver."""
    by_hash = F.xxhash64(F.lit(7), key).alias("h")
    bound = -(2.0**63) + min(1.0, sample / n) * 2.0**64
    chosen = checkpointed(vectors.select(vector, by_hash).filter(F.col("h").cast("double") <= bound))
    centers = units(pa.array([r[0] for r in chosen.orderBy("h", vector).limit(cells).collect()], pa.list_(pa.float64())), dims)

    def sums(centers: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
            for b in sliced(batches):
                v = units(b.column(0), dims)
                own = np.argmax(v @ centers.T, axis=1)
                np.add.at(total, own, v)
                count += np.bincount(own, minlength=len(centers))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], ["cell", "total"])

        return run

    for _ in range(rounds):
        parts = chosen.select(vector).mapInArrow(sums(centers), "cell int, total array<double>")
        parts = parts.select("cell", F.posexplode("total").alias("place", "x")).groupBy("cell", "place").agg(F.sum("x").alias("x"))
        new = centers.copy()
        found = parts.toPandas()
        new[found["cell"], found["place"]] = found["x"]
        size = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(size > 0, new / np.maximum(size, 1e-300), centers)
        if np.allclose(new, centers):
            break
        centers = new
    return centers


def build_index(
    vectors: DataFrame,
    path: str,
    cells: int | None = None,
    rounds: int = 8,
    dims: int | None = None,
    key: str = "message_id",
    vector: str = "embedding",
    model: str = "",
    sample: int = SAMPLE,
) -> None:
    """Write the index: ``rows`` (partitioned by cell), ``cells`` and ``meta``, the last of which seals it."""
    spark = vectors.sparkSession
    dims = dims or (vectors.agg(F.mode(F.size(vector))).first()[0] or 1)
    v = sound(vectors.select(key, vector), vector, dims)
    n = v.count()
    centers = train(v, n, min(cells or round(n**0.5), MAX_CELLS, n), rounds, dims, key, vector, sample) if n else np.zeros((0, dims))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            u = units(b.column(vector), dims)
            near = u @ centers.T
            cell = np.argmax(near, axis=1)
            scale = np.abs(u).max(axis=1) / 127
            code = np.rint(u / scale[:, None]).astype(np.int8)
            left = np.linalg.norm(u - code * scale[:, None], axis=1)
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dims), len(u), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            columns = [pa.array(cell, pa.int32()), pa.array(near[np.arange(len(u)), cell]), codes, pa.array(scale), pa.array(left)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(vector), *columns], names)

    kind = v.schema[key].dataType.simpleString(), v.schema[vector].dataType.simpleString()
    names = ["key", "vector", "cell", "near", "code", "scale", "left"]
    schema = ROWS.format(*kind)
    # A cell with very many rows is dealt out by key over several files.
    rows = v.mapInArrow(assign, schema).repartitionByRange("cell", "key").sortWithinPartitions("cell", "key")
    rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows", compression="zstd")
    found = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    known.join(found, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    meta = spark.createDataFrame([(model, dims, n, *kind)], "model string, dims int, n bigint, key string, vector string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


class Index:
    """A written index; its centroids are read once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.model, self.dims, self.n, *kind = spark.read.parquet(f"{path}/meta").first()
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
        self.cells = cells["cell"].to_numpy()
        self.centers = np.array(cells["center"].tolist()).reshape(-1, self.dims)
        self.least, self.sizes = cells["least"].to_numpy(), cells["n"].to_numpy()
        self.rows = spark.read.schema(ROWS.format(*kind)).parquet(f"{path}/rows")

    def routed(self, queries: DataFrame, probes: int, floor: str | None = None) -> DataFrame:
        """query, q and a row for each cell to read: the ``probes`` nearest ones, or with ``floor``, a column of cosines, the
        others that may reach it."""
        cells, centers, least, dims = self.cells, self.centers, self.least, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                near = np.clip(units(b.column("q"), dims) @ centers.T, -1, 1)
                rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                if floor is None:
                    take = rank < probes
                else:
                    # The greatest cosine that two directions can have, given those with the centroid.
                    most = np.cos(np.maximum(0, np.arccos(near) - np.arccos(np.clip(least, -1, 1))))
                    take = (rank >= probes) & (most >= b.column(floor).to_numpy(zero_copy_only=False)[:, None] - 1e-6)
                at, cell = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(at)), b.column("q").take(pa.array(at)), pa.array(cells[cell], pa.int32())], ["query", "q", "cell"])

        fields = [queries.schema["query"], queries.schema["q"], T.StructField("cell", T.IntegerType())]
        return queries.mapInArrow(run, T.StructType(fields))

    def candidates(self, routed: DataFrame, k: int) -> DataFrame:
        """query, key, cell, low and high: rows whose code says that they may be among the query's k best, with the bounds of
        their cosine. Cells meet their queries in blocks of bounded size."""
        routed = checkpointed(routed)
        wanted = [r[0] for r in routed.select("cell").distinct().collect()]  # of at most MAX_CELLS
        asked = dict(routed.groupBy("cell").count().collect())
        of = dict(zip(self.cells.tolist(), self.sizes.tolist(), strict=True))
        parts = F.create_map(*[F.lit(x) for c in wanted for x in (c, -(-of[c] // BLOCK_ROWS))]) if wanted else F.create_map(F.lit(-1), F.lit(1))
        groups = F.create_map(*[F.lit(x) for c in wanted for x in (c, -(-asked[c] // BLOCK_QUERIES))]) if wanted else parts
        rows = self.rows.filter(F.col("cell").isin(wanted)).select("key", "cell", "code", "scale", "left")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "code"), F.element_at(parts, F.col("cell"))).cast("int"))
        rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.element_at(groups, F.col("cell")) - 1)).alias("group"))
        q = routed.withColumn("group", F.pmod(F.xxhash64("query"), F.element_at(groups, F.col("cell"))).cast("int"))
        q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("cell")) - 1)))
        dims, key = self.dims, self.rows.schema["key"].dataType
        schema = T.StructType([routed.schema["query"], T.StructField("key", key), *T._parse_datatype_string("cell int, low double, high double").fields])

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (len(left) and len(right)):
                return pa.Table.from_pylist([], pa.schema([("query", right["query"].type), ("key", left["key"].type), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))
            code = np.frombuffer(b"".join(left["code"].to_pylist()), np.int8).reshape(-1, dims)
            q, rows = units(right["q"].combine_chunks(), dims), (code * left["scale"].to_numpy()[:, None]).T
            off = left["left"].to_numpy() + 1e-9
            parts = []
            for first in range(0, len(q), AT_ONCE):
                about = q[first : first + AT_ONCE] @ rows
                low, high = about - off, about + off
                kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
                at, row = np.nonzero(high >= kth[:, None])
                parts.append((at + first, row, low[at, row], high[at, row]))
            at, row, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
            columns = [right["query"].take(pa.array(at)), left["key"].take(pa.array(row)), left["cell"].take(pa.array(row)), pa.array(low), pa.array(high)]
            return pa.table(columns, names=["query", "key", "cell", "low", "high"])

        by = ("cell", "part", "group")
        return rows.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(block, schema)

    def ranked(self, candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query, key, similarity, rank of the k best of the candidates, by their own vectors."""
        best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("low")))
        kth = candidates.withColumn("place", best).filter(F.col("place") == k).select("query", F.col("low").alias("floor"))
        left = candidates.join(kth, "query", "left").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("query", "key", "cell")
        left = checkpointed(left)
        wanted = [r[0] for r in left.select("cell").distinct().collect()]
        keys = left.select("cell", "key").distinct()
        few = keys.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        found = self.rows.filter(F.col("cell").isin(wanted)).select("cell", "key", "vector").join(F.broadcast(keys) if few else keys, ["cell", "key"], "left_semi")
        pairs = left.distinct().join(found, ["cell", "key"]).join(queries, "query")
        scored = pairs.select("query", "key", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("similarity"))
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "key"))
        return scored.withColumn("rank", place).filter(F.col("rank") <= k)

    def search_many(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """query, key, similarity, rank: of each row of ``queries`` (query, q: a vector) the k nearest."""
        queries = checkpointed(sound(queries.select("query", "q"), "q", self.dims))
        found = self.candidates(self.routed(queries, probes), k)
        if not exact:
            return self.ranked(found, queries, k)
        found = checkpointed(found)
        best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("low")))
        floor = found.withColumn("place", best).filter(F.col("place") == k).select("query", F.col("low").alias("floor"))
        floor = queries.join(floor, "query", "left").select("query", "q", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
        more = self.candidates(self.routed(floor, probes, "floor"), k)
        return self.ranked(checkpointed(found.unionByName(more)), queries, k)

    def search(self, query: list[float], k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """key, similarity, best first; the plan reads the probed cells' files only."""
        if len(query) != self.dims:
            raise ValueError(f"the index holds vectors of {self.dims} components, the query has {len(query)}")
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query int, q array<double>")
        return self.search_many(one, k, probes, exact).orderBy("rank").select("key", "similarity")

    def similar_to(self, seed, k: int = 10, probes: int = 8, include_seed: bool = True) -> DataFrame:
        """The nearest to a row's own vector, which is among them unless it is left out."""
        own = self.rows.filter(F.col("key") == seed).select("vector").first()
        if own is None:
            raise KeyError(seed)
        found = self.search(list(own[0]), k + (not include_seed), probes)
        return found if include_seed else found.filter(F.col("key") != seed).limit(k)

    def search_text(self, text: str, vectoriser: Callable, k: int = 10, probes: int = 8) -> DataFrame:
        """Free text, by the vectoriser that the index was built with."""
        return self.search([float(x) for x in vectoriser()([text])[0]], k, probes)


_models: dict[str, Callable] = {}


def embed(docs: DataFrame, text: str, vectoriser: Callable, out: str = "embedding", batch: int = 256, name: str = "") -> DataFrame:
    """All columns and a vector of each text. ``vectoriser()`` is called once in a worker and gives a function of a list of
    texts; ``name`` tells models apart. A null text has a null vector."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != out], T.StructField(out, T.ArrayType(T.FloatType()))])
    label = json.dumps([name, getattr(vectoriser, "__module__", ""), getattr(vectoriser, "__qualname__", repr(vectoriser))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if label not in _models:
            _models.clear()
            _models[label] = vectoriser()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                texts = b.column(text).to_pylist()
                vectors = iter(_models[label]([t for t in texts if t is not None]))
                lists = [None if t is None else np.asarray(next(vectors), np.float32) for t in texts]
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in schema.fields[:-1]], pa.array(lists, pa.list_(pa.float32()))], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def hashed_words(dims: int = 64) -> Callable:
    """A vectoriser without a model file: words add or subtract one at a place by their hash."""

    def load() -> Callable:
        import re
        import zlib

        def vectors(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for row, t in zip(out, texts, strict=True):
                h = np.array([zlib.crc32(w.encode()) for w in re.findall(r"\w+", t.lower())], np.int64)
                np.add.at(row, h % dims, np.where(h >> 31, 1.0, -1.0))
            return out

        return vectors

    return load
