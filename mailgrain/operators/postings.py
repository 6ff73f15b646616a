"""An inverted table for BM25: postings by term in blocks of documents, each with a bound on what it can add to a score.

Documents are numbered and dealt out to ranges; a block holds a term's postings of one range: numbers, term frequencies and
lengths, and the greatest share of its inverse document frequency that a document of it reaches. A search reads the blocks'
bounds of its terms, adds them up by range, scores the ranges with the greatest sums first, and then only those whose sum
can still reach the k-th best score. Texts are in no plan. Blocks lie sorted by term, so a search reads few row groups; a
term of very many documents is spread over its ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..lineage import checkpointed, written
from .search import K1, B, query_terms

#: Documents and words of a range at most; a longer document stands alone.
RANGE, RANGE_WORDS = 4096, 4_000_000


def write_postings(docs: DataFrame, path: str, key: str = "message_id", fields: tuple[str, ...] = ("text",), per_range: int = RANGE) -> None:
    """``documents`` (number, key, lengths), ``stats`` (one row), ``terms`` (field, term, df) and ``blocks``. A task makes the
    blocks of its own documents, so what is shuffled is one row for each block, and no words."""
    if not fields:
        raise ValueError("no field")
    spark, n_fields = docs.sparkSession, len(fields)
    d = docs.select(F.col(key).alias("key"), *[words(F.col(f)).alias(f"w{i}") for i, f in enumerate(fields)])
    kind = d.schema["key"].dataType.simpleString()
    made = written(d.mapInArrow(in_ranges(n_fields, per_range), MADE.format(kind)), "postings")
    sizes = [F.element_at("sizes", i + 1).alias(f"len_{i}") for i in range(n_fields)]
    own = made.filter("sizes IS NOT NULL").select("doc", "key", *sizes)
    own.repartitionByRange("doc").sortWithinPartitions("doc").write.mode("overwrite").parquet(f"{path}/documents")
    stats = own.agg(F.count("*").alias("n"), *[F.avg(f"len_{i}").alias(f"avg_{i}") for i in range(n_fields)])
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    found = spark.read.parquet(f"{path}/stats").first()
    average = F.get(F.array(*[F.lit(float(found[f"avg_{i}"] or 1.0)) for i in range(n_fields)]), F.col("field"))
    block = made.filter("sizes IS NULL").select("field", "term", F.col("doc").alias("range"), "at", "tf", "len")
    block = block.repartitionByRange("term", "range").sortWithinPartitions("term", "field", "range")
    share = F.zip_with("tf", "len", lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average)))
    block = block.withColumn("most", F.array_max(share)).withColumn("n", F.size("at").cast("long"))
    block.write.mode("overwrite").parquet(f"{path}/blocks", compression="zstd")
    terms = spark.read.parquet(f"{path}/blocks").groupBy("field", "term").agg(F.sum("n").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms", compression="zstd")


#: A document with its sizes, or a block: ``doc`` is the range's first number, ``at`` counts from there.
MADE = "doc bigint, key {}, sizes array<int>, field int, term string, at array<int>, tf array<int>, len array<int>"


def in_ranges(n_fields: int, per_range: int):
    """Documents with the words of their fields to numbered documents and to blocks of ranges. A range ends with a task, after
    ``per_range`` documents, or once it holds RANGE_WORDS words."""
    names = ["doc", "key", "sizes", "field", "term", "at", "tf", "len"]

    def blocks(held: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
        n = held.num_rows
        columns = [held[f"w{i}"].combine_chunks() for i in range(n_fields)]
        lengths = np.stack([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.int32)
        sizes = pa.ListArray.from_arrays(pa.array(np.arange(0, lengths.size + 1, n_fields), pa.int32()), pa.array(lengths.ravel()))
        ints, none = pa.list_(pa.int32()), pa.nulls(n, pa.list_(pa.int32()))
        key = held["key"].combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(n)), key, sizes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), none, none, none], names)
        for i, column in enumerate(columns):
            coded = column.flatten().dictionary_encode()
            place = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths[:, i])
            place, tf = np.unique(place, return_counts=True)
            term, at = place // n, place % n
            starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            m, ends = len(starts), np.append(starts, len(term))
            for lo in range(0, m, 10_000):
                hi = min(lo + 10_000, m)
                s, off = slice(ends[lo], ends[hi]), pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x[s].astype(np.int32))) for x in (at, tf, lengths[at, i])]
                own = [pa.array(np.full(hi - lo, i, np.int32)), coded.dictionary.take(pa.array(term[starts[lo:hi]])).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, first)), pa.nulls(hi - lo, key.type), pa.nulls(hi - lo, ints), *own, *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n, size = TaskContext.get().partitionId() << 33, [], 0, 0
        for b in batches:
            total = sum(np.cumsum(pc.list_value_length(b.column(f"w{i}")).to_numpy(zero_copy_only=False)) for i in range(n_fields))
            at = 0
            while at < b.num_rows:
                fits = int(np.searchsorted(total, (total[at - 1] if at else 0) + RANGE_WORDS - size, "right"))
                end = min(max(fits, at + (not held)), at + per_range - n, b.num_rows)
                if end > at:
                    held.append(b.slice(at, end - at))
                    size += int(total[end - 1] - (total[at - 1] if at else 0))
                    n, at = n + end - at, end
                if at < b.num_rows or n == per_range:
                    yield from blocks(pa.Table.from_batches(held), first)
                    first, held, n, size = first + n, [], 0, 0
        if held:
            yield from blocks(pa.Table.from_batches(held), first)

    return run


class Postings:
    def __init__(self, spark: SparkSession, path: str):
        self.documents, self.blocks, self.terms = (spark.read.parquet(f"{path}/{t}") for t in ("documents", "blocks", "terms"))
        self.stats = spark.read.parquet(f"{path}/stats").first()

    def top(self, query: str, limit: int, operator: str = "or") -> DataFrame:
        """key, score (9 decimals), matched, best first: equal to :func:`mailgrain.operators.search.bm25` on the texts."""
        terms = query_terms(query)
        if not terms:
            raise ValueError("no search term")
        df = {(r["field"], r["term"]): r["df"] for r in self.terms.filter(F.col("term").isin(terms)).collect()}  # terms times fields
        if not df:
            return self.documents.limit(0).select("key", F.lit(0.0).alias("score"), F.lit(0).alias("matched"))
        n = self.stats["n"]
        idf = F.create_map(*[x for (i, t), k in df.items() for x in (F.lit(f"{i} {t}"), F.log(F.lit(1 + (n - k + 0.5) / (k + 0.5))))])
        own = F.element_at(idf, F.concat_ws(" ", "field", "term"))
        mine = self.blocks.filter(F.col("term").isin(terms))
        bounds = mine.groupBy("range").agg(F.sum(own * F.col("most")).alias("bound"), F.max("n").alias("n"), F.countDistinct("term").alias("terms"))
        if operator == "and":
            bounds = bounds.filter(F.col("terms") == len(terms))
        bounds = checkpointed(bounds)
        # The first ranges that hold ``limit`` documents, by falling bound; each holds one at least.
        first = bounds.orderBy(F.desc("bound"), "range").limit(min(limit, 64)).select("range")
        scored = checkpointed(self.scored(mine.join(F.broadcast(first), "range", "left_semi"), own, terms, operator))
        best = scored.orderBy(F.desc("score")).limit(limit).agg(F.count("*"), F.min("score")).first()
        rest = bounds.join(F.broadcast(first), "range", "left_anti")
        if best[0] == limit:
            rest = rest.filter(F.col("bound") >= best[1] - 1e-6)  # scores are rounded
        more = self.scored(mine.join(rest.select("range"), "range", "left_semi"), own, terms, operator)
        # Ties go by key, so all of the k-th best score count.
        found = scored.unionByName(more)
        if best[0] == limit:
            found = found.filter(F.col("score") >= best[1])
        return found.join(self.documents.select("doc", "key"), "doc").select("key", "score", "matched").orderBy(F.desc("score"), "key").limit(limit)

    def scored(self, blocks: DataFrame, idf, terms: list[str], operator: str) -> DataFrame:
        each = blocks.select("field", "term", "range", idf.alias("idf"), F.inline(F.arrays_zip("at", "tf", "len"))).withColumn("doc", F.col("range") + F.col("at"))
        average = F.array(*[F.lit(float(self.stats[c] or 1.0)) for c in self.stats.asDict() if c.startswith("avg_")])
        norm = K1 * (1 - B + B * F.col("len") / F.get(average, F.col("field")))
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        found = each.groupBy("doc").agg(F.round(F.sum(part), 9).alias("score"), F.countDistinct("term").cast("int").alias("matched"))
        return found.filter(F.col("matched") >= (len(terms) if operator == "and" else 1))
