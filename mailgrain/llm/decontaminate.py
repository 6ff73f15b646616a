"""Benchmark decontamination: size-partitioned MinHash containment search, verified on full shingle sets.

Test items are short and documents long, so the resemblance of whole sets says little; what is asked is containment, the
share of an item's distinct word shingles that a document holds. Items are partitioned by size, each partition with its own
sampling range: an item's sketch is its shingle hashes below the range's bound, the same minima-by-hash rule for documents.
A partition's bound is set so that its smallest item keeps ``sketch`` hashes on average; small items keep all of theirs,
and an item whose sketch would be too thin is kept whole. An item with containment c of a document has at least c of its
sketch there up to sampling error; a document that holds ``1 of 4`` sketch hashes or more is a candidate, so with 24 hashes and
c = 0.8 a true pair is missed with a chance below 10^-9. Candidates are then verified exactly: the document's full shingle
set against the item's.

Item sketches and full item sets are broadcast up to ``max_broadcast_shingles``. Beyond that, sketches are matched by a
shuffle: of a document's hashes only those go into it whose bit is set in a bitmap of all sketch hashes (16 MB, whatever the
number of items), dealt over ``SALTS`` salts so that a hash which very many documents hold is split; only the candidates'
full sets are then matched, by document and hash.

Defined results: null or blank texts and items match nothing; an item of fewer words than a shingle is one shingle of all
its words; repeated items are reported under each of their ids; repeated documents are each reported; an empty benchmark
gives an empty result. Ids may be null; only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, unused
from .shingles import distinct_in_texts, pieces, shingle_hashes, word_hashes

TOP = float(2**64)
BITMAP_BITS, SALTS = 27, 16
SCHEMA = "item bigint, n bigint, h bigint, low boolean"


def item_shingles(items: DataFrame, item: str, text: str) -> DataFrame:
    """item (row number), item_id, n (distinct shingles), h (one of them): a row for each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                h, off = distinct_in_texts(*shingle_hashes(*word_hashes(b.column("text"))))
                n = np.diff(off)
                rows = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("item").take(pa.array(rows)), b.column("item_id").take(pa.array(rows)), pa.array(n[rows]), pa.array(h.view(np.int64))],
                    ["item", "item_id", "n", "h"],
                )

    kind = items.schema[item].dataType.simpleString()
    source = items.select(F.monotonically_increasing_id().alias("item"), F.col(item).alias("item_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"item bigint, item_id {kind}, n bigint, h bigint")


def sampling(n: np.ndarray, sketch: int) -> np.ndarray:
    """The part of the hash range kept for items of ``n`` shingles: partitions by powers of two, so an item of a partition
    keeps between ``sketch`` and twice as many on average; 1 up to 2 * sketch shingles."""
    level = np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / sketch)) - 1)
    return 0.5**level


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    containment: float = 0.8,
    sketch: int = 24,
    max_broadcast_shingles: int = 500_000,
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: a row for each document and item whose containment is reached."""
    scratch = Scratch(docs.sparkSession)
    full = scratch.write(item_shingles(benchmark, item_id, item_text), "items")
    rows = _bounded(full, max_broadcast_shingles)
    if rows is None:
        return _joined(docs, full, doc_id, text, containment, sketch, scratch).select("doc_id", "item_id", "n_shared", "n_item", "containment")
    names = F.broadcast(full.select("item", "item_id").distinct())  # fewer rows than the shingles counted above
    found = _searched(docs if len(rows) else docs.limit(0), rows, doc_id, text, containment, sketch).join(names, "item")
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _bounded(full: DataFrame, most: int) -> pa.Table | None:
    """The items' shingles if there are ``most`` at most: 24 bytes each."""
    return full.select("item", "n", "h").toArrow() if full.limit(most + 1).count() <= most else None


def _index(rows: pa.Table, sketch: int):
    """Arrays of the item side: items' sizes, sketch hashes with their items, all hashes with their items."""
    item, n, h = (rows[k].to_numpy() for k in ("item", "n", "h"))
    numbers, first, at = np.unique(item, return_index=True, return_inverse=True)
    h = h.view(np.uint64)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    size = n[first]
    low = h < sampling(size[at], sketch) * TOP
    kept = np.bincount(at[low], minlength=len(size))
    low |= (kept < sketch // 2)[at]
    return numbers, size, np.bincount(at[low], minlength=len(size)), h[low], at[low], h, at


def _hits(h: np.ndarray, off: np.ndarray, keys: np.ndarray, owner: np.ndarray, n_items: int):
    """(text, item) pairs as text * n_items + item, with the number of the item's keys that the text holds."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    lo = np.searchsorted(keys, h, "left")
    found = keys[np.minimum(lo, len(keys) - 1)] == h
    h, doc, lo = h[found], doc[found], lo[found]
    count = np.searchsorted(keys, h, "right") - lo
    at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    pair_key = np.unique(np.stack([np.repeat(doc, count) * n_items + owner[at], at]), axis=1)[0]
    return np.unique(pair_key, return_counts=True)


def _finder(index, containment: float):
    """A function of texts that gives (text number, item's place, shared shingles) of the confirmed pairs."""
    numbers, size, sketched, low, low_owner, keys, owner = index
    quick = np.zeros(1 << 24, bool)  # a first test by the low bits: most hashes are in no item
    quick[(low & np.uint64((1 << 24) - 1)).astype(np.int64)] = True

    def find(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, off = shingle_hashes(*word_hashes(texts))
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))

        def hits(rows: np.ndarray, keys: np.ndarray, owner: np.ndarray):
            part = np.concatenate([[0], np.cumsum(np.bincount(doc[rows], minlength=len(off) - 1))])
            return _hits(h[rows], part, keys, owner, len(size))

        pair, got = hits(np.flatnonzero(quick[(h & np.uint64((1 << 24) - 1)).astype(np.int64)]), low, low_owner)
        pair = pair[4 * got >= sketched[pair % len(size)]]
        both, shared = hits(np.flatnonzero(np.isin(doc, np.unique(pair // len(size)))), keys, owner)
        ok = np.isin(both, pair) & (shared >= containment * size[both % len(size)] - 1e-9)
        return both[ok] // len(size), both[ok] % len(size), shared[ok]

    return find


def _searched(docs: DataFrame, rows: pa.Table, doc_id: str, text: str, containment: float, sketch: int) -> DataFrame:
    """doc_id, item (its number), n_shared, n_item."""
    kind = docs.schema[doc_id].dataType.simpleString()
    index = docs.sparkSession.sparkContext.broadcast(_index(rows, sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, size = index.value[:2]
        find = _finder(index.value, containment)
        for whole in batches:
            for b in pieces(whole, "text"):
                doc, at, shared = find(b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(doc)), pa.array(numbers[at]), pa.array(shared), pa.array(size[at])],
                    ["doc_id", "item", "n_shared", "n_item"],
                )

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, item bigint, n_shared bigint, n_item bigint")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the low BITMAP_BITS of all hashes: 2^12 rows of 4 kB at most, whatever the number of hashes."""
    place = F.col("h").bitwiseAND(F.lit(2**BITMAP_BITS - 1)) + 1
    parts = hashes.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    rows = parts.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(2**BITMAP_BITS // 8, np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _hashes(docs: DataFrame, kind: str, bitmap: np.ndarray | None = None) -> DataFrame:
    """row, doc_id, h: distinct shingles of each text, or those of them that are in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                h, off = distinct_in_texts(*shingle_hashes(*word_hashes(b.column("text"))))
                rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
                if shared.value is not None:
                    place = (h & np.uint64(2**BITMAP_BITS - 1)).astype(np.int64)
                    known = (shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    h, rows = h[known], rows[known]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("doc_id").take(take), pa.array(h.view(np.int64))], ["row", "doc_id", "h"])

    return docs.mapInArrow(run, f"row bigint, doc_id {kind}, h bigint")


def _joined(docs, full, doc_id, text, containment, sketch, scratch) -> DataFrame:
    """For benchmarks too large to broadcast: counts of the sketch hashes choose the candidates, full sets verify them."""
    kind = docs.schema[doc_id].dataType.simpleString()
    level = F.greatest(F.lit(0.0), F.floor(F.log2(F.col("n") / sketch)) - 1)
    unsigned = F.when(F.col("h") < 0, F.col("h").cast("double") + TOP).otherwise(F.col("h").cast("double"))
    marked = full.withColumn("low", unsigned < F.pow(F.lit(0.5), level) * TOP)
    kept = marked.groupBy("item").agg(F.sum(F.col("low").cast("long")).alias("kept"))
    marked = marked.join(kept, "item").withColumn("low", F.col("low") | (F.col("kept") < sketch // 2))
    marked = marked.withColumn("kept", F.when(F.col("kept") < sketch // 2, F.col("n")).otherwise(F.col("kept")))
    low = scratch.write(marked.filter("low").select("h", "item", "kept"), "sketches")

    keyed = docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = _hashes(keyed, kind, _bitmap(low)).distinct().withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    pairs = seen.join(salted, ["h", "salt"]).groupBy("row", "item", "kept").agg(F.count("*").alias("got")).filter(4 * F.col("got") >= F.col("kept"))
    pairs = scratch.write(pairs.select("row", "item"), "candidates")
    wanted = pairs.join(full.select("item", "item_id", "n", "h"), "item")
    some = keyed.join(small(pairs.select("row").distinct(), 500_000), "row", "left_semi")
    shared = _hashes(some, kind).distinct().join(wanted, ["row", "h"])
    found = shared.groupBy("row", "doc_id", "item", "item_id", "n").agg(F.count("*").alias("n_shared"))
    found = found.filter(F.col("n_shared") >= containment * F.col("n") - 1e-9)
    # Equal rows were matched once; each of them is reported.
    copies = keyed.join(small(found.select("row").distinct(), 500_000), "row", "left_semi").select("row")
    found = found.join(copies.groupBy("row").agg(F.count("*").alias("copies")), "row")
    found = found.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return found.select("row", "doc_id", "item_id", "n_shared", F.col("n").alias("n_item"), (F.col("n_shared") / F.col("n")).alias("containment"))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    containment: float = 0.8,
    sketch: int = 24,
    max_broadcast_shingles: int = 500_000,
) -> DataFrame:
    """The documents, all columns, that hold no item. With a broadcast benchmark this filters rows where they are; else
    rows get keys of their own, so that null or repeated ids neither drop nor keep others."""
    scratch = Scratch(docs.sparkSession)
    full = scratch.write(item_shingles(benchmark, item_id, item_text), "items")
    rows = _bounded(full, max_broadcast_shingles)
    if rows is None:
        row = unused(docs, "row")
        keyed = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate_rows")
        bad = _joined(keyed, full, row, text, containment, sketch, scratch).select(F.col("doc_id").alias(row)).distinct()
        return keyed.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not len(rows):
        return docs
    index = docs.sparkSession.sparkContext.broadcast(_index(rows, sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(index.value, containment)
        for whole in batches:
            for b in pieces(whole, text):
                clean = np.ones(b.num_rows, bool)
                clean[find(b.column(text))[0]] = False
                yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
