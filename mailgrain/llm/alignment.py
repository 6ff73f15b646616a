"""Token alignment between two tokenizers: a byte-level BPE (A) and a SentencePiece BPE with byte fallback (B).

Both encode a blank and the text, the second by its own leading blank. If both token lists spell those bytes, their ends
make two divisions of one range. The B tokens' starts are a static index of intervals, sorted as they are; a bisection at
the first byte of each A token and one at its last give the range of B tokens that it overlaps, which are its links. A gap
between two bytes that no token of either list spans ends a group. All texts of a slice lie on one axis, so one search
serves them all.

Token ids are written once. A first reading of them counts the linked id pairs, a second aligns and looks the counts up: in
a sorted table that every task holds where a count of its rows shows it small, else by a join of each text's distinct
pairs, where pairs of common tokens are spread over salts. Texts are cut at each blank between two other characters, on whose left
neither tokenizer joins, and each distinct part is encoded once, after a blank as in its text; a worker keeps the ids of
a bounded number of parts.

Defined results: null and empty texts, and texts of which a token list doesn't spell a blank and the text (U+2581 stands for
a blank), have no tokens: counts are 0 and ``groups`` is empty. Strings of special tokens are plain text. Repeated rows
count each time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, unused
from .pieces import ragged
from .shingles import pieces as slices

#: Characters of text, and tokens, that a worker handles at once.
CHARACTERS, TOKENS = 1 << 19, 1 << 17
#: Pairs of ids that a task may hold with their counts: 17 bytes each.
MAX_TABLE_PAIRS = 2_000_000
SALTS = 32
#: Parts whose ids a worker keeps, and parts encoded at once: a library's result takes a thousand bytes for each.
KNOWN_PARTS, ENCODED = 200_000, 4096
SHIFT = 32


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones stand for themselves, the others are
    numbered on from 256."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def load(a_path: str, b_path: str) -> dict[str, bytes]:
    """Both models' files, read on the driver; executors needn't have them."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return {"a": a.read(), "b": b.read()}


class Surfaces:
    """A table of byte strings."""

    def __init__(self, surfaces: list[bytes]):
        self.size = np.array([len(s) for s in surfaces], np.int64)
        self.pool = np.frombuffer(b"".join(surfaces), np.uint8)
        self.begin = np.cumsum(self.size) - self.size

    def spell(self, at: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The entries ``at`` one after another, cut at the offsets ``off`` in them."""
        size = self.size[at]
        data = self.pool[ragged(self.begin[at], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[off].tolist()
        return [data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


class Tokenizers:
    def __init__(self, model: dict[str, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(model["a"].decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model["b"])
        sign = byte_of_sign()
        entry = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        added = {t["id"] for t in json.loads(model["a"]).get("added_tokens", [])}
        a = [b"" if i not in entry else entry[i].encode() if i in added else bytes(sign[c] for c in entry[i]) for i in range(max(entry) + 1)]
        b = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            b.append(bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode())
        self.a_bytes, self.b_bytes = Surfaces(a), Surfaces(b)
        self.kind = np.dtype(np.uint16 if max(len(a), len(b)) <= 1 << 16 else np.uint32)
        # Ids as they are written: A's before another of its group and at its group's end, then B's.
        self.written = Surfaces([f"{i}{c}".encode() for n, last in ((len(a), "|"), (len(b), ";")) for c in ("," + last) for i in range(n)])
        self.forget()

    def forget(self) -> None:
        """The parts known so far: their numbers, and for each its ids by A and B and whether they spell it."""
        self.number: dict[str, int] = {}
        self.ids = [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in "ab"]
        self.sound = np.zeros(0, bool)

    def learn(self, parts: list[str]) -> np.ndarray:
        """Numbers of the parts; new ones are encoded."""
        if len(self.number) > KNOWN_PARTS:
            self.forget()
        known = len(self.number)
        at = np.array([self.number.setdefault(p, len(self.number)) for p in parts], np.int64)
        new = list(self.number)[known:]
        if new:
            a, b, spelled = [], [], []
            for i in range(0, len(new), ENCODED):
                some = new[i : i + ENCODED]
                a += [e.ids for e in self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False)]
                b += self.b.encode(some, num_threads=1)
            for k, (lists, surfaces) in enumerate(((a, self.a_bytes), (b, self.b_bytes))):
                flat = np.array([i for x in lists for i in x], np.int32)
                off = np.cumsum([0, *map(len, lists)])
                spelled.append(surfaces.spell(flat, off))
                old, old_off = self.ids[k]
                self.ids[k] = np.concatenate([old, flat]), np.concatenate([old_off, old_off[-1] + off[1:]])
            own = [x == y == b" " + p.encode() for x, y, p in zip(*spelled, new, strict=True)]
            self.sound = np.concatenate([self.sound, np.array(own, bool)])
        return at

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B of all texts, each with the texts' offsets; none where they don't spell the text."""
        parts, size = parts_of(texts)
        at = self.learn(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        bad = added_up(~self.sound[at], np.concatenate([[0], np.cumsum(size)])) > 0
        at = at[~np.repeat(bad, size)]
        ends = np.concatenate([[0], np.cumsum(np.where(bad, 0, size))])
        out = []
        for flat, off in self.ids:
            own = np.diff(off)[at]
            out.append((flat[ragged(off[at], own)], np.concatenate([[0], np.cumsum(own)])[ends]))
        return out


def parts_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All texts cut at the blanks between two other characters, and the number of parts of each; a null or empty text has
    none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(texts, " ")
    size = lists.value_lengths().to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    at, names = words.indices.to_numpy(), words.dictionary.to_pylist()
    opens = np.array([w != "" and not w[0].isspace() for w in names], bool)[at] if names else np.zeros(0, bool)
    closes = np.array([w != "" and not w[-1].isspace() for w in names], bool)[at] if names else opens
    first = np.ones(len(at), bool)
    first[1:] = closes[:-1] & opens[1:]
    first[np.cumsum(size) - size] = True
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(at)))
    # What stands around other white space stays together.
    number = {w: i for i, w in enumerate(names)}
    found = at[start].astype(np.int64)
    for k in np.flatnonzero(count > 1):
        found[k] = number.setdefault(" ".join(names[i] for i in at[start[k] : start[k] + count[k]]), len(number))
    size = np.add.reduceat(first, np.cumsum(size) - size).astype(np.int64) if len(size) else size
    there = pc.binary_length(texts).to_numpy() > 0
    found = found[np.repeat(there, size)]
    return pa.DictionaryArray.from_arrays(pa.array(found), pa.array(list(number), pa.string())), np.where(there, size, 0)


_loaded: dict[str, Tokenizers] = {}  # a worker's last tokenizers, by the content of their files


def tokenizers_of(model: dict[str, bytes], number: str) -> Tokenizers:
    if number not in _loaded:
        _loaded.clear()
        _loaded[number] = Tokenizers(model)
    return _loaded[number]


class Aligned:
    """Links and groups of some texts. ``a`` and ``b``: ids of all texts; ``a_off`` and ``b_off``: where each text's start."""

    def __init__(self, a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray, t: Tokenizers):
        self.a, self.b, self.a_off, self.b_off = a, b, a_off, b_off
        a_at = np.concatenate([[0], np.cumsum(t.a_bytes.size[a])])  # both lists of a text spell the same bytes
        b_at = np.concatenate([[0], np.cumsum(t.b_bytes.size[b])])
        # Stabbing queries: the B token that holds the first byte of each A token, and the one that holds its last.
        self.first = np.searchsorted(b_at, a_at[:-1], "right") - 1
        self.last = np.searchsorted(b_at, a_at[1:], "left") - 1
        self.count = self.last - self.first + 1
        # An A token's end that no B token spans is an end of both; a group ends there.
        ends = b_at[self.last + 1] == a_at[1:]
        self.a_end = np.flatnonzero(ends) + 1  # A tokens, and B tokens, before each group's end
        self.b_end = self.last[ends] + 1
        self.group_off = np.searchsorted(self.a_end, a_off, "right")

    def links(self) -> np.ndarray:
        """The id pair of each link, A token by A token."""
        return (np.repeat(self.a, self.count).astype(np.int64) << SHIFT) | self.b[ragged(self.first, self.count)]

    def link_off(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.count)])[self.a_off]

    def groups(self) -> pa.Array:
        """For each text its groups, each with the ids of both lists."""

        def lists(ids: np.ndarray, end: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(ids, pa.int32()))

        each = pa.StructArray.from_arrays([lists(self.a, self.a_end), lists(self.b, self.b_end)], names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(self.group_off, pa.int32()), each)

    def digests(self, t: Tokenizers) -> list[str]:
        """Of each text the sha256 of ``a1,a2|b1;a3|b2``: ids of both lists, group by group; empty without tokens."""
        n, n_a = len(self.a) + len(self.b), len(t.a_bytes.size)
        at = np.empty(n, np.int64)
        for ids, end, other, base, own in ((self.a, self.a_end, self.b_end, 0, n_a), (self.b, self.b_end, self.a_end, 2 * n_a, len(t.b_bytes.size))):
            size = np.diff(end, prepend=0)
            last = np.zeros(len(ids), np.int64)
            last[end - 1] = own
            before = np.repeat(other - (np.diff(other, prepend=0) if base == 0 else 0), size)  # B stands after A's of its group
            at[np.arange(len(ids)) + before] = base + ids + last
        said = t.written.spell(at, self.a_off + self.b_off)
        return [hashlib.sha256(x[:-1]).hexdigest() if x else "" for x in said]


def added_up(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[off])


def distinct_pairs(links: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, pair, number of links of each distinct pair of each text."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((links, text))
    text, links = text[order], links[order]
    new = np.ones(len(links), bool)
    new[1:] = (links[1:] != links[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], links[at], np.diff(np.append(at, len(links)))


def tokenize(docs: DataFrame, a_path: str, b_path: str, text: str = "text", a: str = "a_ids", b: str = "b_ids") -> DataFrame:
    """All columns but the text, and both lists of ids as packed numbers (:func:`packed`); empty where a text has no tokens."""
    model = docs.sparkSession.sparkContext.broadcast(load(a_path, b_path))
    number = hashlib.sha256(model.value["a"] + model.value["b"]).hexdigest()
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(a, T.BinaryType()), T.StructField(b, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text, CHARACTERS):
                t = tokenizers_of(model.value, number)
                columns = [packed(ids, off, t.kind) for ids, off in t.encode(part.column(text))]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *columns], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def packed(ids: np.ndarray, off: np.ndarray, kind: np.dtype) -> pa.Array:
    """Lists of ids as bytes, two or four an id: what a task is handed at once is half as large as lists of integers."""
    buffers = [None, pa.py_buffer((off * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind))]
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, buffers)


def unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the lists' offsets in them."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // kind.itemsize
    data = column.buffers()[2]
    ids = np.frombuffer(data, kind)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, kind)
    return ids.astype(np.int32), off - off[0]


def align(
    docs: DataFrame, a_path: str, b_path: str, text: str = "text", max_table_pairs: int = MAX_TABLE_PAIRS, digest: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Two tables. Of each text, with all columns but the text: ``groups`` (array of structs of the ids by ``a`` and ``b``), or
    with ``digest`` their hash, groups_sha256; n_groups, n_a, n_b, n_links, n_best (links of which no pair with their B id has
    more), count_sum (of the links' pairs). Of each linked pair: a_id, b_id, n, best."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    a, b, rid = unused(docs, "a_ids"), unused(docs, "b_ids"), unused(docs, "rid")
    kept = [c for c in docs.columns if c != text]
    tokens = scratch.write(tokenize(docs, a_path, b_path, text, a, b).withColumn(rid, F.monotonically_increasing_id()), "tokens")
    model = spark.sparkContext.broadcast(load(a_path, b_path))
    number = hashlib.sha256(model.value["a"] + model.value["b"]).hexdigest()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
        for whole in batches:
            t = tokenizers_of(model.value, number)
            for part in slices(whole, a, TOKENS * t.kind.itemsize):
                yield part, Aligned(*unpacked(part.column(a), t.kind), *unpacked(part.column(b), t.kind), t)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in aligned(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(x.links(), return_counts=True)], ["pair", "n"])

    pairs = tokens.select(a, b).mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    b_id = (F.col("pair") % (1 << SHIFT)).cast("int").alias("b_id")
    pairs = scratch.write(pairs.select("pair", F.shiftright("pair", SHIFT).cast("int").alias("a_id"), b_id, "n"), "pairs")
    # One row for each B id: the vocabulary bounds it.
    most = F.broadcast(pairs.groupBy("b_id").agg(F.max("n").alias("most")))
    pairs = scratch.write(pairs.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best")), "counted")

    in_table = pairs.count() <= max_table_pairs
    known = pairs.select("pair", "n", "best").toArrow() if in_table else None
    if known is not None:
        columns = [known.column(c).to_numpy() for c in ("pair", "n", "best")]
        order = np.argsort(columns[0])
        known = spark.sparkContext.broadcast([c[order] for c in columns])
    fields = ["groups_sha256" if digest else "groups", "n_groups", "n_a", "n_b", "n_links", "n_best", "count_sum"]
    taken = {c.lower(): unused(docs, c) for c in fields}  # of columns that clash, the new ones get a suffix
    groups = "string" if digest else "array<struct<a: array<int>, b: array<int>>>"
    schema = T.StructType([*docs.select(*kept).schema.fields, *T._parse_datatype_string(f"{taken[fields[0]]} {groups}, " + ", ".join(f"{taken[c]} bigint" for c in fields[1:])).fields])
    if not in_table:
        schema = schema.add(rid, T.LongType())

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in aligned(batches):
            off = x.link_off()
            n_best = count_sum = np.zeros(len(off) - 1, np.int64)
            if known is not None:
                pair, n, best = known.value
                at = np.searchsorted(pair, x.links())
                n_best, count_sum = added_up(best[at], off) if len(at) else n_best, added_up(n[at], off) if len(at) else n_best
            numbers = [np.diff(x.group_off), np.diff(x.a_off), np.diff(x.b_off), np.diff(off), n_best, count_sum]
            shown = pa.array(x.digests(tokenizers_of(model.value, number)), pa.string()) if digest else x.groups()
            columns = [*[part.column(c) for c in kept], shown, *[pa.array(v.astype(np.int64)) for v in numbers]]
            yield pa.RecordBatch.from_arrays([*columns, part.column(rid)] if known is None else columns, schema.fieldNames())

    out = tokens.mapInArrow(result, schema)
    if in_table:
        return out, pairs

    def own_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in aligned(batches):
            of, pair, times = distinct_pairs(x.links(), x.link_off())
            yield pa.RecordBatch.from_arrays([part.column(rid).take(pa.array(of)), pa.array(pair), pa.array(times)], ["rid", "pair", "times"])

    own = tokens.select(a, b, rid).mapInArrow(own_pairs, "rid bigint, pair bigint, times bigint")
    own = own.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    salted = pairs.select("pair", "n", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sums = own.join(salted, ["pair", "salt"]).groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("times")).alias("sum")
    )
    sums = sums.select(F.col("rid").alias(rid), F.struct("best", "sum").alias("_found"))
    looked = {taken["n_best"]: F.coalesce(F.col("_found.best"), F.lit(0)), taken["count_sum"]: F.coalesce(F.col("_found.sum"), F.lit(0))}
    names = schema.fieldNames()[:-1]
    return out.join(sums, rid, "left").select(*[looked[c].cast("long").alias(c) if c in looked else F.col(f"`{c}`") for c in names]), pairs

