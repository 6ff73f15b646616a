"""Word shingles of whole texts as 64-bit hashes, in Arrow batches inside tasks.

Words are the maximal runs of bytes other than ASCII white space, after lower-casing A-Z. Each distinct word of a batch is
hashed once; shingle hashes are then made for the whole batch by array arithmetic. Equal shingles have equal hashes;
different ones collide with a chance of 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

K = 5
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(batch: pa.RecordBatch, text: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``max_bytes`` of text (or items of lists), so that many long texts don't add up; a longer
    one stands alone."""
    column = batch.column(text)
    length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    sizes = pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > max_bytes and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lower(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased; null becomes empty. By table over the bytes: Arrow's own kernel now and then returned other bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    part = _LOWER[data[offsets[0] : offsets[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(part))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the offsets of the texts in them. A null text has no words."""
    lists = pc.ascii_split_whitespace(lower(texts))
    flat = lists.flatten()
    coded = pc.dictionary_encode(flat)
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    index = coded.indices.to_numpy()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if "" in words:  # white space at either end of a text
        keep = index != words.index("")
        ends = np.concatenate([[0], np.cumsum(keep)])[ends] if len(ends) else ends
        index = index[keep]
    return table[index] if len(table) else np.empty(0, np.uint64), np.concatenate([[0], ends]).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _MIX2
    h ^= h >> np.uint64(29)
    h *= _MIX1
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text and their offsets; a text of fewer words is one shingle, one without words
    none. Window i of a text starts at its word i."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    starts = np.repeat(offsets[:-1] - out_offsets[:-1], count) + np.arange(out_offsets[-1])
    ends = np.repeat(offsets[1:], count)
    h = np.zeros(len(starts), np.uint64)
    for j in range(k):
        there = starts + j < ends
        word = words[np.minimum(starts + j, max(len(words) - 1, 0))] if len(words) else h
        h = np.where(there, mixed(h * _MIX1 + word + np.uint64(j + 1)), h)
    return h, out_offsets


def distinct_in_texts(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, sorted within it, and their offsets."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(offsets) - 1))]).astype(np.int64)
