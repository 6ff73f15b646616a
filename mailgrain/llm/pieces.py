"""SentencePiece encoding and decoding by suffix-array matching.

For byte-pair models with byte fallback, a leading dummy blank and no other normalisation. A batch's texts are cut where no
merge can cross: before a run of blanks, and around characters that are in no longer piece. The distinct segments are
concatenated and their suffixes sorted as far as the longest piece; every piece is binary-searched there, which gives the
range of its occurrences; all occurrences are edges from start to end, sorted by where they end in their segment, then
relaxed in that order. An edge extends the best path to its start if the two last pieces stand side by side when encoded
alone. Byte-pair merging has exactly one such path to each place: a merge across the border of two pieces would happen in
the pair alone as well, as it depends on nothing else. A worker keeps which pairs hold in a table of fixed size, where a new
pair takes the place of an older one with the same hash.

Defined results: null text has null pieces; empty text has none; characters outside the vocabulary become their UTF-8 byte
pieces; ids that are no piece's decode as unknown; invalid byte pieces decode as U+FFFD each; a null list of ids decodes to
null. A blank piece of the text itself (U+2581) decodes to a space, as in the library.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shingles import pieces as slices

BLANK = "▁"
#: Bytes of text, or pieces, that a worker handles at once; its arrays take some hundred times as much memory.
SLICE = 1 << 20
#: A worker's table of pairs has two to the power of this many places.
PAIR_BITS = 21
codecs.register_error("mailgrain_byte", lambda e: ("�", e.start + 1))


def load(path: str) -> dict:
    """The vocabulary of a model file, read on the driver; its size is the model's, not the data's."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    return {
        "piece": [m.id_to_piece(i) for i in ids],
        "score": [m.get_score(i) for i in ids],
        "kind": ["byte" if m.is_byte(i) else "control" if m.is_control(i) else "unknown" if m.is_unknown(i) else "unused" if m.is_unused(i) else "" for i in ids],
        "unknown": m.unk_id(),
    }


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """What a worker needs to encode: pieces by length, the character alphabet, and the pairs known so far."""

    def __init__(self, model: dict):
        self.size = len(model["piece"])
        self.id = {p: i for i, (p, k) in enumerate(zip(model["piece"], model["kind"], strict=True)) if not k}
        self.rank = {p: -model["score"][i] for p, i in self.id.items()}  # equal for many pieces
        self.traces: dict[str, list[tuple[float, str, str]]] = {}
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(model["piece"]) if model["kind"][i] == "byte"}
        longer = [p for p in self.id if len(p) > 1]
        self.joins = np.zeros(0x110000, bool)
        self.joins[[ord(c) for c in set("".join(longer))]] = True
        missing = sorted(set("".join(longer)) - set(self.id))
        if missing or not self.byte or any(BLANK in p.lstrip(BLANK) for p in longer):
            raise ValueError("only byte-fallback models whose pieces hold blanks at their start alone")
        self.text = [p for p in self.id if self.joins[ord(p[0])]]
        self.longest = max(map(len, self.text))
        self.ids = np.array([self.id[p] for p in self.text], np.int32)
        self.length = np.array([len(p) for p in self.text], np.int32)
        self.chars = np.zeros((len(self.text), self.longest), np.uint32)
        for i, p in enumerate(self.text):
            self.chars[i, : len(p)] = [ord(c) for c in p]
        self.by_id = dict(zip(self.id.values(), self.id, strict=True))
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)  # twice the pair's number, plus one if it holds

    def trace(self, piece: str) -> list[tuple[float, str, str]]:
        """How the piece's characters merge when alone: before each merge its rank, the first and the last symbol; at the end
        infinity. Empty if they don't become the piece. Kept for each piece."""
        if piece not in self.traces:
            symbols, states = list(piece), []
            while True:
                ranks = [self.rank.get(x + y, np.inf) for x, y in zip(symbols, symbols[1:])]
                best = min(ranks, default=np.inf)
                states.append((best, symbols[0], symbols[-1]))
                if best == np.inf:
                    break
                at = ranks.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            self.traces[piece] = states if len(symbols) == 1 else []
        return self.traces[piece]

    def keeps(self, left: str | None, right: str) -> bool:
        """Whether merging the characters of both pieces gives exactly these pieces: each merges as if alone, unless at some
        point the pair across the border comes first. Of equal ranks the leftmost comes first."""
        b = self.trace(right)
        if left is None or not b:
            return bool(b)
        a = self.trace(left)
        i = j = 0
        while a:
            (next_a, _, last), (next_b, first, _) = a[i], b[j]
            cross = self.rank.get(last + first, np.inf)
            if cross < next_a and cross <= next_b:
                return False
            if next_a == next_b == np.inf:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        return False

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of ids, whether they stay side by side; a left of -1 is a segment's start."""
        key = (left.astype(np.int64) + 1) * self.size + right
        known = self.pairs[self.place(key)]
        new = known >> 1 != key
        ok = known & 1 == 1
        if new.any():
            distinct, inverse = np.unique(key[new], return_inverse=True)
            found = np.array([self.keeps(self.by_id.get(k // self.size - 1), self.by_id[k % self.size]) for k in distinct.tolist()], bool)
            self.pairs[self.place(distinct)] = 2 * distinct + found
            ok[new] = found[inverse]
        return ok

    @staticmethod
    def place(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    # -- segments ------------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the texts' offsets in them."""
        marked = [(BLANK + t).replace(" ", BLANK) if t else "" for t in texts]
        ends = np.cumsum([len(t) for t in marked])
        cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        alone = ~self.joins[cp]
        blank = cp == ord(BLANK)
        first = np.ones(len(cp), bool)
        first[1:] = alone[1:] | alone[:-1] | (blank[1:] & ~blank[:-1])
        first[ends[:-1][ends[:-1] < len(cp)]] = True
        starts = np.flatnonzero(first)
        count = np.diff(np.append(starts, len(cp)))
        which, at = self.distinct(cp, starts, count)
        ids, n = self.encode_segments(cp, starts[which], count[which], alone)
        seg_n = n[at]
        flat = ids[ragged((np.cumsum(n) - n)[at], seg_n)]
        total = np.concatenate([[0], np.cumsum(seg_n)])
        return flat, np.concatenate([[0], total[np.searchsorted(starts, ends, "left")]])

    @staticmethod
    def distinct(cp: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of one segment of each content, and for each segment its place among them. Segments are told apart by a
        hash, and every one is then compared with the one that stands for it."""
        offset = np.arange(len(cp)) - np.repeat(starts, count)
        salt = 1
        while True:
            powers = np.cumprod(np.full(int(count.max()), np.uint64(0x9E3779B97F4A7C15 + 2 * salt)))
            value = (cp.astype(np.uint64) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
            value ^= value >> np.uint64(32)
            h = np.add.reduceat(value * powers[offset], starts)
            _, which, at = np.unique(h, return_index=True, return_inverse=True)
            if (count == count[which][at]).all() and (cp == cp[np.repeat(starts[which][at], count) + offset]).all():
                return which, at
            salt += 1

    def encode_segments(self, cp: np.ndarray, starts: np.ndarray, count: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments, one after another, and how many each has."""
        n = np.zeros(len(starts), np.int64)
        single = alone[starts]
        own = []
        for k in np.flatnonzero(single):
            c = chr(cp[starts[k]])
            own.append([self.id[c]] if c in self.id else [self.byte[x] for x in c.encode("utf-8", "surrogatepass")])
            n[k] = len(own[-1])
        rest = np.flatnonzero(~single)
        ids, n[rest] = self.match(cp[ragged(starts[rest], count[rest])], count[rest])
        out = np.empty(n.sum(), np.int32)
        at = np.cumsum(n) - n
        out[ragged(at[rest], n[rest])] = ids
        out[ragged(at[single], n[single])] = [x for xs in own for x in xs]
        return out, n

    def match(self, text: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        # A 0 stands after each segment, so no piece, which holds none, is found across a border.
        begin = np.cumsum(count + 1) - count - 1
        start = np.repeat(begin.astype(np.int32), count + 1)  # a text has fewer than 2^31 characters
        size = len(start)
        alphabet = np.unique(text)
        bits = int(len(alphabet)).bit_length()
        code = np.zeros(int(alphabet[-1]) + 2, np.uint64)
        code[alphabet] = np.arange(1, len(alphabet) + 1)
        piece = code[np.minimum(self.chars, len(code) - 1)]
        depth = int(min(self.longest, count.max()))
        usable = ((piece > 0) | (self.chars == 0)).all(axis=1) & (self.length <= depth)
        piece, length, ids = piece[usable], self.length[usable], self.ids[usable]
        # The suffixes' first characters as numbers, some to a word; each word is the first one of a later suffix.
        per = 64 // bits
        words = -(-depth // per)
        coded = np.zeros(size + words * per, np.uint64)
        coded[np.arange(len(text)) + np.repeat(np.arange(len(count)), count)] = code[text]
        packed = np.zeros(size + (words - 1) * per, np.uint64)
        for j in range(per):
            packed <<= np.uint64(bits)
            packed |= coded[j : j + len(packed)]
        suffix = [packed[w * per : w * per + size] for w in range(words)]
        low, high = [], []
        for w in range(words):
            a, b = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
            for j in range(w * per, w * per + per):
                c = piece[:, j] if j < self.longest else np.zeros(len(ids), np.uint64)
                a = (a << np.uint64(bits)) | c
                b = (b << np.uint64(bits)) | np.where(length > j, c, np.uint64((1 << bits) - 1))
            low.append(a)
            high.append(b)
        order = np.argsort(suffix[0])
        if words > 1:  # suffixes with one first word are put in order by the others
            head = suffix[0][order]
            same = np.zeros(size + 1, bool)
            same[1:-1] = head[1:] == head[:-1]
            tied = np.flatnonzero(same[1:] | same[:-1])
            own = order[tied]
            order[tied] = own[np.lexsort([k[own] for k in suffix[::-1]])]
        suffix, order = [k[order] for k in suffix], order.astype(np.int32)
        lo, hi = self.bound(suffix, low, False), self.bound(suffix, high, True)
        # Edges: each piece's range of occurrences.
        n = hi - lo
        at = order[ragged(lo, n)]
        edge_id, edge_end = np.repeat(ids, n), at + np.repeat(length, n)
        step = edge_end - start[at]
        by_end = np.argsort(step.astype(np.uint16) if count.max() < 1 << 16 else step, kind="stable")  # short numbers sort in one pass
        at, edge_id, edge_end, step = at[by_end], edge_id[by_end], edge_end[by_end], step[by_end]
        last = np.full(size + 1, -2, np.int32)  # of the path that ends before a place; kept at its last character
        rounds = np.searchsorted(step, np.arange(1, int(count.max()) + 2))
        for r in range(len(rounds) - 1):
            e = slice(rounds[r], rounds[r + 1])
            s = at[e]
            before = np.where(s == start[s], -1, last[s - 1])
            reached = before != -2
            s_id, s_end, before = edge_id[e][reached], edge_end[e][reached], before[reached]
            ok = self.fits(before, s_id)
            last[s_end[ok] - 1] = s_id[ok]
        # Walk back from the ends of all segments at once.
        long = np.zeros(self.size, np.int64)
        long[self.ids] = self.length
        on_path = np.zeros(size, bool)
        place = begin + count
        while len(place):
            on_path[place - 1] = True
            head = start[place - 1]
            place = place - long[last[place - 1]]
            place = place[place > head]
        return last[:-1][on_path], np.add.reduceat(on_path.astype(np.int64), begin)

    @staticmethod
    def bound(suffix: list[np.ndarray], key: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search for all keys at once: the first suffix that is not less, or the first that is greater."""
        lo, hi = np.zeros(len(key[0]), np.int64), np.full(len(key[0]), len(suffix[0]))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(suffix[0]) - 1)
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for s, k in zip(suffix, key, strict=True):
                v = s[mid]
                less |= same & (v < k)
                same &= v == k
            less |= same & after
            open_ = lo < hi
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo


_known: dict[str, Vocabulary] = {}  # a worker's last vocabulary with its pairs, by the content of its model


def _with_column(docs: DataFrame, name: str, kind: T.DataType, make) -> DataFrame:
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != name], T.StructField(name, kind)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield from make(whole, names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """All columns, and the ids of the text's pieces as array<int>."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))
    number = hashlib.sha256(repr(sorted(model.value.items())).encode()).hexdigest()

    def make(whole: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
        if number not in _known:
            _known.clear()
            _known[number] = Vocabulary(model.value)
        for b in slices(whole, text, SLICE):
            texts = b.column(text).to_pylist()
            flat, off = _known[number].encode([t or "" for t in texts])
            null = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()), mask=null)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names[:-1]], lists], names)

    return _with_column(docs, ids, T.ArrayType(T.IntegerType()), make)


def decode(docs: DataFrame, model_path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """All columns, and the text of the pieces."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def make(whole: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
        m = model.value
        strings = []
        for p, k in zip(m["piece"], m["kind"], strict=True):
            plain = p.replace(BLANK, " ").encode()
            strings.append(bytes([int(p[1:-1], 16)]) if k == "byte" else b"" if k == "control" else b" \xe2\x81\x87 " if k == "unknown" else plain)
        strings.append(strings[m["unknown"]])
        size = np.array([len(s) for s in strings])
        pool = np.frombuffer(b"".join(strings), np.uint8)
        begin = np.cumsum(size) - size
        blank = np.array([p.startswith(BLANK) for p in m["piece"]] + [False])
        control = np.array([k == "control" for k in m["kind"]] + [False])
        for b in slices(whole, ids, SLICE):
            column = b.column(ids)
            flat = np.asarray(column.flatten().fill_null(-1), np.int64)
            flat = np.where((flat >= 0) & (flat < len(m["piece"])), flat, len(m["piece"]))
            off = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))])
            data = pool[ragged(begin[flat], size[flat])].tobytes()
            places = np.concatenate([[0], np.cumsum(size[flat])])[off]
            # The first piece with a surface loses a leading blank; control pieces before it have none.
            shown = np.append(np.flatnonzero(~control[flat]), len(flat))
            first = shown[np.searchsorted(shown, off[:-1])]
            drop = (first < off[1:]) & blank[np.append(flat, -1)[first]]
            null = column.is_null().to_pylist()
            out = [None if null[i] else data[places[i] + drop[i] : places[i + 1]].decode("utf-8", "mailgrain_byte") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names[:-1]], pa.array(out, pa.string())], names)

    return _with_column(docs, text, T.StringType(), make)
