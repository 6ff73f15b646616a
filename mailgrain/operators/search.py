"""Text retrieval: BM25, substrings with an n-gram accelerator, fuzzy substrings, path mentions, excerpts, diffs."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.bounds import checked_needle, no_phrases
from ..functions.text import words
from ..lineage import checkpointed

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9_]+", no_phrases(query).replace("-", " ").lower())))


def bm25(docs: DataFrame, query: str, key: str = "message_id", fields: tuple[str, ...] = ("text",), operator: str = "or", where: Column | None = None) -> DataFrame:
    """key, score (9 decimals), matched: BM25 summed over fields. Statistics come from all documents; ``where`` only limits
    what is returned. One scan gives each document's length and counts of the query's terms as plain columns, so what is
    shuffled is one row of totals, broadcast back; no inverted index is needed."""
    terms = query_terms(query)
    if not terms:
        raise ValueError("no search term")
    cols = [F.col(key)] + ([where.alias("_in")] if where is not None else [F.lit(True).alias("_in")])
    d = docs.select(*cols, *[words(F.col(f)).alias(f"w{i}") for i, f in enumerate(fields)])
    counts = [_count(i, t).alias(f"tf_{i}_{j}") for i in range(len(fields)) for j, t in enumerate(terms)]
    d = d.select(key, "_in", *[F.size(f"w{i}").alias(f"len_{i}") for i in range(len(fields))], *counts)
    d = checkpointed(d)  # a few numbers a text: the texts are read once
    stats = d.agg(
        F.count("*").alias("n"),
        *[F.avg(f"len_{i}").alias(f"avg_{i}") for i in range(len(fields))],
        *[F.sum((F.col(f"tf_{i}_{j}") > 0).cast("long")).alias(f"df_{i}_{j}") for i in range(len(fields)) for j in range(len(terms))],
    )
    parts = []
    for i in range(len(fields)):
        for j in range(len(terms)):
            tf, df = F.col(f"tf_{i}_{j}"), F.col(f"df_{i}_{j}")
            idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            norm = K1 * (1 - B + B * F.col(f"len_{i}") / F.col(f"avg_{i}"))
            parts.append(F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(F.lit(0.0)))
    matched = reduce(
        lambda a, b: a + b,
        [(reduce(lambda a, b: a | b, [F.col(f"tf_{i}_{j}") > 0 for i in range(len(fields))])).cast("int") for j in range(len(terms))],
    )
    scored = d.crossJoin(F.broadcast(stats)).select(key, "_in", F.round(reduce(lambda a, b: a + b, parts), 9).alias("score"), matched.alias("matched"))  # stats: one row
    return scored.filter(F.col("_in") & (F.col("matched") >= (len(terms) if operator == "and" else 1))).drop("_in")


def _count(i: int, term: str) -> Column:
    return F.size(F.filter(f"w{i}", lambda w: w == term))


def top_scored(scored: DataFrame, limit: int, key: str = "message_id", score: str = "score") -> DataFrame:
    return scored.orderBy(F.desc(score), F.asc(key)).limit(limit)


def substring(docs: DataFrame, needle: str, text: str = "patch") -> DataFrame:
    """Exact, case-sensitive. ``contains`` is pushed towards the scan."""
    return docs.filter(F.contains(F.col(text), F.lit(checked_needle(needle))))


def windows_of(c: Column, n: int, characters: str = r"[\x{0}-\x{10FFFF}]") -> Column:
    """Distinct windows of n characters. The look-ahead consumes nothing, so the text is read once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=({characters}{{{n}}}))"), F.lit(1)))


def trigrams(c: Column) -> Column:
    """Distinct three-byte windows of ASCII text."""
    return windows_of(c, 3, r"[\x00-\x7F]")


def trigram_table(docs: DataFrame, key: str = "message_id", text: str = "patch") -> DataFrame:
    """gram, key: written sorted by gram, it lets a search read a few row groups instead of all bodies."""
    return docs.select(F.explode(trigrams(F.col(text))).alias("gram"), key)


def needle_grams(needle: str) -> list[str]:
    return sorted({needle[i : i + 3] for i in range(len(needle) - 2) if needle[i : i + 3].isascii()})


def candidates(grams: DataFrame, needle: str, key: str = "message_id", edits: int = 0) -> DataFrame | None:
    """Keys with all of the needle's trigrams, or all but those that ``edits`` can spoil; None if nothing can be excluded."""
    wanted = needle_grams(needle)
    least = len(wanted) - 3 * edits
    if least < 1:
        return None
    hit = grams.filter(F.col("gram").isin(wanted)).groupBy(key).agg(F.countDistinct("gram").alias("n"))
    return hit.filter(F.col("n") >= least).select(key)


class TooManyCandidates(ValueError):
    """A needle that leaves more candidates than a caller wants to read: it must be narrowed."""


def guarded(found: DataFrame, most: int | None) -> DataFrame:
    """An error if there are more than ``most`` rows; counting stops one beyond."""
    if most is not None and found.limit(most + 1).count() > most:
        raise TooManyCandidates(f"more than {most} candidates; narrow the needle or the list")
    return found


def indexed_fuzzy(docs: DataFrame, grams: DataFrame, needle: str, edits: int = 1, key: str = "message_id", text: str = "patch", max_candidates: int | None = 100_000) -> DataFrame:
    """The same rows as :func:`fuzzy_substring`, reading only texts with all but ``3 * edits`` of the needle's trigrams."""
    found = candidates(grams, checked_needle(needle), key, edits)
    return fuzzy_substring(docs if found is None else docs.join(guarded(found, max_candidates), key, "left_semi"), needle, edits, key, text)


def indexed_substring(docs: DataFrame, grams: DataFrame, needle: str, key: str = "message_id", text: str = "patch", max_candidates: int | None = None) -> DataFrame:
    """The same rows as :func:`substring`, reading only candidates' texts; with ``max_candidates``, an error beyond them."""
    found = candidates(grams, checked_needle(needle), key)
    found = found if found is None else guarded(found, max_candidates)
    return substring(docs if found is None else docs.join(found, key, "left_semi"), needle, text)


def best_distance(text: str, needle: str, most: int) -> int:
    """Least edit distance between the needle and any substring of the text (Sellers), up to ``most`` + 1. The column over the
    needle is updated by array operations for each character of the text."""
    n = np.frombuffer(needle.encode("utf-32-le"), np.uint32)
    t = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    steps = np.arange(len(n) + 1)
    column, best = steps.copy(), len(n)
    for c in t:
        new = np.empty_like(column)
        new[0] = 0
        new[1:] = np.minimum(column[:-1] + (n != c), column[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        column = new
        if column[-1] < best:
            best = int(column[-1])
            if best == 0:
                break
    return min(best, most + 1)


#: Characters of a lane: texts are cut into lanes that overlap by what a match can take, and all step together.
LANE = 2048


def least_distances(texts: list[str | None], needle: str, most: int) -> np.ndarray:
    """For each text the least edit distance between the needle and any substring, up to ``most`` + 1: the bit-parallel
    recurrence of Myers, a 64-bit word for each lane, all lanes of the batch at a time."""
    n, reach = len(needle), len(needle) + most
    best = np.full(len(texts), min(n, most + 1))
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(c) for c in codes], np.int64)
    stride = max(LANE - reach, reach)
    count = np.maximum(-(-(size - reach) // stride), 0) + (size > 0)
    owner = np.repeat(np.arange(len(texts)), count)
    if not len(owner):
        return best
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * stride
    alphabet = np.unique(np.frombuffer(needle.encode("utf-32-le"), np.uint32))
    mask = np.zeros(len(alphabet) + 1, np.uint64)  # the last is of characters that the needle hasn't
    for i, c in enumerate(np.searchsorted(alphabet, np.frombuffer(needle.encode("utf-32-le"), np.uint32))):
        mask[c] |= np.uint64(1 << i)
    width = stride + reach
    lanes = np.full((len(owner), width), len(alphabet), np.uint8)
    for i, (o, s) in enumerate(zip(owner, start, strict=True)):
        part = codes[o][s : s + width]
        at = np.minimum(np.searchsorted(alphabet, part), len(alphabet) - 1)
        lanes[i, : len(part)] = np.where(alphabet[at] == part, at, len(alphabet))
    up, down = np.full(len(owner), ~np.uint64(0)), np.zeros(len(owner), np.uint64)
    score, low = np.full(len(owner), n), np.full(len(owner), n)
    one, top = np.uint64(1), np.uint64(n - 1)
    steps = np.minimum(size[owner] - start, width)
    for p in range(int(steps.max())):
        eq = mask[lanes[:, p]]
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(across | up), up & across
        score += ((plus >> top) & one).astype(np.int64) - ((minus >> top) & one).astype(np.int64)
        np.minimum(low, score, out=low, where=p < steps)
        plus, minus = plus << one, minus << one
        up, down = minus | ~(vertical | plus), plus & vertical
    np.minimum.at(best, owner, low)
    return best


def fuzzy_substring(docs: DataFrame, needle: str, edits: int = 1, key: str = "message_id", text: str = "patch") -> DataFrame:
    """key, distance of texts with a substring at most ``edits`` away. Needles of ``edits`` + 1 parts: one part must stand
    unchanged, so a native test excludes most texts before the distance is computed."""
    checked_needle(needle)
    if not 0 <= edits <= 2:
        raise ValueError("edits must be 0, 1 or 2")
    if edits == 0:
        return substring(docs, needle, text).select(key, F.lit(0).alias("distance"))
    cut = [round(i * len(needle) / (edits + 1)) for i in range(edits + 2)]
    possible = reduce(lambda a, b: a | b, [F.contains(F.col(text), F.lit(needle[a:b])) for a, b in zip(cut, cut[1:], strict=False)])
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            got = least_distances(texts, needle, edits).tolist() if len(needle) <= 64 else [best_distance(t, needle, edits) for t in texts]
            keep = [i for i, d in enumerate(got) if d <= edits]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(keep, pa.int64())), pa.array([got[i] for i in keep], pa.int32())], [key, "distance"])

    return docs.filter(possible).select(key, F.col(text).alias("t")).mapInArrow(run, f"{key} {kind}, distance int")


def path_mentions(docs: DataFrame, vocabulary: DataFrame, key: str = "message_id", text: str = "text", path: str = "path", mode: str = "exact", value: str | None = None) -> DataFrame:
    """key, path: vocabulary entries named in texts. Path-shaped tokens are joined to the vocabulary by equality, so the work is
    linear in the texts; a token is also tried with trailing punctuation and diff prefixes taken off."""
    if value is not None:
        test = {"exact": F.col(path) == value, "basename": F.element_at(F.split(path, "/"), -1) == value, "prefix": F.col(path).startswith(value)}
        vocabulary = vocabulary.filter(test[mode])
    token = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./+-]*[A-Za-z0-9_+-]"), F.lit(0)), lambda t: F.regexp_replace(t, "^(?:[ab]/)", ""))))
    return docs.select(key, token.alias(path)).join(vocabulary.select(path).distinct(), path).select(key, path)


def contains_any(docs: DataFrame, needles: DataFrame, key: str, text: str, needle_key: str, needle: str, max_chars: int = 1_000_000) -> DataFrame:
    """key, needle_key of texts that contain a needle, wherever it starts. Needles of ``max_chars`` characters in all at most are
    broadcast as one automaton, which reads each text once; more are joined (:func:`contains_any_joined`)."""
    if (needles.agg(F.sum(F.length(needle))).first()[0] or 0) > max_chars:
        return contains_any_joined(docs, needles, key, text, needle_key, needle)
    rows = needles.filter(F.length(needle) > 0).select(needle_key, needle).collect()  # bounded by max_chars
    shared = docs.sparkSession.sparkContext.broadcast([(r[1], r[0]) for r in rows])
    kinds = (docs.schema[key].dataType.simpleString(), needles.schema[needle_key].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, list] = {}
        for word, i in shared.value:
            ids.setdefault(word, []).append(i)
        automaton = ahocorasick.Automaton()
        for word, own in ids.items():
            automaton.add_word(word, own)
        automaton.make_automaton()
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                if ids and t:
                    got = {x for _, own in automaton.iter(t) for x in own}
                    at += [i] * len(got)
                    found += sorted(got)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(found, type_of[0])], [key, needle_key])

    type_of = [to_arrow_type(needles.schema[needle_key].dataType)]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kinds[0]}, `{needle_key}` {kinds[1]}")


def contains_any_joined(docs: DataFrame, needles: DataFrame, key: str, text: str, needle_key: str, needle: str, prefix: int = 32) -> DataFrame:
    """The same by equi-joins: a needle's first ``prefix`` characters (all of a shorter one) against those of every place of each
    text, length by length; the text is then tested. Linear in the texts, not in texts times needles."""
    lengths = [r[0] for r in needles.select(F.least(F.length(needle), F.lit(prefix)).alias("n")).distinct().collect() if r[0]]  # at most ``prefix`` values
    out = None
    for n in sorted(lengths):
        own = needles.filter(F.least(F.length(needle), F.lit(prefix)) == n).select(needle_key, F.col(needle).alias("_needle"), F.substring(needle, 1, n).alias("_head"))
        part = docs.select(key, text, F.explode(windows_of(F.col(text), n)).alias("_head")).join(own, "_head").filter(F.contains(F.col(text), F.col("_needle"))).select(key, needle_key)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def kwic(docs: DataFrame, needle: str, key: str = "message_id", text: str = "prose", window: int = 200) -> DataFrame:
    """key, byte_offset, excerpt, sha256 of the text: the first hit in any case, centred in ``window`` characters."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - (window - len(needle)) // 2, F.lit(1))
    return docs.filter(at > 0).select(
        key,
        F.octet_length(F.substring(F.col(text), F.lit(1), at - 1)).alias("byte_offset"),
        F.substring(F.col(text), start, F.lit(max(window, len(needle)))).alias("excerpt"),
        F.sha2(text, 256).alias("sha256"),
    )


def version_diff(m: DataFrame, a: str, b: str, mode: str = "patch") -> DataFrame:
    """One row: a, b, diff of two messages' patches, prose or whole bodies (mode raw). No row if one isn't there."""
    column = {"patch": "patch", "prose": "prose", "raw": "body"}.get(mode)
    if column is None:
        raise ValueError("mode must be patch, prose or raw")
    if a == b:
        raise ValueError("two different messages are needed")
    one = lambda mid, name: m.filter(F.col("message_id") == mid).orderBy(F.desc_nulls_last("date_unix_ns"), "list").limit(1).select(F.lit(mid).alias(name), F.col(column).alias(f"{name}_text"))
    both = one(a, "a").crossJoin(one(b, "b"))  # one row each
    return unified_diff(both, "a_text", "b_text").select("a", "b", "diff")


def unified_diff(pairs: DataFrame, a: str = "a", b: str = "b", name: str = "diff") -> DataFrame:
    """All columns and a unified diff (three lines of context) of two text columns; empty where they are equal."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields], f"`{name}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = [
                "\n".join(difflib.unified_diff((p or "").splitlines(), (q or "").splitlines(), "a", "b", n=3, lineterm=""))
                for p, q in zip(x.column(a).to_pylist(), x.column(b).to_pylist(), strict=True)
            ]
            yield x.append_column(name, pa.array(out, pa.string()))

    return pairs.mapInArrow(run, schema)
