"""Language identification in two steps: family first, then one-versus-one linear SVMs inside the family.

A text becomes the counts of its hashed byte 2- to 4-grams, lower-cased, under a square root and scaled to length one.
Families of known languages are a fixed table; a language outside it is a family of its own. One-versus-rest SVMs choose the
family; inside it each pair of languages has an SVM, and the language with most wins, then the largest margin, is taken.
The score multiplies calibrated chances of both steps.

Training uses at most ``per_language`` texts of each language (and at most 200 languages); prediction reads every whole
text, long ones in parts that overlap by an n-gram. Defined results: null text, or text without a letter (Unicode's class L:
``½``, ``²`` and ``Ⅷ`` are none), is ``und`` with score 0; without training rows everything is
``und``; ties go to the language first in the alphabet; repeated rows are predicted alike; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .samples import labelled_sample
from .shingles import pieces

BITS = 12
# Families of languages.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
LETTER = regex.compile(r"\p{L}")
#: Bytes of texts that a worker holds at once, and of a text that are put into arrays at once.
SLICE, PART = 4 << 20, 1 << 20


def family_of(language: str) -> str:
    return next((f for f, known in FAMILIES.items() if language in known), language)


def features(text: str) -> np.ndarray:
    whole = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    out = np.zeros(1 << BITS, np.int64)
    for start in range(0, len(whole), PART):
        for n in range(2, 5):
            b = whole[start : start + PART + n - 1].astype(np.uint32)
            if len(b) < n:
                break
            code = b[: len(b) - n + 1]
            for i in range(1, n):
                code = (code << np.uint32(8)) | b[i : len(b) - n + 1 + i]
            hashed = (code + np.uint32(n)) * np.uint32(2654435761)
            out += np.bincount((hashed ^ (hashed >> np.uint32(15))) >> np.uint32(32 - BITS), minlength=1 << BITS)
    out = np.sqrt(out.astype(np.float32))
    return out / max(float(np.linalg.norm(out)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 200) -> np.ndarray:
    """Squared-hinge linear SVM with a bias, by accelerated gradient steps; y is 1 or -1, the classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * cost
    w = look = np.zeros(x.shape[1], np.float32)
    step = 1 / (1 + 4 * cost)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - step * (look * 0.1 - 2 * x.T @ (weight * y * slack))
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


def train(x: np.ndarray, labels: np.ndarray) -> dict:
    languages = sorted(set(labels))
    families = sorted({family_of(c) for c in languages})
    of = np.array([family_of(c) for c in labels])
    model = {"families": families, "family_w": np.stack([svm(x, np.where(of == f, 1.0, -1.0).astype(np.float32)) for f in families]), "inside": {}}
    for f in families:
        own = [c for c in languages if family_of(c) == f]
        pairs = {}
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                rows = (labels == a) | (labels == b)
                pairs[a, b] = svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0).astype(np.float32))
        model["inside"][f] = (own, pairs)
    return model


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    margin = x @ model["family_w"].T
    chance = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)))
    chance /= chance.sum(axis=1, keepdims=True)
    best = margin.argmax(axis=1)
    out, score = np.empty(len(x), object), chance[np.arange(len(x)), best].astype(float)
    for k, f in enumerate(model["families"]):
        rows = np.flatnonzero(best == k)
        own, pairs = model["inside"][f]
        wins, total = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
        least = np.ones((len(rows), len(own)))
        for (a, b), w in pairs.items():
            m = x[rows] @ w
            i, j = own.index(a), own.index(b)
            for at, sign in ((i, 1), (j, -1)):
                wins[:, at] += sign * m > 0
                total[:, at] += sign * m
                least[:, at] = np.minimum(least[:, at], 1 / (1 + np.exp(-3 * sign * m)))
        order = wins * 1e6 + total
        chosen = order.argmax(axis=1)
        out[rows] = [own[c] for c in chosen]
        score[rows] *= least[np.arange(len(rows)), chosen]
    return out.tolist(), score


def learn(docs: DataFrame, labels: DataFrame, per_language: int = 400) -> dict | None:
    """A model from docs (doc_id, text) and labels (doc_id, label). Features are made in tasks; the bounded sample's go to
    the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, "text", SLICE)):
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["label", "x"])

    rows = labelled_sample(docs, labels, per_language).filter(F.col("text").rlike(r"\p{L}")).mapInArrow(run, "label string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in rows])
    return train(x, np.array([r["label"] for r in rows], object))


def identify(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """All columns, lang_pred and score. Columns of these names are replaced."""
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, text, SLICE):
                for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                    texts = part.column(text).to_pylist()
                    rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if shared.value else []
                    lang, score = ["und"] * len(texts), np.zeros(len(texts))
                    if rows:
                        got, p = predict(shared.value, np.stack([features(texts[i]) for i in rows]))
                        for i, g in zip(rows, got, strict=True):
                            lang[i] = g
                        score[rows] = p
                    yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def training_labels(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """doc_id and label of the rows that may be learnt from."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("label")).filter(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
