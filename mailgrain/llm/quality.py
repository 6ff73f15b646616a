"""Quality scores by Bradley-Terry ranking.

A text becomes a few shares and sizes, standardised, with their squares. From the labelled sample, preference pairs (a text
of label 1 over one of label 0) are drawn, and weights are fitted by logistic loss on the features' differences: a text's
score is its strength in a Bradley-Terry model. Strengths go through a logistic curve fitted to the labels, so the score
reads as the chance of label 1. ``kept`` compares the strength with the quantile of all documents' strengths, by default at
the share of label 0 among all labels to learn from.

Training uses at most ``per_label`` texts of each label. Each stands for as many as there are to one that was taken, so the
curve and the share don't depend on which label reaches that number; scoring reads every whole text. Defined results: null text counts
as empty text, which is scored like any other; with one label or none to learn from every score is 0.5; repeated rows are
scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out
from .samples import labelled_sample
from .shingles import pieces

# Bytes of text put into features at once: they take some 30 times as much memory.
SLICE = 2 << 20
# Byte classes.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>@^_=+~\\/{}[]",
    "loud": b"!?",
    "stop": b".,;:",
    "space": b" \t\n\r\x0b\x0c",
}


def _distinct(lists: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and distinct members of each list."""
    count = np.asarray(pc.list_value_length(lists), np.int64)
    coded = pc.dictionary_encode(lists.flatten()).indices.to_numpy()
    key = np.unique(np.repeat(np.arange(n), count) * (int(coded.max(initial=0)) + 1) + coded)
    return count, np.bincount(key // (int(coded.max(initial=0)) + 1), minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(t.as_buffer() for t in texts), np.uint8)
    code = np.full(256, len(CLASSES), np.uint8)
    for k, members in enumerate(CLASSES.values()):
        code[list(members)] = k
    ends = np.cumsum(size)
    counts = np.array([np.bincount(code[data[e - k : e]], minlength=len(CLASSES) + 1) for k, e in zip(size, ends, strict=True)]).reshape(n, -1)
    words, kinds = _distinct(pc.ascii_split_whitespace(texts), n)
    lines, line_kinds = _distinct(pc.split_pattern(texts, "\n"), n)
    share = counts / np.maximum(1, size)[:, None]
    letters = np.maximum(1, counts[:, 0] + counts[:, 1])
    return np.column_stack(
        [
            share,
            counts[:, 0] / letters,
            np.log1p(size),
            np.log1p(words),
            kinds / np.maximum(1, words),
            np.log1p(kinds),
            line_kinds / np.maximum(1, lines),
            size / np.maximum(1, words),
        ]
    )


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, z * z / 6])


def newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression without a bias."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: int = 20_000, quantile: float | None = None) -> dict | None:
    """weight: how many labelled texts each row stands for."""
    if not (0 < y.sum() < len(y)):
        return None
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)) + 1e-6
    z = expanded(x, mean, scale)
    rng = np.random.default_rng(11)
    better, worse = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    w = newton(z[better] - z[worse], np.ones(pairs), ridge=1.0)
    strength = z @ w
    unit = np.sqrt(np.average((strength - np.average(strength, weights=weight)) ** 2, weights=weight)) + 1e-9
    curve = newton(np.column_stack([strength / unit, np.ones(len(y))]), y.astype(float), ridge=0.1, weight=weight)
    return {
        "mean": mean, "scale": scale, "w": w, "unit": float(unit), "curve": curve,
        "quantile": float(np.average(y == 0, weights=weight)) if quantile is None else quantile,
    }


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 4000, quantile: float | None = None) -> dict | None:
    """A model from docs (doc_id, text) and labels (doc_id, label 0 or 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", SLICE):
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(features(b.column("text")).tolist())], ["label", "x"])

    rows = labelled_sample(docs, labels, per_label).mapInArrow(run, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))
    if not rows:
        return None
    known = labels.filter(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n")).collect()
    stands_for = {r["label"]: max(1.0, r["n"] / per_label) for r in known}
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    return train(x, y, np.array([stands_for.get(label, 1.0) for label in y.tolist()]), quantile=quantile)


def in_order(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def at_share(numbers: DataFrame, column: str, share: float) -> int | None:
    """The value at place ceil(share * (rows - 1)), from 0, of a bigint column in order, or None without rows. Exact: each
    round counts the next 16 bits of the numbers that agree so far, so 65536 rows at most reach the driver."""
    prefix, place = 0, None
    for shift in (48, 32, 16, 0):
        part = numbers if place is None else numbers.filter(F.shiftright(column, shift + 16) == prefix)
        counts = sorted(tuple(r) for r in part.groupBy(F.shiftright(column, shift)).count().collect())
        if place is None:
            if not counts:
                return None
            place = math.ceil(share * (sum(n for _, n in counts) - 1))
        for prefix, n in counts:
            if place < n:
                break
            place -= n
    return prefix


def rank(docs: DataFrame, model: dict | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (by default all), score and kept. Columns of these names are replaced. What is carried is
    written once with the strengths, as the quantile needs all of them before any row can be kept."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "kept") and (carry is None or f.name in carry)]
    names = [f.name for f in kept]
    columns = [F.col(f"`{n}`") for n in names]
    if not model:
        return docs.select(*columns, F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "_score double", "_order bigint"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in pieces(whole, "_text", SLICE):
                # Rounded: sums of equal rows may differ in their last bits from batch to batch.
                s = np.round(expanded(features(b.column("_text")), m["mean"], m["scale"]) @ m["w"], 9)
                score = 1 / (1 + np.exp(-np.clip(s / m["unit"] * m["curve"][0] + m["curve"][1], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(n) for n in names], pa.array(score), pa.array(in_order(s))], [*names, "_score", "_order"]
                )

    scored = docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, schema)
    scored = Scratch(docs.sparkSession).write(scored, "strengths")
    cut = at_share(scored, "_order", model["quantile"])
    return scored.select(*columns, F.col("_score").alias("score"), (F.col("_order") >= F.lit(cut).cast("bigint")).alias("kept"))


def training_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id and label of the rows that may be learnt from."""
    return labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
