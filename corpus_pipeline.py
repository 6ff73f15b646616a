"""A corpus pipeline over ``documents``: each stage applies one operator of ``mailgrain.llm`` to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.llm.common import Scratch, drop_since, scratch_mark, table, unused
from mailgrain.llm.decontaminate import drop_contaminated
from mailgrain.llm.language import identify, learn, training_labels
from mailgrain.llm.near_dedup import deduplicate
from mailgrain.llm.pieces import encode
from mailgrain.llm.pii import redact
from mailgrain.llm.queries import model_path

#: Below this score a text is in no language that was learnt.
LEAST_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those without letters, or far from all that were learnt, go."""
    model = learn(docs.select("doc_id", "text"), training_labels(docs))
    own = {c: unused(docs, f"{c}_own") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    found = identify(docs.withColumnsRenamed(own), model)
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near duplicates: of the word shingles that either has,
    0.8 are in both."""
    return deduplicate(docs, similarity=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data replaced."""
    return redact(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece_ids, n_pieces."""
    return encode(docs.select("doc_id", "lang", "source", "text"), model_path()).select(
        "doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces")
    )


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]

#: Learnt models and piece encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        drop_since(spark, mark)  # the stage's own intermediate tables
    return STAGES[-1][1](spark, docs, sf_dir)
