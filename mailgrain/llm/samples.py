"""Bounded labelled samples for the trained models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The most label values a model takes; the most frequent ones count.
MAX_LABELS = 200


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """Up to ``per_label`` (text, label) rows of each label. docs: doc_id, text; labels: doc_id, label, neither null. The rows
    with the smallest hashes of their ids are taken, whatever order or partition they come in, so at most
    ``per_label * MAX_LABELS`` ids are broadcast."""
    known = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS)
    # About twice as many rows of a label as are wanted have a hash below this, so ranking sees no more of a label than that;
    # that fewer than wanted have one is as good as impossible.
    share = F.least(F.lit(1.0), (2 * per_label + 200) / F.col("n"))
    known = known.select("label", (F.lit(-(2.0**63)) + share * 2.0**64).alias("bound"))
    ranked = labels.join(F.broadcast(known), "label").withColumn("h", F.xxhash64("doc_id"))
    ranked = ranked.filter(F.col("h").cast("double") <= F.col("bound")).drop("bound")
    place = F.row_number().over(W.partitionBy("label").orderBy("h", "doc_id"))
    chosen = ranked.withColumn("place", place).filter(F.col("place") <= per_label).select("doc_id", "label")
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "label")
