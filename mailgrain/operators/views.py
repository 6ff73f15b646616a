"""Response shapes: hits, citations, message, patch and thread views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import patch_of, prose_of, quarter_label
from .predicates import top


def slug(message_id: Column) -> Column:
    return F.regexp_replace(F.lower(message_id), "[^a-z0-9]+", "-")


def hits(m: DataFrame) -> DataFrame:
    """The columns of a result list, with a citation key ``list/YYYY-MM/slug`` and place ``N/M`` in the series."""
    place = F.when(F.col("series_total") > 0, F.concat_ws("/", "series_index", "series_total"))
    return m.select(
        "message_id", "list", "from_addr", "from_name", "subject_raw", "date_unix_ns", "has_patch", "is_cover_letter", "series_version",
        place.alias("series_place"),
        F.concat_ws("/", "list", F.coalesce(quarter_label(F.col("date_unix_ns"), "month"), F.lit("undated")), slug(F.col("message_id"))).alias("cite_key"),
    )


def message_view(m: DataFrame, message_id: str) -> DataFrame:
    """The freshest copy of a message with prose and patch."""
    return top(m.filter(F.col("message_id") == message_id), 1)


def split_body(docs: DataFrame, body: str = "body") -> DataFrame:
    return docs.withColumns({"prose": prose_of(F.col(body)), "patch": patch_of(F.col(body))})


def freshness(generations: DataFrame, now_ns: int) -> DataFrame:
    """generation, as_of_ns, lag_seconds of the newest generation row."""
    last = generations.agg(F.max(F.struct("generation", "as_of_ns")).alias("g"))
    return last.select("g.generation", "g.as_of_ns", ((F.lit(now_ns) - F.col("g.as_of_ns")) / 1e9).cast("bigint").alias("lag_seconds"))
