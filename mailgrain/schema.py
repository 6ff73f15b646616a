"""The messages table: one row per (message_id, list)."""

from __future__ import annotations

from pyspark.sql import types as T

PEOPLE = (
    "signed_off_by", "reviewed_by", "acked_by", "tested_by", "co_developed_by", "reported_by", "suggested_by", "helped_by",
    "assisted_by",
)
OTHER_TRAILERS = ("fixes", "link", "closes", "cc_stable")
#: Trailer name in a message, lower-case, to column.
TRAILER_COLUMN = {c.replace("_", "-"): c for c in (*PEOPLE, "fixes", "link", "closes")} | {"co-authored-by": "assisted_by"}

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_A = T.ArrayType(T.StringType())

MESSAGES = T.StructType(
    [
        T.StructField("message_id", _S, False),
        T.StructField("list", _S, False),
        T.StructField("shard", _S),
        T.StructField("commit_oid", _S),
        *[T.StructField(c, _S) for c in ("from_addr", "from_name", "subject_raw", "subject_normalized")],
        T.StructField("subject_tags", _A),
        T.StructField("date_unix_ns", _L),
        T.StructField("in_reply_to", _S),
        T.StructField("references", _A),
        T.StructField("to_addrs", _A),
        T.StructField("cc_addrs", _A),
        T.StructField("series_version", _I),
        T.StructField("series_index", _I),
        T.StructField("series_total", _I),
        T.StructField("is_cover_letter", _B),
        T.StructField("has_patch", _B),
        T.StructField("touched_files", _A),
        T.StructField("touched_functions", _A),
        *[T.StructField(c, _I) for c in ("files_changed", "insertions", "deletions")],
        *[T.StructField(c, _A) for c in (*PEOPLE, *OTHER_TRAILERS)],
        T.StructField("trailers_json", _S),
        T.StructField("body_length", _L),
        T.StructField("body_sha256", _S),
        T.StructField("schema_version", _I),
        T.StructField("body", _S),
        T.StructField("prose", _S),
        T.StructField("patch", _S),
    ]
)

#: Raw archive rows that parsing starts from.
RAW = "list string, shard string, commit_oid string, commit_date_ns bigint, raw binary"

COMMITS = "repo string, sha string, subject string, author_email string, author_date_ns bigint, patch_id string"
