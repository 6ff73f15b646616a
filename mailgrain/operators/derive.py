"""Derived tables: array columns as rows. Views, or written sorted by key for pruning by Parquet statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import email_of, items, refs_of
from ..schema import OTHER_TRAILERS, PEOPLE, TRAILER_COLUMN

ROW = ("message_id", "list", "date_unix_ns")


def involvement(m: DataFrame) -> DataFrame:
    """kind, email, message_id, list, date_unix_ns: author, recipients and people trailers, one row for each address."""
    sources = {"from": F.array("from_addr")} | {c: items(c) for c in PEOPLE if c in m.columns}
    sources |= {k: items(c) for k, c in (("to", "to_addrs"), ("cc", "cc_addrs")) if c in m.columns}
    pairs = F.concat(*[_named(k, a) for k, a in sources.items()])
    return m.select(*ROW, F.inline(pairs)).filter("email IS NOT NULL").select("kind", "email", *ROW).distinct()


def _named(kind: str, values):
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), email_of(x).alias("email")))


def touched(m: DataFrame, column: str = "touched_files", name: str = "path") -> DataFrame:
    return m.select(F.explode(column).alias(name), *ROW).distinct()


def trailer_refs(m: DataFrame) -> DataFrame:
    """kind, ref_kind, ref_value and the row's key for all trailers, named and long-tail; a long-tail kind is the trailer's name
    with underscores."""
    values = [F.transform(items(c), _kind(c)) for c in (*PEOPLE, *OTHER_TRAILERS) if c in m.columns]
    if "trailers_json" in m.columns:
        values.append(_others(F.from_json("trailers_json", "map<string,array<string>>")))
    refs = m.select(*ROW, F.inline(F.concat(*values))).select("kind", F.inline(refs_of(F.col("value"), F.col("kind"))), *ROW)
    return refs.distinct()


def _kind(kind):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))


def _others(by_name):
    """array<struct<kind,value>> of the trailers outside the named columns."""
    rest = F.filter(F.map_entries(by_name), lambda e: ~e["key"].isin(list(TRAILER_COLUMN)))
    each = F.flatten(F.transform(rest, lambda e: F.transform(e["value"], _kind(F.regexp_replace(e["key"], "-", "_")))))
    return F.coalesce(each, F.expr("cast(array() as array<struct<kind:string,value:string>>)"))


def long_tail(m: DataFrame) -> DataFrame:
    """kind, email and the row's key for trailers outside the named columns, from ``trailers_json``."""
    rows = m.select(*ROW, F.explode(F.from_json("trailers_json", "map<string,array<string>>")).alias("kind", "values"))
    rows = rows.filter(~F.col("kind").isin(list(TRAILER_COLUMN))).select("kind", F.explode("values").alias("value"), *ROW).select("kind", email_of(F.col("value")).alias("email"), *ROW)
    return rows.filter("email IS NOT NULL").distinct()


def path_vocabulary(m: DataFrame) -> DataFrame:
    return m.select(F.explode("touched_files").alias("path")).distinct()


def freshest(m: DataFrame, key: str = "message_id", order: str = "date_unix_ns", tie: str = "list") -> DataFrame:
    """One row per key, the one with the greatest date; of equals the first by ``tie``."""
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(order), F.asc(tie))
    return m.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
