"""Structured predicates over messages: equality, membership, substrings, patterns, and their counts.

All use one rule for dates (at or after ``since``, before ``until``, undated rows drop out once a bound is set) and return
the newest rows first with ties by id, so a limit is a true top-N (``TakeOrderedAndProject``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import checked_needle, checked_pattern
from ..functions.text import email_of, items
from ..schema import OTHER_TRAILERS, PEOPLE

SCALARS = ("message_id", "list", "shard", "commit_oid", "from_addr", "from_name", "subject_raw", "subject_normalized", "in_reply_to", "body_sha256")
LISTS = ("touched_files", "touched_functions", "references", "subject_tags", *OTHER_TRAILERS)
FIELDS = (*SCALARS, *LISTS, *PEOPLE)


def newest() -> list[Column]:
    return [F.desc_nulls_last("date_unix_ns"), F.asc("message_id"), F.asc("list")]


def windowed(m: DataFrame, since_ns: int | None = None, until_ns: int | None = None, list_name: str | None = None) -> DataFrame:
    if since_ns is not None:
        m = m.filter(F.col("date_unix_ns") >= since_ns)
    if until_ns is not None:
        m = m.filter(F.col("date_unix_ns") < until_ns)
    return m.filter(F.col("list") == list_name) if list_name else m


def top(m: DataFrame, limit: int | None) -> DataFrame:
    return m if limit is None else m.orderBy(*newest()).limit(limit)


def matches(field: str, values: list[str]) -> Column:
    """Scalars and lists match exactly; people trailers by their e-mail address in any case."""
    if field in SCALARS:
        return F.col(field) == values[0] if len(values) == 1 else F.col(field).isin(values)
    if field in LISTS:
        return F.array_contains(field, values[0]) if len(values) == 1 else F.exists(items(field), lambda x: x.isin(values))
    if field in PEOPLE:
        low = [v.lower() for v in values]
        return F.exists(items(field), lambda x: F.coalesce(email_of(x).isin(low), F.lit(False)))
    raise ValueError(f"unknown field {field}")


def eq(m: DataFrame, field: str, value: str, since_ns=None, until_ns=None, list_name=None, limit: int | None = 100) -> DataFrame:
    return top(windowed(m, since_ns, until_ns, list_name).filter(matches(field, [value])), limit)


def in_list(m: DataFrame, field: str, values: list[str], since_ns=None, until_ns=None, list_name=None, limit: int | None = 100) -> DataFrame:
    return top(windowed(m, since_ns, until_ns, list_name).filter(matches(field, values)), limit)


def count_summary(m: DataFrame, field: str, value: str, since_ns=None, until_ns=None, list_name=None) -> DataFrame:
    return windowed(m, since_ns, until_ns, list_name).filter(matches(field, [value])).agg(
        F.count("*").alias("count"), F.countDistinct("from_addr").alias("distinct_authors"),
        F.min("date_unix_ns").alias("first_ns"), F.max("date_unix_ns").alias("last_ns"),
    )


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def substr_subject(m: DataFrame, needle: str, since_ns=None, until_ns=None, list_name=None, limit: int | None = 100) -> DataFrame:
    return top(windowed(m, since_ns, until_ns, list_name).filter(contains_ci(F.col("subject_raw"), checked_needle(needle, 1))), limit)


def substr_trailers(m: DataFrame, name: str, value: str, since_ns=None, until_ns=None, list_name=None, limit: int | None = 100) -> DataFrame:
    if name not in (*PEOPLE, *OTHER_TRAILERS):
        raise ValueError(f"unknown trailer {name}")
    return top(windowed(m, since_ns, until_ns, list_name).filter(F.exists(items(name), lambda x: contains_ci(x, value))), limit)


def trailer_mentions(m: DataFrame, address: str, since_ns=None, until_ns=None, list_name=None, limit: int | None = 100) -> DataFrame:
    people = F.concat(*[items(c) for c in PEOPLE])
    return top(windowed(m, since_ns, until_ns, list_name).filter(F.exists(people, lambda x: contains_ci(x, address))), limit)


def regex(m: DataFrame, field: str, pattern: str, anchor_required: bool = False, since_ns=None, until_ns=None, list_name=None, limit: int | None = 100) -> DataFrame:
    column = {"subject": "subject_raw", "from": "from_addr", "prose": "prose", "patch": "patch"}[field]
    return top(windowed(m, since_ns, until_ns, list_name).filter(F.col(column).rlike(checked_pattern(pattern, anchor_required))), limit)


def ref_lookup(refs: DataFrame, m: DataFrame, ref_kind: str, value: str, kind: str | None = None, limit: int | None = 100) -> DataFrame:
    """Messages with a trailer reference: the newest ids first, and only those are joined."""
    hit = refs.filter((F.col("ref_kind") == ref_kind) & (F.col("ref_value") == value.lower()))
    hit = hit.filter(F.col("kind") == kind) if kind else hit
    return joined_top(hit, m, limit)


def joined_top(hit: DataFrame, m: DataFrame, limit: int | None) -> DataFrame:
    picked = top(hit.select("message_id", "list", "date_unix_ns").distinct(), limit)
    return top(m.join(picked.drop("date_unix_ns"), ["message_id", "list"]), limit)


def header_search(involvement: DataFrame, m: DataFrame, kind: str, value: str, mode: str = "contains", since_ns=None, list_name=None, limit: int | None = 100) -> DataFrame:
    """Messages by an address in a header or trailer; kind ``any`` takes all, each message once. Wildcards are literal."""
    low = F.lit(value.lower())
    hit = windowed(involvement, since_ns, None, list_name).filter(F.startswith("email", low) if mode == "prefix" else F.contains("email", low))
    return joined_top(hit if kind == "any" else hit.filter(F.col("kind") == kind), m, limit)


#: Kind of involvement to the column that holds it.
INVOLVED = {"from": "from_addr", "to": "to_addrs", "cc": "cc_addrs"}


def involved(m: DataFrame, kind: str, value: str, mode: str = "contains", since_ns=None, list_name=None, limit: int | None = 100) -> DataFrame:
    """As :func:`header_search`, straight from the messages: only the columns of the kind that is asked for are read, and an
    author's address is tested where it can be pushed to the scan."""
    low = F.lit(value.lower())
    test = (lambda x: F.startswith(x, low)) if mode == "prefix" else (lambda x: F.contains(x, low))

    def has(kind: str) -> Column:
        if kind == "from":
            return F.coalesce(test(F.col("from_addr")), F.lit(False))
        return F.exists(items(INVOLVED.get(kind, kind)), lambda x: F.coalesce(test(email_of(x)), F.lit(False)))

    kinds = [k for k in ("from", "to", "cc", *PEOPLE) if INVOLVED.get(k, k) in m.columns] if kind == "any" else [kind]
    hit = has(kinds[0])
    for k in kinds[1:]:
        hit = hit | has(k)
    return top(windowed(m, since_ns, None, list_name).filter(hit), limit)


def expand_citation(m: DataFrame, token: str, limit: int | None = 25) -> DataFrame:
    """A message id, 7 to 40 hex digits of a fixed commit, or a CVE number."""
    token = token.strip().strip("<>")
    if re.fullmatch(r"(?i)CVE-\d{4}-\d{4,}", token):
        return top(m.filter(contains_ci(F.col("subject_raw"), token)), limit)
    if re.fullmatch(r"[0-9a-fA-F]{7,40}", token):
        return top(m.filter(F.exists(items("fixes"), lambda x: contains_ci(x, token))), limit)
    return top(m.filter(F.col("message_id") == token), limit)


def find(m: DataFrame, query: str, limit: int | None = 25) -> DataFrame:
    """Routes by shape: citation, author address, else a substring of patch or prose."""
    q = query.strip()
    if re.fullmatch(r"(?i)CVE-\d{4}-\d{4,}|[0-9a-f]{7,40}|<[^<>\s]+@[^<>\s]+>", q):
        return expand_citation(m, q, limit)
    if re.fullmatch(r"[^\s@]+@[^\s@]+", q):
        return top(m.filter((F.col("from_addr") == q.lower()) | (F.col("message_id") == q)), limit)
    return top(m.filter(F.contains("patch", F.lit(checked_needle(q))) | F.contains("prose", F.lit(q))), limit)


def keyset_page(df: DataFrame, limit: int, after: tuple | None = None, sort: str = "date_unix_ns", key: str = "message_id") -> DataFrame:
    """The next page by (sort descending, key ascending). The bound filters before the limit, so every page is full."""
    if after is not None:
        last, last_key = after
        df = df.filter((F.col(sort) < last) | ((F.col(sort) == last) & (F.col(key) > last_key)))
    return df.orderBy(F.desc(sort), F.asc(key)).limit(limit)
