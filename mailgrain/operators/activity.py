"""Profiles and activity: files, lists, authors, maintainers, timelines, churn, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import email_of, items, quarter_label
from ..lineage import written
from ..schema import PEOPLE
from .predicates import contains_ci, top, windowed


def corpus_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("list").agg(F.count("*").alias("messages"), F.min("date_unix_ns").alias("first_ns"), F.max("date_unix_ns").alias("last_ns")).orderBy("list")


def coverage_markdown(stats: DataFrame, generation: int, as_of: str, limit: int = 500) -> str:
    """A report of the largest lists; the table is bounded by ``limit``."""
    rows = stats.orderBy(F.desc("messages"), "list").limit(limit).collect()
    total = stats.agg(F.sum("messages")).first()[0] or 0
    lines = [f"Generation {generation}, as of {as_of}: {total} messages", "", "| list | messages |", "|---|---|"]
    return "\n".join([*lines, *[f"| {r['list']} | {r['messages']} |" for r in rows]])


def file_activity(m: DataFrame, path: str | None = None, function: str | None = None, since_ns=None, until_ns=None, list_name=None) -> DataFrame:
    """Messages that touch a file and/or a function; a path ending in a slash takes all below it."""
    m = windowed(m, since_ns, until_ns, list_name)
    if path and path.endswith("/"):
        m = m.filter(F.exists(items("touched_files"), lambda x: x.startswith(path)))
    elif path:
        m = m.filter(F.array_contains("touched_files", path))
    return m.filter(F.array_contains("touched_functions", function)) if function else m


def file_timeline(m: DataFrame, path: str, bucket: str = "quarter", since_ns=None, until_ns=None, list_name=None) -> DataFrame:
    """bucket, messages, authors: over all matching messages."""
    hit = file_activity(m, path, None, since_ns, until_ns, list_name).filter("date_unix_ns IS NOT NULL")
    return hit.groupBy(quarter_label(F.col("date_unix_ns"), bucket).alias("bucket")).agg(
        F.count("*").alias("messages"), F.countDistinct("from_addr").alias("authors")
    )


def timeline_events(m: DataFrame, path: str, order: str = "desc", limit: int = 100, since_ns=None, until_ns=None, list_name=None) -> DataFrame:
    """The messages of a file's timeline by date, undated ones last in both orders; the histogram is taken over all of them,
    whatever the limit."""
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    by = F.desc_nulls_last("date_unix_ns") if order == "desc" else F.asc_nulls_last("date_unix_ns")
    return file_activity(m, path, None, since_ns, until_ns, list_name).orderBy(by, "message_id", "list").limit(limit)


def churn(m: DataFrame, since_ns=None, until_ns=None, list_name=None, prefix: str | None = None, limit: int = 20, parts: int | None = None) -> DataFrame:
    """The most patched files: path, patches, authors, first_ns, last_ns, some_authors (five, alphabetical). Paths are
    exploded once into counts by path and author, which are written; both results read these. A message has one author, so
    patches add up. ``parts``: how many tasks share the counts, nearly as many as touched files."""
    rows = windowed(m, since_ns, until_ns, list_name).select("message_id", "from_addr", "date_unix_ns", F.explode("touched_files").alias("path"))
    rows = rows.filter(F.col("path").startswith(prefix)) if prefix else rows
    once = rows.groupBy("path", "from_addr", "message_id").agg(F.min("date_unix_ns").alias("first_ns"), F.max("date_unix_ns").alias("last_ns"))
    once = once.repartition(parts, "path", "from_addr") if parts else once
    pairs = once.groupBy("path", "from_addr").agg(F.count("message_id").alias("n"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))
    pairs = written(pairs, "churn")
    found = pairs.groupBy("path").agg(
        F.sum("n").alias("patches"), F.count("from_addr").alias("authors"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")
    ).orderBy(F.desc("patches"), F.desc("authors"), "path").limit(limit)
    top_paths = found.select("path") if limit > 10_000 else F.broadcast(found.select("path"))
    w = W.partitionBy("path").orderBy("from_addr")
    names = pairs.filter("from_addr IS NOT NULL").join(top_paths, "path").withColumn("n", F.row_number().over(w)).filter("n <= 5")
    few = names.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("from_addr")), ",").alias("some_authors"))
    return found.join(few, "path", "left").orderBy(F.desc("patches"), F.desc("authors"), "path")


def author_profile(m: DataFrame, address: str, since_ns=None, until_ns=None) -> DataFrame:
    """One row of counters over all that an author sent."""
    own = windowed(m, since_ns, until_ns).filter(F.col("from_addr") == address.lower())
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    has = lambda c: F.size(items(c)) > 0
    return own.agg(
        F.count("*").alias("messages"),
        count(F.col("has_patch"))("patches"),
        count(F.col("is_cover_letter"))("covers"),
        count(F.col("in_reply_to").isNotNull())("replies"),
        count(F.col("series_version") > 1)("rerolls"),
        count(has("fixes"))("with_fixes"),
        count(has("cc_stable"))("to_stable"),
        count(has("reviewed_by"))("reviewed"),
        count(has("acked_by"))("acked"),
        count(has("tested_by"))("tested"),
        count(has("signed_off_by"))("signed_off"),
        F.countDistinct("subject_normalized").alias("subjects"),
        F.countDistinct("list").alias("lists"),
        F.min("date_unix_ns").alias("first_ns"),
        F.max("date_unix_ns").alias("last_ns"),
    )


def author_lists(m: DataFrame, address: str) -> DataFrame:
    own = m.filter(F.col("from_addr") == address.lower())
    return own.groupBy("list").agg(F.count("*").alias("messages"), F.sum(F.col("has_patch").cast("int")).alias("patches")).orderBy(F.desc("messages"), "list")


def mentions_beyond_authored(m: DataFrame, address: str) -> DataFrame:
    """Messages that name an address in a people trailer and were sent by someone else."""
    named = F.exists(F.concat(*[items(c) for c in PEOPLE if c in m.columns]), lambda x: contains_ci(x, address))
    return m.filter(named & ~F.col("from_addr").eqNullSafe(F.lit(address.lower())))


def author_footprint(m: DataFrame, address: str, limit: int | None = 100) -> DataFrame:
    """message_id, list, date_unix_ns, roles: every way in which an address takes part in a message, once."""
    low = address.lower()
    key = ["message_id", "list", "date_unix_ns"]
    sources = [m.filter(F.col("from_addr") == low).select(*key, F.lit("author").alias("role"))]
    for c in (*PEOPLE, "to_addrs", "cc_addrs"):
        if c in m.columns:
            named = F.exists(items(c), lambda x: F.coalesce(email_of(x) == low, F.lit(False)))
            sources.append(m.filter(named).select(*key, F.lit(c).alias("role")))
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    grouped = out.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return top(grouped, limit)


def trailer_counts(m: DataFrame, kinds: tuple[str, ...] = ("reviewed_by", "acked_by", "tested_by", "signed_off_by")) -> DataFrame:
    """email, a count for each kind of trailer, last_ns."""
    rows = None
    for k in kinds:
        part = m.select("date_unix_ns", F.lit(k).alias("kind"), F.explode(k).alias("raw"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.select("date_unix_ns", "kind", email_of(F.col("raw")).alias("email")).filter("email IS NOT NULL")
    return rows.groupBy("email").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in kinds], F.max("date_unix_ns").alias("last_ns"))


def maintainer_profile(m: DataFrame, path: str, declared: DataFrame, since_ns=None, until_ns=None, stale_before_ns: int | None = None) -> DataFrame:
    """email, declared, observed counts and status for a path: ``active``, ``stale`` (declared, silent since a bound or ever) or
    ``unlisted`` (active but not declared). declared: email."""
    seen = trailer_counts(file_activity(m, path, None, since_ns, until_ns))
    both = declared.select("email").distinct().withColumn("declared", F.lit(True)).join(seen, "email", "full")
    silent = F.col("last_ns").isNull() | (F.col("last_ns") < stale_before_ns if stale_before_ns is not None else F.lit(False))
    status = F.when(F.col("declared") & silent, "stale").when(F.col("declared"), "active").otherwise("unlisted")
    return both.withColumns({"status": status, "declared": F.coalesce("declared", F.lit(False))})


def declared_vs_observed(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """email, side: who is declared but never observed, and the reverse."""
    d, o = declared.select("email").distinct(), observed.select("email").distinct()
    only = d.join(o, "email", "left_anti").withColumn("side", F.lit("declared_only"))
    return only.unionByName(o.join(d, "email", "left_anti").withColumn("side", F.lit("observed_only")))
