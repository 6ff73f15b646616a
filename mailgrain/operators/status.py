"""Verdicts about patches: thread state, fix status, stable backports, and the commit table that they lean on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import items
from .predicates import top
from .threads import DAY_NS, newer_version, replies, series

NACK = r"(?i)(?:^|\s)(?:NACK|NAK)(?:\s|[:.!]|$)"
#: A release in a subject: after a patch tag, or as a version of Linux.
RELEASE = r"(?:\[PATCH[^\]]*?\s|\bLinux\s)([0-9]+\.[0-9]+(?:\.[0-9]+)?)"


def subject_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def commits_for(m: DataFrame, commits: DataFrame, window_days: int = 90) -> DataFrame:
    """message_id, repo, sha, author_date_ns: commits with a message's subject and author, dated within the window. An equi-join on
    subject and author; the band is a residual condition."""
    c = commits.select("repo", "sha", "author_date_ns", subject_key(F.col("subject")).alias("_s"), F.lower("author_email").alias("_a"))
    k = m.select("message_id", "date_unix_ns", subject_key(F.col("subject_normalized")).alias("_s"), F.lower("from_addr").alias("_a"))
    near = F.abs(F.col("author_date_ns") - F.col("date_unix_ns")) <= window_days * DAY_NS
    return k.join(c, ["_s", "_a"]).filter(near).select("message_id", "repo", "sha", "author_date_ns")


def by_sha(commits: DataFrame, prefix: str) -> DataFrame:
    return commits.filter(F.col("sha").startswith(prefix.lower()))


def by_patch_id(commits: DataFrame, patch_id: str) -> DataFrame:
    return commits.filter(F.col("patch_id") == patch_id)


def repos_and_counts(tips: DataFrame, commits: DataFrame) -> DataFrame:
    """repo, tip_sha, commits: each known repository, also those without commits."""
    return tips.join(commits.groupBy("repo").agg(F.count("*").alias("commits")), "repo", "left").withColumn("commits", F.coalesce("commits", F.lit(0))).orderBy("repo")


def thread_states(m: DataFrame, tid: DataFrame, commits: DataFrame, now_ns: int, abandoned_days: int = 180) -> DataFrame:
    """message_id, tid, state of each message that starts a thread: merged, rfc, superseded, nacked, under_review, abandoned or
    unknown, the first that holds. A nack stands as a word in a reply by someone else than the thread's author."""
    author = m.join(tid, "message_id").filter("message_id = tid").groupBy("tid").agg(F.min("from_addr").alias("author"))
    rows = m.join(tid, "message_id").join(author, "tid", "left")
    root = rows.filter("message_id = tid").select("tid", "message_id", "subject_tags", "has_patch", "date_unix_ns")
    thread = rows.groupBy("tid").agg(
        F.max("date_unix_ns").alias("last_ns"),
        F.max(((F.col("message_id") != F.col("tid")) & ~F.col("from_addr").eqNullSafe(F.col("author")) & F.col("prose").rlike(NACK)).cast("int")).alias("nacked"),
        F.max(((F.size(items("reviewed_by")) + F.size(items("acked_by"))) > 0).cast("int")).alias("reviewed"),
        F.max((F.col("has_patch") | F.coalesce(F.col("is_cover_letter"), F.lit(False))).cast("int")).alias("patched"),
        F.count("*").alias("messages"),
    )
    seeds = rows.filter("message_id = tid").drop("tid", "author")  # a merged patch of a series doesn't mark the others
    merged = commits_for(seeds, commits, 90).select(F.col("message_id").alias("tid")).distinct().withColumn("merged", F.lit(1))
    newer = newer_version(m).select(F.col("message_id").alias("tid")).distinct().withColumn("newer", F.lit(1))  # of the thread's first one
    d = root.join(thread, "tid").join(merged, "tid", "left").join(newer, "tid", "left")
    rfc = F.exists(items("subject_tags"), lambda t: F.lower(t).rlike(r"(?:^|\s)rfc(?:\s|$)"))
    state = (
        F.when(F.col("merged") == 1, "merged")
        .when(rfc, "rfc")
        .when(F.col("newer") == 1, "superseded")
        .when(F.col("nacked") == 1, "nacked")
        .when((F.col("patched") == 1) & (F.col("last_ns") >= now_ns - abandoned_days * DAY_NS), "under_review")
        .when(F.col("patched") == 1, "abandoned")
        .otherwise("unknown")
    )
    return d.select("message_id", "tid", state.alias("state"), "reviewed", "messages")


def fix_status(m: DataFrame, refs: DataFrame, commits: DataFrame, report: dict) -> DataFrame:
    """One row: state (merged, pending_patch, duplicate_suspected, no_fix_found, or unknown without a report) and how many messages point at a report. report: any of
    message_id, bug_hash, url, email, sha."""
    kinds = {"message_id": "archive_mid", "bug_hash": "bug_hash", "url": "url_lc", "email": "email", "sha": "sha_prefix"}
    wanted = [(F.col("ref_kind") == kinds[k]) & (F.col("ref_value") == v.lower()) for k, v in report.items() if v]
    ids = refs.filter(reduce(lambda a, b: a | b, wanted)).select("message_id").distinct()
    hits = m.join(ids, "message_id", "left_semi")
    hits = hits.filter(F.col("message_id") != report["message_id"]) if report.get("message_id") else hits
    dup = F.contains(F.lower("prose"), F.lit("#syz dup:"))
    mine = F.col("message_id") == F.lit(report.get("message_id"))
    counts = hits.agg(F.count("*").alias("correlated"), F.sum((F.col("has_patch") | F.coalesce("is_cover_letter", F.lit(False))).cast("int")).alias("patches"))
    about = m.filter(mine | (F.col("in_reply_to") == F.lit(report.get("message_id")))) if report.get("message_id") else hits
    dups = about.agg(F.sum(F.coalesce(dup, F.lit(False)).cast("int")).alias("dups"))
    landed = commits_for(hits.filter("has_patch"), commits).agg(F.countDistinct("sha").alias("commits"))
    known = bool(report.get("message_id") or report.get("bug_hash"))
    state = (
        F.when(F.col("commits") > 0, "merged")
        .when(F.coalesce("patches", F.lit(0)) > 0, "pending_patch")
        .when(F.coalesce("dups", F.lit(0)) > 0, "duplicate_suspected")
        .otherwise("no_fix_found" if known else "unknown")
    )
    one = counts.crossJoin(landed).crossJoin(dups)  # one row each
    return one.select(state.alias("state"), "correlated", F.coalesce("patches", F.lit(0)).alias("patches"), "commits")


def stable_backports(m: DataFrame, commits: DataFrame, subject: str, sha: str | None = None, stable_list: str = "stable", commits_list: str = "stable-commits") -> DataFrame:
    """One row: status, releases (sorted, comma-joined), autosel and evidence. picked_up: a commit of a stable repository, or
    a message of the list of stable commits, has the subject or names the commit; autosel_skipped: only an opt-out is
    found; pending: it was nominated on the stable list; no_evidence."""
    low = F.lit(subject.lower())
    about = F.contains(F.lower("subject_raw"), low) | (F.contains(F.lower("prose"), F.lit(sha.lower())) if sha else F.lit(False))
    is_commit, is_nomination = F.col("list") == commits_list, F.col("list") == stable_list
    release = F.nullif(F.regexp_extract("subject_raw", RELEASE, 1), F.lit(""))
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0))
    d = m.filter(about).agg(
        F.collect_set(F.when(is_commit, release)).alias("said"),
        count(is_commit).alias("confirmed"),
        count(is_nomination).alias("nominated"),
        count(is_nomination & F.contains(F.lower("subject_raw"), F.lit("autosel"))).alias("by_autosel"),
        count(F.contains(F.lower("subject_raw"), F.lit("noautosel"))).alias("skipped"),
    )
    hit = F.contains(F.lower("subject"), low) | (F.col("sha").startswith(sha.lower()) if sha else F.lit(False))
    c = commits.filter(F.col("repo").startswith("linux-stable") & hit).agg(
        F.count("*").alias("committed"), F.collect_set(F.nullif(F.regexp_extract("subject", RELEASE, 1), F.lit(""))).alias("in_commits")
    )
    status = (
        F.when((F.col("committed") > 0) | (F.col("confirmed") > 0), "picked_up")
        .when(F.col("skipped") > 0, "autosel_skipped")
        .when(F.col("nominated") > 0, "pending")
        .otherwise("no_evidence")
    )
    releases = F.array_join(F.array_sort(F.array_union("said", "in_commits")), ",")  # releases: a bounded set
    evidence = F.col("committed") + F.col("confirmed") + F.col("nominated")
    return d.crossJoin(c).select(status.alias("status"), releases.alias("releases"), (F.col("by_autosel") > 0).alias("autosel"), evidence.alias("evidence"))


def explain_patch(m: DataFrame, message_id: str) -> DataFrame:
    """section, message_id, date_unix_ns, subject_raw: the message, its series, and the replies to it."""
    cols = ["message_id", "date_unix_ns", "subject_raw"]
    own = top(m.filter(F.col("message_id") == message_id), 1).select(F.lit("message").alias("section"), *cols)
    return own.unionByName(series(m, message_id).select(F.lit("series").alias("section"), *cols)).unionByName(
        replies(m, message_id).select(F.lit("reply").alias("section"), *cols)
    )
