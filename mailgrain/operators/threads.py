"""Reply graph: thread roots, members, propagation to cover letters, series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import items
from ..lineage import checkpointed
from .components import components, links

DAY_NS = 86400 * 10**9
#: Series of more than one version that a join may broadcast.
MAX_BROADCAST = 200_000


def parents(m: DataFrame) -> DataFrame:
    """message_id and the id it replies to: In-Reply-To, else the first reference; null if that isn't in the corpus."""
    ids = m.select("message_id").distinct()
    edge = m.groupBy("message_id").agg(F.min(F.coalesce("in_reply_to", F.get(items("references"), F.lit(0)))).alias("parent"))
    known = ids.withColumnRenamed("message_id", "parent").withColumn("there", F.lit(True))
    return edge.join(known, "parent", "left").select("message_id", F.when(F.col("there"), F.col("parent")).alias("parent"))


def thread_roots(edges: DataFrame) -> DataFrame:
    """message_id, tid by pointer jumping: every round halves the way to the root, so a chain of n takes log2(n) rounds.
    Members of a reply cycle, and what hangs on it, get the smallest id that they can reach on it."""
    n = edges.count()
    p = edges.select("message_id", F.coalesce("parent", "message_id").alias("up"))
    p = p.withColumn("least", F.least("message_id", "up"))
    for _ in range(math.ceil(math.log2(max(n, 2))) + 1):
        q = p.select(F.col("message_id").alias("up"), F.col("up").alias("next"), F.col("least").alias("next_least"))
        jumped = p.join(q, "up").select("message_id", F.col("next").alias("up"), F.least("least", "next_least").alias("least"), (F.col("next") != F.col("up")).alias("moved"))
        jumped = checkpointed(jumped)
        done = jumped.filter("moved").isEmpty()
        p = jumped.drop("moved")
        if done:
            break
    roots = edges.filter("parent IS NULL").select(F.col("message_id").alias("up"), F.lit(True).alias("is_root"))
    p = p.join(roots, "up", "left")
    # What is not under a root is on or under a cycle: the smallest id seen from where its pointer ends is the cycle's.
    ends = p.filter("is_root IS NULL").select(F.col("message_id").alias("up"), F.col("least").alias("cycle_least"))
    return p.join(ends, "up", "left").select("message_id", F.when(F.col("is_root"), F.col("up")).otherwise(F.col("cycle_least")).alias("tid"))


def with_fallback(m: DataFrame, tid: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Roots with the same list, subject and author as an earlier root of the last 30 days join its thread; their replies
    follow unless ``strict_compat``."""
    rows = m.join(tid, "message_id").filter(F.col("message_id") == F.col("tid"))
    keyed = rows.filter("subject_normalized IS NOT NULL AND date_unix_ns IS NOT NULL")
    key = F.to_json(F.struct("list", "subject_normalized", "from_addr"), {"ignoreNullFields": "false"})
    keyed = keyed.select(key.alias("key"), F.col("date_unix_ns").alias("at"), "message_id")
    joined = earliest_before(keyed, 30 * DAY_NS).groupBy(F.col("message_id").alias("tid")).agg(F.min("older").alias("older"))
    out = tid.join(joined, "tid", "left")
    moves = F.col("older").isNotNull() & (F.lit(not strict_compat) | (F.col("message_id") == F.col("tid")))
    return out.select("message_id", F.when(moves, F.col("older")).otherwise(F.col("tid")).alias("tid"))


def earliest_before(rows: DataFrame, span: int, steps: int = 720) -> DataFrame:
    """message_id, older: for rows of key, at, message_id, the earliest of the key in the ``span`` up to the row's time; of
    equal times the smallest id.

    Times are cut into buckets of one span, and these into steps. The earliest one is in the bucket before, at or after the
    row's time less the span: in that step, by a window over the step alone, else in a later step, by the steps' minima; if
    none is there, it is the first of the row's own bucket. So no window holds more than a key's rows of one step, or
    ``steps`` minima, however many rows a key has."""
    step = span // steps
    whole = lambda x: F.floor(x / F.lit(step)).cast("long")
    first = F.struct("at", "message_id")
    data = rows.select("key", whole(F.expr("cast(at as decimal(20,0))")).alias("step"), "at", "message_id", F.lit(None).cast("string").alias("probe"))
    probes = rows.select("key", whole(F.expr(f"cast(at - {span} as decimal(20,0))")).alias("step"), (F.col("at") - span).alias("at"), F.lit(None).cast("string").alias("message_id"), F.col("message_id").alias("probe"))
    both = data.union(probes)
    # At a probe's time and after it in its step; a probe stands before rows of its own time.
    w = W.partitionBy("key", "step").orderBy("at", F.col("probe").isNull()).rowsBetween(0, W.unboundedFollowing)
    inside = both.withColumn("inside", F.min(F.when(F.col("message_id").isNotNull(), first)).over(w)).filter("probe IS NOT NULL").select("key", "step", "probe", "inside")
    minima = both.groupBy("key", "step").agg(F.min(F.when(F.col("message_id").isNotNull(), first)).alias("least"))
    bucket = F.floor(F.col("step") / steps).cast("long").alias("bucket")
    after = W.partitionBy("key", "bucket").orderBy("step").rowsBetween(1, W.unboundedFollowing)
    minima = minima.select("*", bucket).withColumn("later", F.min("least").over(after))
    heads = minima.groupBy("key", (F.col("bucket") - 1).alias("bucket")).agg(F.min("least").alias("head"))
    found = inside.join(minima.select("key", "step", "bucket", "later"), ["key", "step"]).join(heads, ["key", "bucket"], "left")
    return found.select(F.col("probe").alias("message_id"), F.coalesce("inside", "later", "head")["message_id"].alias("older"))


def thread_of(m: DataFrame, tid: DataFrame, message_id: str, limit: int = 1000) -> DataFrame:
    """The newest ``limit`` members of a message's thread, oldest first, undated ones first of all."""
    own = tid.filter(F.col("message_id") == message_id).select("tid").limit(1)
    members = m.join(tid.join(F.broadcast(own), "tid"), "message_id")
    newest = members.orderBy(F.desc_nulls_last("date_unix_ns"), "message_id", "list").limit(limit)
    return newest.orderBy(F.asc_nulls_first("date_unix_ns"), "message_id", "list")


def propagate(m: DataFrame, tid: DataFrame) -> DataFrame:
    """message_id of each cover letter, with the sorted files and functions of all its thread."""
    rows = m.join(tid, "message_id")

    def union(column: str, name: str) -> DataFrame:
        """Distinct values first, so a thread is collected once, without repeats."""
        each = rows.select("tid", F.explode(column).alias("x")).distinct()
        return each.groupBy("tid").agg(F.array_sort(F.collect_list("x")).alias(name))

    covers = rows.filter("is_cover_letter").select("message_id", "tid")
    for column, name in (("touched_files", "propagated_files"), ("touched_functions", "propagated_functions")):
        covers = covers.join(union(column, name), "tid", "left").withColumn(name, items(name))
    return covers.select("message_id", "tid", "propagated_files", "propagated_functions")


def newest_first(found: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` messages, or all, oldest first, undated ones first of all."""
    if limit is not None:
        found = found.orderBy(F.desc_nulls_last("date_unix_ns"), "message_id", "list").limit(limit)
    return found.orderBy(F.asc_nulls_first("date_unix_ns"), "message_id", "list")


def conversation(m: DataFrame, message_id: str, limit: int | None = 1000) -> DataFrame:
    """The newest ``limit`` messages that hang together with one through replies *and* references, in either direction,
    oldest first. The corpus' components are found in rounds that grow with the logarithm of the longest chain; ask
    ``Maintained.conversation`` where they are stored."""
    message_id = message_id.strip().strip("<>")
    labels = checkpointed(components(links(m)))
    own = labels.filter(F.col("node") == message_id).select("label").first()
    ids = labels.filter(F.col("label") == own[0]).select(F.col("node").alias("message_id")) if own else None
    found = m.join(ids, "message_id", "left_semi") if own else m.filter(F.col("message_id") == message_id)
    return newest_first(found, limit)


def series(m: DataFrame, message_id: str) -> DataFrame:
    """All versions of a message's series: same list, subject and author (a missing author equals a missing one)."""
    seed = m.filter(F.col("message_id") == message_id).select("list", "subject_normalized", F.col("from_addr").alias("author")).limit(1)
    same = m.join(F.broadcast(seed), ["list", "subject_normalized"]).filter(F.col("from_addr").eqNullSafe(F.col("author")))
    return same.drop("author").orderBy("series_version", F.coalesce("series_index", F.lit(0)), "message_id")


def newer_version(m: DataFrame) -> DataFrame:
    """message_id, superseded_by: the first message of the highest version of the same series, if above its own."""
    key = ["list", "subject_normalized", "from_addr"]
    first = F.struct(F.col("series_version"), (-F.coalesce("date_unix_ns", F.lit(0))).alias("d"), F.col("message_id"))
    best = m.groupBy(*key).agg(F.max(first).alias("b"), F.min("series_version").alias("least")).filter("b.series_version > least")
    best = checkpointed(best)
    if best.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:  # else both sides are shuffled
        best = F.broadcast(best)
    on = [m[k].eqNullSafe(best[k]) for k in key]
    newer = m.join(best, on).filter(F.col("b.series_version") > m["series_version"])
    return newer.select(m["message_id"], F.col("b.message_id").alias("superseded_by"))


def replies(m: DataFrame, message_id: str) -> DataFrame:
    return m.filter(F.col("in_reply_to") == message_id).orderBy("date_unix_ns", "message_id")


def trailer_union(m: DataFrame, tid: DataFrame, column: str = "reviewed_by") -> DataFrame:
    """tid, value: a trailer's distinct values over each thread, in the order in which they are first seen."""
    rows = m.join(tid, "message_id").select("tid", "date_unix_ns", "message_id", F.posexplode(items(column)).alias("pos", "value"))
    first = rows.groupBy("tid", "value").agg(F.min(F.struct("date_unix_ns", "message_id", "pos")).alias("at"))
    return first.select("tid", "value", F.row_number().over(W.partitionBy("tid").orderBy("at")).alias("place"))
