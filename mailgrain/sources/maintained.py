"""Derived tables kept by deltas: each batch of new and replaced messages adds to them what it changes and nothing else.

All tables are written in runs (``table/run=n``), so a batch that is replayed takes its own place. Rows of side tables carry
their message's key. A replaced key goes to the small table ``dead``; readers leave out its rows of earlier runs. Labels of
nodes (thread ids, conversations) are written once for each node; what merges is a row from old to new label, applied to
labels of earlier runs, so a large thread that joins another costs one row. Where an edge was replaced, or new edges close a
cycle of replies, the threads concerned are labelled anew from their own edges.

Each tier is marked when its run is written. Readers see the newest run that all tiers have: a batch that stopped between
two of them is invisible until it is replayed. Old runs are folded by :meth:`Maintained.compact` into another folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import items
from ..lineage import checkpointed, written
from ..operators.components import components, links
from ..operators.derive import involvement, touched, trailer_refs
from ..operators.search import trigrams
from ..operators.threads import newest_first, thread_roots

KEY = ["message_id", "list"]
SIDE = {
    "touched_file": lambda m: touched(m),
    "touched_function": lambda m: touched(m, "touched_functions", "function"),
    "involvement": lambda m: involvement(m),
    "trailer_ref": lambda m: trailer_refs(m),
    "trigram": lambda m: m.select(F.explode(trigrams(F.col("patch"))).alias("gram"), *KEY),
}
SORTED_BY = {"touched_file": "path", "touched_function": "function", "involvement": "email", "trailer_ref": "ref_value", "trigram": "gram"}
LABELS = ("threads", "conversations")
TIERS = (*SIDE, *LABELS)


class Maintained:
    def __init__(self, spark: SparkSession, path: str, tiers: tuple[str, ...] = TIERS):
        self.spark, self.path, self.tiers = spark, path, tiers

    # -- runs ----------------------------------------------------------------------------------------------------------

    def _at(self, name: str):
        """A path and its file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        at, files = self._at(name)
        return files.exists(at)

    def _write(self, df: DataFrame, name: str, run: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}", compression="zstd")

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        """Rows of all runs before one, with their run."""
        if not self._exists(name):
            return self.spark.createDataFrame([], f"{schema}, run bigint")
        return self.spark.read.schema(f"{schema}, run bigint").parquet(f"{self.path}/{name}").filter(F.col("run") < before)

    def _mark(self, tier: str, run: int) -> None:
        at, files = self._at(f"markers/{tier}/run={run}")
        files.create(at, True).close()

    def generations(self) -> dict[str, int]:
        """The newest run of each tier."""
        out = {}
        for t in self.tiers:
            at, files = self._at(f"markers/{t}")
            runs = [int(x.getPath().getName().removeprefix("run=")) for x in (files.listStatus(at) if files.exists(at) else [])]
            out[t] = max(runs, default=-1)
        return out

    def generation(self) -> int:
        """The newest run that all tiers have."""
        return min(self.generations().values())

    # -- a batch -------------------------------------------------------------------------------------------------------

    def apply(self, changed: DataFrame, run: int, only: tuple[str, ...] | None = None) -> None:
        """``changed``: the rows, as they are now, of each key that is new or replaced. Runs come in order; a run that was
        applied before is done again. ``only`` names the tiers to do."""
        changed = written(changed, "changed")
        by_id = changed.repartition("message_id")  # what is distinct with it is shuffled no more
        keys = changed.select(*KEY).distinct()
        known = self._read("keys", "message_id string, list string", run)
        self._write(known.select(*KEY).distinct().join(keys, KEY, "left_semi"), "dead", run)
        self._write(keys, "keys", run)
        for tier in only or self.tiers:
            if tier in SIDE:
                # Sorted where they are: ranges over all rows would make each row twice, for their sample, and shuffle it.
                self._write(SIDE[tier](by_id).sortWithinPartitions(SORTED_BY[tier]), tier, run)
            else:
                getattr(self, f"_{tier}")(changed, run)
            self._mark(tier, run)

    # -- readers -------------------------------------------------------------------------------------------------------

    def side(self, tier: str) -> DataFrame:
        """The rows of a side table, without those of replaced messages."""
        end = self.generation() + 1
        rows = self.spark.read.parquet(f"{self.path}/{tier}").filter(F.col("run") < end)
        dead = self._read("dead", "message_id string, list string", end).groupBy(*KEY).agg(F.max("run").alias("dead"))
        return rows.join(dead, KEY, "left").filter("dead IS NULL OR run >= dead").select(*[c for c in rows.columns if c != "run"])

    def path_vocabulary(self) -> DataFrame:
        return self.side("touched_file").select("path").distinct()

    def thread_ids(self) -> DataFrame:
        return self._labels("threads", self.generation() + 1).toDF("message_id", "tid")

    def conversation_ids(self) -> DataFrame:
        """message_id (of named ones as well), conversation."""
        return self._labels("conversations", self.generation() + 1).toDF("message_id", "conversation")

    def conversation(self, m: DataFrame, message_id: str, limit: int | None = 1000) -> DataFrame:
        """The newest ``limit`` messages that hang together with one, oldest first: a filter on the stored labels."""
        message_id = message_id.strip().strip("<>")
        label = self.conversation_ids().filter(F.col("message_id") == message_id).first()
        if label is None:
            found = m.filter(F.col("message_id") == message_id)
        else:
            ids = self.conversation_ids().filter(F.col("conversation") == label[1]).select("message_id")
            found = m.join(ids.hint("merge"), "message_id", "left_semi")  # a conversation may hold most messages
        return newest_first(found, limit)

    # -- labels --------------------------------------------------------------------------------------------------------

    def _labels(self, tier: str, before: int, nodes: DataFrame | None = None) -> DataFrame:
        """node, label: the newest label of each, through the newest merge of a later run."""
        own = self._read(f"{tier}_labels", "node string, label string", before)
        if nodes is not None:
            own = own.join(nodes.hint("merge"), "node", "left_semi")  # labels and merges are too many to broadcast
        own = own.groupBy("node").agg(F.max(F.struct("run", "label")).alias("x")).select("node", "x.*")
        merged = self._read(f"{tier}_merges", "old string, new string", before)
        merged = merged.groupBy(F.col("old").alias("label")).agg(F.max(F.struct(F.col("run").alias("then"), "new")).alias("x")).select("label", "x.*")
        return own.join(merged.hint("merge"), "label", "left").select("node", F.when(F.col("then") > F.col("run"), F.col("new")).otherwise(F.col("label")).alias("label"))

    def _members(self, tier: str, before: int, labels: DataFrame) -> DataFrame:
        """node, label of all nodes with one of these labels now: those that were given it, or one merged into it."""
        labels = labels.select("label").distinct()
        merged = self._read(f"{tier}_merges", "old string, new string", before)
        olds = merged.join(labels.withColumnRenamed("label", "new"), "new", "left_semi").select(F.col("old").alias("label"))
        any_of = labels.union(olds).distinct()
        given = self._read(f"{tier}_labels", "node string, label string", before).join(any_of, "label", "left_semi").select("node").distinct()
        return self._labels(tier, before, given).join(labels, "label", "left_semi")

    def _save(self, tier: str, run: int, labels: DataFrame, merges: DataFrame, anew: DataFrame | None = None) -> None:
        """Merges of earlier runs into what is merged now go on to the new label. Nodes that are labelled ``anew`` are labels of
        no one else: merges of them are undone."""
        merges = merges.filter("old != new")
        before = self._read(f"{tier}_merges", "old string, new string", run)
        newest = before.groupBy("old").agg(F.max(F.struct("run", "new")).alias("x")).select("old", F.col("x.new").alias("through"))
        if anew is not None:
            undone = newest.join(anew.select(F.col("node").alias("old")), "old", "left_semi").select("old", F.col("old").alias("new"))
            newest = newest.join(undone.select("old"), "old", "left_anti")
            merges = merges.join(anew.select(F.col("node").alias("old")), "old", "left_anti").union(undone)
        merges = checkpointed(merges)
        on = newest.join(merges.select(F.col("old").alias("through"), "new"), "through").select("old", "new")
        fresh = on.join(merges, "old", "left_anti").union(merges.select("old", "new"))
        self._write(labels.select("node", "label"), f"{tier}_labels", run)
        self._write(fresh, f"{tier}_merges", run)

    # -- threads -------------------------------------------------------------------------------------------------------

    def _threads(self, changed: DataFrame, run: int) -> None:
        own = F.coalesce("in_reply_to", F.get(items("references"), F.lit(0)))
        copies = changed.groupBy(*KEY).agg(F.min(own).alias("want"))
        schema = "message_id string, list string, want string"
        before = self._read("threads_copies", schema, run)
        ids = copies.select("message_id").distinct()
        # What the batch's messages reply to, by all their copies; and what they did before.
        old = before.join(ids, "message_id", "left_semi").groupBy(*KEY).agg(F.max(F.struct("run", "want")).alias("x")).select(*KEY, "x.want")
        old = checkpointed(old)
        now = old.join(copies.select(*KEY), KEY, "left_anti").union(copies).groupBy("message_id").agg(F.min("want").alias("want"))
        was = old.groupBy("message_id").agg(F.min("want").alias("was"), F.lit(True).alias("known"))
        now = checkpointed(now.join(was, "message_id", "left"))
        new = now.filter("known IS NULL").select("message_id", "want")
        rewired = now.filter("known AND NOT want <=> was").select("message_id", "want")
        self._write(copies, "threads_copies", run)

        wanted = new.select(F.col("want").alias("node")).filter("node IS NOT NULL").distinct()
        there = checkpointed(self._labels("threads", run, wanted))
        fresh = new.select(F.col("message_id").alias("node"), F.col("message_id").alias("label"))
        up = new.join(there.union(fresh).toDF("want", "up"), "want", "left").select("message_id", "up")
        # Threads that begin with a reply to a message that comes only now.
        waiting = self._read("threads_waiting", "message_id string, want string", run)
        orphans = waiting.join(new.select(F.col("message_id").alias("want")), "want", "left_semi").select("message_id").distinct()
        theirs = self._wants(run, orphans).join(new.select(F.col("message_id").alias("want")), "want", "left_semi")
        theirs = checkpointed(theirs.join(rewired.select("message_id"), "message_id", "left_anti").select("message_id", F.col("want").alias("up")))
        ends = there.select(F.col("label").alias("message_id")).distinct().join(theirs, "message_id", "left_anti").select("message_id", F.lit(None).cast("string").alias("up"))
        edges = checkpointed(up.union(theirs).union(ends).toDF("message_id", "parent"))
        roots = checkpointed(thread_roots(edges)) if not edges.isEmpty() else edges.toDF("message_id", "tid")
        labels = new.join(roots, "message_id").select(F.col("message_id").alias("node"), F.col("tid").alias("label"))
        merges = roots.join(new, "message_id", "left_anti").toDF("old", "new")
        missing = new.join(there.select(F.col("node").alias("want")).union(new.select("message_id")), "want", "left_anti").filter("want IS NOT NULL")
        missing = missing.select("message_id", "want").union(rewired.filter("want IS NOT NULL"))
        self._write(missing, "threads_waiting", run)
        self._save("threads", run, labels, merges)

        # Replaced edges, and threads whose new edges close a cycle: labelled anew from the edges of all their messages.
        at_root = edges.filter("parent IS NULL").select(F.col("message_id").alias("tid"))
        cycles = roots.join(at_root, "tid", "left_anti").select(F.col("tid").alias("label"))
        seeds = rewired.select(F.col("message_id").alias("node")).union(rewired.select(F.col("want").alias("node")).filter("node IS NOT NULL"))
        again = checkpointed(self._labels("threads", run + 1, seeds.distinct()).select("label").union(cycles).distinct())
        if again.isEmpty():
            return
        members = checkpointed(self._members("threads", run + 1, again))
        wants = self._wants(run + 1, members.select(F.col("node").alias("message_id")))
        known = members.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
        sub = wants.withColumnRenamed("want", "parent").join(known, "parent", "left").select("message_id", F.when(F.col("there"), F.col("parent")).alias("parent"))
        found = checkpointed(thread_roots(checkpointed(sub))).select(F.col("message_id").alias("node"), F.col("tid").alias("label"))
        labels = checkpointed(labels.join(found, "node", "left_anti").union(found))
        self._save("threads", run, labels, merges, found)

    def _wants(self, before: int, ids: DataFrame) -> DataFrame:
        """message_id, want: what each message replies to, by all its copies."""
        copies = self._read("threads_copies", "message_id string, list string, want string", before).join(ids, "message_id", "left_semi")
        newest = copies.groupBy(*KEY).agg(F.max(F.struct("run", "want")).alias("x"))
        return newest.groupBy("message_id").agg(F.min("x.want").alias("want"))

    # -- conversations -------------------------------------------------------------------------------------------------

    def _conversations(self, changed: DataFrame, run: int) -> None:
        own = checkpointed(links(changed, "list").select(F.col("a").alias("message_id"), "list", "b"))
        before = self._read("conversations_edges", "message_id string, list string, b string", run)
        self._write(own, "conversations_edges", run)
        replaced = before.join(changed.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY, "b").agg(F.max("run").alias("run"))
        newest = replaced.withColumn("last", F.max("run").over(W.partitionBy(*KEY))).filter("run = last")
        gone = checkpointed(newest.select(*KEY, "b").join(own, [*KEY, "b"], "left_anti"))
        ends = own.select(F.col("message_id").alias("node")).union(own.select(F.col("b").alias("node"))).distinct()
        there = checkpointed(self._labels("conversations", run, ends))
        # Edges between labels: a node that has none stands for itself.
        named = own.select(F.col("message_id").alias("a"), "b").distinct()
        for side in ("a", "b"):
            named = named.join(there.toDF(side, f"{side}_label").hint("merge"), side, "left").withColumn(f"{side}_label", F.coalesce(f"{side}_label", side))
        edges = named.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).filter("a != b").distinct()
        found = checkpointed(components(checkpointed(edges)))
        fresh = ends.join(there.select("node").hint("merge"), "node", "left_anti")
        labels = checkpointed(fresh.join(found.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("label")))
        merges = checkpointed(found.join(fresh.hint("merge"), "node", "left_anti").toDF("old", "new"))
        self._save("conversations", run, labels, merges)
        if gone.isEmpty():
            return
        again = self._labels("conversations", run + 1, gone.select(F.col("message_id").alias("node")).distinct()).select("label").distinct()
        members = checkpointed(self._members("conversations", run + 1, checkpointed(again)))
        edges = self._read("conversations_edges", "message_id string, list string, b string", run + 1)
        edges = edges.join(members.select(F.col("node").alias("message_id")), "message_id", "left_semi")
        dead = self._read("dead", "message_id string, list string", run + 1).groupBy(*KEY).agg(F.max("run").alias("dead"))
        edges = edges.join(dead, KEY, "left").filter("dead IS NULL OR run >= dead").select(F.col("message_id").alias("a"), "b").distinct()
        found = members.select("node").join(components(checkpointed(edges)), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        found = checkpointed(found)
        labels = checkpointed(labels.join(found, "node", "left_anti").union(found))
        self._save("conversations", run, labels, merges, found)

    # -- folding -------------------------------------------------------------------------------------------------------

    def compact(self, to: str) -> Maintained:
        """All that readers see, as one run in another folder; the caller swaps the paths."""
        run, out = self.generation(), Maintained(self.spark, to, self.tiers)
        for tier in self.tiers:
            if tier in SIDE:
                out._write(self.side(tier).repartitionByRange(SORTED_BY[tier]).sortWithinPartitions(SORTED_BY[tier]), tier, run)
            else:
                out._write(self._labels(tier, run + 1), f"{tier}_labels", run)
        out._write(self._read("keys", "message_id string, list string", run + 1).select(*KEY).distinct(), "keys", run)
        if "threads" in self.tiers:
            copies = self._read("threads_copies", "message_id string, list string, want string", run + 1)
            out._write(copies.groupBy(*KEY).agg(F.max(F.struct("run", "want")).alias("x")).select(*KEY, "x.want"), "threads_copies", run)
            out._write(self._read("threads_waiting", "message_id string, want string", run + 1).select("message_id", "want").distinct(), "threads_waiting", run)
        if "conversations" in self.tiers:
            edges = self._read("conversations_edges", "message_id string, list string, b string", run + 1)
            dead = self._read("dead", "message_id string, list string", run + 1).groupBy(*KEY).agg(F.max("run").alias("dead"))
            out._write(edges.join(dead, KEY, "left").filter("dead IS NULL OR run >= dead").select(*KEY, "b"), "conversations_edges", run)
        for tier in self.tiers:
            out._mark(tier, run)
        return out
