"""Near-duplicate documents by an LSH forest, confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles; documents with equal sets form a class, which goes on as one.
2. Each class gets ``SLOTS`` minhash values. A tree of the forest is the classes in the order of their values there; classes
   with a longest common prefix of ``FIRST`` values (3 below a similarity of 0.85) lie in one region. In a region of
   ``region`` classes or fewer, neighbours in the sorted order are compared by the share of all their minhash values that
   agree; what reaches ``sketch_similarity`` joins into candidate groups.
3. A larger region is first compared with ``REPRESENTATIVES`` of its own: classes near one of them are in one candidate group,
   so no pair among them is left to find. What no representative is near to is compared with the whole region in blocks, if
   that is ``region`` classes or fewer. Else the region goes on, split by one more value in each of ``BRANCHES`` orders, again
   and again: depth adapts to each region. At full depth all that is left is compared in blocks.
4. Candidate groups are compared on full sets in the same way: all pairs of a small group; a large one with representatives
   first, then what they aren't linked with against the whole group, in blocks. A group of n near copies so takes n
   comparisons, and n * |rest| only for texts that no representative is linked with. A task reports a spanning forest.
5. Components of the confirmed links.

What may be missed: a pair that shares no region, or that differs too much in its sketch. At similarity s a pair shares 4
values in one of 16 trees but for (1 - s^4)^16, 8e-6 at 0.85 (3 values at 0.8: 1e-5). In regions that have to be split down
to depth 8 it is (1 - s^4 (1 - (1 - s^4)^4))^16: 2e-5 at 0.85, and with the smaller first depth 1e-4 at 0.8. The sketch's
bound lies 0.15 below the similarity, 4 standard deviations of 128 values.

Defined results: a document without words has an empty set, is linked with nothing and keeps its own id; fewer words than a
shingle are one shingle; repeated rows are in one class; a null id is never the smallest id of a component that has another;
an empty table gives an empty result; columns other than id and text are carried by ``deduplicate`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, unused
from .graph import connected_components
from .shingles import pieces, shingle_hashes, word_hashes

TREES, DEPTH, FIRST = 16, 8, 4
SLOTS = TREES * DEPTH
#: Orders in which a region is split further, and about how many members of a large group stand for it.
BRANCHES, REPRESENTATIVES = 4, 24


def branch_slots(tree: int, branch: int) -> list[int]:
    """The values by which a tree's region is split further: of those that are no tree's first ones."""
    return np.random.default_rng([tree, branch]).permutation(np.arange(TREES * FIRST, SLOTS))[: DEPTH - 3].tolist()


def multipliers() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least of the permuted upper halves of the hashes, for each multiplier."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(by), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 8192):
        np.minimum(out, (by[:, None] * x[None, i : i + 8192]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), k1 and k2 (hash of the set), slots and their low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = multipliers()
        for whole in batches:
            for b in pieces(whole, "text"):
                h, off = shingle_hashes(*word_hashes(b.column("text")))
                n, keys, slots, low = [], [], [], []
                for i in range(len(off) - 1):
                    s = np.unique(h[off[i] : off[i + 1]])
                    n.append(len(s))
                    keys.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                    sig = signature(s, by) if len(s) else np.zeros(0, np.uint32)
                    slots.append(sig.astype(">u4").tobytes())
                    low.append(sig.astype(np.uint8).tobytes())
                keys = np.array(keys, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                        pa.array(slots, pa.binary()), pa.array(low, pa.binary()),
                    ],
                    ["doc_id", "th", "n", "k1", "k2", "slots", "low"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, th bigint, n bigint, k1 bigint, k2 bigint, slots binary, low binary")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of rows with complete keys, from batches sorted by key: the last key waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut or (held and held[-1].column(key)[-1].as_py() != k[0]):
            yield pa.Table.from_batches([*held, *([b.slice(0, cut)] if cut else [])])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def spread(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index joined to each of n, given linked indices."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def least_agreeing(sketch_similarity: float) -> float:
    """Low bytes that must agree; of those that differ one in 256 does so by chance."""
    return SLOTS * (sketch_similarity + (1 - sketch_similarity) / 256)


def sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(-1, SLOTS)


def near_in_regions(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "key"):
            key, c, low = t["key"].to_numpy(), t["c"].to_numpy(), sketches(t)
            first, second, at, step = [], [], np.arange(len(key)), 0
            while True:
                step += 1
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
                if not len(at):
                    break
                near = at[(low[at] == low[at + step]).sum(axis=1) >= least]
                first.append(near)
                second.append(near + step)
            if first:
                label = spread(np.concatenate(first), np.concatenate(second), len(key))
                joined = np.flatnonzero(label != np.arange(len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(c[joined]), pa.array(c[label[joined]])], ["a", "b"])

    return run


def stood_for(near: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near: members x representatives. Links (member, representative) of the representatives that hang together in the
    largest number, and of all who are linked with one of them; and the members without such a link."""
    rep = np.flatnonzero(role == 1)
    if not len(rep):
        none = np.zeros(0, np.int64)
        return none, none, np.arange(len(role))
    a, b = np.nonzero(near[rep])
    label = spread(a, b, len(rep))
    main = np.flatnonzero(label == np.bincount(label).argmax())
    linked = near[:, main]
    member = np.flatnonzero(linked.any(axis=1))
    other = rep[main[linked[member].argmax(axis=1)]]
    # The main representatives hang together through their own links, one to the next.
    x, y = np.nonzero(near[np.ix_(rep[main], main)])
    return np.concatenate([member, rep[main][x]]), np.concatenate([other, rep[main][y]]), np.setdiff1d(np.arange(len(role)), member)


def joined_parts(near: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """near: members x others, of which ``rep`` are the places among the members. What hangs together through these, as one
    link of each to the least of the others there: so a task's links are as many as its members at most."""
    a, b = np.nonzero(near)
    n = len(near)
    own = np.arange(len(rep))
    label = spread(np.concatenate([n + b, n + own]), np.concatenate([a, rep]), n + len(rep))
    root = np.full(n + len(rep), n + len(rep))
    np.minimum.at(root, label[n:], own)
    root = root[label[:n]]
    member = np.flatnonzero(root < len(rep))
    return member, rep[root[member]]


FOUND = "a bigint, b bigint, left bigint, region bigint"


def found_batch(c, a, b, left, region) -> pa.RecordBatch:
    """Links between classes, and classes that are left with their region."""
    a, b, left = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, left))
    region = np.concatenate([np.zeros(0, np.int64), *region])
    link = a != b
    a, b = a[link], b[link]
    mask = np.arange(len(a) + len(left)) >= len(a)
    fill = np.zeros(len(left), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.append(x, y), mask=m) for x, y, m in ((a, fill, mask), (b, fill, mask), (a * 0, left, ~mask), (a * 0, region, ~mask))],
        ["a", "b", "left", "region"],
    )


def runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True)


def near_representatives(least: float, rest: bool):
    """Of each part of a region: links with its representatives and the classes that have none. ``rest``: links of the classes
    with a role with all others, and nothing left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "key"):
            c, role, region, low = t["c"].to_numpy(), t["role"].to_numpy(), t["region"].to_numpy(), sketches(t)
            links, others, left, regions = [], [], [], []
            for lo, hi in runs(t["key"].to_numpy()):
                own = slice(lo, hi)
                rep = np.flatnonzero(role[own] == 1)
                near = np.stack([(low[own] == low[lo + r]).sum(axis=1) >= least for r in rep], axis=1) if len(rep) else np.zeros((hi - lo, 0), bool)
                if rest:
                    a, b, out = *joined_parts(near, rep), []
                else:
                    a, b, out = stood_for(near, role[own])
                links.append(c[own][a])
                others.append(c[own][b])
                left.append(c[own][out] if len(out) else np.zeros(0, np.int64))
                regions.append(region[own][out] if len(out) else np.zeros(0, np.int64))
            yield found_batch(c, links, others, left, regions)

    return run


def part(by: str, n: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), by), F.col(n))


def in_parts(rows: DataFrame, group: str, parts: str, by: str, size: str) -> DataFrame:
    """Members of large groups dealt out to ``parts`` parts of their group, with about REPRESENTATIVES of them (role 1) in
    every part. They are chosen by hash, so no task has to see a whole group."""
    is_rep = F.pmod(F.xxhash64(F.lit(2), group, by), F.col(size)) < REPRESENTATIVES
    rows = rows.withColumn("role", is_rep.cast("int"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1)
    rows = rows.withColumn("part", F.explode(F.when(F.col("role") == 1, every).otherwise(F.array(part(by, parts)))))
    return rows.withColumn("key", F.xxhash64(group, "part")).drop("part")


def in_rest(rows: DataFrame, group: str, parts: str, by: str, left: str, left_parts: str) -> DataFrame:
    """Members that are left (role 1) in blocks of their own, each with every part of its group (role 0)."""
    every, own = F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1), F.sequence(F.lit(0).cast("bigint"), F.col(left_parts) - 1)
    pairs = lambda role, x, y: F.struct(F.lit(role).alias("role"), x.alias("x"), y.alias("y"))
    against = F.transform(own, lambda i: pairs(0, i, part(by, parts)))
    as_left = F.when(F.col(left), F.transform(every, lambda j: pairs(1, part(by, left_parts), j))).otherwise(F.slice(against, 1, 0))
    rows = rows.withColumn("_at", F.explode(F.concat(against, as_left)))
    return rows.withColumns({"role": F.col("_at.role"), "key": F.xxhash64(group, "_at.x", "_at.y")}).drop("_at")


def candidate_links(classes: DataFrame, region: int, first: int, sketch_similarity: float, scratch: Scratch) -> DataFrame:
    """a, b: links that join the candidate groups."""
    least, found, tables = least_agreeing(sketch_similarity), None, []
    rows = classes.filter("n > 0").select("c", "slots", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.withColumn("branch", F.lit(0))
    at = F.create_map(*[F.lit(x) for t in range(TREES) for b in range(BRANCHES) for x in (t * BRANCHES + b, branch_slots(t, b))])

    def value(i: Column) -> Column:
        return F.substring(F.col("slots"), i * 4 + 1, F.lit(4))

    def collect(links: DataFrame) -> None:
        nonlocal found
        links = links.select("a", "b")
        found = links if found is None else found.unionByName(links)

    def compared(rows: DataFrame, rest: bool) -> DataFrame:
        full = rows.select("key", "c", "role", "region", "low").repartition("key").sortWithinPartitions("key")
        return full.mapInArrow(near_representatives(least, rest), FOUND)

    for depth in range(first, DEPTH + 1):
        own = F.element_at(at, F.col("tree") * BRANCHES + F.col("branch"))
        order = F.substring("slots", F.col("tree") * 4 * FIRST + 1, F.lit(4 * FIRST))
        prefix = [F.substring(order, F.lit(1), F.lit(4 * first)), *[value(F.get(own, F.lit(i))) for i in range(depth - first)]]
        keyed = rows.select("c", "tree", "branch", order.alias("order"), F.xxhash64("tree", "branch", *prefix).alias("region"))
        sizes = keyed.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
        # Sketches join what is left of the rows: most share no region.
        held = keyed.join(sizes, "region").join(classes.select("c", "low"), "c")
        held = scratch.write(held, f"regions{depth}")
        tables.append(f"regions{depth}")
        few = held.filter(F.col("size") <= region).withColumnRenamed("region", "key").select("key", "c", "low", "order")
        collect(few.repartition("key").sortWithinPartitions("key", "order").drop("order").mapInArrow(near_in_regions(least), "a bigint, b bigint"))
        many = held.filter(F.col("size") > region).withColumn("parts", F.ceil(F.col("size") / region))
        if many.isEmpty():
            break
        got = scratch.write(compared(in_parts(many, "region", "parts", "c", "size"), False), f"represented{depth}")
        tables.append(f"represented{depth}")
        collect(got.filter("a IS NOT NULL"))
        left = got.filter("left IS NOT NULL").select(F.col("left").alias("c"), "region").distinct()
        counts = left.groupBy("region").agg(F.count("*").alias("n_left"))
        most = counts.agg(F.max("n_left")).first()[0]
        if not most:
            break
        if depth == DEPTH:
            blocks, deeper = F.ceil(F.col("n_left") / region), None
        else:
            blocks, deeper = F.lit(1).cast("bigint"), counts.filter(F.col("n_left") > region).select("region") if most > region else None
            counts = counts.filter(F.col("n_left") <= region)
        # A class that is left meets each part of its region; so do the parts' members, once for each block of what is left.
        region_parts = many.select("region", "parts").distinct().join(counts, "region").withColumn("blocks", blocks)
        left = left.join(region_parts, "region").join(classes.select("c", "low"), "c").withColumns({"role": F.lit(1), "block": part("c", "blocks")})
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        members = many.withColumns({"role": F.lit(0), "part": part("c", "parts")})
        if depth < DEPTH or most <= region:
            members = members.withColumn("block", F.lit(0).cast("bigint"))
        else:
            members = members.join(region_parts.select("region", "blocks"), "region")
            members = members.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        names = ["key", "c", "role", "region", "low"]
        both = members.unionByName(left, allowMissingColumns=True).withColumn("key", F.xxhash64("region", "part", "block")).select(*names)
        collect(compared(both, True).filter("a IS NOT NULL"))
        if deeper is None:
            break
        rows = many.select("c", "tree", "branch", "region").join(deeper, "region").join(classes.select("c", "slots"), "c")
        if depth == first:
            rows = rows.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
    found = scratch.write(found.distinct(), "candidates")
    for name in tables:
        scratch.drop(name)
    return found


def linked_sets(similarity: int, sets: list[np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """Which of the other sets have 100 * intersection >= similarity * union with set i. Sets are sorted."""
    n, sizes = len(sets[i]), np.array([len(sets[j]) for j in others], np.int64)
    fit = (100 * np.minimum(n, sizes) >= similarity * np.maximum(n, sizes)) & (sizes > 0)
    others, sizes = others[fit], sizes[fit]
    if not len(others) or not n:
        return others[:0]
    flat = np.concatenate([sets[j] for j in others])
    at = np.minimum(np.searchsorted(sets[i], flat), n - 1)
    shared = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return others[100 * shared >= similarity * (n + sizes - shared)]


def confirmed(similarity: int, mode: str):
    """Links on full sets. Mode ``all``: a spanning forest of all pairs of a group; ``representatives`` and ``rest`` as above."""

    def forest(c: np.ndarray, sets: list[np.ndarray]) -> tuple[list, list]:
        root, a, b = np.arange(len(c)), [], []
        for i in range(len(c) - 1):
            rest = np.arange(i + 1, len(c))
            for k in linked_sets(similarity, sets, i, rest[root[rest] != root[i]]):
                if root[k] != root[i]:
                    root[root == max(root[k], root[i])] = min(root[k], root[i])
                    a.append(i)
                    b.append(k)
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "key"):
            links, others, left, regions = [], [], [], []
            for lo, hi in runs(t["key"].to_numpy()):
                g = t.slice(lo, hi - lo)
                # A class may be read from several equal rows.
                _, first = np.unique(np.stack([g["c"].to_numpy(), g["role"].to_numpy()]), axis=1, return_index=True)
                g = g.take(pa.array(first))
                c, role = g["c"].to_numpy(), g["role"].to_numpy()
                h, off = shingle_hashes(*word_hashes(g["text"].combine_chunks()))
                sets = [np.unique(h[off[i] : off[i + 1]]) for i in range(len(c))]
                out = []
                if mode == "all":
                    a, b = forest(c, sets)
                else:
                    rep = np.flatnonzero(role == 1)
                    near = np.zeros((len(c), len(rep)), bool)
                    for k, r in enumerate(rep):
                        near[linked_sets(similarity, sets, r, np.arange(len(c))), k] = True
                    if mode == "rest":
                        a, b = joined_parts(near, rep)
                    else:
                        a, b, out = stood_for(near, role)
                links.append(c[a] if len(a) else c[:0])
                others.append(c[b] if len(a) else c[:0])
                left.append(c[out] if len(out) else c[:0])
                regions.append(np.full(len(out), g["component"][0].as_py(), np.int64))
            yield found_batch(None, links, others, left, regions)

    return run


def find_near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: int = 85,
    sketch_similarity: float | None = None,
    region: int = 512,
    group_docs: int = 512,
    group_shingles: int = 1_000_000,
    max_broadcast_rows: int = 500_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each document."""
    scratch = Scratch(docs.sparkSession)
    sig = scratch.write(signatures(docs, doc_id, text), "signatures")
    classes = sig.filter("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("d"), F.min(F.struct("doc_id", "th")).alias("at"), F.count("*").alias("copies"),
        F.first("n").alias("n"), F.first("slots").alias("slots"), F.first("low").alias("low"),
    )
    classes = scratch.write(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    sketch = similarity / 100 - 0.15 if sketch_similarity is None else sketch_similarity
    near = candidate_links(classes, region, FIRST if similarity >= 85 else FIRST - 1, sketch, scratch)
    near = connected_components(near, scratch)

    member = classes.select("c", "n", "at").join(near.withColumnRenamed("v", "c"), "c")
    parts = F.ceil(F.greatest(F.count("*") / group_docs, F.sum("n") / group_shingles))
    member = member.join(member.groupBy("component").agg(parts.alias("parts"), F.count("*").alias("size")), "component")
    member = scratch.write(member.select("c", "component", "parts", "size", F.col("at.doc_id").alias("w"), F.col("at.th").alias("th")), "members")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))

    def with_text(dealt: DataFrame) -> DataFrame:
        """Joined to the texts first and dealt out to parts after, so a text is read once."""
        wanted = small(dealt, max_broadcast_rows)
        return texts.join(wanted, (texts["th"] == wanted["th"]) & texts["doc_id"].eqNullSafe(wanted["w"])).drop("doc_id", "th", "w")

    def checked(rows: DataFrame, mode: str) -> DataFrame:
        rows = rows.repartition("key").sortWithinPartitions("key").select("key", "c", "role", "component", "text")
        return rows.mapInArrow(confirmed(similarity, mode), FOUND)

    few = with_text(member.filter("parts = 1"))
    links = checked(few.withColumns({"key": F.xxhash64("component"), "role": F.lit(0)}), "all").select("a", "b")
    many = member.filter("parts > 1")
    if not many.isEmpty():
        dealt = in_parts(with_text(many), "component", "parts", "c", "size")
        got = scratch.write(checked(dealt, "representatives").distinct(), "represented")
        links = links.union(got.filter("a IS NOT NULL").select("a", "b"))
        left = got.filter("left IS NOT NULL").select(F.col("left").alias("c"), F.col("region").alias("component"))
        if not left.isEmpty():
            open_ = left.groupBy("component").agg(F.ceil(F.count("*") / group_docs).alias("left_parts"))
            rest = many.join(open_, "component").join(left.withColumn("is_left", F.lit(True)), ["component", "c"], "left")
            rest = with_text(rest.withColumn("is_left", F.coalesce("is_left", F.lit(False))))
            rest = in_rest(rest, "component", "parts", "c", "is_left", "left_parts")
            links = links.union(checked(rest, "rest").filter("a IS NOT NULL").select("a", "b"))
    links = scratch.write(links.distinct(), "confirmed")
    parts = connected_components(links, scratch)
    linked = classes.select("c", "d").join(parts.withColumnRenamed("v", "c"), "c")
    least = linked.groupBy("component").agg(F.min("d").alias("component_id"))
    moved = classes.select("c", "k1", "k2", "d", "copies").join(
        linked.join(least, "component").select("c", "component_id"), "c", "left"
    )
    moved = moved.filter("copies > 1 OR component_id IS NOT NULL").select("k1", "k2", F.coalesce("component_id", "d").alias("component_id"))
    out = sig.select("doc_id", "n", "k1", "k2").join(small(scratch.write(moved, "moved"), max_broadcast_rows), ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, all columns: the one with the smallest id. Rows are written once with a key that puts null
    ids last and tells repeated ids apart."""
    name = unused(docs, "key")
    key = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = Scratch(docs.sparkSession).write(docs.withColumn(name, key), "dedup_rows")
    gone = find_near_duplicates(rows, name, text, **options).filter("NOT kept").select(F.col("doc_id.row").alias("row"))
    return rows.join(gone, rows[f"{name}.row"] == gone["row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
