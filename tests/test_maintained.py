"""Tables kept by deltas equal a full rebuild after each batch."""

import random

import pytest
from pyspark.sql import functions as F

from mailgrain.operators.components import components, links
from mailgrain.operators.threads import parents, thread_roots
from mailgrain.sources.maintained import SIDE, Maintained

SCHEMA = (
    "message_id string, list string, from_addr string, date_unix_ns bigint, in_reply_to string, `references` array<string>, to_addrs array<string>, cc_addrs array<string>, "
    "touched_files array<string>, touched_functions array<string>, reviewed_by array<string>, signed_off_by array<string>, fixes array<string>, link array<string>, closes array<string>, cc_stable array<string>, patch string"
)


def row(rng, i, others, name="a"):
    reply = rng.choice([None, None, *[f"m{j}" for j in others]]) if others else None
    refs = [f"m{j}" for j in rng.sample(others, min(2, len(others)))] if rng.random() < 0.4 else None
    file = f"f{rng.randrange(4)}.c"
    return (f"m{i}", name, f"a{i % 3}@x.org", rng.randrange(100), reply, refs, ["L@x.org"], None, [file], [f"fn{i % 2}"], [f"R <r{rng.randrange(3)}@x.org>"], None, [f"{i:08x}abcd12 (\"x\")"], None, None, None, f"diff {file} {i}")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def rebuilt(m):
    tid = pairs(thread_roots(parents(m.select("message_id", "in_reply_to", "references"))))
    own = {r["message_id"]: r["message_id"] for r in m.collect()}
    own |= {r["node"]: r["label"] for r in components(links(m)).collect()}
    return tid, own


def same(spark, kept, state, tiers=()):
    m = spark.createDataFrame(list(state.values()), SCHEMA)
    tid, own = rebuilt(m)
    assert pairs(kept.thread_ids()) == tid
    got = {r["message_id"]: r["conversation"] for r in kept.conversation_ids().collect()}
    ids = {r[0] for r in state.values()}
    assert {i: got.get(i, i) for i in ids} == {i: own[i] for i in ids}
    for tier in tiers:
        assert pairs(kept.side(tier)) == pairs(SIDE[tier](m)), tier


def test_batches_equal_a_rebuild(spark, tmp_path):
    """New messages, replies that come before what they reply to, copies on two lists, replaced rows, cycles, a batch twice."""
    rng = random.Random(1)
    kept, state, at = Maintained(spark, str(tmp_path / "kept")), {}, 0
    for run in range(5):
        batch = {}
        for _ in range(8):
            others = [j for j in range(at + 6) if j != at]
            for name in rng.sample(["a", "b"], rng.choice([1, 1, 2])):
                batch[f"m{at}", name] = row(rng, at, others, name)
            at += 1
        if run:
            for key in rng.sample(sorted(state), 3):  # replaced: other replies, files, people
                batch[key] = row(rng, int(key[0][1:]), [j for j in range(at) if f"m{j}" != key[0]], key[1])
        state |= batch
        changed = spark.createDataFrame(list(batch.values()), SCHEMA)
        kept.apply(changed, run)
        if run == 2:
            kept.apply(changed, run)  # replayed
        same(spark, kept, state, [sorted(SIDE)[run]])
    same(spark, kept, state, SIDE)
    folded = kept.compact(str(tmp_path / "folded"))
    batch = {(f"m{at}", "a"): row(rng, at, [0, 1], "a"), ("m0", "a"): row(rng, 0, [at], "a")}
    state |= batch
    folded.apply(spark.createDataFrame(list(batch.values()), SCHEMA), 5)
    same(spark, folded, state, SIDE)


def chain(spark, ids, up):
    rng = random.Random(0)
    rows = [row(rng, i, [])[:4] + (up(i), None) + row(rng, i, [])[6:] for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def test_a_thread_that_joins_costs_one_row(spark, tmp_path):
    kept = Maintained(spark, str(tmp_path), ("threads", "conversations"))
    kept.apply(chain(spark, range(1, 200), lambda i: f"m{i - 1}"), 0)  # m0 isn't there yet
    assert {r["tid"] for r in kept.thread_ids().collect()} == {"m1"}
    kept.apply(chain(spark, [0, 500], lambda i: f"m{1000 + i}"), 1)
    assert {r["tid"] for r in kept.thread_ids().filter("message_id != 'm500'").collect()} == {"m0"}
    assert spark.read.parquet(f"{tmp_path}/threads_labels").filter("run = 1").count() == 2
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{tmp_path}/threads_merges").filter("run = 1").collect()] == [("m1", "m0")]
    m = chain(spark, range(200), lambda i: f"m{i - 1}")
    assert kept.conversation(m, "<m150>").count() == 200 and kept.conversation(m, "m7", limit=3).count() == 3
    assert kept.conversation(m, "nowhere").count() == 0


def test_a_batch_that_stopped_between_two_tiers_is_invisible(spark, tmp_path):
    kept = Maintained(spark, str(tmp_path))
    first, second = chain(spark, [0, 1], lambda i: None), chain(spark, [2, 1], lambda i: "m0")
    kept.apply(first, 0)
    kept.apply(second, 1, only=("touched_file", "threads"))
    assert kept.generation() == 0 and kept.generations()["threads"] == 1 and kept.generations()["trigram"] == 0
    assert {r["message_id"] for r in kept.side("touched_file").collect()} == {"m0", "m1"}
    assert pairs(kept.thread_ids()) == [("m0", "m0"), ("m1", "m1")]
    kept.apply(second, 1)
    assert kept.generation() == 1 and pairs(kept.thread_ids()) == [("m0", "m0"), ("m1", "m0"), ("m2", "m0")]
    assert kept.path_vocabulary().count() == len({r["path"] for r in kept.side("touched_file").collect()})


def test_components_of_long_paths_and_stars(spark):
    n = 1000
    path = spark.range(n - 1).select(F.format_string("p%04d", F.col("id")).alias("a"), F.format_string("p%04d", F.col("id") + 1).alias("b"))
    star = spark.range(300).select(F.concat(F.lit("s"), "id").alias("a"), F.lit("sz").alias("b"))
    found = components(path.union(star).union(path.limit(5)), max_rounds=24)  # a path of n takes some log n rounds
    assert {r["label"] for r in found.filter("node like 'p%'").collect()} == {"p0000"} and found.count() == n + 301
    assert {r["label"] for r in found.filter("node like 's%'").collect()} == {"s0"}
    assert components(path.limit(0)).collect() == []
