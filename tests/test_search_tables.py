"""Postings, fuzzy search, budgets, look-back and batches against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import classify as C
from mailgrain.operators import search as S
from mailgrain.operators.postings import Postings, write_postings
from mailgrain.operators.threads import earliest_before
from mailgrain.sources import store


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(40)]
    rows = []
    for i in range(600):
        body = " ".join(rng.choice(common if rng.random() < 0.9 else rare) for _ in range(rng.randrange(0, 60)))
        rows.append((i, body if i % 50 else None, rng.choice([None, "r1 c2", "c0"])))
    return spark.createDataFrame(rows, "id int, body string, subject string").repartition(5)


@pytest.mark.parametrize("per_range", [16, 4096])
def test_postings_equal_bm25(spark, docs, tmp_path, per_range):
    write_postings(docs, str(tmp_path), "id", ("body", "subject"), per_range)
    p = Postings(spark, str(tmp_path))
    for query, k, operator in (("r1", 5, "or"), ("c0 c1 r7", 10, "or"), ("c2 r3", 8, "and"), ("nowhere", 5, "or"), ("r1 nowhere", 600, "or")):
        want = rows_of(S.top_scored(S.bm25(docs, query, "id", ("body", "subject"), operator), k, "id"))
        assert rows_of(p.top(query, k, operator)) == want, query
    plan = p.top("r1", 5)._jdf.queryExecution().toString()
    assert "body" not in plan and "PushedFilters" in plan
    with pytest.raises(ValueError):
        p.top("!", 3)


def test_blocks_are_skipped(spark, tmp_path):
    """With a score that few documents reach, the ranges whose bound stays below it aren't read."""
    rows = [(i, "x " * (8 if i < 40 else 1) + "y " * 30) for i in range(2000)]
    write_postings(spark.createDataFrame(rows, "id int, text string").coalesce(1), str(tmp_path), "id", per_range=20)
    p = Postings(spark, str(tmp_path))
    seen = []
    scored = p.scored
    p.scored = lambda blocks, *a: seen.append(blocks.select("range").distinct().count()) or scored(blocks, *a)
    assert [r["key"] for r in p.top("x", 2).collect()] == [0, 1]
    assert seen[0] + seen[1] <= 4  # of 100


def test_words_are_not_shuffled(spark, docs, tmp_path, monkeypatch):
    """A task makes its own blocks: a range has one row for a term, and a range's words are bounded too."""
    import mailgrain.operators.postings as M

    monkeypatch.setattr(M, "RANGE_WORDS", 100)
    for name, per_range in (("a", 4096), ("b", 7)):
        write_postings(docs, f"{tmp_path}/{name}", "id", ("body", "subject"), per_range)
        p = Postings(spark, f"{tmp_path}/{name}")
        ranges = p.blocks.groupBy("range", "field").agg(F.sum(F.aggregate("tf", F.lit(0), lambda a, x: a + x)).alias("words"))
        assert ranges.agg(F.max("words")).first()[0] <= 100 and p.blocks.agg(F.max("n")).first()[0] <= per_range
        assert p.blocks.groupBy("range", "field", "term").count().filter("count > 1").isEmpty() and p.documents.select("doc").distinct().count() == 600
        assert rows_of(p.top("c0 c1 r7", 10)) == rows_of(S.top_scored(S.bm25(docs, "c0 c1 r7", "id", ("body", "subject"), "or"), 10, "id"))


def test_least_distances():
    rng = random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choice("abcé🦙") for _ in range(rng.randrange(0, 40))) for _ in range(6)] + [None]
        needle = "".join(rng.choice("abcé🦙d") for _ in range(rng.randrange(3, 12)))
        for most in (1, 2):
            want = [S.best_distance(t or "", needle, most) for t in texts]
            assert S.least_distances(texts, needle, most).tolist() == want
    long = "z" * 5000 + "needle in hay" + "z" * 5000
    for shift in range(0, 60, 7):
        assert S.least_distances(["q" * shift + long, "z" * 9000], "neadle in hay", 2).tolist() == [1, 3]
    assert S.least_distances([], "abc", 1).tolist() == []


def test_budgets_of_a_hot_group(spark):
    rows = [("hot", i, "ab" * (1 + i % 3)) for i in range(3000)] + [("cold", i, "x" * 7) for i in range(5)] + [(None, 1, "null group"), ("cold", 9, None)]
    df = spark.createDataFrame(rows, "g string, n int, t string").repartition(6)
    for budget in (1, 10, 25, 9000):
        want = []
        for g in ("hot", "cold", None):
            used = 0
            for _, n, t in sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: r[1]):
                if used < budget:
                    want.append((g, n, t[: budget - used]))
                    used += len(t) + 2
        assert sorted(rows_of(C.within_budget(df, "g", ["n"], "t", budget)), key=repr) == sorted(want, key=repr)
        want = []
        for g in ("hot", "cold", None):
            used = 0
            for _, n, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
                used += len(t or "")
                want += [(g, n, t)] * (used <= budget)
        assert sorted(rows_of(C.within_bytes(df, "g", ["n"], ["t"], budget)), key=repr) == sorted(want, key=repr)


def test_look_back(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(3)}", rng.randrange(0, 4000), f"m{i}") for i in range(300)] + [("k0", -700 - i, f"n{i}") for i in range(9)] + [("k1", 77, "same1"), ("k1", 77, "same0")]
    got = {r["message_id"]: r["older"] for r in earliest_before(spark.createDataFrame(rows, "key string, at bigint, message_id string"), 360, 12).collect()}
    want = {m: min((a, i) for k, a, i in rows if k == key and at - 360 <= a <= at)[1] for key, at, m in rows}
    assert got == want


def test_concern_lines():
    import re

    p = re.compile(C.concern_pattern())
    yes = ["nit: x", "NITS: x", "- bug: y", "3) shouldn't it", "can't", "wont be", "should  not go", "* Would not", "doesnt", "broken: z"]
    no = ["a nit: x", "fine", "cannot", "should it", "issue x", "-nit: x", "does not"]
    assert [x for x in yes if not p.search(x)] == [] and [x for x in no if p.search(x)] == []


def test_batches_to_a_caller(spark):
    m = spark.range(0, 1000, 1, 8).select(F.col("id"), (F.col("id") * 2).alias("twice"))
    got = list(store.batches(m, ["id"], rows=40, ahead=2))
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(1000)) and max(b.num_rows for b in got) <= 40
    pulled = store.batches(m, rows=40)
    assert next(pulled).column("twice").to_pylist() == list(range(0, 80, 2))
    pulled.close()  # an early stop
    assert list(store.batches(m.limit(0))) == []


def test_manifest_of_one_file(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "m.js.gz", "wt") as f:
        f.write('{"/a/git/0.git": {"fingerprint": "f0",\n "modified": 5, "symlinks": ["x"]},\n "/b/git/1.git": {"modified": null}}')
    assert sorted(rows_of(store.read_manifest(spark, str(tmp_path)))) == [("/a/git/0.git", "f0", 5), ("/b/git/1.git", None, None)]
