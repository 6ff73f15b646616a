"""The table of vectors by cells against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgrain.operators import vector as V
from mailgrain.operators import vector_index as VI

DIMS = 24


def made(n, groups, noise, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, DIMS))
    return middle[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, DIMS))


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    v = made(4000, 60, 0.5)
    rows = [(f"m{i}", x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    odd = [("null", None), ("short", [1.0]), ("zero", [0.0] * DIMS), ("nan", [float("nan")] * DIMS), ("hole", [None] * DIMS), ("twice", rows[5][1]), ("twice", rows[5][1]), ("large", [3e38] * DIMS)]
    df = spark.createDataFrame(rows + odd, "message_id string, embedding array<float>").repartition(4)
    path = str(tmp_path_factory.mktemp("index"))
    VI.build_index(df, path, cells=64, model="made")
    return df, VI.Index(spark, path), v


def test_recall_and_share(clustered):
    df, index, v = clustered
    k, probes, queries = 10, 8, list(range(0, 4000, 50))
    want = {}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in queries:
        want[i] = {f"m{j}" for j in np.argsort(-(u @ u[i]))[:k]}
    q = df.sparkSession.createDataFrame([(i, v[i].tolist()) for i in queries], "query int, q array<double>")
    got = index.search_many(q, k, probes).collect()
    hits = sum(r["key"] in want[r["query"]] or r["key"] == "twice" for r in got)
    size = dict(zip(index.cells.tolist(), index.sizes.tolist()))
    read = sum(size[r["cell"]] for r in index.routed(q, probes).collect()) / (len(queries) * index.n)
    print(f"recall {hits / (k * len(queries)):.3f}, share of rows read {read:.3f}")
    assert hits >= 0.95 * k * len(queries) and read < 0.2


def test_one_search_reads_its_cells(clustered):
    df, index, v = clustered
    rows = index.rows.filter(F.col("cell").isin([1, 2]))
    plan = rows.select("key", "code")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and "vector" not in plan.split("ReadSchema: ")[1].split(">")[0]
    got = index.search(v[7].tolist(), 5, exact=True).collect()
    want = V.nearest(df.filter("message_id not in ('nan', 'hole', 'short')"), v[7].tolist(), 5).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("probes", [1, 4])
def test_exact_on_vectors_without_clusters(spark, tmp_path, probes):
    v = made(600, 600, 0.1, seed=3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "message_id int, embedding array<double>")
    VI.build_index(df, str(tmp_path), cells=20)
    index = VI.Index(spark, str(tmp_path))
    q = df.filter("message_id % 40 = 0").select(F.col("message_id").alias("query"), F.col("embedding").alias("q"))
    got = index.search_many(q, 7, probes, exact=True).collect()
    for i in range(0, 600, 40):
        want = [(r["message_id"], r["similarity"]) for r in V.nearest(df, v[i].tolist(), 7).collect()]
        assert sorted([(r["rank"], r["key"], r["similarity"]) for r in got if r["query"] == i]) == [(n + 1, *w) for n, w in enumerate(want)]


def test_seed_blocks_and_odd_rows(clustered, monkeypatch):
    df, index, v = clustered
    assert index.n == 4000 + 3 and index.model == "made"
    assert index.similar_to("m9").first()["key"] == "m9" and "m9" not in [r["key"] for r in index.similar_to("m9", include_seed=False).collect()]
    with pytest.raises(KeyError):
        index.similar_to("null")
    with pytest.raises(ValueError):
        index.search([1.0])
    q = df.filter("message_id in ('m5', 'm6', 'zero', 'null')").select(F.col("message_id").alias("query"), F.col("embedding").alias("q"))
    one = sorted(tuple(r) for r in index.search_many(q, 4).collect())
    assert sum(r[0] == "m5" and r[1] == "twice" for r in one) == 2 and {r[0] for r in one} == {"m5", "m6"}
    monkeypatch.setattr(VI, "BLOCK_ROWS", 20)
    monkeypatch.setattr(VI, "BLOCK_QUERIES", 1)
    monkeypatch.setattr(VI, "MAX_BROADCAST", 0)
    assert sorted(tuple(r) for r in index.search_many(q, 4).collect()) == one


def test_empty_index(spark, tmp_path):
    VI.build_index(spark.createDataFrame([], "message_id string, embedding array<float>"), str(tmp_path), dims=3)
    assert VI.Index(spark, str(tmp_path)).search([1.0, 2.0, 3.0], exact=True).collect() == []


def test_few_vectors_meet_all_centroids_at_once():
    """A task's products have AT_ONCE rows at most, whatever an Arrow batch holds."""
    import pyarrow as pa

    b = pa.record_batch({"x": list(range(10_000))})
    parts = list(VI.sliced(iter([b, b.slice(0, 5)])))
    assert max(p.num_rows for p in parts) == VI.AT_ONCE and sum((p.column(0).to_pylist() for p in parts), []) == [*range(10_000), *range(5)]


def test_free_text(spark, tmp_path):
    texts = ["mount option parsing fails", "network driver timeout", "parsing of mount options", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "message_id int, text string")
    rows = VI.embed(docs, "text", VI.hashed_words(64))
    assert [r["embedding"] is None for r in rows.orderBy("message_id").collect()] == [False, False, False, True, False]
    VI.build_index(rows, str(tmp_path), cells=2)
    index = VI.Index(spark, str(tmp_path))
    assert index.n == 3
    assert index.search_text("timeout of a network driver", VI.hashed_words(64), 1, probes=2).first()["key"] == 1


def test_vectoriser_is_loaded_once_a_worker(spark, tmp_path):
    def counted():
        with open(f"{tmp_path}/loads", "a") as f:
            f.write("x")
        return lambda texts: np.ones((len(texts), 2))

    docs = spark.range(500).select(F.col("id").cast("string").alias("text")).coalesce(1)
    assert VI.embed(docs, "text", counted, batch=10).count() == 500
    assert len(open(f"{tmp_path}/loads").read()) == 1
