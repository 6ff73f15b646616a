"""Driver queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import held_out, span_text, table


def op1_pii(spark, sf_dir):
    from .pii import find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )


def op2_quality_rules(spark, sf_dir):
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_near_dedup(spark, sf_dir):
    from .near_dedup import find_near_duplicates

    return find_near_duplicates(table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    from .secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_pieces(spark, sf_dir):
    from .pieces import decode, encode

    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return decode(ids, model_path()).select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op6_language(spark, sf_dir):
    from .language import identify, learn, training_labels

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text"), training_labels(docs))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op7_quality(spark, sf_dir):
    from .quality import learn, rank, training_labels

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, training_labels(table(spark, sf_dir, "labels")))
    return rank(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("kept").alias("top_quantile"),
    )


def op8_decontaminate(spark, sf_dir):
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark, sf_dir):
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_passages(spark, sf_dir):
    from .passages import find_passages, with_classes

    return with_classes(find_passages(table(spark, sf_dir, "documents"), within=False))  # passages that repeat across documents


def op11_clusters(spark, sf_dir):
    from .kd_clusters import cluster, with_inertia

    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))


def op12_alignment(spark, sf_dir):
    import public_tokenizers

    from .alignment import align

    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found, _ = align(table(spark, sf_dir, "documents").select("doc_id", "text"), *paths, digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_topk(spark, sf_dir):
    from .maxscore import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries():
    return {k: f for k, f in globals().items() if (k.startswith("op") or k == "pipeline") and callable(f)}


def _rounds(n: int) -> str:
    """Rounds of exact k-means: c{i} are the centroids before round i + 1, a{i} the vectors with theirs."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""
  d{i} AS (SELECT r, k, sum((x - c) * (x - c)) AS d FROM p JOIN c{i} USING (j) GROUP BY r, k),
  a{i} AS (SELECT r, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < n:
            parts.append(f"""
  m{i} AS (SELECT k, j, sum(x) AS s, count(*) AS n FROM p JOIN a{i} USING (r) GROUP BY k, j),
  c{i + 1} AS (SELECT k, j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{i} LEFT JOIN m{i} USING (k, j))""")
    return ",".join(parts)


ORACLE = {
    "op11_clusters": f"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS z FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
  p AS (SELECT r, unnest(range(64)) AS j, unnest(z) AS x FROM v),
  f AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), z) - 1 AS k, z FROM v WHERE vec_id IS NOT NULL QUALIFY k < 16),
  c0 AS (SELECT k, unnest(range(64)) AS j, unnest(z) AS c FROM f),{_rounds(3)},
  n AS (SELECT k, sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY j)) AS h FROM c3 GROUP BY k)
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN n USING (k)""",
    "op13_topk": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS z FROM embeddings
    WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
  p AS (SELECT r, vec_id, unnest(range(len(z))) AS j, unnest(z) AS x FROM v),
  s AS (
    SELECT q.r, q.vec_id AS query_id, p.vec_id, p.r AS other, sum(q.x * p.x)::BIGINT AS score
    FROM p q JOIN p ON q.j = p.j AND q.r <> p.r WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5""",
}


def oracle_sql():
    return ORACLE
