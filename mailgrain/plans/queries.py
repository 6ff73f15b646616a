"""Driver queries: each applies an operator to whole test tables, with its equivalent in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.bounds import time_bound
from ..operators import activity as A
from ..operators import classify as C
from ..operators import derive as D
from ..operators import fusion as U
from ..operators import predicates as P
from ..operators import search as S
from ..operators import status as ST
from ..operators import threads as G
from ..operators import vector as V
from ..sources import maintainers as MT
from ..sources import store
from ..streaming import windows
from .adapters import MESSAGES_SQL, conversation_edges, headers, messages, micros, parts, table, texts

NOW = time_bound("2001-08-02", 0)
Y1997, Y1998 = time_bound("1997-01-01", 0), time_bound("1998-01-01", 0)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def on_messages(sql: str):
    return query(MESSAGES_SQL + sql)


def _as_messages(docs: DataFrame) -> DataFrame:
    return docs.withColumn("subject_raw", F.col("text"))


# -- predicates ---------------------------------------------------------------------------------------------------------


@on_messages("SELECT message_id, list, date_unix_ns FROM msgs WHERE from_addr = 'c7@example.com' ORDER BY date_unix_ns DESC, message_id LIMIT 50")
def eq_author_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.eq(headers(spark, sf_dir), "from_addr", "c7@example.com", limit=50).select("message_id", "list", "date_unix_ns")


@on_messages(f"SELECT message_id, from_addr, date_unix_ns FROM msgs WHERE list = '1-URGENT' AND date_unix_ns >= {Y1997} AND date_unix_ns < {Y1998} ORDER BY date_unix_ns DESC, message_id LIMIT 100")
def eq_list_window(spark, sf_dir):
    return P.eq(headers(spark, sf_dir), "list", "1-URGENT", Y1997, Y1998).select("message_id", "from_addr", "date_unix_ns")


@on_messages("SELECT message_id, from_addr, date_unix_ns FROM msgs WHERE from_addr IN ('c1@example.com', 'c20@example.com', 'c300@example.com')")
def in_list_authors(spark, sf_dir):
    found = P.in_list(headers(spark, sf_dir), "from_addr", ["c1@example.com", "c20@example.com", "c300@example.com"], limit=None)
    return found.select("message_id", "from_addr", "date_unix_ns")


@on_messages("SELECT count(*) AS count, count(DISTINCT from_addr) AS distinct_authors, min(date_unix_ns) AS first_ns, max(date_unix_ns) AS last_ns FROM msgs WHERE list = '5-LOW'")
def count_summary(spark, sf_dir):
    return P.count_summary(headers(spark, sf_dir), "list", "5-LOW")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def substr_text_ci(spark, sf_dir):
    return P.substr_subject(_as_messages(texts(spark, sf_dir)), "License", limit=None).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Z]{3,}!!\s[A-Z]+')")
def regex_validated(spark, sf_dir):
    return P.regex(_as_messages(texts(spark, sf_dir)), "subject", r"[A-Z]{3,}!!\s[A-Z]+", limit=None).select("doc_id")


@on_messages("SELECT message_id, list FROM msgs WHERE len(list_filter(reviewers, lambda x: contains(x, 's11@'))) > 0")
def trailer_contains(spark, sf_dir):
    return P.substr_trailers(messages(spark, sf_dir), "reviewed_by", "S11@", limit=None).select("message_id", "list")


@on_messages("SELECT message_id FROM msgs WHERE list_contains(reviewers, 's12@example.com') ORDER BY date_unix_ns DESC, message_id LIMIT 100")
def eq_reviewer_email(spark, sf_dir):
    return P.eq(messages(spark, sf_dir), "reviewed_by", "S12@example.com").select("message_id")


@on_messages("""SELECT kind, count(*) AS rows, count(DISTINCT email) AS emails FROM (
  SELECT 'from' AS kind, from_addr AS email FROM msgs UNION ALL SELECT 'reviewed_by', unnest(reviewers) FROM msgs) GROUP BY kind""")
def involvement_kinds(spark, sf_dir):
    return D.involvement(messages(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("rows"), F.countDistinct("email").alias("emails"))


@on_messages("""SELECT DISTINCT message_id, date_unix_ns FROM (SELECT message_id, date_unix_ns, from_addr AS email FROM msgs
  UNION ALL SELECT message_id, date_unix_ns, unnest(reviewers) FROM msgs) WHERE contains(email, '17@') ORDER BY date_unix_ns DESC, message_id LIMIT 100""")
def involvement_any(spark, sf_dir):
    m = messages(spark, sf_dir)
    return P.involved(m, "any", "17@").select("message_id", "date_unix_ns")


@on_messages("SELECT message_id, date_unix_ns FROM msgs WHERE starts_with(from_addr, 'c14') ORDER BY date_unix_ns DESC, message_id LIMIT 100")
def header_prefix(spark, sf_dir):
    m = headers(spark, sf_dir)
    return P.involved(m, "from", "C14", "prefix").select("message_id", "date_unix_ns")


@on_messages("SELECT message_id, date_unix_ns FROM msgs WHERE date_unix_ns < 900000000000000000 OR (date_unix_ns = 900000000000000000 AND message_id > 'o1') ORDER BY date_unix_ns DESC, message_id LIMIT 40")
def keyset_page(spark, sf_dir):
    return P.keyset_page(headers(spark, sf_dir), 40, (900000000000000000, "o1")).select("message_id", "date_unix_ns")


@query("SELECT 'o' || o_orderkey || '@x' AS message_id FROM orders WHERE o_orderkey % 7 = 0 AND contains(sha1(CAST(o_orderkey AS VARCHAR)), 'abcde')")
def citation_fixes(spark, sf_dir):
    m = headers(spark, sf_dir)
    return m.filter(F.exists(X.items("fixes"), lambda x: P.contains_ci(x, "abcde"))).select("message_id")


@query("""SELECT ref_kind, count(*) AS rows, count(DISTINCT ref_value) AS ref_values FROM (
  SELECT 'raw_lc' AS ref_kind, sha1(CAST(o_orderkey AS VARCHAR)) AS ref_value FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 'sha_prefix', sha1(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderkey % 7 = 0) GROUP BY ref_kind""")
def trailer_ref_kinds(spark, sf_dir):
    return D.trailer_refs(headers(spark, sf_dir)).groupBy("ref_kind").agg(F.count("*").alias("rows"), F.countDistinct("ref_value").alias("ref_values"))


@query("""SELECT 'o' || o_orderkey || '@x' AS message_id, o_orderkey % 3 + 1 AS version, o_orderkey % 4 AS index, 3 AS total, o_orderkey % 4 = 0 AS cover,
  'Order ' || o_orderstatus || ' of customer ' || o_custkey AS normalized FROM orders""")
def subject_parts(spark, sf_dir):
    s = headers(spark, sf_dir).select("message_id", X.subject_parts(F.concat(F.lit("Re: "), F.col("subject_raw"))).alias("s"))
    return s.select("message_id", "s.version", "s.index", "s.total", "s.cover", "s.normalized")


# -- activity -----------------------------------------------------------------------------------------------------------


@on_messages("SELECT message_id, date_unix_ns FROM msgs WHERE list_contains(touched_files, 'part/155')")
def file_activity(spark, sf_dir):
    return A.file_activity(messages(spark, sf_dir), "part/155").select("message_id", "date_unix_ns")


@on_messages("""SELECT strftime(make_timestamp(date_unix_ns // 1000), '%Y') || 'Q' || quarter(make_timestamp(date_unix_ns // 1000)) AS bucket,
  count(*) AS messages, count(DISTINCT from_addr) AS authors FROM msgs WHERE list_contains(touched_files, 'part/155') GROUP BY 1""")
def file_timeline(spark, sf_dir):
    return A.file_timeline(messages(spark, sf_dir), "part/155")


@on_messages("""SELECT * FROM (SELECT path, count(DISTINCT message_id) AS patches, count(DISTINCT from_addr) AS authors, min(date_unix_ns) AS first_ns, max(date_unix_ns) AS last_ns,
    array_to_string(list_slice(list_sort(list(DISTINCT from_addr)), 1, 5), ',') AS some_authors
  FROM (SELECT message_id, from_addr, date_unix_ns, unnest(touched_files) AS path FROM msgs) GROUP BY path) ORDER BY patches DESC, authors DESC, path LIMIT 20""")
def list_churn_top_files(spark, sf_dir):
    return A.churn(messages(spark, sf_dir), parts=parts(spark, sf_dir))


@on_messages("""SELECT count(*) AS messages, sum(CAST(has_patch AS INT)) AS patches, sum(CAST(NOT has_patch AS INT)) AS covers, sum(CAST(k % 5 = 0 AS INT)) AS replies,
  sum(CAST(series_version > 1 AS INT)) AS rerolls, sum(CAST(k % 7 = 0 AS INT)) AS with_fixes, 0 AS to_stable, sum(CAST(coalesce(len(reviewers), 0) > 0 AS INT)) AS reviewed,
  0 AS acked, 0 AS tested, 0 AS signed_off, count(DISTINCT subject_normalized) AS subjects, count(DISTINCT list) AS lists,
  min(date_unix_ns) AS first_ns, max(date_unix_ns) AS last_ns FROM msgs WHERE from_addr = 'c7@example.com'""")
def author_profile(spark, sf_dir):
    return A.author_profile(messages(spark, sf_dir), "c7@example.com")


@on_messages("SELECT list, count(*) AS messages, sum(CAST(has_patch AS INT)) AS patches FROM msgs WHERE from_addr = 'c7@example.com' GROUP BY list")
def author_lists(spark, sf_dir):
    return A.author_lists(headers(spark, sf_dir), "c7@example.com")


@on_messages("""SELECT message_id, list, date_unix_ns, string_agg(role, ',' ORDER BY role) AS roles FROM (
  SELECT message_id, list, date_unix_ns, 'author' AS role FROM msgs WHERE from_addr = 's9@example.com'
  UNION ALL SELECT message_id, list, date_unix_ns, 'reviewed_by' FROM msgs WHERE list_contains(reviewers, 's9@example.com'))
  GROUP BY 1, 2, 3 ORDER BY date_unix_ns DESC, message_id, list LIMIT 100""")
def author_footprint(spark, sf_dir):
    return A.author_footprint(messages(spark, sf_dir), "s9@example.com")


@on_messages("SELECT message_id FROM msgs WHERE len(list_filter(reviewers, lambda x: contains(x, 's9@example.com'))) > 0 AND from_addr <> 's9@example.com'")
def mentions_beyond_authored(spark, sf_dir):
    return A.mentions_beyond_authored(messages(spark, sf_dir), "s9@example.com").select("message_id")


@on_messages("""SELECT email, count(*) AS reviewed_by, 0 AS acked_by, 0 AS tested_by, 0 AS signed_off_by, max(date_unix_ns) AS last_ns
  FROM (SELECT unnest(reviewers) AS email, date_unix_ns FROM msgs) GROUP BY email""")
def trailer_counts(spark, sf_dir):
    return A.trailer_counts(messages(spark, sf_dir))


@on_messages("""SELECT coalesce(d.email, o.email) AS email, CASE WHEN o.email IS NULL THEN 'declared_only' ELSE 'observed_only' END AS side FROM
  (SELECT 's' || s_suppkey || '@example.com' AS email FROM supplier WHERE s_suppkey % 3 = 0) d FULL JOIN
  (SELECT DISTINCT unnest(reviewers) AS email FROM msgs WHERE list_contains(touched_files, 'part/155')) o ON d.email = o.email WHERE d.email IS NULL OR o.email IS NULL""")
def declared_vs_observed(spark, sf_dir):
    some = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0")
    declared = some.select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit("@example.com")).alias("email"))
    observed = A.trailer_counts(A.file_activity(messages(spark, sf_dir), "part/155"), ("reviewed_by",))
    return A.declared_vs_observed(declared, observed)


@on_messages("SELECT list, count(*) AS messages, min(date_unix_ns) AS first_ns, max(date_unix_ns) AS last_ns FROM msgs GROUP BY list")
def corpus_stats(spark, sf_dir):
    return A.corpus_stats(headers(spark, sf_dir))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM lineitem GROUP BY l_orderkey")
def array_sets(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    return sets.select("l_orderkey", F.array_join(F.col("p").cast("array<string>"), ",").alias("parts"))


@query("""SELECT p AS path, CASE WHEN p LIKE 'part/1_' THEN 'teens' ELSE 'part' END AS name, CASE WHEN p LIKE 'part/1_' THEN 2 ELSE 1 END AS depth
  FROM (SELECT DISTINCT 'part/' || p_partkey AS p FROM part) WHERE p LIKE 'part/1_' OR NOT starts_with(p, 'part/2')
  UNION ALL SELECT p, 'part', 1 FROM (SELECT DISTINCT 'part/' || p_partkey AS p FROM part) WHERE p LIKE 'part/1_'""")
def path_owners(spark, sf_dir):
    sections = MT.parse("PART\nM:\tA <a@x.org>\nF:\tpart/\nX:\tpart/2*\n\nTEENS\nF:\tpart/1?\n")
    for s in sections:
        s["name"] = s["name"].lower()
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey")).alias("path"))
    return MT.owners(paths, MT.rules(spark, sections))


# -- threads and series -------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (
  SELECT conv_id, turn, turn AS root FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1)
  UNION ALL SELECT c.conv_id, c.turn, r.root FROM c JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
  SELECT conv_id || ':' || turn AS message_id, conv_id || ':' || root AS tid FROM r""")
def thread_roots(spark, sf_dir):
    return G.thread_roots(conversation_edges(spark, sf_dir))


@query("SELECT DISTINCT conv_id || ':' || turn AS message_id, turn AS date_unix_ns FROM conversations WHERE conv_id = 3")
def thread_members(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.col("role").alias("list"), F.col("turn").alias("date_unix_ns"))
    tid = G.thread_roots(conversation_edges(spark, sf_dir))
    return G.thread_of(m.dropDuplicates(["message_id"]), tid, "3:0").select("message_id", "date_unix_ns")


@on_messages("""SELECT a.message_id, CAST(a.series_version AS INT) AS series_version, CAST(a.series_index AS INT) AS series_index FROM msgs a JOIN msgs s
  ON s.message_id = 'o5@x' AND a.list = s.list AND a.subject_normalized = s.subject_normalized AND a.from_addr = s.from_addr""")
def series_order(spark, sf_dir):
    return G.series(headers(spark, sf_dir), "o5@x").select("message_id", "series_version", "series_index")


@on_messages("""SELECT message_id, best AS superseded_by FROM (SELECT message_id, series_version, max(series_version) OVER w AS top,
    first_value(message_id) OVER (PARTITION BY list, subject_normalized, from_addr ORDER BY series_version DESC, date_unix_ns, message_id DESC) AS best
  FROM msgs WINDOW w AS (PARTITION BY list, subject_normalized, from_addr)) WHERE top > series_version""")
def superseded(spark, sf_dir):
    return G.newer_version(headers(spark, sf_dir))


@query("""SELECT h, doc_id FROM (SELECT sha256(text) AS h, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe_freshest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "doc_id", "n_chars")
    return D.freshest(d, "h", "n_chars", "doc_id").select("h", "doc_id")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 3""")
def per_key_topn(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("user_id", "event_id")


# -- text ---------------------------------------------------------------------------------------------------------------

BM25_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS t1, len(list_filter(w, lambda x: x = 'apache')) AS t2 FROM d),
s AS (SELECT count(*) AS n_docs, avg(n) AS mean, sum(CAST(t1 > 0 AS INT)) AS d1, sum(CAST(t2 > 0 AS INT)) AS d2 FROM c),
scored AS (SELECT doc_id, round(CASE WHEN t1 > 0 THEN ln(1 + (n_docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) ELSE 0 END
  + CASE WHEN t2 > 0 THEN ln(1 + (n_docs - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * n / mean)) ELSE 0 END, 9) AS score FROM c, s WHERE t1 + t2 > 0)
"""


@query(BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM scored")
def bm25_scores(spark, sf_dir):
    return S.bm25(texts(spark, sf_dir), "apache license", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 25")
def bm25_topk(spark, sf_dir):
    return S.top_scored(S.bm25(texts(spark, sf_dir), "apache license", "doc_id"), 25, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'tion of the')")
def substring_docs(spark, sf_dir):
    return S.substring(texts(spark, sf_dir), "tion of the", "text").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'MIT') AND contains(text, 'IT ') AND contains(text, 'T L') AND contains(text, ' Li')")
def trigram_candidates(spark, sf_dir):
    return S.candidates(S.trigram_table(texts(spark, sf_dir), "doc_id", "text"), "MIT Li", "doc_id")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def text_mentions(spark, sf_dir):
    return S.contains_any(texts(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item"), "doc_id", "text", "item_id", "item")


@query(r"""SELECT DISTINCT page_id, path FROM (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, '[A-Za-z0-9_./+-]*[A-Za-z0-9_+-]'), lambda t: regexp_replace(t, '^(?:[ab]/)', '')))) AS path FROM pages)
  WHERE path IN ('www.example.com', 'charset', 'body', 'html', 'utf-8')""")
def path_mentions(spark, sf_dir):
    v = spark.createDataFrame([("www.example.com",), ("charset",), ("body",), ("html",), ("utf-8",)], "path string")
    return S.path_mentions(table(spark, sf_dir, "pages"), v, "page_id", "html").select("page_id", "path")


@query()
def fuzzy_substring(spark, sf_dir):
    return S.fuzzy_substring(texts(spark, sf_dir), "MIT Licence.", 1, "doc_id", "text")


@query("""SELECT doc_id, strlen(substr(text, 1, instr(lower(text), 'license') - 1)) AS byte_offset, sha256(text) AS sha256 FROM documents WHERE contains(lower(text), 'license')""")
def kwic(spark, sf_dir):
    return S.kwic(texts(spark, sf_dir), "license", "doc_id", "text").select("doc_id", "byte_offset", "sha256")


@query(BM25_SQL + """, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored ORDER BY score DESC, doc_id LIMIT 1000),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE contains(text, 'MIT License') ORDER BY n_chars DESC, doc_id LIMIT 1000)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""")
def rrf_fused(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    prose = U.ranked(S.bm25(d, "apache license", "doc_id"), "prose", [F.desc("score"), F.asc("doc_id")], "doc_id")
    exact = U.ranked(S.substring(d, "MIT License", "text"), "patch", [F.desc("n_chars"), F.asc("doc_id")], "doc_id")
    return U.fuse([prose, exact], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bidiot|\bclown|\bscum|worthless') THEN 'rude' WHEN contains(text, 'License') THEN 'license' ELSE 'other' END AS label FROM documents""")
def classify_ladder(spark, sf_dir):
    t = F.col("text")
    label = F.when(t.rlike(r"(?i)\bidiot|\bclown|\bscum|worthless"), "rude").when(F.contains(t, F.lit("License")), "license").otherwise("other")
    return texts(spark, sf_dir).select("doc_id", F.coalesce(label, F.lit("other")).alias("label"))


@query(r"""SELECT 'o' || k || '@x' AS message_id, CASE k % 9 WHEN 0 THEN 'revert' WHEN 1 THEN 'security' WHEN 2 THEN 'bugfix' WHEN 3 THEN 'backport' WHEN 4 THEN 'doc' WHEN 5 THEN 'test' WHEN 6 THEN 'cleanup' WHEN 7 THEN 'feature' ELSE 'unknown' END AS label
  FROM (SELECT o_orderkey AS k FROM orders)""")
def classify_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    subject = F.concat(F.element_at(F.array(*map(F.lit, ["Revert ", "fix CVE-2024-10001 ", "x ", "x ", "docs: ", "selftests: ", "mm: cleanup ", "x ", "x "])), (k % 9 + 1).cast("int")), k)
    some = lambda n, v: F.when(k % 9 == n, F.array(F.lit(v)))
    m = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), k, F.lit("@x")).alias("message_id"), subject.alias("subject_raw"), subject.alias("subject_normalized"), some(7, "RFC").alias("subject_tags"),
        F.when(k % 9 < 3, F.array(F.lit("f"))).alias("fixes"), F.when((k % 9 == 3) | (k % 9 == 2), F.array(F.lit("stable@x"))).alias("cc_stable"), F.lit(None).cast("string").alias("patch"),
    )
    return C.classify(m).select("message_id", "label")


@query()
def summaries(spark, sf_dir):
    return C.summarize(texts(spark, sf_dir), 2, "doc_id", "text")


@query(r"SELECT page_id, nullif(lower(regexp_extract(url, '^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host FROM pages")
def url_refs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))


# -- vectors, commits, sources, streams ---------------------------------------------------------------------------------


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))
  / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))), 6) AS similarity
  FROM embeddings, q WHERE vec_id <> 7 ORDER BY similarity DESC, vec_id LIMIT 10""")
def similar_excl_seed(spark, sf_dir):
    return V.similar_to(table(spark, sf_dir, "embeddings"), 7, 10, "vec_id")


@query("""WITH q AS (SELECT list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE -0.5 END) AS q) SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))
  / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))), 6) AS similarity
  FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 10""")
def nearest_topk(spark, sf_dir):
    return V.nearest(table(spark, sf_dir, "embeddings"), [1.0 if i % 2 == 0 else -0.5 for i in range(64)], 10, "vec_id")


@query("""SELECT 'o' || a.o_orderkey || '@x' AS message_id, sha1(CAST(b.o_orderkey AS VARCHAR)) AS sha FROM orders a JOIN orders b
  ON a.o_orderstatus = b.o_orderstatus AND a.o_custkey = b.o_custkey AND abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= 2592000000000""")
def sidecar_window(spark, sf_dir):
    m = headers(spark, sf_dir)
    commits = m.select(F.lit("main").alias("repo"), F.sha1(F.regexp_extract("message_id", "[0-9]+", 0)).alias("sha"), F.col("subject_normalized").alias("subject"), F.col("from_addr").alias("author_email"), F.col("date_unix_ns").alias("author_date_ns"))
    return ST.commits_for(m, commits, 30).select("message_id", "sha")


@query("SELECT 'p' || p_partkey AS path, CAST(p_size AS VARCHAR) AS fingerprint FROM part WHERE p_partkey % 10 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 6 = 0)")
def manifest_changes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path, k = F.concat(F.lit("p"), F.col("p_partkey")).alias("path"), F.col("p_partkey")
    now = p.select(path, F.col("p_size").cast("string").alias("fingerprint"))
    before = p.filter(k % 6 != 0).select(path, F.when(k % 4 == 0, "old").otherwise(F.col("p_size").cast("string")).alias("fingerprint"))
    return store.manifest_diff(now, before, include="^p", exclude="0$")


@query("""SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, sf_dir):
    w = windows.tumbling_counts(table(spark, sf_dir, "events"))
    return w.select(micros("window_start").alias("start_us"), "event_type", "events", F.round("total", 2).alias("total"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM e)
SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, g""")
def sessions(spark, sf_dir):
    s = windows.sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", micros("session_start").alias("start_us"), micros("session_end").alias("end_us"), "events")
