"""Driver queries over parsed mail, the store, threads with prose, verdicts and views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.bounds import window
from ..lineage import checkpointed, scratch_folder, written
from ..operators import activity as A
from ..operators import classify as C
from ..operators import derive as D
from ..operators import fusion as U
from ..operators import predicates as P
from ..operators import search as S
from ..operators import status as ST
from ..operators import threads as G
from ..operators import views
from ..schema import COMMITS, MESSAGES, OTHER_TRAILERS, PEOPLE
from ..sources import maintainers as MT
from ..sources import store
from ..sources.mail import parse_messages
from .adapters import MESSAGES_SQL, TALK_SQL, headers, mails, messages, nanos, table, talk
from .adapters import parts as of_lines
from .queries import NOW, query

APRIL = 1777593600 * 10**9  # 2026-05-01
MAIL_SQL = """WITH m AS (SELECT o_orderkey AS k, o_custkey AS c, 'o' || o_orderkey || '@x' AS message_id, o_orderpriority AS list, epoch_us(o_orderdate) * 1000 AS commit_ns,
  CASE WHEN o_orderkey % 9 = 0 THEN epoch_us(o_orderdate) * 1000 ELSE (1775001600 + (o_orderkey % 28) * 86400 + 43200) * 1000000000 END AS date_unix_ns FROM orders) """


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_messages(mails(spark, sf_dir), APRIL)


def on_talk(sql: str):
    return query(MESSAGES_SQL + TALK_SQL + sql)


def threaded(spark, sf_dir):
    m = talk(spark, sf_dir)
    return m, checkpointed(G.thread_roots(G.parents(m.select("message_id", "in_reply_to", "references"))))


def commits(m: DataFrame, every: int) -> DataFrame:
    """Each ``every``-th message as a commit."""
    k = F.regexp_extract("message_id", "[0-9]+", 0)
    return m.filter(k.cast("bigint") % every == 0).select(
        F.when(k.cast("bigint") % 3 == 0, "linux-stable").otherwise("linux").alias("repo"), F.sha1(k).alias("sha"), F.col("subject_normalized").alias("subject"),
        F.col("from_addr").alias("author_email"), F.col("date_unix_ns").alias("author_date_ns"), F.md5(k).alias("patch_id"),
    )


# -- parsing ------------------------------------------------------------------------------------------------------------


@query(MAIL_SQL + """SELECT message_id, list, 'c' || c || '@example.com' AS from_addr, 'Cust ' || c AS from_name, 'part: order ' || k AS subject_normalized, date_unix_ns,
  CASE WHEN k % 5 = 0 THEN 'o' || (k - 1) || '@x' END AS in_reply_to, CASE WHEN k % 5 = 0 THEN 'a@x,o' || (k - 1) || '@x' ELSE '' END AS refs, 'l@x.org,b@x.org' AS recipients,
  k % 3 + 1 AS series_version, k % 4 AS series_index, 3 AS series_total, k % 4 = 0 AS is_cover_letter FROM m""")
def parsed_headers(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "message_id", "list", "from_addr", "from_name", "subject_normalized", "date_unix_ns", "in_reply_to", F.array_join("references", ",").alias("refs"), F.array_join("to_addrs", ",").alias("recipients"),
        "series_version", "series_index", "series_total", "is_cover_letter",
    )


LINES_SQL = """'Fixes: ' || sha1(CAST(k AS VARCHAR)) || ' ("x")\nReviewed-by: S <s' || k % 7 || '@Example.com>\nX-Odd: Q <q' || k % 3 || '@x.org>\nLink: https://bugs.example.com/bug?extid=' || substr(sha1(CAST(k AS VARCHAR)), 1, 20)
  || '\nLink: https://arch.example.org/all/o' || k || '@x/\n---\n'"""


@query(MAIL_SQL + f"""SELECT message_id, 'Hello ' || k || '\n\n' || {LINES_SQL} AS prose, 'p/' || k % 11 || '.c' AS files, 'f_' || k % 13 AS functions, 1 AS files_changed, 2 AS insertions, 1 AS deletions, TRUE AS has_patch,
  sha256('Hello ' || k || '\n> quoted\n\n' || {LINES_SQL} || replace('diff --git a/F b/F\n--- a/F\n+++ b/F', 'F', 'p/' || k % 11 || '.c') || '\n@@ -1,2 +1,3 @@ int f_' || k % 13 || '(void)\n a\n+b\n+d\n-c\n') AS body_sha256 FROM m""")
def parsed_bodies(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "message_id", "prose", F.array_join("touched_files", ",").alias("files"), F.array_join("touched_functions", ",").alias("functions"), "files_changed", "insertions", "deletions", "has_patch", "body_sha256"
    )


@query(MAIL_SQL + """SELECT message_id, 'S <s' || k % 7 || '@Example.com>' AS reviewed_by, sha1(CAST(k AS VARCHAR)) || ' ("x")' AS fixes, 2 AS links, 'q' || k % 3 || '@x.org' AS odd FROM m""")
def parsed_trailers(spark, sf_dir):
    m = written(parsed(spark, sf_dir).select(*D.ROW, "reviewed_by", "fixes", "link", "trailers_json"), "trailers")
    odd = D.long_tail(m).filter("kind = 'x-odd'").select("message_id", F.col("email").alias("odd"))
    own = m.select("message_id", F.array_join("reviewed_by", ",").alias("reviewed_by"), F.array_join("fixes", ",").alias("fixes"), F.size("link").alias("links"))
    return own.join(odd, "message_id")


@query("""SELECT ref_kind, n AS rows FROM (SELECT count(*) AS o FROM orders), (VALUES ('raw_lc', 5), ('bug_hash', 1), ('url_lc', 2), ('archive_mid', 1), ('email', 2), ('sha_prefix', 1)) v(ref_kind, per), LATERAL (SELECT o * per AS n)""")
def trailer_ref_all_kinds(spark, sf_dir):
    return D.trailer_refs(parsed(spark, sf_dir)).groupBy("ref_kind").agg(F.count("*").alias("rows"))


@query(MAIL_SQL + "SELECT message_id, 'bug_hash' AS ref_kind FROM m WHERE substr(sha1(CAST(k AS VARCHAR)), 1, 20) = substr(sha1('7'), 1, 20) UNION ALL SELECT message_id, 'archive_mid' FROM m WHERE k = 32")
def ref_lookups(spark, sf_dir):
    m = written(parsed(spark, sf_dir).select(*D.ROW, *PEOPLE, *OTHER_TRAILERS, "trailers_json"), "trailers")
    refs = D.trailer_refs(m)
    by_hash = P.ref_lookup(refs, m, "bug_hash", "902ba3cda1883801594b").select("message_id", F.lit("bug_hash").alias("ref_kind"))
    return by_hash.unionByName(P.ref_lookup(refs, m, "archive_mid", "o32@x", "link").select("message_id", F.lit("archive_mid").alias("ref_kind")))


@query(MAIL_SQL + "SELECT message_id FROM m WHERE c = 7 UNION ALL SELECT message_id FROM m WHERE k = 32 UNION ALL SELECT message_id FROM m WHERE k = 7 UNION ALL SELECT message_id FROM m WHERE k % 13 = 12 AND c = 7")
def find_and_cite(spark, sf_dir):
    m = written(parsed(spark, sf_dir).select(*D.ROW, "from_addr", "subject_raw", "fixes", "prose", "patch"), "cited")
    parts = [P.find(m, "C7@example.com", None), P.find(m, "<o32@x>"), P.expand_citation(m, "902ba3cda1"), P.find(P.eq(m, "from_addr", "c7@example.com", limit=None), "int f_12(void)", None)]
    out = parts[0].select("message_id")
    for p in parts[1:]:
        out = out.unionByName(p.select("message_id"))
    return out


# -- store --------------------------------------------------------------------------------------------------------------


def stored(spark, sf_dir) -> DataFrame:
    """Written, updated where 3 divides the key, compacted, updated again where 5 does, then an older run once more."""
    h = headers(spark, sf_dir)
    own = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in h.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MESSAGES.fields]
    m = h.select(*own)
    k = F.regexp_extract("message_id", "[0-9]+", 0).cast("bigint")
    at = scratch_folder(spark, "store")
    store.write_messages(m, f"{at}/a", 0)
    store.write_messages(m.filter(k % 3 == 0).withColumn("subject_raw", F.lit("third")), f"{at}/a", 1)
    store.compact(spark, f"{at}/a", f"{at}/b")
    store.write_messages(m.filter(k % 5 == 0).withColumn("subject_raw", F.lit("fifth")), f"{at}/b", 2)
    store.write_messages(m.filter(k % 7 == 0).withColumn("subject_raw", F.lit("stale")), f"{at}/b", 0)
    return store.read_messages(spark, f"{at}/b")


@query("""SELECT 'o' || o_orderkey || '@x' AS message_id, o_orderpriority AS list, CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS run,
  CASE WHEN o_orderkey % 5 = 0 THEN 'fifth' WHEN o_orderkey % 3 = 0 THEN 'third' ELSE 'first' END AS version FROM orders""")
def store_round_trip(spark, sf_dir):
    m = stored(spark, sf_dir)
    first = F.when(F.col("subject_raw").isin("third", "fifth"), F.col("subject_raw")).when((F.col("subject_raw") == "stale") | F.col("subject_raw").startswith("[PATCH"), F.lit("first"))
    return m.select("message_id", "list", "run", first.alias("version"))


@query("""SELECT 'o' || o_orderkey || '@x' AS message_id, 'scan' AS how FROM orders WHERE o_orderpriority = '5-LOW' AND (epoch_us(o_orderdate) * 1000 >= 852076800000000000 OR o_orderdate IS NULL)
  UNION ALL SELECT 'o' || o_orderkey || '@x', 'fetch' FROM orders WHERE o_orderkey = 5 UNION ALL SELECT 'o' || o_orderkey || '@x', 'many' FROM orders WHERE o_orderkey IN (1, 2, 3)
  UNION ALL SELECT 'o' || o_orderkey || '@x', 'hydrate' FROM orders WHERE o_orderkey IN (6, 7)""")
def store_reads(spark, sf_dir):
    m = checkpointed(stored(spark, sf_dir))
    ids = m.select("message_id").filter(F.col("message_id").isin("o6@x", "o7@x")).distinct()
    parts = {"scan": store.all_rows(m, "5-LOW", 852076800000000000), "fetch": store.fetch_message(m, "<o5@x>"), "many": store.get_many(m, ["o1@x", "o2@x", "o3@x"]), "hydrate": store.hydrate(m, ids)}
    out = None
    for how, p in parts.items():
        p = p.select("message_id", F.lit(how).alias("how"))
        out = p if out is None else out.unionByName(p)
    return out


@query(MESSAGES_SQL + """SELECT 'touched_file' AS name, count(*) AS rows FROM (SELECT unnest(touched_files) FROM msgs) UNION ALL SELECT 'path_vocabulary', count(*) FROM (SELECT DISTINCT unnest(touched_files) AS p FROM msgs)
  UNION ALL SELECT 'involvement', count(*) + (SELECT count(*) FROM msgs) FROM (SELECT unnest(reviewers) FROM msgs)""")
def side_tables(spark, sf_dir):
    at = scratch_folder(spark, "side")
    names = ("touched_file", "path_vocabulary", "involvement")
    store.write_side_tables(messages(spark, sf_dir), at, names, of_lines(spark, sf_dir))
    out = None
    for name in names:
        p = store.side_table(spark, at, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = p if out is None else out.unionByName(p)
    return out


@query("SELECT 'p' || p_partkey AS path, CAST(p_size AS VARCHAR) AS fingerprint, p_partkey * 7 AS modified FROM part")
def manifest_parsed(spark, sf_dir):
    """A manifest of each brand, written as gzip JSON and read back."""
    p = table(spark, sf_dir, "part")
    entry = F.struct(F.col("p_size").cast("string").alias("fingerprint"), (F.col("p_partkey") * 7).alias("modified"), F.lit("x").alias("owner"))
    one = p.groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), "p_partkey"), entry)))).alias("value"))  # a brand is a small manifest
    at = scratch_folder(spark, "manifests")
    one.select("value").write.text(at, compression="gzip")
    return store.read_manifest(spark, at, lines=True)


@query("SELECT 'o' || o_orderkey || '@x' AS message_id, substr('Order ' || o_orderstatus || ' of customer ' || o_custkey || '\nOrder ' || o_orderkey, 1, 30) AS text FROM orders WHERE o_orderkey % 5 <> 0")
def embedding_texts(spark, sf_dir):
    m = talk(spark, sf_dir).filter(F.regexp_extract("message_id", "[0-9]+", 0).cast("bigint") % 5 != 0)
    return store.embedding_text(m.filter("prose IS NOT NULL"), 30)


# -- predicates ---------------------------------------------------------------------------------------------------------


@on_talk("SELECT message_id FROM talk WHERE len(list_filter(reviewers, lambda x: contains(x, 's13@'))) > 0 ORDER BY date_unix_ns DESC, message_id LIMIT 100")
def trailer_mentions(spark, sf_dir):
    m = talk(spark, sf_dir)
    none = {c: F.lit(None).cast("array<string>") for c in P.PEOPLE if c not in m.columns}
    return P.trailer_mentions(m.withColumns(none), "S13@").select("message_id")


@query("SELECT 'o' || o_orderkey || '@x' AS message_id FROM orders WHERE contains(lower('Order ' || o_orderstatus || ' of customer ' || o_custkey), 'f of customer 10') ORDER BY o_orderdate DESC, 1 LIMIT 100")
def substr_subject(spark, sf_dir):
    return P.substr_subject(headers(spark, sf_dir), "F Of Customer 10").select("message_id")


@query("SELECT 'o' || o_orderkey || '@x' AS message_id FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 4 = 2 AND o_custkey % 100 = 7 ORDER BY o_orderdate DESC, 1 LIMIT 100")
def regex_subject(spark, sf_dir):
    return P.regex(headers(spark, sf_dir), "subject", r"^\[PATCH v2 2/3\] .*[ 0-9]07$|^\[PATCH v2 2/3\] .* 7$", anchor_required=True).select("message_id")


@on_talk("SELECT message_id FROM talk WHERE k % 97 = 12 ORDER BY date_unix_ns DESC, message_id LIMIT 50")
def eq_function(spark, sf_dir):
    return P.eq(talk(spark, sf_dir), "touched_functions", "f_12", limit=50).select("message_id")


@query(f"SELECT 'o' || o_orderkey || '@x' AS message_id FROM orders WHERE epoch_us(o_orderdate) * 1000 >= {NOW} - 14 * 604800000000000 AND epoch_us(o_orderdate) * 1000 < {NOW}")
def relative_window(spark, sf_dir):
    since, until = window("14w", str(NOW), NOW)
    return P.windowed(headers(spark, sf_dir), since, until).select("message_id")


@on_talk("SELECT path, count(*) AS messages FROM (SELECT unnest(touched_files) AS path FROM talk) GROUP BY path")
def path_vocabulary(spark, sf_dir):
    m = messages(spark, sf_dir)
    return D.path_vocabulary(m).join(D.touched(m).groupBy("path").agg(F.count("*").alias("messages")), "path")


@on_talk("SELECT message_id, date_unix_ns, from_addr FROM talk WHERE list_contains(touched_files, 'part/155') ORDER BY date_unix_ns DESC, message_id LIMIT 10")
def touched_topn(spark, sf_dir):
    m = messages(spark, sf_dir)
    return P.joined_top(D.touched(m).filter("path = 'part/155'"), m, 10).select("message_id", "date_unix_ns", "from_addr")


@on_talk("SELECT message_id, date_unix_ns FROM talk WHERE list_contains(touched_files, 'part/155') ORDER BY date_unix_ns, message_id LIMIT 7")
def timeline_events(spark, sf_dir):
    return A.timeline_events(messages(spark, sf_dir), "part/155", "asc", 7).select("message_id", "date_unix_ns")


# -- threads ------------------------------------------------------------------------------------------------------------


@on_talk("""SELECT t.message_id, t.tid, array_to_string(list_sort(list(DISTINCT p)), ',') AS files FROM (SELECT tid.message_id, tid.tid FROM tid JOIN msgs USING (message_id) WHERE k % 4 = 0) t
  JOIN (SELECT tid.tid, unnest(touched_files) AS p FROM tid JOIN msgs USING (message_id)) f ON f.tid = t.tid GROUP BY 1, 2""".replace("WHERE k", "WHERE msgs.k"))
def cover_files(spark, sf_dir):
    m, tid = threaded(spark, sf_dir)
    return G.propagate(m, tid).filter(F.size("propagated_files") > 0).select("message_id", "tid", F.array_join("propagated_files", ",").alias("files"))


@on_talk("""SELECT tid, value, row_number() OVER (PARTITION BY tid ORDER BY d, message_id, value) AS place FROM (SELECT tid, value, min(date_unix_ns) AS d, arg_min(message_id, (date_unix_ns, message_id)) AS message_id FROM (
  SELECT tid.tid, msgs.message_id, date_unix_ns, unnest(reviewers) AS value FROM tid JOIN msgs USING (message_id)) GROUP BY 1, 2)""")
def reviewers_of_threads(spark, sf_dir):
    m, tid = threaded(spark, sf_dir)
    emails = F.array_sort(F.transform("reviewed_by", lambda x: X.email_of(x)))
    return G.trailer_union(m.withColumn("reviewed_by", emails), tid)


@on_talk("SELECT a.message_id FROM msgs a WHERE a.k = 10 AND a.k % 5 = 0")
def replies_to(spark, sf_dir):
    return G.replies(headers(spark, sf_dir), "o9@x").select("message_id")


@on_talk("SELECT message_id FROM tid WHERE tid IN (SELECT tid FROM tid WHERE message_id = 'o35@x') AND EXISTS (SELECT 1 FROM msgs WHERE k = 34) UNION SELECT message_id FROM msgs WHERE k = 35")
def conversation(spark, sf_dir):
    return G.conversation(talk(spark, sf_dir), "<o35@x>").select("message_id")


@query("""WITH r AS (SELECT o_orderkey AS k, 'o' || o_orderkey || '@x' AS id, o_orderpriority AS l, o_orderstatus AS s, o_custkey AS c, epoch_us(o_orderdate) AS t FROM orders)
  SELECT a.id AS message_id, coalesce((SELECT arg_min(b.id, (b.t, b.id)) FROM r b WHERE b.l = a.l AND b.s = a.s AND b.c = a.c AND b.t BETWEEN a.t - 2592000000000 AND a.t), a.id) AS tid FROM r a""")
def subject_fallback(spark, sf_dir):
    m = headers(spark, sf_dir)
    tid = m.select("message_id", F.col("message_id").alias("tid"))
    return G.with_fallback(m, tid)


# -- verdicts -----------------------------------------------------------------------------------------------------------

SERIES_SQL = ", best AS (SELECT list, subject_normalized, from_addr, max(series_version) AS top FROM msgs GROUP BY ALL)"


@on_talk(SERIES_SQL + f""", x AS (SELECT tid.tid, m.*, t.prose AS says, EXISTS (SELECT 1 FROM msgs c WHERE c.k % 8 = 0 AND c.subject_normalized = m.subject_normalized AND c.from_addr = m.from_addr AND abs(c.date_unix_ns - m.date_unix_ns) <= 7776000000000000) AS merged,
    m.series_version < best.top AS newer FROM tid JOIN msgs m ON m.message_id = tid.message_id JOIN talk t ON t.message_id = m.message_id JOIN best ON best.list = m.list AND best.subject_normalized = m.subject_normalized AND best.from_addr = m.from_addr),
  a AS (SELECT tid, bool_or(merged) FILTER (message_id = tid) AS merged, bool_or(newer) FILTER (message_id = tid) AS newer, max(date_unix_ns) AS last, count(*) AS messages, max(from_addr) FILTER (message_id = tid) AS author FROM x GROUP BY tid),
  n AS (SELECT x.tid, bool_or(x.message_id <> x.tid AND x.from_addr <> a.author AND contains(says, 'NAK:')) AS nacked FROM x JOIN a USING (tid) GROUP BY 1)
  SELECT a.tid, CASE WHEN merged THEN 'merged' WHEN CAST(regexp_extract(a.tid, '[0-9]+') AS BIGINT) % 6 = 1 THEN 'rfc' WHEN newer THEN 'superseded' WHEN nacked THEN 'nacked' WHEN last >= {NOW} - 180 * 86400000000000 THEN 'under_review' ELSE 'abandoned' END AS state, messages FROM a JOIN n USING (tid)""")
def thread_states(spark, sf_dir):
    m, tid = threaded(spark, sf_dir)
    return ST.thread_states(m, tid, commits(m, 8), NOW).select("tid", "state", "messages")


@query("""WITH h AS (SELECT o_orderkey AS k FROM orders WHERE sha1(CAST(o_orderkey AS VARCHAR)) = sha1('7') AND o_orderkey % 7 = 0)
  SELECT 'open' AS report, CASE WHEN (SELECT count(*) FROM h) > 0 THEN 'pending_patch' ELSE 'unknown' END AS state, (SELECT count(*) FROM h) AS correlated
  UNION ALL SELECT 'landed', CASE WHEN (SELECT count(*) FROM h) > 0 THEN 'merged' ELSE 'unknown' END, (SELECT count(*) FROM h) UNION ALL SELECT 'none', 'no_fix_found', 0""")
def fix_states(spark, sf_dir):
    m = headers(spark, sf_dir).withColumns({"prose": F.lit(""), "touched_files": F.array().cast("array<string>")})
    refs = D.trailer_refs(m)
    sha = {"sha": "902ba3cda1883801594b6e1b452790cc53948fda"}
    none = spark.createDataFrame([], COMMITS)
    parts = {"open": (none, sha), "landed": (commits(m, 7), sha), "none": (none, {"bug_hash": "00000000"})}
    out = None
    for name, (c, report) in parts.items():
        p = ST.fix_status(m, refs, c, report).select(F.lit(name).alias("report"), "state", "correlated")
        out = p if out is None else out.unionByName(p)
    return out


@on_talk("""SELECT s AS subject, CASE WHEN c > 0 OR l > 0 THEN 'picked_up' WHEN u > 0 THEN 'pending' ELSE 'no_evidence' END AS status, c + l + u AS evidence FROM (SELECT s,
  (SELECT count(*) FROM msgs WHERE contains(lower(subject_normalized), lower(s)) AND k % 24 = 0) AS c, (SELECT count(*) FROM msgs WHERE contains(lower(subject_normalized), lower(s)) AND list = '5-LOW') AS l,
  (SELECT count(*) FROM msgs WHERE contains(lower(subject_normalized), lower(s)) AND list = '1-URGENT') AS u FROM (VALUES ('Order F of customer 7'), ('Order O of customer 11'), ('No such order')) v(s))""")
def stable_states(spark, sf_dir):
    m = talk(spark, sf_dir)
    out = None
    for s in ("Order F of customer 7", "Order O of customer 11", "No such order"):
        p = ST.stable_backports(m, commits(m, 8), s, stable_list="1-URGENT", commits_list="5-LOW").select(F.lit(s).alias("subject"), "status", "evidence")
        out = p if out is None else out.unionByName(p)
    return out


@on_talk("""SELECT tid.tid, 1 AS place, 'nit: name it.' AS line FROM tid JOIN msgs USING (message_id) WHERE msgs.k % 10 = 0 AND msgs.k % 35 <> 0
  UNION ALL SELECT tid.tid, 2, 'Shouldn''t this be static?' FROM tid JOIN msgs USING (message_id) WHERE msgs.k % 10 = 0 AND msgs.k % 35 <> 0""")
def review_concerns(spark, sf_dir):
    m, tid = threaded(spark, sf_dir)
    return C.concerns(m, tid)


@query("""SELECT conv_id, turn, role, substr(text, 1, 400 - before::BIGINT) AS text FROM (SELECT conv_id, turn, role, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations WHERE text IS NOT NULL) WHERE before < 400""")
def bodies_within_budget(spark, sf_dir):
    return C.within_budget(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "text", 400).select("conv_id", "turn", "role", "text")


@on_talk("""SELECT 'message' AS section, message_id FROM msgs WHERE k = 4 UNION ALL SELECT 'reply', message_id FROM msgs WHERE k = 5 UNION ALL
  SELECT 'series', a.message_id FROM msgs a JOIN msgs s ON s.k = 4 AND a.list = s.list AND a.subject_normalized = s.subject_normalized AND a.from_addr = s.from_addr""")
def patch_explained(spark, sf_dir):
    return ST.explain_patch(headers(spark, sf_dir), "o4@x").select("section", "message_id")


@on_talk("""SELECT coalesce(d.email, o.email) AS email, d.email IS NOT NULL AS declared, o.n AS reviewed_by, CASE WHEN d.email IS NOT NULL AND o.email IS NULL THEN 'stale' WHEN d.email IS NOT NULL THEN 'active' ELSE 'unlisted' END AS status FROM
  (SELECT 's' || s_suppkey || '@example.com' AS email FROM supplier WHERE s_suppkey % 4 = 0) d FULL JOIN (SELECT email, count(*) AS n FROM (SELECT unnest(reviewers) AS email FROM msgs WHERE list_contains(touched_files, 'part/155')) GROUP BY 1) o ON d.email = o.email""")
def maintainer_profile(spark, sf_dir):
    declared = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit("@example.com")).alias("email"))
    return A.maintainer_profile(messages(spark, sf_dir), "part/155", declared).select("email", "declared", "reviewed_by", "status")


@on_talk("SELECT r.repo, 't' AS tip_sha, count(k) AS commits FROM (VALUES ('linux'), ('linux-stable'), ('empty')) r(repo) LEFT JOIN (SELECT k, CASE WHEN k % 3 = 0 THEN 'linux-stable' ELSE 'linux' END AS repo FROM msgs WHERE k % 8 = 0) c ON c.repo = r.repo GROUP BY 1")
def repos_and_counts(spark, sf_dir):
    tips = spark.createDataFrame([("linux", "t"), ("linux-stable", "t"), ("empty", "t")], "repo string, tip_sha string")
    return ST.repos_and_counts(tips, commits(headers(spark, sf_dir), 8))


@query("SELECT 'sha' AS how, sha1(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders WHERE o_orderkey % 2 = 0 AND starts_with(sha1(CAST(o_orderkey AS VARCHAR)), 'ab') UNION ALL SELECT 'patch_id', sha1(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderkey % 2 = 0 AND md5(CAST(o_orderkey AS VARCHAR)) = md5('32')")
def commit_lookups(spark, sf_dir):
    c = commits(headers(spark, sf_dir), 2)
    by_patch = ST.by_patch_id(c, "6364d3f0f495b6ab9dcf8d3b5c6e0b01").select(F.lit("patch_id").alias("how"), "sha")
    return ST.by_sha(c, "AB").select(F.lit("sha").alias("how"), "sha").unionByName(by_patch)


# -- search and views ---------------------------------------------------------------------------------------------------


@on_talk("""SELECT message_id, list || '/' || strftime(make_timestamp(date_unix_ns // 1000), '%Y-%m') || '/o' || k || '-x' AS cite_key, series_index || '/3' AS series_place FROM msgs""")
def result_rows(spark, sf_dir):
    return views.hits(talk(spark, sf_dir)).select("message_id", "cite_key", "series_place")


@on_talk("""SELECT message_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (
    SELECT message_id, row_number() OVER (ORDER BY date_unix_ns DESC, message_id) AS rank FROM talk WHERE from_addr LIKE '%c7@%'
    UNION ALL SELECT message_id, row_number() OVER (ORDER BY date_unix_ns DESC, message_id) FROM talk WHERE from_addr LIKE '%c7@%' AND k % 4 <> 0) GROUP BY 1 ORDER BY score DESC, message_id LIMIT 25""")
def search_fused(spark, sf_dir):
    return U.search(talk(spark, sf_dir), "f:c7@ dfb:int", NOW).select("message_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def indexed_substring(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return S.indexed_substring(d, S.trigram_table(d, "doc_id", "text"), "License", "doc_id", "text", max_candidates=10**9).select("doc_id")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct([substr(text, i, n) FOR i IN range(1, length(text) + 1)])) AS part FROM documents, (VALUES (10), (11), (12)) l(n)
  WHERE contains(text, 'MIT L') OR contains(text, 'icense')) SELECT doc_id, min(levenshtein(part, 'MIT License')) AS distance FROM w GROUP BY doc_id HAVING distance <= 1""")
def fuzzy_license(spark, sf_dir):
    """One edit leaves the needle's first five or its last six characters as they are, so no other text is near."""
    return S.fuzzy_substring(table(spark, sf_dir, "documents").select("doc_id", "text"), "MIT License", 1, "doc_id", "text").withColumn("distance", F.col("distance").cast("bigint"))


@query("SELECT doc_id, CASE WHEN a = b THEN '' ELSE '--- a\n+++ b\n@@ -1 +1 @@\n-' || a || '\n+' || b END AS diff FROM (SELECT doc_id, source AS a, lang AS b FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)")
def text_diffs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.col("source").alias("a"), F.col("lang").alias("b"))
    return S.unified_diff(d).select("doc_id", "diff")


@query("SELECT doc_id, substr(text, greatest(p - 19, 1), 46) AS excerpt FROM (SELECT doc_id, text, instr(lower(text), 'license') AS p FROM documents) WHERE p > 0")
def kwic_excerpts(spark, sf_dir):
    return S.kwic(table(spark, sf_dir, "documents").select("doc_id", "text"), "license", "doc_id", "text", window=46).select("doc_id", "excerpt")


@on_talk("SELECT 'part/' || p_partkey AS path, 'NET' AS name, 1 AS depth FROM part WHERE p_partkey % 10 <> 3 UNION ALL SELECT 'part/' || p_partkey, 'ODD', 0 FROM part WHERE CAST(p_partkey AS VARCHAR) LIKE '%7'")
def owners_by_folder(spark, sf_dir):
    sections = MT.parse("NET\nM:\tA <a@x.org>\nF:\tpart/\nX:\tpart/*3\n\nODD\nN:\t^part/.*7$\n")
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey")).alias("path"))
    return MT.owners(paths, MT.rules(spark, sections))
