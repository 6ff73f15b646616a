"""Parsing of RFC822 messages, and what is derived from them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailgrain.functions import text as X
from mailgrain.functions.bounds import checked_pattern, time_bound, window
from mailgrain.operators import activity as A
from mailgrain.operators import classify as C
from mailgrain.operators import derive as D
from mailgrain.operators import fusion as U
from mailgrain.operators import predicates as P
from mailgrain.operators import search as S
from mailgrain.operators import status as ST
from mailgrain.operators import threads as G
from mailgrain.operators import views
from mailgrain.schema import COMMITS, MESSAGES, RAW
from mailgrain.sources import maintainers as MT
from mailgrain.sources import store
from mailgrain.sources.mail import decode_message, parse_messages

NS = 10**9
NOW = int(dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc).timestamp()) * NS
FILE1 = "fs/smb/server/smbacl.c"


def mail(mid, subject, body, sender="Alice <alice@example.com>", date="Tue, 14 Apr 2026 12:00:00 +0000", extra=""):
    head = f"From: {sender}\r\nTo: list@x.org\r\nSubject: {subject}\r\nDate: {date}\r\nMessage-ID: <{mid}>\r\n{extra}"
    return (head + "\r\n" + body.replace("\n", "\r\n")).encode()


def diff(path, context, added="+\tif (!acl) return;"):
    return f"---\ndiff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,2 +1,3 @@ {context}\n a\n{added}\n b\n"


M1 = mail(
    "m1@x",
    "[PATCH v3 1/2] ksmbd: tighten ACL bounds",
    'Text here.\n\nFixes: deadbeef01234567 ("ksmbd: x")\nReviewed-by: Carol <carol@example.com>\nSigned-off-by: Alice <alice@example.com>\nCc: stable@vger.example.org # 5.15+\n' + diff(FILE1, "int smb_check_perm_dacl(struct x *y)"),
)
M2 = mail(
    "m2@x",
    "[PATCH v3 2/2] ksmbd: follow-up",
    "> quoted\nNot bad.\n\nSigned-off-by: Alice <alice@example.com>\n" + diff("fs/smb/server/smb2pdu.c", "int smb2_create(void)"),
    date="Tue, 14 Apr 2026 12:05:00 +0000",
    extra="In-Reply-To: <m1@x>\r\nReferences: <m1@x>\r\n",
)
REPORT = mail("report@x", "BUG in foo", "extid=ac3c79181f6aecc5120c\n", sender="bot <bot@x.org>", date="Mon, 13 Apr 2026 12:00:00 +0000")
FIX = mail(
    "fix@x",
    "[PATCH] foo: fix crash",
    "Why.\n\nReported-by: syzbot+ac3c79181f6aecc5120c@bugs.example.com\nLink: https://bugs.example.com/bug?extid=ac3c79181f6aecc5120c\nLink: https://archive.example.org/all/report@x/\n" + diff("drivers/foo.c", "int foo_fix(void)"),
    date="Wed, 15 Apr 2026 12:00:00 +0000",
)
RAWS = [M1, M2, REPORT, FIX]


def parsed(spark, raws, list_name="cifs"):
    rows = [(list_name, "0", f"c{i}", NOW, bytearray(r)) for i, r in enumerate(raws)]
    return parse_messages(spark.createDataFrame(rows, RAW), NOW)


@pytest.fixture(scope="module")
def m(spark):
    return parsed(spark, RAWS).cache()


def by_id(df):
    return {r["message_id"]: r for r in df.collect()}


def test_patch_series(m):
    r = by_id(m)
    a = r["m1@x"]
    assert (a["series_version"], a["series_index"], a["series_total"], a["is_cover_letter"], a["has_patch"]) == (3, 1, 2, False, True)
    assert a["subject_normalized"] == "ksmbd: tighten ACL bounds" and a["subject_tags"] == ["PATCH v3 1/2", "PATCH"]
    assert a["touched_files"] == [FILE1] and a["touched_functions"] == ["smb_check_perm_dacl"]
    assert "carol@example.com" in a["reviewed_by"][0] and "stable@" in a["cc_stable"][0]
    assert (a["insertions"], a["deletions"], a["files_changed"]) == (1, 0, 1)
    assert a["from_addr"] == "alice@example.com" and a["to_addrs"] == ["list@x.org"]
    assert a["date_unix_ns"] == int(dt.datetime(2026, 4, 14, 12, tzinfo=dt.timezone.utc).timestamp()) * NS
    b = r["m2@x"]
    assert b["in_reply_to"] == "m1@x" and b["references"] == ["m1@x"]
    assert "quoted" not in b["prose"] and "Not bad." in b["prose"] and b["patch"].startswith("diff --git ")
    assert r["report@x"]["touched_files"] is None and not r["report@x"]["has_patch"]


def test_schema(m):
    assert [(f.name, f.dataType) for f in m.schema] == [(f.name, f.dataType) for f in MESSAGES]


def test_mime_and_dates(spark):
    qp = (
        b"From: =?utf-8?q?J=C3=B6rg?= <J@X.org>\nSubject: Re: Fwd: [RFC PATCH v2 0/3] =?utf-8?q?gr=C3=BC=C3=9Fe?=\nDate: Thu, 1 Jan 1970 00:00:00 +0000\n"
        b"Message-ID: <q@x>\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\nGr=C3=BC=C3=9Fe=\n!\n"
    )
    r = by_id(parsed(spark, [qp, b"From: a@b.c\n\nno id", b""]))
    assert list(r) == ["q@x"]
    q = r["q@x"]
    assert q["from_addr"] == "j@x.org" and q["from_name"] == "Jörg" and q["prose"].startswith("Grüße!")
    assert q["subject_normalized"] == "grüße" and q["series_version"] == 2 and q["is_cover_letter"]
    assert q["date_unix_ns"] == NOW  # implausible header date: the commit's


def test_refs(spark, m):
    refs = D.trailer_refs(m).filter("message_id = 'fix@x'").collect()
    got = {(r["kind"], r["ref_kind"], r["ref_value"]) for r in refs}
    assert ("reported_by", "bug_hash", "ac3c79181f6aecc5120c") in got
    assert ("link", "bug_hash", "ac3c79181f6aecc5120c") in got
    assert ("link", "archive_mid", "report@x") in got
    assert ("reported_by", "email", "syzbot+ac3c79181f6aecc5120c@bugs.example.com") in got
    assert ("link", "url_lc", "https://archive.example.org/all/report@x") in got
    sha = D.trailer_refs(m).filter("ref_kind = 'sha_prefix'").collect()
    assert [r["ref_value"] for r in sha] == ["deadbeef01234567"]
    assert P.ref_lookup(D.trailer_refs(m), m, "archive_mid", "report@x").select("message_id").collect()[0][0] == "fix@x"


def test_fix_status(spark, m):
    refs = D.trailer_refs(m)
    commits = spark.createDataFrame([], COMMITS)
    r = ST.fix_status(m, refs, commits, {"message_id": "report@x", "bug_hash": "ac3c79181f6aecc5120c"}).first()
    assert (r["state"], r["patches"], r["commits"]) == ("pending_patch", 1, 0)
    landed = [("main", "f" * 40, "foo: fix crash", "alice@example.com", NOW, None), ("main", "e" * 40, "foo: fix crash", "bob@example.com", NOW, None)]
    assert ST.fix_status(m, refs, spark.createDataFrame(landed, COMMITS), {"message_id": "report@x"}).first()["state"] == "merged"


def test_thread_states(spark, m):
    tid = G.thread_roots(G.parents(m))
    assert {r["message_id"]: r["tid"] for r in tid.collect()} == {"m1@x": "m1@x", "m2@x": "m1@x", "report@x": "report@x", "fix@x": "fix@x"}
    states = {r["message_id"]: r["state"] for r in ST.thread_states(m, tid, spark.createDataFrame([], COMMITS), NOW).collect()}
    assert states == {"m1@x": "under_review", "report@x": "unknown", "fix@x": "under_review"}
    late = ST.thread_states(m, tid, spark.createDataFrame([], COMMITS), NOW + 365 * 86400 * NS)
    assert {r["message_id"]: r["state"] for r in late.collect()}["fix@x"] == "abandoned"


def test_cover_propagation(spark):
    cover = mail("m0@x", "[PATCH 0/2] ksmbd cleanup", "Cover.\n")
    a = mail("m1@x", "[PATCH 1/2] a", "A\n" + diff(FILE1, "int smb_check_perm_dacl(void)"), extra="In-Reply-To: <m0@x>\r\n")
    b = mail("m2@x", "[PATCH 2/2] b", "B\n" + diff("path.c", "int ksmbd_canonical_path(void)"), extra="In-Reply-To: <m0@x>\r\n")
    m = parsed(spark, [cover, a, b])
    tid = G.thread_roots(G.parents(m))
    assert {r["tid"] for r in tid.collect()} == {"m0@x"}
    got = G.propagate(m, tid).collect()
    assert len(got) == 1 and got[0]["propagated_files"] == sorted([FILE1, "path.c"])
    assert got[0]["propagated_functions"] == ["ksmbd_canonical_path", "smb_check_perm_dacl"]


def test_long_chain_cycle_and_missing_parent(spark):
    edges = [(f"n{i:04}", f"n{i - 1:04}" if i else None) for i in range(300)]
    edges += [("a", "c"), ("b", "a"), ("c", "b"), ("hang", "c"), ("lone", None)]
    got = {r["message_id"]: r["tid"] for r in G.thread_roots(spark.createDataFrame(edges, "message_id string, parent string")).collect()}
    assert {got[f"n{i:04}"] for i in range(300)} == {"n0000"}
    assert {got[x] for x in ("a", "b", "c", "hang")} == {"a"} and got["lone"] == "lone"
    rows = [("x", "gone", ["y"]), ("y", None, None), ("z", None, ["y", "w"])]
    m = spark.createDataFrame(rows, "message_id string, in_reply_to string, references array<string>")
    assert {r["message_id"]: r["parent"] for r in G.parents(m).collect()} == {"x": None, "y": None, "z": "y"}


def test_subject_fallback(spark):
    day = 86400 * NS
    rows = [("a", "l", "s", "p", 10 * day), ("b", "l", "s", "p", 30 * day), ("c", "l", "s", "p", 90 * day), ("r", "l", "other", "q", 31 * day)]
    m = spark.createDataFrame(rows, "message_id string, list string, subject_normalized string, from_addr string, date_unix_ns bigint")
    tid = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("r", "b")], "message_id string, tid string")
    assert {r[0]: r[1] for r in G.with_fallback(m, tid).collect()} == {"a": "a", "b": "a", "c": "c", "r": "a"}
    assert {r[0]: r[1] for r in G.with_fallback(m, tid, strict_compat=True).collect()}["r"] == "b"


def test_predicates(m):
    ids = lambda df: [r["message_id"] for r in df.collect()]
    assert ids(P.eq(m, "reviewed_by", "CAROL@example.com")) == ["m1@x"]
    assert ids(P.in_list(m, "touched_files", [FILE1, "drivers/foo.c"])) == ["fix@x", "m1@x"]
    assert ids(P.substr_subject(m, "KSMBD")) == ["m2@x", "m1@x"]
    assert ids(P.regex(m, "subject", r"crash$")) == ["fix@x"]
    assert ids(P.trailer_mentions(m, "carol")) == ["m1@x"]
    assert ids(P.expand_citation(m, "deadbeef")) == ["m1@x"] and ids(P.expand_citation(m, "<m2@x>")) == ["m2@x"]
    assert ids(P.find(m, "alice@example.com")) == ["fix@x", "m2@x", "m1@x"] and ids(P.find(m, "if (!acl)")) == ["fix@x", "m2@x", "m1@x"]
    assert ids(P.header_search(D.involvement(m), m, "any", "carol")) == ["m1@x"]
    assert ids(P.header_search(D.involvement(m), m, "any", "c%rol")) == []
    assert ids(store.fetch_message(m, "<m1@x>")) == ["m1@x"]
    with pytest.raises(ValueError):
        P.eq(m, "nope", "x")


def test_patterns_and_times():
    for bad in (".*x", "^.*x", "(?=a)b", r"(a)\1", "a*+", "(?>a)"):
        with pytest.raises(ValueError):
            checked_pattern(bad)
    assert checked_pattern("a$[$]") == r"(?d)a\z[$]"
    assert time_bound("2D", NOW) == NOW - 2 * 86400 * NS and time_bound("17", 0) == 17
    assert time_bound("2026-01-01", 0) == time_bound("2026-01-01T00:00:00Z", 0)
    with pytest.raises(ValueError):
        window("1d", "2d", NOW)


def test_search_and_cursor(m):
    hits = U.search(m, "ksmbd follow-up", NOW).collect()
    assert [h["message_id"] for h in hits][0] == "m2@x"
    both = U.search(m, "list:cifs dfb:acl ksmbd", NOW).collect()
    assert both[0]["tiers"].count(",") == 2
    pages, after = [], None
    while True:
        page = U.search(m, "list:cifs ksmbd", NOW, limit=1, after=after).collect()
        if not page:
            break
        pages.append(page[0]["message_id"])
        after = (page[0]["score"], page[0]["message_id"])
    assert sorted(pages) == ["fix@x", "m1@x", "m2@x", "report@x"]
    token = U.sign_cursor(b"k", "q", 10**18 + 1, "m")
    assert U.read_cursor(b"k", "q", token) == (10**18 + 1, "m")
    for secret, query, t in ((b"x", "q", token), (b"k", "other", token)):
        with pytest.raises(ValueError):
            U.read_cursor(secret, query, t)
    with pytest.raises(ValueError):
        U.parse_query('"a phrase"')
    assert U.parse_query('f:"Al ice" x b:y') == {"f": "Al ice", "words": ["x", "y"], "b": "y"}


def test_rrf_value(spark):
    a = spark.createDataFrame([("x", "a", 1)], "message_id string, tier string, rank int")
    b = spark.createDataFrame([("x", "b", 3), ("y", "b", 1)], "message_id string, tier string, rank int")
    got = {r["message_id"]: r["score"] for r in U.fuse([a, b]).collect()}
    assert got == {"x": round(1 / 61 + 1 / 63, 9), "y": round(1 / 61, 9)}


@pytest.mark.parametrize("edits,expected", [(0, []), (1, ["one"]), (2, ["one", "two"])])
def test_fuzzy(spark, edits, expected):
    d = spark.createDataFrame([("one", "xx smb_chekc_perm"[:-5] + "k_perm_dacl"), ("two", "smb_chck_perm_dcl()"), ("none", "abc"), ("null", None)], "message_id string, patch string")
    d = d.withColumn("patch", F.when(F.col("message_id") == "one", "xx smb_chck_perm_dacl").otherwise(F.col("patch")))
    assert sorted(r["message_id"] for r in S.fuzzy_substring(d, "smb_check_perm_dacl", edits).collect()) == expected
    assert S.best_distance("abcdef", "cxe", 2) == 1 and S.best_distance("", "abc", 2) == 3


def test_indexed_substring(spark):
    d = spark.createDataFrame([("a", "hello wörld foo"), ("b", "hello"), ("c", None), ("d", "world foo")], "message_id string, patch string")
    grams = S.trigram_table(d)
    for needle in ("hello", "wörld", "foo", "öööö"):
        assert sorted(S.indexed_substring(d, grams, needle).collect()) == sorted(S.substring(d, needle).collect())
    with pytest.raises(ValueError):
        S.substring(d, "ab")


def test_kwic_and_diff(spark):
    d = spark.createDataFrame([("a", "ü" * 300 + " Needle " + "y" * 300)], "message_id string, prose string")
    r = S.kwic(d, "needle").first()
    assert r["byte_offset"] == 601 and "Needle" in r["excerpt"] and len(r["excerpt"]) == 200
    p = spark.createDataFrame([("a\nb\nc", "a\nx\nc"), ("s", "s"), (None, "q")], "a string, b string")
    assert [r["diff"] for r in S.unified_diff(p).collect()] == ["--- a\n+++ b\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c", "", "--- a\n+++ b\n@@ -0,0 +1 @@\n+q"]


def test_contains_any_both_ways(spark):
    d = spark.createDataFrame([(1, "xx abc def"), (2, "abcabc"), (3, None), (4, "z" * 40 + "q")], "k int, t string")
    n = spark.createDataFrame([(1, "abc"), (2, "c d"), (3, "z" * 40 + "q"), (4, "zzzz"), (5, ""), (6, "abc")], "n int, s string")
    want = {(1, 1), (1, 2), (1, 6), (2, 1), (2, 6), (4, 3), (4, 4)}
    for f in (S.contains_any, S.contains_any_joined):
        assert {tuple(r) for r in f(d, n, "k", "t", "n", "s").collect()} == want


MAINTAINERS = """KSMBD
M:\tNam <nam@example.org>
M:\tSteve <steve@example.org>
R:\tTom <tom@example.org>
L:\tcifs@example.org
S:\tMaintained
T:\tgit example
F:\tfs/smb/common/
F:\tfs/smb/server/

NETDEV
M:\tJ <j@example.org>
F:\tnet/
X:\tnet/bpf/
K:\tfoo

CATCH-ALL
N:\t^drivers/.*\\.c$

INTEL
F:\tdrivers/
F:\tdrivers/net/ethernet/intel/e1000/
"""


def test_maintainers(spark):
    sections = MT.parse(MAINTAINERS)
    paths = [FILE1, "net/core/sock.c", "net/bpf/verifier.c", "drivers/net/foobar.c", "drivers/net/ethernet/intel/e1000/a.c"]
    got = MT.owners(spark.createDataFrame([(p,) for p in paths], "path string"), MT.rules(spark, sections)).collect()
    assert {(r["path"], r["name"], r["depth"]) for r in got} == {
        (FILE1, "KSMBD", 3), ("net/core/sock.c", "NETDEV", 1), ("drivers/net/foobar.c", "CATCH-ALL", 0), ("drivers/net/foobar.c", "INTEL", 1),
        (paths[4], "CATCH-ALL", 0), (paths[4], "INTEL", 5),
    }
    assert MT.people(spark, sections).filter("name = 'KSMBD'").count() == 3


def test_maintainer_profile(spark, m):
    declared = spark.createDataFrame([("nam@example.org",), ("carol@example.com",)], "email string")
    got = {r["email"]: r["status"] for r in A.maintainer_profile(m, "fs/smb/", declared).collect()}
    assert got == {"nam@example.org": "stale", "carol@example.com": "active", "alice@example.com": "unlisted"}


def test_store_round_trip(spark, m, tmp_path):
    path = str(tmp_path / "messages")
    store.write_messages(m, path, 0)
    store.write_messages(m.filter("message_id = 'm1@x'").withColumn("subject_raw", F.lit("new")), path, 1)
    got = store.read_messages(spark, path)
    assert got.count() == 4 and by_id(got)["m1@x"]["subject_raw"] == "new"
    store.compact(spark, path, str(tmp_path / "compacted"))
    small = str(tmp_path / "compacted")
    assert store.read_messages(spark, small).count() == 4 and by_id(store.read_messages(spark, small))["m1@x"]["subject_raw"] == "new"
    # An update after compaction wins, one with an older run does not, and a run written twice counts once.
    newest = m.filter("message_id = 'm1@x'").withColumn("subject_raw", F.lit("newest"))
    store.write_messages(newest, small, 2)
    store.write_messages(newest, small, 2)
    store.write_messages(m.withColumn("subject_raw", F.lit("old")), small, 0)
    got = by_id(store.read_messages(spark, small))
    assert len(got) == 4 and store.read_messages(spark, small).count() == 4 and got["m1@x"]["subject_raw"] == "newest" and got["m2@x"]["subject_raw"] != "old"
    plan = store.read_messages(spark, small).filter("list = 'cifs' AND date_unix_ns > 5")._jdf.queryExecution().toString()
    assert "GreaterThan(date_unix_ns,5)" in plan
    assert "not bad." in store.fetch_body(store.read_messages(spark, small), "m2@x").first()["body"].lower()
    assert "> quoted" in store.fetch_body(m, "m2@x").first()["body"]
    ids = spark.createDataFrame([("m1@x", 1), ("gone", 2)], "message_id string, n int")
    assert {r["message_id"]: r["subject_raw"] for r in store.hydrate(store.read_messages(spark, small), ids).collect()} == {"m1@x": "newest", "gone": None}
    assert store.visit(m, lambda b: None, ["message_id"]) == 4
    store.write_side_tables(m, str(tmp_path / "side"))
    assert store.side_table(spark, str(tmp_path / "side"), "touched_file").filter(F.col("path") == FILE1).count() == 1
    grams = store.side_table(spark, str(tmp_path / "side"), "trigram")
    assert [r["message_id"] for r in S.indexed_substring(m, grams, "foo_fix").collect()] == ["fix@x"]
    assert [r["message_id"] for r in S.indexed_fuzzy(m, grams, "int foo_fiz(void)", 1).collect()] == ["fix@x"]
    with pytest.raises(S.TooManyCandidates):
        S.indexed_substring(m, grams, "diff --git", max_candidates=1)


def test_streaming_ingest(spark, tmp_path):
    from mailgrain.streaming.ingest import generations, ingest

    raw, out, state = (str(tmp_path / x) for x in ("raw", "out", "state"))
    rows = [("cifs", "0", "c", NOW, bytearray(r)) for r in RAWS]
    spark.createDataFrame(rows[:2], RAW).write.mode("append").parquet(raw)
    ingest(spark, raw, out, state, NOW).awaitTermination()
    spark.createDataFrame(rows[1:], RAW).write.mode("append").parquet(raw)
    ingest(spark, raw, out, state, NOW).awaitTermination()
    ingest(spark, raw, out, state, NOW).awaitTermination()
    assert store.read_messages(spark, out).count() == 4
    assert generations(spark, state).count() == 2
    assert views.freshness(generations(spark, state), NOW + 5 * NS).first()["lag_seconds"] == 5


def test_stream_windows_equal_batch(spark, tmp_path):
    from mailgrain.streaming.windows import tumbling_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = tumbling_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("w").collect()) == sorted(tumbling_counts(events).collect())


def test_views_and_rules(spark, m):
    hit = {r["message_id"]: r for r in views.hits(m).collect()}
    assert hit["m1@x"]["cite_key"] == "cifs/2026-04/m1-x" and hit["m1@x"]["series_place"] == "1/2" and hit["fix@x"]["series_place"] is None
    labels = {r["message_id"]: r["label"] for r in C.classify(m).collect()}
    assert labels["m1@x"] == "bugfix" and labels["fix@x"] == labels["m2@x"] == "unknown"
    texts = spark.createDataFrame([("a", "One short. Thanks for it all. > not: foo_bar() in mm/x.c. This one calls foo_bar() in fs/x.c now. Another plain sentence.")], "message_id string, prose string")
    assert C.summarize(texts, 1).first()["summary"].startswith("> not: foo_bar()") is False
    budget = spark.createDataFrame([("g", 1, "x" * 10), ("g", 2, "y" * 10), ("g", 3, "z" * 10), ("h", 1, "q" * 99)], "g string, n int, t string")
    assert sorted((r["g"], r["n"]) for r in C.within_budget(budget, "g", ["n"], "t", 20).collect()) == [("g", 1), ("g", 2), ("h", 1)]
    assert sorted(r["t"] for r in C.within_budget(budget, "g", ["n"], "t", 20).collect()) == ["q" * 20, "x" * 10, "y" * 8]
    assert [r["section"] for r in ST.explain_patch(m, "m1@x").collect()] == ["message", "series", "reply"]
    assert A.coverage_markdown(A.corpus_stats(m), 3, "now").endswith("| cifs | 4 |")


def test_freshest_ties_and_nulls(spark):
    rows = [("a", "l2", 5), ("a", "l1", 5), ("b", "l1", None), ("b", "l2", 1), ("c", "l1", None)]
    d = spark.createDataFrame(rows, "message_id string, list string, date_unix_ns bigint")
    assert sorted((r[0], r[1]) for r in D.freshest(d).collect()) == [("a", "l1"), ("b", "l2"), ("c", "l1")]
    kept = store.all_rows(d, since_ns=3).count(), P.windowed(d, since_ns=3).count()
    assert kept == (4, 2)


def test_email_of(spark):
    d = spark.createDataFrame([("A B <A@B.c>",), ("a@b.c (x)",), ("none",), (None,), ("<a> <C@d>",)], "raw string")
    assert [r[0] for r in d.select(X.email_of(F.col("raw"))).collect()] == ["a@b.c", "a@b.c", None, None, "c@d"]


def test_conversation_walks_references_too(spark):
    rows = [("a", "l", 1, None, None), ("b", "l", 2, "a", ["a"]), ("c", "l", 3, None, ["gone", "b"]), ("d", "l", 4, "gone", None), ("e", "l", 5, "other", None)]
    m = spark.createDataFrame(rows, "message_id string, list string, date_unix_ns bigint, in_reply_to string, references array<string>")
    for seed in ("a", "<c>", "d"):
        assert [r["message_id"] for r in G.conversation(m, seed).collect()] == ["a", "b", "c", "d"]
    assert [r["message_id"] for r in G.conversation(m, "e").collect()] == ["e"]
    assert [r["message_id"] for r in G.conversation(m, "a", limit=2).collect()] == ["c", "d"]


def test_version_diff_and_timeline(spark, m):
    got = S.version_diff(m, "m1@x", "m2@x").first()
    assert got["diff"].startswith("--- a") and "smb2pdu.c" in got["diff"]
    assert "-Text here." in S.version_diff(m, "m1@x", "m2@x", "prose").first()["diff"]
    assert "+> quoted" in S.version_diff(m, "m1@x", "m2@x", "raw").first()["diff"]
    assert S.version_diff(m, "m1@x", "gone").collect() == []
    for a, b, mode in (("m1@x", "m1@x", "patch"), ("m1@x", "m2@x", "words")):
        with pytest.raises(ValueError):
            S.version_diff(m, a, b, mode)
    dated = m.withColumn("date_unix_ns", F.when(F.col("message_id") != "m1@x", F.col("date_unix_ns"))).withColumn("touched_files", F.array(F.lit("f")))
    order = lambda o: [r["message_id"] for r in A.timeline_events(dated, "f", o).collect()]
    assert order("asc") == ["report@x", "m2@x", "fix@x", "m1@x"] and order("desc") == ["fix@x", "m2@x", "report@x", "m1@x"]


def test_stable_states(spark):
    cols = "message_id string, list string, subject_raw string, prose string"
    say = lambda *rows: spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], cols)
    none = spark.createDataFrame([], COMMITS)
    nominated = ("stable", "[PATCH AUTOSEL 6.1] foo: fix crash", "")
    confirmed = ("stable-commits", 'patch "foo: fix crash" added to Linux 6.1.9', "")
    got = lambda m, c=none: tuple(ST.stable_backports(m, c, "foo: fix crash").first())
    assert got(say(nominated)) == ("pending", "", True, 1)
    assert got(say(nominated, confirmed)) == ("picked_up", "6.1.9", True, 2)
    assert got(say(("lkml", "noautosel: foo: fix crash", ""))) == ("autosel_skipped", "", False, 0)
    assert got(say(("lkml", "other", ""))) == ("no_evidence", "", False, 0)
    landed = spark.createDataFrame([("linux-stable", "f" * 40, "foo: fix crash", "a@b.c", NOW, None), ("linux", "e" * 40, "foo: fix crash", "a@b.c", NOW, None)], COMMITS)
    assert got(say(("lkml", "other", "")), landed) == ("picked_up", "", False, 1)


def test_classifier_priority(spark):
    rows = [
        ("[PATCH] Revert x", ["Revert"], ["f"], None, "", "revert"), ("Revert x", [], None, None, "", "revert"), ("fix CVE-2024-12345", [], ["f"], None, "", "security"),
        ("x", [], ["f"], ["stable@"], "", "bugfix"), ("x", [], None, ["stable@"], "", "backport"), ("docs: x", [], None, None, "", "doc"), ("selftests: x", [], None, None, "", "test"),
        ("mm: some cleanup", [], None, None, "", "cleanup"), ("Merge y", [], None, None, "", "merge"), ("x", ["RFC"], None, None, "", "feature"),
        ("x", [], None, None, "--- /dev/null\n+++ b/n.c\n@@ -0,0 +1,2 @@", "feature"), ("x", None, None, None, None, "unknown"),
    ]
    m = spark.createDataFrame(rows, "subject_raw string, subject_tags array<string>, fixes array<string>, cc_stable array<string>, patch string, want string").withColumn("subject_normalized", F.lit(None).cast("string"))
    assert all(r["label"] == r["want"] for r in C.classify(m).collect())


def test_summary_rules(spark):
    import re

    text = "On Monday X wrote: hello there all.\n> Quoted foo_bar() line here.\nThanks for it all. It calls foo_bar() in fs/x.c now! Reviewed-by: nobody at all here. 3 more to come? yes. CVE-2024-99999 is fixed by it."
    signals = [(2, r"\b[a-z][a-z0-9_]*_[a-z0-9_]+\(?", 0), (1.5, r"\b[A-Z][a-z]+(-[A-Z][a-z]+)+:", 0), (0.5, r"\b(?:fixes|reviewed|acked|tested|signed-off)-?by:", re.I), (1.5, r"\bfs/|\bmm/|\.c\b|\.h\b", 0), (-1.5, r"^(thanks|yes|no|nit)", re.I), (-2, "wrote:|^>", re.I), (2, r"\bcve-\d{4}-\d{4,}\b", re.I)]
    score = lambda s: 0.0 if not 10 <= len(s) <= 400 else 1 + sum(g for g, p, f in signals if re.search(p, s, f))
    flat = " ".join(x for x in text.splitlines() if not x.lstrip().startswith(">"))
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", flat) if s.strip()]
    d = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "message_id string, prose string")
    for k in range(1, len(parts) + 1):
        picked = sorted(sorted(enumerate(parts), key=lambda x: (-score(x[1]), x[0]))[:k])
        assert {r["message_id"]: r["summary"] for r in C.summarize(d, k).collect()} == {"a": " ".join(s for _, s in picked)}


def test_headers_in_any_zone(monkeypatch):
    """A time without a zone is in UTC wherever the task runs; folded, encoded and raw 8-bit subjects are read."""
    import time

    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        noon = int(dt.datetime(2026, 4, 14, 12, tzinfo=dt.timezone.utc).timestamp()) * NS
        for zone in ("-0000", "+0000", ""):
            assert decode_message(mail("z@x", "s", "b", date=f"Tue, 14 Apr 2026 12:00:00 {zone}".strip()))["header_date_ns"] == noon
        assert decode_message(mail("z@x", "s", "b", date="Tue, 14 Apr 2026 12:00:00 +0200"))["header_date_ns"] == noon - 7200 * NS
    finally:
        monkeypatch.undo()
        time.tzset()
    assert decode_message(mail("z@x", "one\r\n  two", "b"))["subject_raw"] == "one two"
    assert decode_message(mail("z@x", "=?utf-8?q?caf=C3=A9?= x", "b"))["subject_raw"] == "café x"
    assert decode_message(mail("z@x", "café x", "b"))["subject_raw"].endswith(" x")
    assert decode_message(mail("", "s", "b")) is None


def test_subject_fallback_ties(spark):
    """Of two older roots with one date the smallest id counts, in whatever order they come."""
    rows = [("b", "l", "s", "f", 5), ("a", "l", "s", "f", 5), ("c", "l", "s", "f", 6), ("d", "l", "t", "f", 6)]
    for order in (rows, rows[::-1]):
        m = spark.createDataFrame(order, "message_id string, list string, subject_normalized string, from_addr string, date_unix_ns bigint")
        got = G.with_fallback(m, m.select("message_id", F.col("message_id").alias("tid"))).collect()
        assert {r["message_id"]: r["tid"] for r in got} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_paths_with_blanks(spark):
    body = "X\n---\ndiff --git a/doc/my file.txt b/doc/my file.txt\n--- a/doc/my file.txt\n+++ b/doc/my file.txt\n@@ -1 +1 @@ x\n-a\n+b\ndiff --git a/old.c b/new.c\n"
    assert by_id(parsed(spark, [mail("p@x", "[PATCH] p", body)]))["p@x"]["touched_files"] == ["doc/my file.txt", "old.c", "new.c"]


def test_involved_equals_the_table(m):
    for kind, value, mode in (("any", "carol", "contains"), ("from", "ALI", "prefix"), ("reviewed_by", "carol", "prefix"), ("to", "x.org", "contains")):
        table = P.header_search(D.involvement(m), m, kind, value, mode).select("message_id").collect()
        assert P.involved(m, kind, value, mode).select("message_id").collect() == table


def test_pages_beyond_the_depth(spark):
    rows = [(f"m{i:03}", "l", i, f"a{i}@x", "s", "word", "p") for i in range(60)]
    m = spark.createDataFrame(rows, "message_id string, list string, date_unix_ns bigint, from_addr string, subject_normalized string, prose string, patch string")
    seen, after = [], None
    while True:
        page = U.search(m, "list:l word", NOW, limit=20, after=after, depth=8).collect()
        if not page:
            break
        seen += [r["message_id"] for r in page]
        after = (page[-1]["score"], page[-1]["message_id"])
    assert sorted(seen) == [r[0] for r in rows]
