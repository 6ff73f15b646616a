"""Messages, threads and commits as views over the test tables, so that operators run on them unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(c: str) -> Column:
    """Nanoseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} as timestamp_ntz)) * 1000")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages without bodies."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), key, F.lit("@x")).alias("message_id"),
        F.col("o_orderpriority").alias("list"),
        F.concat(F.lit("c"), F.col("o_custkey"), F.lit("@example.com")).alias("from_addr"),
        nanos("o_orderdate").alias("date_unix_ns"),
        F.concat(F.lit("[PATCH v"), key % 3 + 1, F.lit(" "), key % 4, F.lit("/3] Order "), F.col("o_orderstatus"), F.lit(" of customer "), F.col("o_custkey")).alias("subject_raw"),
        F.concat(F.lit("Order "), F.col("o_orderstatus"), F.lit(" of customer "), F.col("o_custkey")).alias("subject_normalized"),
        (key % 3 + 1).cast("int").alias("series_version"),
        (key % 4).cast("int").alias("series_index"),
        (key % 4 == 0).alias("is_cover_letter"),
        (key % 4 != 0).alias("has_patch"),
        F.when(key % 5 == 0, F.concat(F.lit("o"), key - 1, F.lit("@x"))).alias("in_reply_to"),
        F.when(key % 7 == 0, F.array(F.concat(F.sha1(key.cast("string")), F.lit(' ("x")')))).alias("fixes"),
        F.lit(None).cast("array<string>").alias("cc_stable"),
    )


_prepared: dict[str, str] = {}


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Write the messages once, so that what follows is timed on a table and not on its making."""
    path = scratch_folder(spark, "messages")
    messages(spark, sf_dir).write.parquet(path)
    _prepared[sf_dir] = path


#: Rows of lineitem of one task, about.
LINES_A_TASK = 100_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks share the messages and what is made of their lines; the count is read from the files' footers."""
    return -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK) or 1


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with touched files and reviewers from the order's lines, dealt out by message_id to tasks of bounded size: what
    is grouped by it, or made distinct with it, is shuffled no more."""
    if sf_dir in _prepared:
        return spark.read.parquet(_prepared[sf_dir])
    n = parts(spark, sf_dir)
    own = F.concat(F.lit("o"), F.col("l_orderkey"), F.lit("@x")).alias("message_id")
    lines = table(spark, sf_dir, "lineitem").select(own, "l_partkey", "l_suppkey", "l_quantity").repartition(n, "message_id")
    lines = lines.groupBy("message_id").agg(
        F.collect_set("l_partkey").alias("parts"), F.collect_set("l_suppkey").alias("suppliers"), F.sum("l_quantity").cast("bigint").alias("insertions")
    )
    file = lambda k: F.concat(F.lit("part/"), k)
    reviewer = lambda k: F.concat(F.lit("S"), k, F.lit(" <s"), k, F.lit("@example.com>"))
    lines = lines.select(
        "message_id", F.array_sort(F.transform("parts", file)).alias("touched_files"), F.array_sort(F.transform("suppliers", reviewer)).alias("reviewed_by"), "insertions"
    )
    m = headers(spark, sf_dir).repartition(n, "message_id").join(lines, "message_id", "left")
    none = F.lit(None).cast("array<string>")
    return m.withColumns({c: none for c in ("acked_by", "tested_by", "signed_off_by")})


MESSAGES_SQL = """
WITH lines AS (
  SELECT l_orderkey, list_sort(list(DISTINCT 'part/' || l_partkey)) AS touched_files,
         list_sort(list(DISTINCT 's' || l_suppkey || '@example.com')) AS reviewers, CAST(sum(l_quantity) AS BIGINT) AS insertions
  FROM lineitem GROUP BY l_orderkey),
msgs AS (
  SELECT 'o' || o_orderkey || '@x' AS message_id, o_orderpriority AS list, 'c' || o_custkey || '@example.com' AS from_addr,
         epoch_us(o_orderdate) * 1000 AS date_unix_ns, o_orderkey AS k, o_custkey,
         'Order ' || o_orderstatus || ' of customer ' || o_custkey AS subject_normalized,
         o_orderkey % 3 + 1 AS series_version, o_orderkey % 4 AS series_index, o_orderkey % 4 <> 0 AS has_patch,
         touched_files, reviewers, insertions
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)
"""


def conversation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id ``conv:turn`` and the turn before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    own = F.concat_ws(":", "conv_id", "turn")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("there"))
    return c.join(before, ["conv_id", "turn"], "left").select(
        own.alias("message_id"), F.when(F.col("there"), F.concat_ws(":", "conv_id", F.col("turn") - 1)).alias("parent")
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def micros(c: str) -> Column:
    """Microseconds of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw archive mail: CRLF, a patch, trailers, some replies, some implausible dates."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.when(k % 9 == 0, F.lit("01 Jan 1970")).otherwise(F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" Apr 2026")))
    reply = F.when(k % 5 == 0, F.concat(F.lit("In-Reply-To: <o"), k - 1, F.lit("@x>\n"), F.lit("References: <a@x> <o"), k - 1, F.lit("@x>\n"))).otherwise("")
    file = F.concat(F.lit("p/"), k % 11, F.lit(".c"))
    text = F.concat(
        F.lit("From: Cust "), c, F.lit(" <C"), c, F.lit("@Example.com>\nTo: L@x.org, B <b@x.org>\nSubject: Re: [PATCH v"), k % 3 + 1, F.lit(" "), k % 4, F.lit("/3] part: order "), k,
        F.lit("\nDate: Tue, "), day, F.lit(" 12:00:00 +0000\nMessage-ID: <o"), k, F.lit("@x>\n"), reply, F.lit("\nHello "), k, F.lit("\n> quoted\n\nFixes: "), F.sha1(k.cast("string")),
        F.lit(' ("x")\nReviewed-by: S <s'), k % 7, F.lit("@Example.com>\nX-Odd: Q <q"), k % 3, F.lit("@x.org>\nLink: https://bugs.example.com/bug?extid="), F.substring(F.sha1(k.cast("string")), 1, 20),
        F.lit("\nLink: https://arch.example.org/all/o"), k, F.lit("@x/\n---\ndiff --git a/"), file, F.lit(" b/"), file, F.lit("\n--- a/"), file, F.lit("\n+++ b/"), file,
        F.lit("\n@@ -1,2 +1,3 @@ int f_"), k % 13, F.lit("(void)\n a\n+b\n+d\n-c\n"),
    )
    raw = F.encode(F.regexp_replace(text, "\n", "\r\n"), "UTF-8")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("list"), F.lit("0").alias("shard"), F.concat(F.lit("c"), k).alias("commit_oid"), nanos("o_orderdate").alias("commit_date_ns"), raw.alias("raw"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with tags, prose and references, in threads of two: order k replies to k - 1 where 5 divides it."""
    k = F.regexp_extract("message_id", "[0-9]+", 0).cast("bigint")
    prose = F.when(k % 35 == 0, "Hi.\nNAK: no.").when(k % 10 == 0, "nit: name it.\n> doesn't count\n  Shouldn't this be static?\nNIT: name it.").otherwise(F.concat(F.lit("Order "), k))
    return messages(spark, sf_dir).withColumns(
        {
            "subject_tags": F.when(k % 6 == 1, F.array(F.lit("RFC PATCH"), F.lit("PATCH"))),
            "prose": prose,
            "patch": F.when(k % 4 != 0, F.concat(F.lit("diff --git a/p b/p\n+int f_"), k % 97, F.lit("(void);"))),
            "references": F.lit(None).cast("array<string>"),
            "touched_functions": F.array(F.concat(F.lit("f_"), k % 97)),
            "from_name": F.lit(None).cast("string"),
            "series_total": F.lit(3),
        }
    )


TALK_SQL = """, talk AS (SELECT *, CASE WHEN k % 35 = 0 THEN 'Hi.\nNAK: no.' WHEN k % 10 = 0 THEN 'nit: name it.\n> doesn''t count\n  Shouldn''t this be static?\nNIT: name it.' ELSE 'Order ' || k END AS prose FROM msgs),
tid AS (SELECT a.k, a.message_id, coalesce(b.message_id, a.message_id) AS tid FROM msgs a LEFT JOIN msgs b ON a.k % 5 = 0 AND b.k = a.k - 1)
"""
