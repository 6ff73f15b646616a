"""Document quality rules with host-level verdicts (native DataFrame operations only).

Per document: counts of words, word characters, symbols, repeated lines and repeated three-word windows, and the rules that
they fail. Per host: the failure rate of each rule is shrunk towards the corpus by a beta prior whose two parameters are
fitted to all hosts by the method of moments, from the variance between hosts that is left once the binomial noise of
hosts with few documents is taken off; a host whose shrunk rate of any rule reaches ``host_rate`` is rejected, and its verdict
is joined back to its documents. The host of a URL is its domain; anything else is a host by its own name.

Defined results: null or blank text has no words and fails ``short``; a null host is no host and rejects nothing; repeated
rows are judged one by one; an empty table gives an empty result; columns other than the id, text and host are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, let, small

MIN_WORDS = 50
RULES = ("short", "repeats", "symbols", "dup_lines")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are sorted with their place, so equal ones are
    neighbours; the places found are then covered by intervals of three words."""

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        return F.sort_array(
            F.arrays_zip(
                F.slice(w, F.lit(1), n).alias("a"),
                F.slice(w, F.lit(2), n).alias("b"),
                F.slice(w, F.lit(3), n).alias("c"),
                F.sequence(F.lit(1), n).alias("p"),
            )
        )

    def same(x: Column, y: Column) -> Column:
        return (x["2"] == y["2"]) & (x["1"] == y["1"]) & (x["0"] == y["0"])

    def places(z: Column) -> Column:
        return F.transform(
            F.filter(
                z,
                lambda x, i: F.coalesce(same(x, F.get(z, i + 1)), F.lit(False))
                | F.coalesce(same(x, F.get(z, i - 1)), F.lit(False)),
            ),
            lambda x: x["3"],
        )

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    fields = "array<struct<`0`:string,`1`:string,`2`:string,`3`:int>>"
    return F.when(
        F.size(words) > 3, let(windows(words).cast(fields), lambda z: let(F.sort_array(places(z)), covered))
    ).otherwise(F.lit(0).cast("long"))


def domain(source: Column) -> Column:
    """The lower-cased domain of an http(s) URL, without user, port and ``www.``; other values as they are."""
    found = F.lower(F.regexp_extract(source, r"^(?i)https?://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    return F.when(found != "", found).otherwise(source)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: id, host, counts, and one boolean for each of RULES."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), domain(F.col(host)).alias("host"), t.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        "host",
        F.filter(F.split("t", SPACE + "+"), lambda x: x != "").alias("w"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.size(lines).alias("n_lines"),
    )
    d = d.withColumns({"n_words": F.size("w").cast("long"), "n_repeat_words": repeat_words(F.col("w"))}).drop("w")
    return d.withColumns(
        {
            "short": F.col("n_words") < MIN_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
            "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
            "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        }
    )


def host_verdicts(measured: DataFrame, host_rate: float = 0.5) -> DataFrame:
    """host, host_docs, one shrunk rate for each rule, host_kept. The prior's mean is the mean host rate m and its weight
    follows from the variance v between hosts: a + b = m(1-m)/v - 1, held between 1 and 10^4. The observed rates of hosts
    vary by v + (m(1-m) - v) * mean(1/n), as n documents of a host alone make its rate vary; v is what solves this."""
    h = (
        measured.filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("host_docs"), *[F.sum(F.col(r).cast("long")).alias(f"f_{r}") for r in RULES])
    )
    rates = {r: F.col(f"f_{r}") / F.col("host_docs") for r in RULES}
    prior = h.agg(
        *[F.avg(x).alias(f"m_{r}") for r, x in rates.items()], *[F.var_pop(x).alias(f"v_{r}") for r, x in rates.items()],
        F.avg(1 / F.col("host_docs")).alias("noise"),
    )
    h = h.join(F.broadcast(prior))  # one row

    def shrunk(r: str) -> Column:
        m, noise = F.col(f"m_{r}"), F.col("noise")
        v = F.when(noise < 1, (F.col(f"v_{r}") - m * (1 - m) * noise) / (1 - noise)).otherwise(F.lit(0.0))
        weight = F.least(F.lit(1e4), F.greatest(F.lit(1.0), F.when(v > 0, m * (1 - m) / v - 1).otherwise(F.lit(1e4))))
        return (F.col(f"f_{r}") + m * weight) / (F.col("host_docs") + weight)

    h = h.select("host", "host_docs", *[shrunk(r).alias(f"rate_{r}") for r in RULES])
    return h.withColumn("host_kept", F.greatest(*[f"rate_{r}" for r in RULES]) < host_rate)


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    host_rate: float = 0.5,
    max_broadcast_hosts: int = 200_000,
) -> DataFrame:
    """Counts, rules, base_failed, host_kept and kept for each document. The counts are written once, as both the hosts'
    rates and the result need them. Host verdicts are broadcast up to ``max_broadcast_hosts`` hosts; beyond that, documents
    of a host are dealt over 16 salts, so one host with a third of all rows doesn't meet in one task."""
    spark = docs.sparkSession
    m = Scratch(spark).write(measure(docs, doc_id, text, host), "measured")
    v = host_verdicts(m, host_rate).select("host", "host_kept")
    known = small(v, max_broadcast_hosts)
    if known is not v:
        out = m.join(known, "host", "left")
    else:
        v = v.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        out = m.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(v, ["host", "salt"], "left")
    failed = F.col("short") | F.col("repeats")
    return out.withColumn("host_kept", F.coalesce("host_kept", F.lit(True))).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("host_kept")).alias("kept"), *RULES, "host_kept",
    )
