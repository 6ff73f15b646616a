"""Secret scan with a randomness test battery (native DataFrame operations only).

Three patterns give base spans. For the method, every token of ``min_length`` or more key characters, letters alone included,
is put down as hex, base32, lower-case alphanumeric or base64, and three tests measure how far it is from uniformly drawn
characters of that alphabet: chi-squared of the character counts, runs above and below the alphabet's middle, and lag-one
serial correlation. A token whose three tests together reject uniformity at 0.001 is none. Of the others, each has the
chance that a name, number or word of its encoding and length looks as random, from two tests. Its characters repeat as
often as ``REPEATS`` says, and give a chi-squared as small: the lower tail of the noncentral chi-squared distribution, by its
normal approximation and a bound of the normal tail. And digits, capitals and small letters follow one another in runs that
end with chance ``SWITCHES``: the upper tail of the number of runs, by Chernoff's bound. Fisher's method combines both. So
p-values depend on a token's own length and alphabet, not on what else the corpus holds. Benjamini-Hochberg over all tokens
of an encoding and length class, uniform or not, picks the cut.

Defined results: null or empty text has no spans; repeated rows are scanned one by one; an empty table gives an empty
result; only the id and text columns are read. Spans of the method that overlap a base span are left out.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, let, no_spans, spans

# The base patterns, written so that no input makes them search long runs again and again.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex")

# Alphabets in their natural order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LENGTHS = (24, 32, 48)
#: Bins of -log10 of the p-values.
BIN, BINS = 0.25, 80
# The chance that two characters agree: of ordinary text in the languages of Europe about 0.065 to 0.08, of
# numbers, which hexadecimal tokens are if not keys, 0.1.
REPEATS = {"hex": 0.1, "base32": 0.065, "alnum": 0.065, "base64": 0.065}
# Where the kind of character changes (digits, capitals, small letters, signs), by place in the alphabet, and
# the chance that it does from one character to the next: once or twice in a word with a number, often in names of several
# words, which base64 tokens may be.
KIND_STARTS = {"hex": (10,), "base32": (26,), "alnum": (10,), "base64": (26, 52, 62)}
SWITCHES = {"hex": 0.05, "base32": 0.05, "alnum": 0.05, "base64": 0.35}
# Fixed value: 0.999 quantile of chi-squared with three degrees of freedom; three tests of a uniform token sum to less.
UNIFORM = 16.27


def randomness(token: Column) -> Column:
    """code: the encoding's number. stat: sum of squares of the three test scores, about 3 for random tokens, larger for
    language. bin: of -log10 of the chance that what is no key looks as random."""
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")

    def for_alphabet(text: Column, name: str) -> Column:
        alphabet, repeats, often = ALPHABETS[name], REPEATS[name], SWITCHES[name]
        k = len(alphabet)

        def score(x: Column) -> Column:
            n = F.size(x).cast("double")
            runs_of = F.aggregate(
                F.array_sort(x),
                F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sq")),
                lambda a, c: F.when(
                    a["last"] == c,
                    F.struct(c.alias("last"), (a["run"] + 1).alias("run"), (a["sq"] + 2 * a["run"] + 1).alias("sq")),
                ).otherwise(F.struct(c.alias("last"), F.lit(1.0).alias("run"), (a["sq"] + 1).alias("sq"))),
                lambda a: a["sq"],
            )
            raw = runs_of * k / n - n
            chi = (raw - (k - 1)) / (2.0 * (k - 1)) ** 0.5
            beyond = n * (k * repeats - 1)
            z = (raw - (k - 1) - beyond) / F.sqrt(2.0 * (k - 1) + 4 * beyond)
            log_p = F.when(z < 0, (z * z / 2 + math.log(2)) / math.log(10)).otherwise(F.lit(0.0))
            kind = F.transform(x, lambda c: reduce(add, [(c >= start).cast("int") for start in KIND_STARTS[name]]))
            changes = let(kind, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: (a != b).cast("double")))
            share = F.aggregate(changes, F.lit(0.0), lambda a, c: a + c) / (n - 1)
            stays = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - often))).otherwise(F.lit(0.0))
            log_runs = F.when(share > often, (n - 1) * (share * F.log(share / often) + stays) / math.log(10)).otherwise(F.lit(0.0))
            both = log_p + log_runs
            log_p = both - F.log10(1 + both * math.log(10))  # Fisher's method for two tests
            high = F.aggregate(x, F.lit(0.0), lambda a, c: a + (c >= k // 2).cast("double"))
            steps = F.zip_with(
                F.slice(x, F.lit(1), F.size(x) - 1),
                F.slice(x, F.lit(2), F.size(x) - 1),
                lambda a, b: ((a >= k // 2) != (b >= k // 2)).cast("double"),
            )
            runs = F.aggregate(steps, F.lit(1.0), lambda a, c: a + c)
            mu = 2 * high * (n - high) / n + 1
            var = (mu - 1) * (mu - 2) / (n - 1)
            run_score = F.when(var > 0, (runs - mu) / F.sqrt(var)).otherwise(F.lit(9.0))
            mean = F.aggregate(x, F.lit(0.0), lambda a, c: a + c) / n
            serial = let(
                let(mean, lambda m: F.transform(x, lambda c: c - m)),  # bound first: a lambda's body is evaluated per element
                lambda d: F.try_divide(
                    F.aggregate(
                        F.zip_with(F.slice(d, F.lit(1), F.size(d) - 1), F.slice(d, F.lit(2), F.size(d) - 1), lambda a, b: a * b),
                        F.lit(0.0),
                        lambda a, c: a + c,
                    ),
                    F.aggregate(d, F.lit(0.0), lambda a, c: a + c * c),
                ),
            )
            stat = (
                F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2))
                + F.pow(run_score, F.lit(2))
                + F.coalesce(serial * serial, F.lit(1.0)) * n
            )
            return F.struct(F.lit(code).alias("code"), stat.alias("stat"), F.least(F.lit(BINS), F.floor(log_p / BIN)).cast("int").alias("bin"))

        code = list(ALPHABETS).index(name)
        none = F.struct(F.lit(code).alias("code"), F.lit(99.0).alias("stat"), F.lit(0).alias("bin"))
        places = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
        return let(F.filter(places, lambda p: p >= 0), lambda x: F.when(F.size(x) > 1, score(x)).otherwise(none))

    return (
        F.when(bare.rlike("^[0-9a-fA-F]*$"), for_alphabet(F.lower(bare), "hex"))
        .when(bare.rlike("^[A-Z2-7]*$"), for_alphabet(bare, "base32"))
        .when(bare.rlike("^[0-9a-z]*$"), for_alphabet(bare, "alnum"))
        .otherwise(for_alphabet(bare, "base64"))
    )


def token_class(code: Column, n: Column) -> Column:
    """A number for each encoding and length class."""
    out = code * (len(LENGTHS) + 1)
    for least in LENGTHS:
        out = out + (n >= least).cast("int")
    return out


def measure(docs: DataFrame, doc_id: str, text: str, min_length: int) -> DataFrame:
    """doc_id, base spans by kind, and tokens with their class, bin and whether uniformity holds."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    none = no_spans()
    assign = F.when(F.col("t").contains("=") | F.col("t").contains(":"), spans(F.col("t"), ASSIGN)).otherwise(none)
    found = {
        "assign": F.filter(assign, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 8),
        "access": F.when(F.col("t").contains("AKIA"), spans(F.col("t"), ACCESS)).otherwise(none),
        "hex": spans(F.col("t"), HEX),
    }
    place = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    tokens = F.transform(
        spans(F.col("t"), rf"[A-Za-z0-9+/_=-]{{{min_length},}}+"),
        lambda x: let(
            randomness(x["m"]),
            lambda r: F.struct(
                x["s"].alias("s"), x["e"].alias("e"), token_class(r["code"], x["e"] - x["s"]).alias("c"), r["bin"].alias("b"), (r["stat"] <= UNIFORM).alias("uniform")
            ),
        ),
    )
    return d.select("doc_id", *[place(x).alias(k) for k, x in found.items()], tokens.alias("tokens"))


def cuts(measured: DataFrame, rate: float) -> DataFrame:
    """c, cut: the least bin of each class whose Benjamini-Hochberg bound holds, by the largest p-value of each bin.
    Works on a histogram of at most classes x bins rows, gathered from all documents."""
    seen = measured.select(F.explode("tokens").alias("x")).groupBy(F.col("x.c").alias("c"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))
    upto, whole = W.partitionBy("c").orderBy(F.desc("b")), W.partitionBy("c")
    h = seen.select("c", "b", F.sum("n").over(upto).alias("found"), F.sum("n").over(whole).alias("m"))
    p = F.pow(F.lit(10.0), -BIN * F.col("b"))
    return h.filter(p * F.col("m") <= rate * F.col("found")).groupBy("c").agg(F.min("b").alias("cut"))


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 20, false_discovery_rate: float = 0.05
) -> DataFrame:
    """doc_id, base (array of kind, s, e by start, then kind as listed) and spans (with the method's, of kind ``random``)."""
    m = Scratch(docs.sparkSession).write(measure(docs, doc_id, text, min_length), "secrets")
    cut = cuts(m, false_discovery_rate).agg(F.map_from_entries(F.collect_list(F.struct("c", "cut"))).alias("cut"))
    kinds = [*KINDS, "random"]

    def named(a: Column, kind: str) -> Column:
        return F.transform(
            a, lambda x: F.struct(x["s"].alias("s"), F.lit(kinds.index(kind)).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"))
        )

    d = m.join(F.broadcast(cut)).withColumn("base", F.array_sort(F.concat(*[named(F.col(k), k) for k in KINDS])))  # one row
    extra = F.filter(
        "tokens",
        lambda x: x["uniform"]
        & F.coalesce(x["b"] >= F.try_element_at(F.col("cut"), x["c"]), F.lit(False))
        & ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])),
    )
    return d.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        "base",
        F.array_sort(F.concat("base", named(extra, "random"))).alias("spans"),
    )
