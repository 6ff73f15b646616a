"""Personal-data spans by candidate gradient boosting (native DataFrame operations only on the executors).

Base spans: e-mail and IP addresses, payment cards and phone numbers, by pattern and validator. For the method, high-recall
generators propose overlapping candidate spans; each is reduced to a few discrete format and context features; boosted
two-level trees are fitted to how often candidates with the same features are valid, on four fifths of the documents by hash; a threshold per generator is calibrated
to a wanted precision on the other fifth; candidates that pass and overlap no base span are added as ``<generator>_like``.

A candidate is valid if it is a validated base span or proves itself: an IPv6 address by its syntax (with a digit in it, if
it is shortened by ``::``), an IBAN by its country's length and its check digits (modulo 97), a written-out e-mail address
(``a at b dot com``, ``a [at] b.com``) by being one once normalised. One that proves itself is added whatever the trees
say, and (e-mails apart) also where it overlaps base spans that don't cover it; `` at `` alone, with plain dots, proves nothing
and is left to the trees.

The trees see all documents: candidates are counted by feature cell in Spark, and only that table, at most ``n_cells()``
rows however large the input, reaches the driver. The fitted trees go back as one native expression.

Defined results: null or empty text has no spans; repeated rows are scanned one by one; an empty table, or one without a
valid candidate, gives no added spans; only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, before_each, let, no_spans, spans

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with possessive repeats and anchored starts so that long runs are read once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# IBAN lengths by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_H, _V4 = "[0-9A-Fa-f]{1,4}", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
IPV6_WHOLE = rf"(?:{_H}:){{7}}{_H}|(?:{_H}:){{6}}{_V4}"
IPV6_SHORT = rf"(?:{_H}(?::{_H}){{0,6}})?::(?:(?:{_H}:){{0,5}}{_V4}|{_H}(?::{_H}){{0,6}})?"
AT, DOT = r"\x20?[(\[](?:at|AT)[)\]]\x20?", r"\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20dot\x20"
GENERATORS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:@|{AT}|\x20at\x20)[A-Za-z0-9-]{{1,63}}"
    rf"(?:(?:\.|{DOT})[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "number": r"\+?[0-9(][0-9\x20().-]{5,30}[0-9]",
    "ipv6": rf"(?=[0-9A-Fa-f]{{0,4}}:)(?<![0-9A-Za-z_])(?<!::)(?<!(?<![0-9A-Za-z_]){_H}:)(?:{IPV6_WHOLE}|{IPV6_SHORT}|(?:{_H}:){{3,7}}{_H})"
    rf"(?![0-9A-Za-z_])(?!:(?::|{_H}(?![0-9A-Za-z_])))",
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}})(?<![A-Z0-9])(?:(?:{IBAN})(?![A-Za-z0-9])|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}})",
}
NEAR = r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|account|iban|host|addr|server|ip|ssn|born)"
#: Levels of each feature: generator, digits, plus sign, dot, space, dash or bracket, groups of digits, cue word before,
#: character before, how an address is written out (plain, `` at ``, in brackets or with ``dot``).
LEVELS = (len(GENERATORS), 6, 2, 2, 2, 2, 5, 2, 3, 3)
FOLDS = 5


def n_cells() -> int:
    return math.prod(LEVELS)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    total = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.length(d)),
            lambda i: let(
                F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (2 - i % 2),
                lambda x: x - 9 * (x > 9).cast("int"),
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    least, most = (13, 19) if kind == "card" else (9, 15)
    return let(
        digits(m),
        lambda d: F.when(F.length(d).between(least, most), luhn(d) if kind == "card" else F.lit(True)).otherwise(F.lit(False)),
    )


def proven(generator: str, m: Column) -> Column:
    """True for a candidate that needs no base span to be valid."""
    if generator == "email":
        address = F.regexp_replace(F.regexp_replace(m, rf"{AT}|\x20at\x20", "@"), DOT, ".")
        written_out = m.rlike(rf"{AT}|{DOT}") & address.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
        return written_out
    if generator == "ipv6":
        part = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
        # Groups of 16 bits; a dotted end holds two, and ``::`` stands for one or more.
        groups = F.size(F.filter(F.split(m, ":"), lambda x: x != "")) + m.contains(".").cast("int")
        dotted = ~m.contains(".") | m.rlike(rf":{part}(?:\.{part}){{3}}$")
        return dotted & (m.rlike(f"^(?:{IPV6_WHOLE})$") | (m.rlike(f"^(?:{IPV6_SHORT})$") & (groups <= 7) & m.rlike("[0-9]")))
    if generator == "iban":
        bare = F.translate(m, " ", "")
        # Letters count as 10 to 35, so each takes two decimal places.
        rest = F.aggregate(
            F.filter(F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), ""), lambda c: c != ""),
            F.lit(0),
            lambda a, c: let(
                F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1,
                lambda v: ((a * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int"),
            ),
        )
        return bare.rlike("^(?:" + IBAN.replace(r"\x20?", "") + ")$") & (rest == 1)
    return F.lit(False)


def bucket(n: Column, least: tuple[int, ...]) -> Column:
    out = F.lit(0)
    for x in least:
        out = out + (n >= x).cast("int")
    return out


def cell(generator: int, m: Column, before: Column) -> Column:
    """The number of a candidate's feature cell."""
    groups = F.size(F.filter(F.split(m, "[^0-9]+"), lambda x: x != ""))
    features = [
        F.lit(generator),
        bucket(F.length(digits(m)), (7, 9, 13, 16, 20)),
        m.startswith("+").cast("int"),
        m.contains(".").cast("int"),
        m.contains(" ").cast("int"),
        m.rlike("[()-]").cast("int"),
        bucket(groups, (2, 3, 4, 5)),
        before.rlike(NEAR).cast("int"),
        F.when(before.rlike(r"[\x20\x09-\x0D]$|^$"), F.lit(0)).when(before.rlike("[A-Za-z0-9]$"), F.lit(1)).otherwise(F.lit(2)),
        F.when(m.rlike(rf"{AT}|{DOT}"), F.lit(2)).when(m.contains(" at "), F.lit(1)).otherwise(F.lit(0)),
    ]
    out = F.lit(0)
    for x, n in zip(features, LEVELS, strict=True):
        out = out * n + x
    return out


def unpacked(cells: np.ndarray) -> np.ndarray:
    """Indicator matrix of ``feature >= level`` for each cell number."""
    values = np.stack(np.unravel_index(cells, LEVELS), axis=1)
    return np.stack([values[:, f] >= v for f, v in conditions()], axis=1)


def conditions() -> list[tuple[int, int]]:
    return [(f, v) for f, n in enumerate(LEVELS) for v in range(1, n)]


def measure(docs: DataFrame, text: str, carry: Column, fold: Column) -> DataFrame:
    """carried, held (whether the row only calibrates), base spans of each kind, and candidates as array<struct<s,e,g,c,...>> with generator and feature cell."""
    d = docs.select(carry.alias("carried"), (F.pmod(fold, F.lit(FOLDS)) == 0).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    guard = {"email": t.contains("@"), "phone": t.contains("+"), "ipv6": t.contains(":")}

    def found(name: str, pattern: str) -> Column:
        return F.when(guard[name], spans(t, pattern)).otherwise(no_spans()) if name in guard else spans(t, pattern)

    def validated(k: str, p: str) -> Column:
        ok = F.filter(found(k, p), lambda x: valid(k, x["m"]))
        return F.transform(ok, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k)

    base = [validated(k, p) for k, p in BASE.items()]
    at = r"@|\x20at\x20|[(\[](?:at|AT)[)\]]"  # without one of these no address is written or written out
    guard = {"ipv6": t.contains(":"), "email": t.rlike(at), "iban": t.rlike("[A-Z]{2}[0-9]{2}")}

    def proposed(i: int, g: str, p: str) -> Column:
        def described(x: Column) -> Column:
            before = F.substring(t, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
            number = let(before, lambda b: cell(i, x["m"], b))
            sure = proven(g, x["m"]).alias("proven")
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(i).alias("g"), number.alias("c"), sure)

        return F.transform(found(g, p), described)

    candidates = F.concat(*[proposed(i, g, p) for i, (g, p) in enumerate(GENERATORS.items())])
    d = d.select("carried", "held", *base, candidates.alias("candidates"))
    known = F.concat(*KINDS)
    return d.withColumn(
        "candidates",
        F.transform(
            "candidates",
            lambda x: F.struct(
                x["s"].alias("s"),
                x["e"].alias("e"),
                x["g"].alias("g"),
                x["c"].alias("c"),
                x["proven"].alias("proven"),
                (x["proven"] | F.exists(known, lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"]))).alias("valid"),
                F.exists(known, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])).alias("overlaps"),
                F.exists(known, lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"])).alias("covered"),
            ),
        ),
    )


def boost(x: np.ndarray, good: np.ndarray, all_: np.ndarray, rounds: int = 40, rate: float = 0.3):
    """Log-loss boosting of two-level trees on indicator features with counts. Returns prior and trees
    (root, (left split, left-left, left-right), (right split, ...)) of leaf values; also the cells' scores."""
    prior = math.log((good.sum() + 1) / (all_.sum() - good.sum() + 1))
    score = np.full(len(x), prior)
    trees = []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        a, b = rows[:, None] & x, rows[:, None] & ~x
        gain = (g @ a) ** 2 / (h @ a + 1) + (g @ b) ** 2 / (h @ b + 1)
        k = int(np.argmax(gain))
        leaf = lambda r: rate * float((g @ r) / (h @ r + 1))
        return k, leaf(b[:, k]), leaf(a[:, k])

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = good - all_ * p, all_ * p * (1 - p)
        root = best(np.ones(len(x), bool), g, h)[0]
        low, high = best(~x[:, root], g, h), best(x[:, root], g, h)
        trees.append((root, low, high))
        score += np.where(x[:, root], np.where(x[:, high[0]], high[2], high[1]), np.where(x[:, low[0]], low[2], low[1]))
    return prior, trees, score


def fit(measured: DataFrame, precision: float) -> tuple[float, list, dict[int, float]] | None:
    """Prior, trees, and the threshold of each generator: the lowest score at which the held-out candidates that reach it,
    counted with one failure added, are valid at the wanted precision. None if no candidate to fit to is valid."""
    counts = (
        measured.select("held", F.explode("candidates").alias("x"))
        .groupBy("held", "x.c")
        .agg(F.sum(F.col("x.valid").cast("long")).alias("good"), F.count("*").alias("n"))
        .collect()  # at most 2 * n_cells() rows
    )
    cells = np.array(sorted({r["c"] for r in counts}), np.int64)
    table = {(r["held"], r["c"]): (r["good"], r["n"]) for r in counts}
    fitted, held = (np.array([table.get((h, c), (0, 0)) for c in cells.tolist()], float).reshape(-1, 2) for h in (False, True))
    if not fitted[:, 0].sum():
        return None
    prior, trees, score = boost(unpacked(cells), fitted[:, 0], fitted[:, 1])
    good, n = held.T
    generator = np.unravel_index(cells, LEVELS)[0]
    cut = {}
    for g in range(len(GENERATORS)):
        rows = np.flatnonzero(generator == g)
        rows = rows[np.argsort(-score[rows], kind="stable")]
        ok = np.flatnonzero(np.cumsum(good[rows]) >= precision * (np.cumsum(n[rows]) + 1))
        if len(ok):
            cut[g] = float(score[rows[ok[-1]]]) - 1e-6
    return prior, trees, cut


def score_of(cell_number: Column, model) -> Column:
    prior, trees, _ = model
    values, rest = [], cell_number
    for n in reversed(LEVELS):
        values.insert(0, rest % n)
        rest = F.floor(rest / n).cast("int")

    def is_on(k: int) -> Column:
        f, v = conditions()[k]
        return values[f] >= v

    out = F.lit(prior)
    for root, low, high in trees:
        side = lambda s: F.when(is_on(s[0]), F.lit(s[2])).otherwise(F.lit(s[1]))
        out = out + F.when(is_on(root), side(high)).otherwise(side(low))
    return out


def spans_with(docs: DataFrame, text: str, carry: Column, fold: Column, precision: float) -> DataFrame:
    """carried, n_<kind>, base and spans. The candidates are written once, as the fit and the result need them; what is
    carried goes with them, so nothing has to be joined back."""
    m = Scratch(docs.sparkSession).write(measure(docs, text, carry, fold), "pii")
    model = fit(m.drop("carried"), precision)
    names = [*KINDS, *[f"{g}_like" for g in GENERATORS]]

    def named(a: Column, k) -> Column:
        """k: the kind's number, or a function of a span that gives it."""

        def of(x: Column) -> Column:
            number = k(x) if callable(k) else F.lit(k)
            kind = F.get(F.array(*map(F.lit, names)), number)
            return F.struct(number.alias("k"), x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"))

        return F.transform(a, of)

    base = F.concat(*[named(F.col(kind), i) for i, kind in enumerate(KINDS)])
    sure = lambda x: x["proven"] & ~F.when(x["g"] == 0, x["overlaps"]).otherwise(x["covered"])
    extra = F.filter("candidates", sure)
    if model:
        cuts = F.array(*[F.lit(model[2].get(g)).cast("double") for g in range(len(GENERATORS))])
        extra = F.filter(
            "candidates",
            lambda x: sure(x) | F.coalesce(~x["overlaps"] & (score_of(x["c"], model) >= F.get(cuts, x["g"])), F.lit(False)),
        )
    return m.select(
        "carried",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        base.alias("base"),
        F.array_sort(F.concat(base, named(extra, lambda x: x["g"] + len(KINDS)))).alias("spans"),
    )


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = 0.9) -> DataFrame:
    """doc_id, n_<kind>, base and spans (arrays of k, s, e, kind, by kind as listed and start)."""
    return spans_with(docs, text, F.col(doc_id), F.xxhash64(doc_id), precision).withColumnRenamed("carried", "doc_id")


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", precision: float = 0.9, doc_id: str = "doc_id") -> DataFrame:
    """The same rows and columns, with each found span replaced by its kind in brackets and ``n_chars`` brought up to date;
    of overlapping spans the first one, of several the longest, is named and the rest of the others goes with it. Rows without a span don't change."""
    fold = F.xxhash64(doc_id if doc_id in docs.columns else text)
    found = spans_with(docs, text, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), fold, precision)
    place = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("last"), x["e"].alias("e"), x["kind"].alias("kind")))
    t = F.col("carried").getField(text)

    def cut(spans: Column) -> Column:
        """The text between spans, and names for the spans. Where spans overlap, the largest end of all before counts."""
        return let(
            before_each(F.transform(spans, lambda x: x["e"]), lambda a, x: F.greatest(a, x)),
            lambda before: F.concat(
                F.array_join(
                    F.transform(
                        spans,
                        lambda x, i: F.when(
                            x["s"] >= F.get(before, i),
                            F.concat(
                                F.substring(t, F.get(before, i) + 1, x["s"] - F.get(before, i)), F.lit("["), F.upper(x["kind"]), F.lit("]")
                            ),
                        ).otherwise(F.lit("")),
                    ),
                    "",
                ),
                F.substring(t, F.array_max(F.transform(spans, lambda x: x["e"])) + 1, F.length(t)),
            ),
        )

    redacted = F.when(F.size("spans") > 0, let(F.array_sort(place), cut)).otherwise(t)
    found = found.select("carried", (F.size("spans") > 0).alias("changed"), redacted.alias("redacted"))
    size = lambda: F.length("redacted").cast(docs.schema[n_chars].dataType)
    new = {text: F.col("redacted")}
    if n_chars in docs.columns:
        new[n_chars] = F.when(F.col("changed"), size()).otherwise(F.col("carried").getField(n_chars))
    return found.select(*[new.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])
