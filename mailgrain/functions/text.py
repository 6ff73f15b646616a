"""Column functions for subjects, bodies, trailers and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAILER_LINE = r"^[A-Za-z][A-Za-z0-9_-]{0,63}: "
NONE = "cast(array() as array<string>)"


def items(c: Column | str) -> Column:
    """An array column with null read as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.expr(NONE))


def email_of(raw: Column) -> Column:
    """Text in the last <..>, else the first token with an @, lower-cased; empty becomes null."""
    inside = F.regexp_extract(raw, r"<([^<>]*)>[^<>]*$", 1)
    token = F.regexp_extract(raw, r"(\S*@\S*)", 1)
    return F.nullif(F.lower(F.trim(F.when(inside != "", inside).otherwise(token))), F.lit(""))


def strip_angles(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^<(.*)>$", "$1")


def bare_message_id(c: Column) -> Column:
    return F.regexp_replace(strip_angles(c), r"\s+", "")


def subject_parts(subject: Column) -> Column:
    """struct(normalized, tags, version, index, total, cover). Reply marks, then bracketed tags, are taken off the front; in
    the tags ``vN`` is the version and ``N/M`` place and total, the last one counts; 0 of M is a cover letter."""
    rest = F.regexp_replace(F.trim(subject), r"^(?i)((re|fwd|fw):\s*)+", "")
    head = F.regexp_extract(rest, r"^((?:\s*\[[^\]]*\])*)", 1)
    tags = F.transform(F.regexp_extract_all(head, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda t: F.trim(t))
    words = F.flatten(F.transform(tags, lambda t: F.split(t, r"\s+")))
    version = F.try_element_at(
        F.filter(F.transform(words, lambda w: F.regexp_extract(w, r"^(?i)v([0-9]{1,6})$", 1)), lambda v: (v != "") & (v.cast("int") > 0)), F.lit(-1)
    )
    place = F.try_element_at(
        F.filter(
            F.transform(words, lambda w: F.struct(F.regexp_extract(w, r"^([0-9]{1,6})/([0-9]{1,6})$", 1).alias("i"), F.regexp_extract(w, r"^([0-9]{1,6})/([0-9]{1,6})$", 2).alias("n"))),
            lambda p: (p["n"] != "") & (p["n"].cast("int") > 0),
        ),
        F.lit(-1),
    )
    named = F.array_distinct(
        F.flatten(F.transform(tags, lambda t: F.when(F.upper(t).contains("PATCH"), F.array(t, F.lit("PATCH"))).otherwise(F.array(t))))
    )
    return F.struct(
        F.trim(F.substring(rest, F.length(head) + 1, F.length(rest))).alias("normalized"),
        named.alias("tags"),
        F.coalesce(version.cast("int"), F.lit(0)).alias("version"),
        place["i"].cast("int").alias("index"),
        place["n"].cast("int").alias("total"),
        F.coalesce(place["i"].cast("int") == 0, F.lit(False)).alias("cover"),
    )


def patch_start(body: Column) -> Column:
    """1-based place of the first line that starts a diff, or 0."""
    return F.when(body.startswith("diff --git "), F.lit(1)).otherwise(
        F.when(F.locate("\ndiff --git ", body) > 0, F.locate("\ndiff --git ", body) + 1).otherwise(F.lit(0))
    )


def prose_of(body: Column) -> Column:
    at = patch_start(body)
    return F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body)


def patch_of(body: Column) -> Column:
    at = patch_start(body)
    return F.when(at > 0, F.substring(body, at, F.length(body))).otherwise(F.lit(""))


def scrubbed(prose: Column) -> Column:
    """Prose without quoted lines and without all that follows a signature line."""
    lines = F.split(F.regexp_replace(prose, r"(?s)(^|\n)-- ?\r?(\n.*|$)", "$1"), "\n")
    return F.array_join(F.filter(lines, lambda x: ~x.startswith(">")), "\n")


def trailer_lines(prose: Column) -> Column:
    """array<struct<name,value>> of distinct trailer-shaped lines, names lower-cased."""
    lines = F.array_distinct(F.filter(F.transform(F.split(prose, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(TRAILER_LINE)))
    return F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")
        ),
    )


def trailer(lines: Column, name: str) -> Column:
    return F.transform(F.filter(lines, lambda x: x["name"] == name), lambda x: x["value"])


def refs_of(raw: Column, kind_of: Column | None = None) -> Column:
    """array<struct<ref_kind,ref_value>> of one trailer's value: raw_lc, email, sha_prefix, bug_hash, archive_mid, url_lc. Of a
    trailer of the kind ``fixes`` each commit that it names counts, of others one that it begins with."""
    # Plain searches come first: few values have what a pattern looks for.
    having = lambda c, mark: F.when(raw.contains(mark), c).otherwise(F.expr(NONE))
    urls = having(F.regexp_extract_all(raw, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1)), "://")
    plain = lambda u: F.url_decode(F.regexp_replace(F.regexp_replace(u, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))
    mids = F.transform(F.filter(urls, lambda u: u.contains("@") | u.contains("%")), lambda u: strip_angles(F.regexp_extract(plain(u), r"^https?://[^/]+/(?:[^/]+/)*?([^/?#\s]+@[^/?#\s]+)", 1)))
    hashes = F.concat(
        having(F.regexp_extract_all(raw, F.lit(r"[?&](?:extid|id)=([0-9a-f]{8,40})\b"), F.lit(1)), "id="),
        having(F.regexp_extract_all(raw, F.lit(r"\+([0-9a-f]{8,40})@"), F.lit(1)), "+"),
    )
    sha = F.array(F.lower(F.regexp_extract(raw, r"^([0-9a-fA-F]{8,40})(?![0-9A-Za-z])", 1)))
    if kind_of is not None:
        each = F.regexp_extract_all(F.lower(raw), F.lit(r"(?<![0-9a-f])([0-9a-f]{8,40})(?![0-9a-f])"), F.lit(1))
        sha = F.when(kind_of == "fixes", each).otherwise(sha)

    def kind(name: str, values: Column) -> Column:
        return F.transform(
            F.filter(values, lambda v: v.isNotNull() & (v != "")), lambda v: F.struct(F.lit(name).alias("ref_kind"), v.alias("ref_value"))
        )

    return F.array_distinct(
        F.concat(
            kind("raw_lc", F.array(F.lower(F.trim(raw)))),
            kind("email", F.when(raw.contains("@") & ~raw.rlike("^https?://"), F.array(email_of(raw))).otherwise(F.expr(NONE))),
            kind("sha_prefix", sha),
            kind("bug_hash", hashes),
            kind("archive_mid", mids),
            kind("url_lc", F.transform(urls, lambda u: F.lower(F.rtrim(u, F.lit("/.,;)"))))),
        )
    )


def url_host(url: Column) -> Column:
    """Lower-cased host of an http(s) URL, without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def words(text: Column) -> Column:
    """Whole identifiers, lower-cased: no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def glob_regex(glob: str) -> str:
    """A maintainers' glob: ``*`` and ``?`` stay inside a path segment, a trailing slash takes all below."""
    body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_" else c) for c in glob)
    return f"^{body}.*" if glob.endswith("/") else f"^{body}(/.*)?$"


def quarter_label(ns: Column, bucket: str) -> Column:
    """In UTC, whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ns / (86400 * 10**9)).cast("int"))
    if bucket == "year":
        return F.when(ns.isNotNull(), F.format_string("%04d", F.year(day)))
    if bucket == "month":
        return F.when(ns.isNotNull(), F.format_string("%04d-%02d", F.year(day), F.month(day)))
    return F.when(ns.isNotNull(), F.format_string("%04dQ%d", F.year(day), F.quarter(day)))
