"""Driver-side checks: time bounds, patterns, limits."""

from __future__ import annotations

import datetime as dt
import re

UNIT_S = {"h": 3600, "d": 86400, "w": 7 * 86400, "mo": 30 * 86400, "y": 365 * 86400}
MAX_QUERY = 2048


def time_bound(value: str | int | None, now_ns: int) -> int | None:
    """Nanoseconds of: a number, ``<n>h|d|w|mo|y`` before ``now_ns``, a date, or an ISO time. Units in any case."""
    if value is None or value == "":
        return None
    if isinstance(value, int) or str(value).isdigit():
        return int(value)
    text = str(value).strip()
    if m := re.fullmatch(r"(?i)(\d+)(h|d|w|mo|y)", text):
        return now_ns - int(m[1]) * UNIT_S[m[2].lower()] * 10**9
    t = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    t = t.replace(tzinfo=t.tzinfo or dt.timezone.utc)
    since = t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return (since.days * 86400 + since.seconds) * 10**9 + since.microseconds * 1000


def window(since, until, now_ns: int) -> tuple[int | None, int | None]:
    lo, hi = time_bound(since, now_ns), time_bound(until, now_ns)
    if lo is not None and hi is not None and lo >= hi:
        raise ValueError("since must lie before until")
    return lo, hi


def checked_pattern(pattern: str, anchor_required: bool = False) -> str:
    """A pattern for rlike with the semantics of a DFA engine: no look-around, back-references, possessive or atomic parts;
    ``$`` is the end of the text, ``.`` stops at a newline alone."""
    if len(pattern) > MAX_QUERY:
        raise ValueError("pattern too long")
    if re.match(r"\^?\.\*", pattern):
        raise ValueError("a leading .* is not allowed")
    if anchor_required and not pattern.startswith("^"):
        raise ValueError("the pattern must start with ^")
    if re.search(r"\(\?(?:[=!>]|<[=!])|(?<!\\)\\[1-9kG]|[*+?}]\+", pattern):
        raise ValueError("look-around, back-references and possessive repeats are not supported")
    if re.match(r"\(\?[a-z]*m", pattern):
        return "(?d)" + pattern
    out, in_class, i = "", False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out, i = out + pattern[i : i + 2], i + 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out, i = out + (r"\z" if c == "$" and not in_class else c), i + 1
    return "(?d)" + out


def checked_needle(needle: str, least: int = 3) -> str:
    if not least <= len(needle) <= MAX_QUERY:
        raise ValueError(f"needle must have {least} to {MAX_QUERY} characters")
    return needle


def no_phrases(query: str) -> str:
    if '"' in query:
        raise ValueError("phrase queries are not supported: terms have no positions")
    return query
