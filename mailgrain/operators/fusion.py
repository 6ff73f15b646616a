"""Fused search: query grammar, tiers, reciprocal rank fusion, signed cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import shlex

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bounds import checked_needle, window
from ..lineage import checkpointed
from .derive import freshest
from .predicates import contains_ci, eq, expand_citation, keyset_page, newest, windowed
from .search import bm25, substring

RRF_K = 60
KEYS = ("list", "dfn", "dfhh", "dfb", "mid", "f", "fixes", "since", "until", "b")


def parse_query(text: str) -> dict:
    """``key:value`` terms for KEYS, values possibly quoted; other words are free text. Quotes around free text are refused."""
    if len(text) > 2048:
        raise ValueError("query too long")
    out: dict = {"words": []}
    for token in re.findall(r'(?:[a-z]+:"[^"]*"|\S)+', text):
        key, _, value = token.partition(":")
        if key in KEYS and value:
            out[key] = shlex.split(value)[0] if value.startswith('"') else value
        elif '"' in token:
            raise ValueError("phrase queries are not supported")
        else:
            out["words"].append(token)
    if "b" in out:
        out["words"].append(out["b"])
    return out


def ranked(tier: DataFrame, name: str, order: list, key: str = "message_id", limit: int = 1000) -> DataFrame:
    """key, tier, rank from 1. The cut comes before the window, so the window sees ``limit`` rows."""
    cut = tier.orderBy(*order).limit(limit)
    return cut.select(key, F.lit(name).alias("tier"), F.row_number().over(W.orderBy(*order)).alias("rank"))


def fuse(tiers: list[DataFrame], key: str = "message_id") -> DataFrame:
    """key, score, tiers: sum of 1 / (60 + rank), by score, then key."""
    rows = tiers[0]
    for t in tiers[1:]:
        rows = rows.unionByName(t)
    fused = rows.groupBy(key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("tier")), ",").alias("tiers"))
    return fused.orderBy(F.desc("score"), F.asc(key))


def search(m: DataFrame, text: str, now_ns: int, limit: int = 25, after: tuple | None = None, depth: int = 1000) -> DataFrame:
    """message_id, score, tiers. Tiers are cut at ``depth``, which is doubled until the page is certain: what is cut off
    scores less than the page's last row, or nothing is cut off. Of the metadata keys one decides the metadata tier: mid, fixes, file or function, author,
    list or dates. List, author and dates filter all tiers before ranking, so no good hit is cut off by a worse one."""
    q = parse_query(text)
    since, until = window(q.get("since"), q.get("until"), now_ns)
    rows = windowed(m, since, until, q.get("list"))
    if "f" in q:
        rows = rows.filter(contains_ci(F.col("from_addr"), q["f"]))
    hits = _hits(m, rows, q, since, until)
    while True:
        tiers = [ranked(h, name, order, limit=depth) for name, h, order in hits]
        cut = [h.count() >= depth for _, h, _ in hits]
        page = keyset_page(fuse(tiers), limit, after, "score", "message_id")
        if not any(cut):
            return page
        last = page.select(F.min("score"), F.count("*")).first()
        if last[1] == limit and last[0] > round(sum(cut) / (RRF_K + depth + 1), 9):
            return page
        depth *= 2


def search_page(m: DataFrame, text: str, now_ns: int, limit: int = 25, after: tuple | None = None, depth: int = 1000) -> DataFrame:
    """A page of :func:`search` with what a reader sees of each hit: list, subject, author and date of its freshest copy, best
    first. The page is broadcast: it has ``limit`` rows at most."""
    page = checkpointed(search(m, text, now_ns, limit, after, depth))
    shown = m.select("message_id", "list", "subject_raw", "from_addr", "date_unix_ns").join(F.broadcast(page), "message_id")
    return freshest(shown).orderBy(F.desc("score"), "message_id")


def _hits(m: DataFrame, rows: DataFrame, q: dict, since: int | None, until: int | None) -> list[tuple[str, DataFrame, list]]:
    """name, hits and order of each tier. Keys and what orders them are written once, and read for each depth."""
    found = []
    if "mid" in q:
        found.append(("metadata", eq(rows, "message_id", q["mid"], limit=None)))
    elif "fixes" in q:
        found.append(("metadata", expand_citation(rows, q["fixes"], None)))
    elif "dfn" in q or "dfhh" in q:
        hit = eq(rows, "touched_files", q["dfn"], limit=None) if "dfn" in q else rows
        found.append(("metadata", eq(hit, "touched_functions", q["dfhh"], limit=None) if "dfhh" in q else hit))
    elif "f" in q or "list" in q or since is not None or until is not None:
        found.append(("metadata", rows))
    if "dfb" in q:
        found.append(("patch", substring(rows, checked_needle(q["dfb"]), "patch")))
    out = [(name, checkpointed(h.select("message_id", "list", "date_unix_ns")), newest()) for name, h in found]
    if q["words"]:
        scored = bm25(m, " ".join(q["words"]), fields=("prose", "subject_normalized"))
        allowed = scored.join(rows.select("message_id").distinct(), "message_id", "left_semi")
        out.append(("prose", checkpointed(allowed.select("message_id", "score")), [F.desc("score"), F.asc("message_id")]))
    if not out:
        raise ValueError("empty query")
    return out


def sign_cursor(secret: bytes, query: str, score, message_id: str) -> str:
    body = json.dumps({"q": _bound(query), "s": score, "m": message_id}, sort_keys=True).encode()
    mac = hmac.new(secret, body, hashlib.sha256).digest()
    return base64.urlsafe_b64encode(mac + body).decode().rstrip("=")


def read_cursor(secret: bytes, query: str, cursor: str) -> tuple:
    """(score, message_id) of a cursor that was signed for this query; integers stay exact."""
    raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
    mac, body = raw[:32], raw[32:]
    if not hmac.compare_digest(mac, hmac.new(secret, body, hashlib.sha256).digest()):
        raise ValueError("bad cursor signature")
    got = json.loads(body)
    if got["q"] != _bound(query):
        raise ValueError("cursor belongs to another query")
    return got["s"], got["m"]


def _bound(query: str) -> str:
    return hashlib.blake2b(query.encode(), digest_size=8).hexdigest()
