"""k-means, token alignment and top-k against plain Python, on awkward rows and on the smallest tables."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    schema = "vec_id bigint, embedding array<float>, id string, v string, rid string, rank int, score string, cluster string"
    return spark.createDataFrame([(i, v, "clash", "clash", "clash", 1, "clash", "clash") for i, v in rows], schema)


def some_vectors(dims, n=500, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dims))
    out = [(i, (middle[i % 6] + 0.2 * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]
    hot = [(n + i, out[7][1]) for i in range(n // 2)]  # a third of all rows are one vector
    odd = [(9001, None), (9002, []), (9003, [None] * dims), (9004, [NAN] * dims), (9005, [INF] * dims), (None, out[3][1]), (9050, [0.0] * dims), (9100, out[7][1])]
    return out + hot + odd + [(9150, [3e38] * dims), (9200, [-1e6] * dims)] + out[:2] * 2 + [(50, out[1][1])]


def whole(x, scale):
    return max(-(1 << 24), min(1 << 24, math.floor(float(np.float32(x)) * scale)))


# -- op11 --------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [whole(x, 64) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    z = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(z))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(z)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                z[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    of = Counter()
    for _, c, d in found:
        of[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return sorted(((i, c, d, of[c], sum(of.values()), names[c]) for i, c, d in found), key=repr)


def clustered(df, **options):
    from mailgrain.llm.kd_clusters import cluster, with_inertia

    return sorted((tuple(r) for r in with_inertia(*cluster(df, **options)).collect()), key=repr)


def test_clusters(spark):
    rows = some_vectors(64)
    assert clustered(vectors(spark, rows).repartition(3)) == plain_clusters(rows)
    assert clustered(vectors(spark, rows[:0])) == []
    assert clustered(vectors(spark, rows[:5])) == plain_clusters(rows[:5])  # fewer vectors than centroids
    assert clustered(vectors(spark, rows[:1] * 50)) == plain_clusters(rows[:1] * 50)  # all equal: one centroid takes all


def test_clusters_with_ties_and_other_sizes(spark):
    rng = np.random.default_rng(5)
    grid = [(i, [float(x) / 64 for x in rng.integers(-2, 3, 3)]) for i in range(400)]
    assert clustered(vectors(spark, grid), k=9, rounds=4, dims=3) == plain_clusters(grid, 9, 4, 3)


def test_clusters_of_embeddings(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert clustered(e) == plain_clusters([(r["vec_id"], r["embedding"]) for r in e.collect()])


def test_filtering_leaves_little_to_the_leaves():
    """Where clusters are apart, whole nodes are assigned; the nodes' sums are those of their points."""
    from mailgrain.llm.kd_clusters import assign, built

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-40, 40, (500, 8)) + 1000 * c for c in range(8)])
    order, nodes = built(points)
    tree = {**nodes, "points": points[order]}
    for first, last, s in zip(tree["first"], tree["last"], tree["sums"]):
        assert (tree["points"][first:last].sum(axis=0) == s).all()
    z = np.array([[1000 * c + 3] * 8 for c in range(8)])
    owner, count, sums, resolved = assign(tree, z)
    assert resolved == 0 and count.tolist() == [500] * 8
    assert (owner == ((tree["points"][:, None] - z) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert (sums == [points[owner[np.argsort(order)] == c].sum(axis=0) for c in range(8)]).all()


# -- op13 --------------------------------------------------------------------------------------------------------------


def plain_top(rows, k=5, every=50):
    kept = [(i, [whole(x, 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(kept):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(kept) if other != at)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "query_rows": 3}])
def test_top_k(spark, options):
    from mailgrain.llm.maxscore import top_k

    rows = some_vectors(16)
    df = vectors(spark, rows).repartition(3)
    query = F.col("id") % 50 == 0
    assert sorted(tuple(r) for r in top_k(df, query, **options).collect()) == plain_top(rows)
    assert top_k(df.limit(0), query, **options).collect() == []
    assert sorted(tuple(r) for r in top_k(vectors(spark, rows[:3]), query, **options).collect()) == plain_top(rows[:3])
    longer = [(0, [1.0, 2.0]), (1, [3.0]), (2, []), (3, [1.0, 1.0, 9.0]), (50, [])]
    assert sorted(tuple(r) for r in top_k(vectors(spark, longer), query, **options).collect()) == plain_top(longer)


def test_non_essential_terms_are_probed_for_few(spark):
    """A term of small weights is non-essential; the rows that it alone speaks for aren't looked at."""
    from mailgrain.llm.maxscore import Shard

    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (3000, 12))
    v[:, 0] = rng.integers(0, 400, 3000)
    s = Shard(np.arange(3000), np.arange(3000), v)
    ids, score = s.top(v[5], 5, 4)
    want = sorted((-int(x), i) for i, x in enumerate(v @ v[5]) if i != 5)[:4]
    assert list(zip((-score).tolist(), ids.tolist())) == want


# -- op12 --------------------------------------------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "a", "  two  blanks ", "line\n\n\tother\r\n", "été ñandú 日本語 🦙 x", "▁ stands for a blank", "<s> <|endoftext|> <0x41> </s>",
    "\x00 nul", "naïve café " * 40, "the same text", "the same text", "x" * 3000, "١٢٣ ½ ǅ", "it's they'll WE'VE 12,345.67 $#@!", "é ‍​ joined",
]


def plain_alignment(docs):
    """docs: (doc_id, text). By the definition: all pairs of tokens whose byte ranges overlap."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in visible)}

    def surface(i):
        s = p.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode()

    rows, count = [], Counter()
    for d, text in docs:
        a = b = []
        if text:
            a = [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, surface(i)) for i in p.encode(text)]
            if {b"".join(s for _, s in a), b"".join(s for _, s in b)} != {b" " + text.encode()}:
                a = b = []

        def ranged(tokens):
            out, at = [], 0
            for i, s in tokens:
                out.append((i, at, at + len(s)))
                at += len(s)
            return out

        a, b = ranged(a), ranged(b)
        links = [(x, y) for x, s, e in a for y, u, w in b if s < w and u < e]
        count.update(links)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [[[i for i, _, e in side if lo < e <= hi] for side in (a, b)] for lo, hi in zip([0, *ends], ends)]
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((d, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((d, a, b, g, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), h) for d, a, b, g, x, h in rows)


def aligned(df, **options):
    import public_tokenizers

    from mailgrain.llm.alignment import align

    found, pairs = align(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), **options)
    ids = lambda x: F.array_join(x.cast("array<string>"), ",")
    if "groups" in found.columns:
        text = F.array_join(F.transform("groups", lambda g: F.concat(ids(g["a"]), F.lit("|"), ids(g["b"]))), ";")
        found = found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2(text, 256)).otherwise(""))
    return sorted(tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), pairs


@pytest.mark.parametrize("most", [2_000_000, 0])  # the table of pairs, and the join
@pytest.mark.parametrize("digest", [False, True])
def test_alignment(spark, most, digest):
    docs = list(enumerate(TEXTS)) + [(3, "a")] * 2
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"rid": F.lit("clash"), "a_ids": F.lit("clash")}).repartition(3)
    got, pairs = aligned(df, max_table_pairs=most, digest=digest)
    assert got == plain_alignment(docs)
    assert sum(r["n"] for r in pairs.collect()) == sum(r[4] for r in got)
    assert aligned(df.limit(0), max_table_pairs=most, digest=digest)[0] == []


def test_alignment_of_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.length("text") < 3000)  # the plain form is quadratic in a text
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert aligned(df.select("doc_id", "text"))[0] == plain_alignment(docs)


def test_alignment_in_parts(monkeypatch):
    """A text cut at its blanks has the tokens of the whole one."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from mailgrain.llm import alignment

    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    rng = np.random.default_rng(4)
    signs = list("ab1'. \n\té日½🦙\u00a0\u200d\x1c\x85") + [" ", " ", " a", "'s ", "  ", " _", " <s> "]
    texts = ["".join(rng.choice(signs, 40)) for _ in range(400)] + [" ".join(f"word{i} été  two\nline" for i in range(300)), "x" * 5000]
    t = alignment.Tokenizers(alignment.load(*paths))
    monkeypatch.setattr(alignment, "KNOWN_PARTS", 1000)
    for part in (texts[:300], texts[300:], texts):  # some parts are known by then, and forgotten in between
        found = t.encode(pa.array(part))
        for (ids, off), own in zip(found, (lambda t: a.encode(" " + t, add_special_tokens=False).ids, b.encode), strict=True):
            for i, text in enumerate(part):
                assert ids[off[i] : off[i + 1]].tolist() == own(text), text


def test_alignment_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text", "mine")], "doc_id bigint, text string, groups string")
    import public_tokenizers

    from mailgrain.llm.alignment import align

    found, _ = align(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    r = found.first()
    assert r["groups"] == "mine" and r["n_a"] == sum(len(g["a"]) for g in r["groups_"])


@pytest.mark.parametrize("name", ["op11_clusters", "op13_topk"])
def test_sql(spark, name):
    import duckdb

    from mailgrain.llm.queries import ORACLE, queries

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    df, want = queries()[name](spark, SMALL), con.sql(ORACLE[name])
    assert df.columns == want.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(want.fetchall())


def test_license_phrases_stand_at_their_place(spark):
    """Key phrases elsewhere in a file make no other licence of a notice that shares nearly all words."""
    from mailgrain.llm.licenses import TEMPLATES, scan_licenses

    notice = {label: text for label, text, _ in TEMPLATES if label in ("gpl-2", "gpl-3", "cc-by", "cc-by-sa", "apache-2")}
    rows = [
        (1, notice["gpl-2"] + "\nThis is version 3 of the tool."),
        (2, "Version 2 of the tool.\n" + notice["gpl-3"]),
        (3, "/* " + notice["gpl-2"].replace("; you can", "; as before, you can") + " */"),  # words put in
        (4, notice["gpl-2"] + "\n\nPart two:\n" + notice["gpl-3"]),
        (5, notice["cc-by"]),
        (6, notice["cc-by-sa"] + " Version 4.0 of the attribution."),
    ]
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "gpl-2", 2: "gpl-3", 3: "gpl-2", 4: "gpl-2,gpl-3", 5: "cc-by", 6: "cc-by-sa"}


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    from corpus_pipeline import STAGES

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    own = {"score": F.lit(42.0), "Lang_Pred": F.lit("mine"), "piece_ids": F.lit("mine"), "n_pieces": F.lit(-1)}
    docs = docs.withColumns(own)
    want = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[c] for c in own] == [want[r["doc_id"]][c] for c in own], name
    assert STAGES[-1][1](spark, docs, SMALL).columns == ["doc_id", "lang", "source", "piece_ids", "n_pieces"]


# -- op4 ---------------------------------------------------------------------------------------------------------------

HEX, CAPITALS, LETTERS, DIGITS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
KEYS = [(HEX, 24), (HEX, 31), (HEX.upper(), 40), (HEX.upper(), 64), (CAPITALS + "234567", 32), (LETTERS + DIGITS, 32), (LETTERS + DIGITS, 40), (CAPITALS + LETTERS + DIGITS + "+/", 24), (CAPITALS + LETTERS + DIGITS + "+/", 40)]


def plain_battery(token):
    """(encoding's number, sum of squares, -log10 p) of a token, by the definitions."""
    from mailgrain.llm import secrets as S

    bare = token.rstrip("=").replace("-", "+").replace("_", "/")
    if all(c in HEX + HEX.upper() for c in bare):
        bare, name = bare.lower(), "hex"
    else:
        name = "base32" if all(c in CAPITALS + "234567" for c in bare) else "alnum" if all(c in DIGITS + LETTERS for c in bare) else "base64"
    alphabet, n, k = S.ALPHABETS[name], len(bare), len(S.ALPHABETS[name])
    x = [alphabet.index(c) for c in bare]
    raw = sum(v * v for v in Counter(x).values()) * k / n - n
    beyond = n * (k * S.REPEATS[name] - 1)
    z = (raw - (k - 1) - beyond) / math.sqrt(2 * (k - 1) + 4 * beyond)
    log_p = (z * z / 2 + math.log(2)) / math.log(10) if z < 0 else 0.0
    kind = [sum(c >= s for s in S.KIND_STARTS[name]) for c in x]
    q, s = sum(a != b for a, b in zip(kind, kind[1:])) / (n - 1), S.SWITCHES[name]
    if q > s:
        log_p += (n - 1) * (q * math.log(q / s) + ((1 - q) * math.log((1 - q) / (1 - s)) if q < 1 else 0)) / math.log(10)
    log_p -= math.log10(1 + log_p * math.log(10))
    up = [c >= k // 2 for c in x]
    high, runs = sum(up), 1 + sum(a != b for a, b in zip(up, up[1:]))
    mu = 2 * high * (n - high) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    mean = sum(x) / n
    square = sum((c - mean) ** 2 for c in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / square if square else None
    chi = max((raw - (k - 1)) / math.sqrt(2 * (k - 1)), 0)
    stat = chi**2 + (((runs - mu) / math.sqrt(var)) if var > 0 else 9.0) ** 2 + (serial**2 if serial is not None else 1.0) * n
    return list(S.ALPHABETS).index(name), stat, log_p


def some_tokens(rng):
    words = ["the", "ra", "tion", "ing", "er", "on", "an", "re", "st", "en", "version", "Node", "Http", "get", "count"]
    plain = ["".join(rng.choices(words[:11], k=rng.randrange(8, 14))) for _ in range(2000)]
    plain += ["".join(w.title() for w in rng.choices(words, k=7)) for _ in range(400)] + ["_".join(rng.choices(words, k=6)) for _ in range(400)]
    plain += ["".join(rng.choices(DIGITS, k=rng.randrange(20, 32))) for _ in range(200)] + [f"release{i:04d}candidate{i % 7}build" for i in range(200)]
    plain += ["".join(rng.choices(["THE", "RA", "TION", "ING", "ER"], k=9)) for _ in range(200)] + ["0" * 24 + f"{i:04x}" for i in range(100)] + ["deadbeef" * 3] * 20
    return [p for p in plain if len(p) >= 20]


@pytest.fixture(scope="module")
def scanned(spark):
    """60 keys of each kind, then tokens that are none; the ids in which the scan finds a key."""
    import random

    from mailgrain.llm.secrets import scan_secrets

    rng = random.Random(8)
    keys = ["".join(rng.choices(a, k=n)) for a, n in KEYS for _ in range(60)]
    rows = [(i, f"see {t} there") for i, t in enumerate(keys + some_tokens(rng))]
    return {r["doc_id"] for r in scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r["spans"]}


@pytest.mark.parametrize("at", range(len(KEYS)))
def test_secret_recall_by_encoding(scanned, at):
    assert sum(60 * at <= i < 60 * (at + 1) for i in scanned) >= 54, KEYS[at]


def test_secret_false_discoveries(scanned):
    assert sum(i >= 60 * len(KEYS) for i in scanned) <= 0.05 * len(scanned)


def test_battery_against_plain_python(spark):
    import random

    from mailgrain.llm import secrets as S

    rng = random.Random(1)
    tokens = some_tokens(rng)[::20] + ["".join(rng.choices(a, k=n)) for a, n in KEYS for _ in range(5)] + ["a" * 30, "Ab" * 12, "ab==", "a-b_c/+Z9" * 3]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", S.randomness(F.col("t")).alias("r")).collect()
    for r in got:
        code, stat, log_p = plain_battery(r["t"])
        assert r["r"]["code"] == code and abs(r["r"]["stat"] - stat) < 1e-6 * max(stat, 1), r["t"]
        assert r["r"]["bin"] in {min(S.BINS, math.floor((log_p + e) / S.BIN)) for e in (-1e-9, 1e-9)}, r["t"]
