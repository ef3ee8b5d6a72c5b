import hashlib
import random
import re

from terrier.llm import substrings
from terrier.llm.queries import op11_substrings

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width=50):
    """Every row against the definition: the smallest id of every window, then the words that windows of smaller ids cover."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, rank(i)), rank(i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < rank(i):
                gone |= set(range(k, k + width))
        spans = [(a, b) for a in sorted(gone) if a - 1 not in gone for b in [next(x for x in range(a, len(w) + 1) if x not in gone)]]
        out.append((i, len(w), len(gone), spans, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def told(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.removed], r.kept) for r in frame.collect()), key=str)


def test_query_against_the_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op11_substrings(spark, DIR).collect()))
    assert got == sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, _, kept in plain(rows))
    assert any(r[2] for r in got)


def test_passages_over_pieces_and_buckets(spark):
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 40))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))) for _ in range(4)]
        for k in range(3):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((rng.randrange(60) if i % 9 else None, rng.choice([" ", "\n", " \t "]).join(parts)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for width, piece_bytes, bucket_windows in ((8, 1000, 50), (8, 1 << 20, 1 << 20), (1, 300, 1000), (12, 1, 7)):
        got = told(substrings.without_repeats(frame.repartition(5), width=width, piece_bytes=piece_bytes, bucket_windows=bucket_windows))
        assert got == plain(rows, width)


def test_rows(spark):
    long_ = " ".join(f"w{i}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, None), (2, ""), (3, " \n "), (4, passage), (4, passage), (4, "other " + passage), (5, f"ä {passage}\tö"), (None, passage), (None, passage), (7, long_), (8, "head " + long_ + " tail"), (9, "x" * 3_000_000), (-1, " ".join(passage.split()[5:])), (10, "a " * 200)]
    frame = spark.createDataFrame([(a, b, 1, "n") for a, b in rows], "doc_id long, text string, piece int, kept string")
    got = {}
    for r in substrings.without_repeats(frame).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert [(r.n_words, r.n_removed, r.kept) for r in (got[1] + got[2] + got[3])] == [(0, 0, "")] * 3
    assert got[-1][0].n_removed == 0 and got[9][0].kept == "x" * 3_000_000 and got[10][0].n_removed == 0
    # of 55 words the last 50 stand in -1
    assert sorted(r.kept for r in got[4]) == sorted(["p0 p1 p2 p3 p4"] * 2 + ["other p0 p1 p2 p3 p4"])
    assert got[5][0].kept == "ä ö" and {r.n_removed for r in got[None]} == {55}
    assert got[7][0].n_removed == 0 and got[8][0].kept == "head tail" and [tuple(s) for s in got[8][0].removed] == [(1, 60_001)]
    assert substrings.without_repeats(frame.limit(0)).count() == 0
    assert substrings.without_repeats(frame.filter("doc_id = 1")).count() == 1


def test_texts_are_shuffled_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = substrings.without_repeats(spark.read.parquet(f"{DIR}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") == 1 and plan.count("FileScan") == 1
