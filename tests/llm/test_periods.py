import hashlib
import random
import zlib

import pyarrow as pa

from terrier.llm import periods
from terrier.llm.queries import op12_periods
from terrier.llm.tokens import Tokens

DIR = "/root/testdata/sf0.001"


def plain_runs(w):
    """Every run by its definition: for each period the stretches that agree with themselves one period on."""
    out, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)  # periods ascend: the first is the smallest
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_rebuilt(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def plain_row(doc_id, text):
    w = plain_rebuilt(doc_id, text)
    runs = plain_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def found(texts, **more):
    words = Tokens(pa.array([t.encode() for t in texts], pa.large_binary()))
    out = [[] for _ in texts]
    for r, *run in zip(*(x.tolist() for x in periods.runs(words, **more)), strict=True):
        out[r].append(tuple(run))
    return out


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(8):
            w = []
            while len(w) < rng.randint(0, 90):
                unit = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 12))]
                w += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
            texts.append(" ".join(w))
        assert found(texts) == [plain_runs(t.split()) for t in texts]


def test_nested_and_neighbouring_runs():
    inner = "x x x x x x x y "  # a run of one word inside runs of eight and sixteen
    texts = [inner * 4, inner * 6 + "z " + inner * 5, ("p " * 4 + "q ") * 9, "a b " * 4, "a b " * 3, "w " * 5, "w " * 6]
    assert found(texts) == [plain_runs(t.split()) for t in texts]
    assert found(["w " * 6]) == [[(0, 6, 1)]] and found(["a b " * 3, "w " * 5]) == [[], []]


def test_a_word_that_stands_very_often_is_linear_work():
    assert found(["w " * 400_000, "a b c " * 100_000]) == [[(0, 400_000, 1)], [(0, 300_000, 3)]]


def test_other_limits():
    t = "a b c d " * 5 + "e"
    assert found([t], repeats=5) == [[(0, 20, 4)]] and found([t], repeats=6) == [[]] and found([t], least=21) == [[]]


def test_query_against_the_definition(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, op12_periods(spark, DIR).collect()))
    assert got == sorted(plain_row(*r) for r in docs.collect())
    assert any(r[1] for r in got)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a a a a a a a"), (5, "é é é é é é é"), (None, "b c " * 9), (None, "b c " * 9), (6, "x" * 400_000), (7, "k l m " * 60_000), (8, "one\vtwo\fthree")]
    frame = spark.createDataFrame([(a, b, "n", 1) for a, b in rows], "doc_id long, text string, runs string, _w int")
    got = sorted(map(tuple, periods.digests(periods.periodic(frame)).collect()), key=str)
    want = []
    for i, t in rows:
        if i == 7:
            want.append((7, 1, 0, 180_000, 3, 60_000_000, hashlib.sha256(b"0,180000,3\n").hexdigest(), hashlib.sha256(b"k l m").hexdigest()))
        else:
            w = (t or "").encode().split()
            runs = plain_runs(w)
            r = runs[0] if runs else None
            drop = {j for s, n, q in runs for j in range(s + q, s + n)}
            want.append((i, len(runs), *(r or (None, None, None)), 1000 * r[1] // r[2] if r else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in drop)).hexdigest()))
    assert got == sorted(want, key=str)
    assert {r.collapsed for r in periods.periodic(frame).filter("doc_id = 8").collect()} == {"one two three"}
    assert periods.periodic(frame.limit(0)).count() == 0


def test_planted_tails(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 60))) for i in range(400)] + [(None, "a b"), (23, None), (23, "")]
    got = periods.with_planted_runs(spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, _n int")).collect()
    assert sorted((str(r.doc_id), (r.text or "").encode().split()) for r in got) == sorted((str(i), plain_rebuilt(i, t)) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
