import math
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from terrier.llm import quality as q
from terrier.llm import queries

DIR = "/root/testdata/sf0.001"


def plain_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def plain_distance(p, r):
    p, r = ([x / max(sum(v), 1.0) for x in v] for v in (p, r))
    total = 0.0
    for a, b in zip(p, r, strict=True):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(total / 2, 0))


def test_odd_rows_against_plain_counts(spark):
    good = "the cat of a house and the garden in spring is green for all that see it " * 2
    texts = [None, "", " \n ", "a b c a b c a", "one\none\n \n one\n#$%", "x " * 100, "aa bb cc\naa bb cc\n\ndd", good * 3, good.upper() * 3, "é " * 70, "w1 w2 w3 w4 w5 w1 w2 w3 w9 w1 w2 w3", "  x y", "ab c\vd\fe", " ".join(f"w{i}" for i in range(3000)) + " w1 w2 w3"]
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], "e", 1) for i, t in enumerate(texts)] + [(3, "a b c a b c a", "xx", "e", 1), (None, "z", "en", "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, classes int")
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.quality(docs).collect()), key=str)
    want = []
    for r in rows:
        c = plain_counts(r[1])
        want.append((r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want, key=str)


def test_distances(spark):
    fill = " ".join(f"{chr(97 + i % 26)}x{chr(97 + i // 26)}" for i in range(60))  # 60 words of three letters, none twice
    texts = [f"the Cat, of 12! {fill}", f"and | and {fill}", "junk 99999 " * 30]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(7, "9 " * 60, "xx")], "doc_id long, text string, lang string")
    # a-z, A-Z, beyond ASCII, digits, symbols, stops, rest; then the, of, and, others
    classes = [[187, 1, 0, 2, 0, 1, 1], [186, 0, 0, 0, 1, 0, 0], [120, 0, 0, 150, 0, 0, 0]]
    words = [[1, 1, 0, 62], [0, 0, 2, 61], [0, 0, 0, 60]]
    got = {r.doc_id: r for r in q.quality(docs).collect()}
    # the third fails the base rules, so its language's sums are those of the first two
    assert [got[i].base_failed for i in (0, 1, 2, 7)] == [False, False, True, True]
    for i in range(3):
        assert got[i].class_distance == pytest.approx(plain_distance(classes[i], [sum(x) for x in zip(*classes[:2], strict=True)]), abs=1e-4)
        assert got[i].word_distance == pytest.approx(plain_distance(words[i], [sum(x) for x in zip(*words[:2], strict=True)]), abs=1e-4)
    assert got[7].class_distance == got[7].word_distance == 0


def test_given_tables_against_sql_and_labels(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    rel = con.sql(queries.ORACLES["op10_quality"])
    got = queries.QUERIES["op10_quality"](spark, DIR)
    assert sorted(rel.columns) == sorted(got.columns)
    want = sorted(rel.select(*got.columns).fetchall())
    assert sorted(map(tuple, got.collect())) == want
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("not base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    assert sum(clean) >= 0.99 * len(clean)


def test_empty_table(spark):
    assert q.quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_other_languages_have_their_own_words(spark):
    common = "и в не на я быть он с что а по это она этот к но они мы весь который".split()
    good = lambda i: " ".join(common[(i + j // 2) % 20] if j % 2 else f"слово{(7 * i + j) % 90}" for j in range(200))
    junk = " ".join(f"слово{j}" for j in range(200))
    rows = [(100 * k + i, good(i), lang) for k, lang in enumerate(("ru", None)) for i in range(60)]
    rows += [(901, junk, "ru"), (902, junk, None), (903, "раз два", "xx"), (904, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in q.quality(docs).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if not r.kept} == {901, 902, 903, 904}
    assert min(got[i].word_distance for i in (901, 902)) > q.MOST_WORD_DISTANCE
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang"), map(list, zip(*rows, strict=True)), strict=True))))
    told = con.sql(queries.ORACLES["op10_quality"])
    assert sorted(told.select(*q.quality(docs).columns).fetchall()) == sorted(map(tuple, got.values()))
    assert not got[901].base_failed and got[903].word_distance == got[904].word_distance == 0
    for k, lang in ((901, "ru"), (902, None)):
        own = [t.split() for _, t, x in rows if x == lang]
        top = [w for w, _ in sorted(Counter(w for t in own for w in t).items(), key=lambda x: (-x[1], x[0]))[:20]]
        lists = [[t.count(w) for w in top] + [sum(w not in top for w in t)] for t in own]
        passed = [x for x, (i, _, y) in zip(lists, [r for r in rows if r[2] == lang], strict=True) if not got[i].base_failed]
        assert got[k].word_distance == pytest.approx(plain_distance(lists[-1], [sum(x) for x in zip(*passed, strict=True)]), abs=1e-4)
