import hashlib
import itertools
import random
import re
import time

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from terrier.llm import decontaminate, queries, shared

DIR = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found, best = words(text), set(), set(), []
        for item, body in items:
            b = words(body)
            n = min(10, len(b))
            item = None if item is None else str(item)
            for j in range(len(b) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[j : j + n]:
                        hit |= set(range(i, i + n))
                        found.add(item)
                        m = n
                        while i + m < len(w) and j + m < len(b) and w[i + m] == b[j + m]:
                            m += 1
                        best.append((-m, i, item is None, item or "", j))
        listed = sorted(x for x in found if x is not None)
        m, i, none, item, j = min(best) if best else (0, None, True, "", None)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit), -m, i, None if none else item, j))
    return sorted(out, key=str)


def cases():
    passage = " ".join(f"w{i}" for i in range(14))
    items = [(1, passage), (2, "Alpha beta"), (10, ""), (9, None), (3, passage.upper()), (4, "x x x x x x x x x x x x"), (5, "été-où; naïve"), (2, "alpha BETA"), (6, "last"), (None, "no id of mine"), (None, passage + " more"), (12, "pre " + passage)]
    docs = [(1, None), (2, ""), (3, "start " + passage + " end"), (4, "w0 w1 w2 w3 w4 w5 w6 w7 w8, w9!"), (5, "say alpha, beta alpha"), (5, "say alpha, beta alpha"), (6, "x " * 30), (7, "Été où Naïve"), (8, "une été où naïve fin"), (9, "the last"), (10, "alphabeta alpha"), (11, passage + " " + passage), (12, " ".join(f"w{i}" for i in range(9))), (13, "beta"), (14, "alpha"), (15, "it has No ID of mine"), (16, "pre " + passage + " more"), (17, "w13 " * 3 + passage[:-4])]
    return docs, items


def test_against_brute_force_in_one_and_many_blocks(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, items int").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (90, 1 << 24):
        got = decontaminate.contamination(d, b, block_bytes=size).collect()
        assert sorted(map(tuple, got), key=str) == plain(docs, items)


def test_given_tables_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = sorted(con.sql(queries.ORACLES["op3_decontaminate"]).fetchall(), key=str)
    assert sorted(map(tuple, queries.QUERIES["op3_decontaminate"](spark, DIR).collect()), key=str) == want
    assert any(r[5] for r in want)


def test_empty_tables_and_removal(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(d, b.limit(0)).collect())
    kept = decontaminate.decontaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(((i, t) for i, t in docs if (i,) in {(r[0],) for r in plain(docs, items) if not r[5]}), key=str)


def test_longest_match_and_place(spark):
    docs, items = cases()
    d, b = spark.createDataFrame([docs[2]], "doc_id long, text string"), spark.createDataFrame(items[:1], "item_id long, text string")
    got = {(r.item_word, r.word, r.n_words) for r in decontaminate.locations(d, b).collect()}
    assert got == {(k, k + 1, 14 - k) for k in range(5)}


def test_suffix_array_holds_all_suffixes_in_order():
    rng = random.Random(5)
    for depth in (1, 3, 10, 40):
        texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(12)]
        w = decontaminate.Words(pa.array(texts, pa.large_binary()))
        key = lambda p: [*w.hash[p : p + min(depth, w.left[p])].tolist()]
        array = decontaminate.suffix_array(w, depth).tolist()
        assert sorted(array) == list(range(len(w.hash))) and all(key(a) <= key(b) for a, b in zip(array, array[1:], strict=False))


def test_random_texts(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "c"]) for _ in range(n))
    items = [(rng.choice([None, *range(8)]), text(rng.choice([2, 5, 11, 14, 20]))) for _ in range(14)]
    docs = [(i, text(rng.randint(0, 50)) + (" " + rng.choice(items)[1] if rng.random() < 0.5 else "") + " " + text(3)) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (100, 1 << 24):
        assert sorted(map(tuple, decontaminate.contamination(d, b, block_bytes=size).collect()), key=str) == plain(docs, items)


def test_items_with_a_common_preamble_and_a_very_long_text(spark):
    preamble = " ".join(f"p{i}" for i in range(12))
    items = [(i, f"{preamble} question {i} of this kind") for i in range(800)]
    body = " ".join([preamble, "filler"] * 2000)
    d = spark.createDataFrame([(1, body), (2, "clean"), (3, f"{preamble} question 77 of this kind and on")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert time.time() - began < 30
    assert (got[1].n_hit, got[1].n_items, got[1].match_words, got[1].match_word, got[1].match_item) == (24_000, 800, 12, 0, "0")
    assert not got[2].contaminated and (got[3].match_words, got[3].match_item, got[3].n_hit) == (17, "77", 17)


def test_texts_reach_python_in_bounded_batches(spark):
    conf, key = spark.conf, shared._BATCH
    had = conf.get(key, None)
    try:
        conf.unset(key)
        docs = spark.range(40).repartition(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"))
        size = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
        rows = [r.n for r in shared.in_batches(docs).mapInArrow(size, "n long").collect()]
        assert sum(rows) == 40 and max(rows) <= shared.BATCH_BYTES // 1_000_000 + 1
        conf.set(key, "2m")
        shared.in_batches(docs)
        assert conf.get(key) == "2m"  # the session's own bound stays
    finally:
        conf.unset(key) if had is None else conf.set(key, had)


def test_a_benchmark_of_megabytes_costs_the_texts_not_the_items():
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(4000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(draw(120)) for _ in range(6000)]
    tests = decontaminate.TestSuffixes([str(i) for i in range(len(items))], [t.encode() for t in items])
    assert sum(map(len, items)) > 3_000_000
    docs = [" ".join([*draw(150), *(items[i * 7].split()[5 : 5 + 9 + i % 5] if i % 3 == 0 else []), *draw(150)]) for i in range(600)]
    began = time.process_time()
    got = decontaminate.shard_hits(pa.array([d.encode() for d in docs], pa.large_binary()), tests)
    assert time.process_time() - began < 5
    windows = {}
    for i, t in enumerate(items):
        w = t.split()
        for j in range(len(w) - 9):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    for d, (n, bits, found, match) in zip(docs, got, strict=True):
        w = d.split()
        hit = [windows.get(tuple(w[j : j + 10])) for j in range(len(w) - 9)]
        assert n == len(w) and set(found) == set().union(*filter(None, hit)) and (bits is None) == (not any(hit))
        if match:
            assert match["words"] == max(sum(1 for _ in run) for k, run in itertools.groupby(hit, bool) if k) + 9
