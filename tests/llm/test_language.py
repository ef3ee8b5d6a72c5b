import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrier.llm import language

DIR = "/root/testdata/sf0.01"


def plain_seen(text):
    out = b" "
    for c in (text or "").encode().decode("utf-8"):
        if c.isascii():
            b = c.lower().encode() if c.isalpha() or c == "'" else b" "
        else:
            b = (c.lower() if "À" <= c <= "Þ" and c != "×" else c).encode()
        if b != b" " or out[-1:] != b" " or len(out) == 0:
            out += b
    return out


def plain_trees(texts, order):
    trees = [dict() for _ in range(order + 1)]
    for t in texts:
        b = plain_seen(t)
        for k in range(order + 1):
            for i in range(k, len(b)):
                trees[k].setdefault(b[i - k : i], Counter())[b[i]] += 1
    return trees


def plain_bits(trees, text):
    b, total = plain_seen(text), 0.0
    for i in range(1, len(b)):
        for k in range(len(trees) - 1, -1, -1):
            if k > i:
                continue
            seen = trees[k].get(b[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if seen[b[i]]:
                total -= math.log2(seen[b[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8.0
    return total


def test_code_lengths_against_plain_trees(spark):
    train = {"aa": ["the cat sat on the mat", "a theme, THE end. Éa É", "12 x"], "bb": ["le chat é sur la mère", "œuvre d'été", "le"], "cc": ["zzz"]}
    rows = [(t, lang) for lang, ts in train.items() for t in ts]
    model = language.trained(spark.createDataFrame(rows, "text string, lang string"))
    tests = ["the mother", "la mère ÉTÉ", "", "a", "zz the é", "日本語 text", "1234 !!", "THE   CAT\n\nsat", "d'où × ×"]
    data, starts = language.seen(pa.array([t.encode() for t in tests], pa.large_binary()))
    got = model.code_lengths(data, starts)
    for step in (1, 20, 33):
        assert model.code_lengths(data, starts, step) == pytest.approx(got, abs=1e-6)
    assert model.languages == ["aa", "bb", "cc"]
    for t, bits in zip(tests, got, strict=True):
        assert list(bits) == pytest.approx([plain_bits(plain_trees(train[x], language.ORDER), t) for x in model.languages], abs=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 100
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, "the cat", "en", "x"), (2, "le chat", "fr", "x"), (3, None, "en", "x"), (4, "12 34", "en", "x"), (None, "the", None, "x"), (1, "the cat", "en", "x"), (6, "", None, "x"), (7, "Ж", None, "x"), (8, "the " * 50000, None, "x"), (9, "² ½ Ⅷ ①", None, "x"), (10, "½ ñ", None, "x")]
    got = language.languages(spark.createDataFrame(rows, schema))
    found = sorted(((r.doc_id, r.lang_pred) for r in got.collect()), key=str)
    assert len(found) == len(rows)
    assert {i for i, x in found if x == "und"} == {3, 4, 6, 9}
    assert dict(found)[8] == "en"
    assert language.languages(spark.createDataFrame([], schema)).count() == 0
    unlabelled = language.languages(spark.createDataFrame([(1, "the cat", None, "")], schema)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    rows = []
    for i in range(210):
        letters = [chr(0x4E00 + 40 * i + j) for j in range(12)]  # each language has letters of its own
        text = lambda: " ".join("".join(rng.choices(letters, k=4)) for _ in range(12))
        rows += [(1000 * i + j, text(), f"l{i:03}") for j in range(8 if i < 200 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    assert len(got) == len(rows)
    assert [i for i, _, lang in rows if got[i].lang_pred != lang] == []
    # groups summed up one by one agree with all code lengths at once
    model = language.trained(docs.select("text", "lang"))
    data, starts = language.seen(pa.array([t.encode() for _, t, _ in rows[::100]], pa.large_binary()))
    bits, (best, least, score) = model.code_lengths(data, starts), model.best(data, starts)
    assert len(model.languages) == bits.shape[1] == 210 and list(best) == list(bits.argmin(axis=1)) and list(least) == list(bits.min(axis=1))
    assert list(score) == pytest.approx([1 / sum(2 ** max(min(b) - x, -1000) for x in b) for b in bits.tolist()])


def test_a_language_is_sampled_by_bytes_too(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_BYTES", 1000)
    docs = spark.createDataFrame([(i, "word " * 60, "en") for i in range(40)] + [(100, "mot " * 9000, "fr")], "doc_id long, text string, lang string")
    got = {r.lang: r.n for r in language.sampled(docs, "text", "lang", 400).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert got == {"en": 4, "fr": 1}  # 300 bytes each; the one long text of a language is taken whole
