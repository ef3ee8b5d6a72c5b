import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrier.llm import mixing, prefix, sharding

DIR = "/root/testdata/sf0.001"


def plain_shards(rows, n):
    rows = sorted(((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, out, slots = sum(r[2] for r in rows), 0, [], {}
    for i, crc, size in rows:
        shard = (2 * before + size) * n // (2 * total)
        out.append((i, size, crc, "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


def test_shards_of_odd_rows(spark):
    rows = [(3, "abc"), (1, None), (2, ""), (3, "abc"), (None, "é" * 40), (5, "long " * 200), (4, "x"), *[(7, "same")] * 60]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard string")
    assert sorted(map(tuple, sharding.shards(docs).collect()), key=str) == plain_shards(rows, 8)
    assert sharding.shards(docs.limit(0)).count() == 0


def test_shards_of_given_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, sharding.shards(docs).collect()), key=str) == plain_shards(rows, 8)


def test_prefix_sums(spark):
    table = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") % 5).alias("x")).repartition(6)
    path = "file:///tmp/spark-prefix-" + __import__("uuid").uuid4().hex
    table.write.parquet(path)
    got = prefix.with_prefix(spark.read.parquet(path), [F.col("k")], {"before": "x"}, parts=5).orderBy("row_index").collect()
    total = 0
    for n, r in enumerate(got):
        assert (r.row_index, r.before) == (n, total)
        total += r.x
    assert [r.k for r in got] == sorted(r.k for r in got) and got[0].before_total == total


def plain_targets(sizes):
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ranked)}
    left, target, todo = float(sum(sizes.values())), {}, set(ranked)
    while todo:
        level = left / sum(w[s] for s in todo)
        full = {s for s in todo if w[s] * level >= 3 * sizes[s]}
        if not full:
            target |= {s: w[s] * level for s in todo}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        todo -= full
    return target


@pytest.mark.parametrize("kind", ["given", "odd"])
def test_mix_meets_targets(spark, kind):
    if kind == "given":
        docs = spark.read.parquet(f"{DIR}/documents.parquet")
    else:
        rng = np.random.default_rng(3)
        rows = [(i, "word " * int(rng.integers(0, 200)), ["b", "a", "é", None, "B", "zz"][int(rng.integers(0, 6))], 1) for i in range(120)]
        rows += [(205, None, "a", 1), (206, "", "empty", 2), (207, "a b c", "tiny", 2), (207, "a b c", "tiny", 2), (None, "one two", None, 3)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    per = {}
    by_id = {}
    for r in docs.collect():
        per[r.source] = per.get(r.source, 0) + len((r.text or "").split())
        by_id[r.doc_id] = r.source
    want = plain_targets(per)
    taken = {}
    assert len(got) == docs.count()
    for r in got:
        source = by_id[r.doc_id]
        assert r.target == pytest.approx(want[source]) and r.taken <= 3 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= mixing.BLOCK_WORDS
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    out = texts.groupBy("source").agg(F.sum(F.size(F.expr("filter(split(text, ' |\\n|\\t'), x -> x <> '')"))).alias("n")).collect()
    assert {r.source: r.n for r in out} == {s: n for s, n in taken.items() if n}


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


def plain_draws(rows, block, slots, group):
    """Sizes of (doc_id, text, source) rows, and for each word that the mix takes (row, place of the word, epoch, shard), by plain loops over draws in order."""
    sizes = [len((t or "").split()) for _, t, _ in rows]
    per = {}
    for (_, _, s), n in zip(rows, sizes, strict=True):
        per[s] = per.get(s, 0) + n
    target, names = plain_targets(per), sorted(per, key=lambda s: (s is None, s or ""))
    blocks = {i: -(-per[s] // block) for i, s in enumerate(names) if per[s]}
    want = {}
    for i, b in blocks.items():
        n, t = per[names[i]], target[names[i]]
        want[i] = int(t // n) * b + math.floor((t - (t // n) * n) * b / n + 0.5)
    order, total = sorted(i for i in want if want[i]), sum(want.values())
    dealt = []
    for shard in range(-(-total // slots)):
        parts = sorted({i // group for i in order})
        members = [[i for i in order if i // group == p] for p in parts]
        sums = [sum(want[i] for i in m) for m in members]
        outer = np.random.default_rng([mixing.SEED, shard]).multinomial(min(slots, total - shard * slots), np.array(sums, float) / total)
        for p, m, k in zip(parts, members, outer, strict=True):
            if k:
                w = np.array([want[i] for i in m], float)
                inner = np.random.default_rng([mixing.SEED, shard, p]).multinomial(k, w / w.sum())
                dealt += [(i, shard) for i, c in zip(m, inner, strict=True) for _ in range(c)]
    dealt.sort()
    number, final, spare = {i: 0 for i in blocks}, [], []
    for i, shard in dealt:
        if number[i] < want[i]:
            final.append((i, number[i], shard))
            number[i] += 1
        else:
            spare.append(shard)
    for i in sorted(blocks):
        while number[i] < want[i]:
            final.append((i, number[i], spare.pop(0)))
            number[i] += 1
    assert not spare
    laid = {i: [] for i in blocks}
    for at in sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, sizes[r])):
        if sizes[at]:
            laid[names.index(rows[at][2])] += [(at, k) for k in range(sizes[at])]
    words = []
    for i, k, shard in final:
        epoch = k // blocks[i]
        b = int(mixing.permuted(np.array([k % blocks[i]]), blocks[i], mixing._key(mixing.SEED, i, epoch))[0])
        words += [(at, place, epoch, shard) for at, place in laid[i][b * block : (b + 1) * block]]
    return sizes, words


def plain_mix(rows, block, slots, group):
    """(doc_id, size, taken, first_shard) of the rows."""
    sizes, words = plain_draws(rows, block, slots, group)
    taken, first = [0] * len(rows), [None] * len(rows)
    for at, _, _, shard in words:
        taken[at] += 1
        first[at] = shard if first[at] is None else min(first[at], shard)
    return sorted(((r[0], n, t, f) for r, n, t, f in zip(rows, sizes, taken, first, strict=True)), key=str)


def test_taken_words_against_plain_loops_in_any_order(spark, monkeypatch):
    rng = np.random.default_rng(8)
    names = ["b", "a", "é", None, "B", "zz", "tiny"]
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(int(rng.integers(0, 40)))), names[int(rng.integers(0, 6))]) for i in range(90)]
    rows += [(200, None, "a"), (201, "one two three", "tiny"), (None, "no id here", "a"), (3, "a second text with the id three", "a"), (300, "x " * 9000, "b")]
    for group, own in ((4096, rows), (3, rows[::-1])):
        monkeypatch.setattr(mixing, "SOURCE_GROUP", group)
        docs = spark.createDataFrame(own, "doc_id long, text string, source string")
        got = mixing.mix(docs, block_words=4, n_slots=50).collect()
        assert sorted(((r.doc_id, r.size, r.taken, r.first_shard) for r in got), key=str) == plain_mix(rows, 4, 50, group)
    shares = mixing.shard_mix(docs, block_words=4, n_slots=50).groupBy("shard").agg(F.sum("blocks").alias("n")).orderBy("shard").collect()
    assert {r.n for r in shares[:-1]} == {50} and [r.shard for r in shares] == list(range(len(shares))) and 0 < shares[-1].n <= 50
    mixed = mixing.shard_mix(docs, block_words=4, n_slots=50).groupBy("shard").count()
    assert mixed.filter("count > 1").count() > len(shares) // 2


def test_texts_that_tie_take_the_same_in_any_order(spark):
    rows = [(1, f"w{i} " * 8, "a") for i in range(11)] + [(1, "same " * 8, "a")] * 3 + [(2, f"v{i} " * 8, "b") for i in range(11)]
    took = []
    for own in (rows, rows[::-1]):
        docs = spark.createDataFrame(own, "doc_id long, text string, source string")
        took.append(sorted((r.text, r.n) for r in mixing.mixed_documents(docs, block_words=5, n_slots=7).groupBy("text").agg(F.count("*").alias("n")).collect()))
    assert took[0] == took[1]
