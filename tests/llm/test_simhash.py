import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from terrier.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, fps):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r), r)
    return [least[find(i)] for i in range(len(rows))]


def test_documents_with_odd_rows_against_brute_force(spark):
    base = " ".join(f"word{i}" for i in range(200))
    texts = [None, "", " \t\n", "one two", "One  two", base, base.upper(), base.replace("word7 ", "wordx "), base + " end", "Ünï " * 9, base, "a b c d"]
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)] + [(89, base, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components([r[0] for r in rows], fps)
    assert got == sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], plain_components([r.doc_id for r in rows], fps), strict=True))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want


def test_lists_beyond_the_limit_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    while len(fps) < 400:
        x = centre
        for b in rng.integers(0, 64, 3):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    ids = list(range(len(fps)))
    prints = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in zip(ids, fps, strict=True)], "doc_id long, fp long")
    want = dict(zip(ids, plain_components(ids, fps), strict=True))
    for limit in (4, 8, 64, 4096):
        assert {r.doc_id: r.component_id for r in simhash.grouped(prints, limit).collect()} == want


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "x y"), (4, "x y"), (None, "lone text")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).orderBy(F.col("doc_id").asc_nulls_last(), "component_id").collect()]
    assert got == [(4, 4), (None, None), (None, 4)]


def test_any_four_positions_hold_a_posted_set():
    assert len(simhash.SETS) == 20
    for four in combinations(range(8), 4):
        assert any(set(three) <= set(four) for three in simhash.POSTED)
    # and of what is open after three or four bytes, a finer set
    for mask in simhash.SETS:
        assert len(simhash._finer(mask)) == 5 and all(m.bit_count() == 32 and len(simhash._finer(m)) == 70 for m in simhash._finer(mask))


def test_the_tally_drops_pairs_and_the_bits_the_rest():
    a = 0x1122334455667788
    near, three_bytes, four_bytes = a ^ 0x0101010100000000, a ^ 0x1F1F1F1F1F000000, a ^ 0xFF00FF0300000000
    fps = np.array([a, near, three_bytes, four_bytes], np.uint64)
    assert simhash.tallied(np.repeat(fps[:1], 4), fps).tolist() == [8, 4, 3, 5]
    left, right = simhash._linked(np.zeros(4, np.int64), fps)
    assert (left.tolist(), right.tolist()) == ([near], [a])
    # in lists of random fingerprints that share three bytes nearly every pair falls short of the tally
    rng = np.random.default_rng(0)
    own = (rng.integers(0, 1 << 62, 300).astype(np.uint64) << np.uint64(24)) | np.uint64(0x778899)
    i, j = np.triu_indices(300, 1)
    assert (simhash.tallied(own[i], own[j]) >= simhash.MIN_SHARED).mean() < 0.05


def test_lists_broken_off_by_batches():
    rng = np.random.default_rng(2)
    centre, mask = np.uint64(0x0123456789ABCDEF), np.uint64(simhash.SETS[0])
    fps = np.sort(np.unique(centre ^ (np.uint64(1) << rng.integers(24, 64, 40).astype(np.uint64))))
    rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), mask).view(np.int64)), pa.array(fps.view(np.int64))], names=["mask", "fp"])
    edges = lambda size: {(r["a"], r["b"]) for out in simhash._scan_lists(rows.slice(i, size) for i in range(0, len(fps), size)) for r in out.to_pylist()}
    assert edges(3) == edges(len(fps)) and len(edges(3)) == len(fps) - 1


def test_a_very_long_text_against_the_plain_fingerprint(spark):
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    got = simhash.near_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.fingerprint == f"{plain_fingerprint(text):016x}"


def test_a_list_of_the_last_level_takes_work_by_members_not_pairs():
    mask = next(m for m in range(1, 1 << 16) if m.bit_count() == 12)
    mask = sum(15 << (4 * u) for u in range(16) if mask >> u & 1)
    open_units = [u for u in range(16) if not mask >> (4 * u) & 15]
    spread = lambda v: sum((v >> (4 * k) & 15) << (4 * u) for k, u in enumerate(open_units)) | (0x123456789ABCDEF & mask)
    rng = random.Random(3)
    for n in (2, 40, 300):
        fps = np.array([spread(v) for v in rng.sample(range(1 << 16), n)], np.uint64)
        group = lambda pair: simhash._joined(np.arange(len(fps)), np.searchsorted(np.sort(fps), pair[0]), np.searchsorted(np.sort(fps), pair[1])).tolist()
        assert group(simhash._linked_by_table(mask, fps)) == group(simhash._linked(np.zeros(len(fps), np.int64), fps))
    # codes that are five bits apart at least: many groups of one
    code = []
    for v in range(1 << 16):
        if all((v ^ c).bit_count() > 4 for c in code):
            code.append(v)
    assert len(simhash._linked_by_table(mask, np.array([spread(v) for v in code], np.uint64))[0]) == 0
    fps = np.array([spread(v) for v in range(1 << 16)], np.uint64)
    began = time.process_time()
    a, b = simhash._linked_by_table(mask, fps)
    assert time.process_time() - began < 2 and len(a) == (1 << 16) - 1 and set(b.tolist()) == {int(fps[0])}
    # the worst: half of all values, so that few labels are alike until late
    some = fps[np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) % 2 == 0]
    began = time.process_time()
    assert len(simhash._linked_by_table(mask, some)[0]) == (1 << 15) - 1 and time.process_time() - began < 2


def test_long_lists_of_the_last_level_are_scanned_by_table(spark):
    base = 0x0F1E2D3C4B5A6978
    fps = [base ^ v for v in range(4096)]
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    star = {r.node for r in simhash.components(simhash.links(frame, 8)).collect()}
    assert len(star) == 4095
