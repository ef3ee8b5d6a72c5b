import zlib

import corpus_pipeline as cp
from terrier.llm import language, mixing, sharding
from terrier.llm.shared import stored
from tests.llm import test_decontaminate, test_language, test_sharding_mixing, test_simhash

DIR = "/root/testdata/sf0.001"


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(cp.STAGES):
        before, docs = docs, stored(stage(spark, docs, DIR), "stage")
        if i + 1 < len(cp.STAGES):
            assert docs.columns == names
        if i < 3:
            assert docs.join(before, names, "left_anti").count() == 0
            assert docs.count() >= 0.7 * before.count()
    mixed = before
    assert docs.count() == mixed.count()


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, fp string"
    good = "the house and the garden of a friend in the town near the river with a bridge"
    rows = [(5, good, "en", "a", 77, "x", 1, "y"), (3, good, "en", "a", 77, "x", 1, "y"), (3, good, "en", "a", 77, "x", 1, "y"), (None, good + " more words here and there", "en", None, 9, "x", 1, "y"), (7, None, "en", "b", 0, None, None, None), (8, "12 34", None, "b", 5, "x", 1, "y"), (9, "quite another text about the town and its people", None, "b", 5, "x", 1, "y")]
    docs = stored(spark.createDataFrame(rows, schema), "odd")
    told = stored(cp.language_id(spark, docs, DIR), "stage")
    assert told.columns == docs.columns and told.count() == 5
    kept = stored(cp.near_duplicates(spark, told, DIR), "stage")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 9), (True, 0)]
    clean = stored(cp.decontamination(spark, kept, DIR), "stage")
    assert clean.count() == 3
    mixed = stored(cp.source_mix(spark, clean, DIR), "stage")
    assert mixed.columns == docs.columns
    assert cp.shard(spark, mixed, DIR).count() == mixed.count()
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, DIR).count() == 0


def plain_run(rows, items):
    """The rows of ``run`` over (doc_id, text, lang, source), stage by stage, by the plain versions of the operators' tests."""
    train = {}
    for i, t, lang, _ in rows:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            train.setdefault(lang, []).append(t)
    trees = [test_language.plain_trees(train[x], language.ORDER) for x in sorted(train)]
    kept = []
    for r in rows:
        if any(c.isalpha() for c in r[1] or ""):
            bits = [test_language.plain_bits(t, r[1]) for t in trees]
            share = 1 / sum(2.0 ** (min(bits) - b) if b - min(bits) < 900 else 0 for b in bits)
            if min(bits) / (len(test_language.plain_seen(r[1])) - 1) <= cp.MOST_BITS_PER_BYTE and share >= cp.LEAST_SCORE:
                kept.append(r)
    told = len(kept)
    group = test_simhash.plain_components([r[0] for r in kept], [test_simhash.plain_fingerprint(r[1]) for r in kept])
    kept = [r for r, g in zip(kept, group, strict=True) if r[0] == g]
    single = len(kept)
    hit = {r[0] for r in test_decontaminate.plain([(r[0], r[1]) for r in kept], items) if r[5]}
    kept = [r for r in kept if r[0] not in hit]
    triples = [(r[0], r[1], r[3]) for r in kept]
    sizes, words = test_sharding_mixing.plain_draws(triples, mixing.BLOCK_WORDS, mixing.SHARD_SLOTS, mixing.SOURCE_GROUP)
    parts = {}
    for at, place, epoch, _ in words:
        parts.setdefault((at, epoch), []).append(place)
    mixed = []
    for (at, _), places in parts.items():
        text = triples[at][1]
        mixed.append((triples[at][0], text if len(places) == sizes[at] else " ".join(text.split()[p] for p in sorted(places))))
    return sorted(test_sharding_mixing.plain_shards(mixed, sharding.SHARDS), key=str), (len(rows), told, single, len(kept))


def test_run_against_plain_versions_of_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect() if len(r.text or "") < 3000][:110]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").limit(20).collect()]
    body = rows[0][1].split()
    rows += [(5001, None, "en", "x"), (5002, "12 34", None, None), (5003, " ".join([*body, "end"]), rows[0][2], "zz"), (5004, rows[1][1] + " " + items[3][1], rows[1][2], None), (5005, rows[2][1], rows[2][2], rows[2][3]), (5006, items[5][1], None, "zz")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    want, counts = plain_run(rows, items)
    assert counts[0] > counts[1] > counts[2] > counts[3] > 80  # every stage has something to do
    got = cp.run(spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got), key=str) == want
