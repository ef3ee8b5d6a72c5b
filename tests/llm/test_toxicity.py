import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from terrier.llm import toxicity as x

DIR = "/root/testdata/sf0.01"


def test_given_documents(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in x.judged(docs, labels).collect()}
    assert len(got) == docs.count()
    said = {r.doc_id: r.toxic for r in labels.collect()}
    right = [got[i].toxic == bool(t) for i, t in said.items()]
    assert np.mean(right) > 0.95


def test_unlabelled_documents_of_a_made_up_corpus(spark):
    rng = random.Random(6)
    calm = ["garden", "river", "house", "lantern", "meadow", "winter", "bridge", "paper"]
    bad = ["idiot", "scum", "worthless", "moron", "trash"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [rng.choice(calm) for _ in range(60)]
        if toxic:
            for _ in range(6):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), "n", 0.5))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    rows += [(900, None, "n", 0.5), (901, "", "n", 0.5), (902, "12 %%", "n", 0.5), (None, "you idiot, you scum, moron and trash " * 3, "n", 0.5), (904, "river house " * 40_000, "n", 0.5), (0, rows[0][1], "n", 0.5)]
    labels += [(None, 1, 1), (1, None, 1), (5555, 1, 1), (0, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, p_toxic double")
    frame = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = x.judged(docs, frame).collect()
    assert sorted(map(str, got)) == sorted(map(str, x.judged(docs, frame).collect()))
    assert len(got) == len(rows)
    held = {r.doc_id: r for r in got}
    assert np.mean([held[i].toxic == (i % 5 == 0) for i in range(1, 400, 2)]) > 0.98
    assert held[None].toxic and held[None].p_insult > 0.5
    assert not any(held[i].toxic for i in (900, 901, 902, 904))
    assert [held[i].p_toxic for i in (900, 901, 902)] == [0, 0, 0]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxic for r in x.judged(docs, none).collect()] == [False]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.toxic for r in x.judged(docs, one).collect()] == [False]
    assert x.judged(docs.limit(0), one).count() == 0


def test_later_models_are_trained_on_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    x0 = rng.normal(size=(600, 3))
    y0 = (x0[:, 0] > 0).astype(float)
    y1 = ((y0 == 1) & (rng.random(600) < 0.9)).astype(float)
    chain = x.Chain(np.arange(3, dtype=np.uint64), x0, np.column_stack((y0, y0, y1)), np.arange(600) % 4, np.ones(600), dict.fromkeys((None, 0, 1, 2, 3), np.arange(3)))
    assert [len(m) for m in chain.models] == [4, 5, 6]
    rows, cols = np.nonzero(x0)
    p = chain.judge(600, rows, cols, x0[rows, cols])
    assert ((p[:, 2] >= chain.threshold) == (y1 == 1)).mean() > 0.85


def test_chain_against_a_plain_one_whose_columns_are_chosen_without_each_fold():
    rng = np.random.default_rng(4)
    x0, fold = rng.normal(size=(120, 6)), rng.integers(0, 4, 120)
    ys = np.column_stack([(x0[:, k] + 0.3 * rng.normal(size=120) > 0.2).astype(float) for k in (0, 1, 0)])
    chosen = {None: np.array([0, 1, 2]), 0: np.array([0, 3]), 1: np.array([1, 4, 5]), 2: np.array([0, 1]), 3: np.array([2, 5])}
    chain = x.Chain(np.arange(6, dtype=np.uint64), x0, ys, fold, np.ones(120), chosen)

    def plain_fit(a, y):
        w = np.zeros(a.shape[1] + 1)
        a = np.column_stack((a, np.ones(len(a))))
        for _ in range(20_000):  # gradient descent on the ridge loss, the intercept free
            p = 1 / (1 + np.exp(-a @ w))
            w -= 0.02 * (a.T @ (p - y) + np.append(np.full(len(w) - 1, x.PENALTY), 0) * w)
        return w

    before = []
    for c in range(3):
        out = np.zeros(120)
        for f in range(4):
            own = np.column_stack([x0[:, chosen[f]], *before])
            w = plain_fit(own[fold != f], ys[fold != f, c])
            out[fold == f] = 1 / (1 + np.exp(-(own[fold == f] @ w[:-1] + w[-1])))
        assert np.allclose(chain.models[c], plain_fit(np.column_stack([x0[:, :3], *before]), ys[:, c]), atol=1e-3)
        before.append(out)
    assert np.allclose(chain.out_of_fold, np.column_stack(before), atol=1e-4)


def test_labelled_documents_that_trained_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.filter("toxic is not null").collect() if texts.get(r.doc_id)}
    part = lambda i: zlib.crc32(texts[i].encode()) % 2  # noqa: E731  equal texts stay together
    got = {r.doc_id: r.toxic for r in x.judged(docs, labels.filter(F.col("doc_id").isin([i for i in known if part(i)]))).collect()}
    # some labels are noise: what must be caught holds one of the words that make a text toxic
    said = re.compile(rf"(?i)\b({'|'.join(x.INSULTS + x.CONTEMPT)})\b")
    held = [(bool(known[i]), bool(said.search(texts[i])), got[i]) for i in known if not part(i)]
    caught, flagged = sum(g for t, w, g in held if t and w), sum(g for t, _, g in held if not t)
    assert len(held) > 100 and caught >= 0.85 * sum(t and w for t, w, _ in held) and flagged <= 0.02 * sum(not t for t, _, _ in held)
