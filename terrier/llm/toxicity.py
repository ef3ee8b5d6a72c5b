"""Toxicity by a classifier chain: one linear model for each category, in order, fed with the categories before.

Features of a text are how often it holds certain runs of six bytes, and of five at the start of a word (lower case,
all but letters as one space), as log(1 + count). Which runs, counts over the labelled sample decide: those whose
share among toxic texts differs most from that among others. Each model also gets the probabilities of the categories
before it. In training these are out-of-fold predictions, by models whose runs were chosen without the fold too, so a model sees
how sure the ones before are about texts that they don't know. A text is toxic if the last category's probability reaches the
threshold with the best F1 out of fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.llm.language import Table, grams, seen
from terrier.llm.shared import blobs, in_batches, runs_of_rows, stored

#: Labelled rows of each label that the chain is trained on at most; a hash of doc_id decides which.
SAMPLE_ROWS = 1_500
#: Byte runs that a model reads, and texts of the sample that a run must stand in to be one of them. Neither bounds the rows.
FEATURES = 400
LEAST_ROWS = 5
FOLDS = 4
PENALTY = 2.0
RUN_BYTES = 2 << 20
_START = np.uint64(1 << 62)

# Words that make a toxic text an insult to a person, or one of contempt.
INSULTS = ("idiot", "moron", "loser", "clown", "stupid")
CONTEMPT = ("trash", "scum", "worthless", "pathetic", "disgusting")
CATEGORIES = ("insult", "contempt", "toxic")


def _runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte runs of a run of texts and the row of each."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    six, at = grams(data, starts, 6)
    five, to = grams(data, starts, 5)
    lead = five >> np.uint64(32) == 32
    return np.concatenate((six, five[lead] | _START)), np.concatenate((row[at], row[to[lead]]))


def counted(data: np.ndarray, starts: np.ndarray, table: Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, log(1 + count)) of the features that occur."""
    keys, row = _runs(data, starts)
    found = table.find(keys)
    hit = found >= 0
    pair, times = np.unique(row[hit].astype(np.int64) * n + found[hit], return_counts=True)
    return pair // n, pair % n, np.log1p(times)


def sampled(docs: DataFrame, labels: DataFrame, text: str, rows: int) -> DataFrame:
    """(text, fold, insult, contempt, toxic) of up to ``rows`` labelled rows of each label, those of smallest hash. Equal texts share a fold."""
    said = labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    have = docs.filter(F.col(text).isNotNull()).select("doc_id").distinct()
    known = said.join(have, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.filter("toxic = 0").limit(rows).union(known.filter("toxic = 1").limit(rows))

    def word(ws: tuple[str, ...]) -> Column:
        return ((F.col("toxic") == 1) & F.col("text").rlike(rf"(?i)\b({'|'.join(ws)})\b")).cast("int")

    both = docs.select("doc_id", F.col(text).alias("text")).filter("text is not null").join(F.broadcast(picked), "doc_id")  # 2 x rows ids
    both = both.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # an id that many rows share counts once
    return both.select("text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), word(INSULTS).alias("insult"), word(CONTEMPT).alias("contempt"), "toxic")


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 10) -> np.ndarray:
    """Weights (the intercept last, not penalised) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, penalty), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """The features' keys, a model for each category, and the threshold for the last."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, ys: np.ndarray, fold: np.ndarray, weight: np.ndarray, chosen: dict[int | None, np.ndarray], categories=CATEGORIES):
        """x: features (columns ``keys``) of the sample, ys: a column for each category, weight: how many labelled rows a row stands for,
        chosen: the columns that were chosen without each fold, and under None from all rows."""
        self.categories, self.keys, self.models, self.threshold = categories, keys[chosen[None]], [], np.inf
        before = np.zeros((len(x), 0))
        for c in range(len(categories)):
            y, out = ys[:, c], np.zeros(len(x))
            for f in np.unique(fold):
                rest, own = fold != f, np.column_stack((x[:, chosen[int(f)]], before))
                out[~rest] = chance(own[~rest], fitted(own[rest], y[rest])) if 0 < y[rest].sum() < rest.sum() else y[rest].mean() if rest.any() else 0.0
            self.models.append(fitted(np.column_stack((x[:, chosen[None]], before)), y) if 0 < y.sum() < len(y) else None)
            before = np.column_stack((before, out))
        self.out_of_fold = before
        if len(x) and self.models[-1] is not None:
            order = np.argsort(-out, kind="stable")
            true, wrong = np.cumsum((y * weight)[order]), np.cumsum(((1 - y) * weight)[order])
            f1 = 2 * true / (true + wrong + (y * weight).sum())
            last = np.append(out[order][1:] != out[order][:-1], True)
            best = int(np.argmax(np.where(last, f1, -1)))
            below = out[order][best + 1] if best + 1 < len(out) else 0.0
            self.threshold = float((out[order][best] + below) / 2)
            self.f1 = float(f1[best])

    def judge(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The probability of each category for each of ``rows`` texts."""
        out = np.zeros((rows, len(self.categories)))
        for c, w in enumerate(self.models):
            if w is not None:
                z = np.bincount(row, w[feature] * value, rows) + out[:, :c] @ w[len(self.keys) : len(self.keys) + c] + w[-1]
                out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def trained(sample: DataFrame, ratio: tuple[int, int], features: int = FEATURES) -> Chain:
    """The chain for a written sample; ``ratio``: how many rows are labelled 0 and 1 in all. Runs are counted in tasks; the driver gets the best ``features`` without each fold and of all, and the sample's counts of them."""
    names = sample.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds, toxic = blobs(batch.column(0)), batch.column(1).to_numpy(), batch.column(4).to_numpy()
            for a, b in runs_of_rows(texts, RUN_BYTES):
                keys, row = _runs(*seen(texts.slice(a, b - a)))
                order = np.lexsort((row, keys))
                keys, row = keys[order], row[order]
                first = np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])) if len(keys) else np.zeros(0, bool)
                keys, row = keys[first], row[first]
                fold, yes = folds[a:b][row], toxic[a:b][row]
                order = np.lexsort((fold, keys))
                keys, fold, yes = keys[order], fold[order], yes[order]
                at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (fold[1:] != fold[:-1]))) if len(keys) else np.zeros(0, np.int64)
                n = np.diff(np.append(at, len(keys)))
                n1 = np.add.reduceat(yes.astype(np.int64), at) if len(at) else n
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(fold[at].astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(n1.astype(np.int64))], names=["key", "fold", "n", "n1"])

    rows_in = {r.fold: (r.n, r.n1) for r in sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).collect()}
    counts = in_batches(sample).mapInArrow(count, "key long, fold int, n long, n1 long").groupBy("key").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(FOLDS) for c in ("n", "n1")])
    counts = stored(counts, "runs")
    chosen = {}
    for without in (None, *range(FOLDS)):
        folds = [f for f in range(FOLDS) if f != without]
        n, n1 = (float(sum(rows_in.get(f, (0, 0))[k] for f in folds)) for k in (0, 1))
        sums = counts.select("key", sum((F.col(f"n_{f}") for f in folds), F.lit(0)).alias("n"), sum((F.col(f"n1_{f}") for f in folds), F.lit(0)).alias("n1")).filter(F.col("n") >= LEAST_ROWS)
        share = F.col("n") / F.lit(n or 1.0)
        gap = F.abs(F.col("n1") / F.lit(n1 or 1.0) - (F.col("n") - F.col("n1")) / F.lit(max(n - n1, 1.0)))
        best = sums.withColumn("score", gap / F.sqrt(share * (1 - share) + 1e-6)).orderBy(F.desc("score"), "key").limit(features)
        chosen[without] = np.sort(np.array([r.key for r in best.select("key").collect()], np.int64).view(np.uint64))
    keys = np.unique(np.concatenate(list(chosen.values())))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(keys)
        for batch in batches:
            texts, out = blobs(batch.column(0)), np.zeros((batch.num_rows, len(keys)))
            for a, b in runs_of_rows(texts, RUN_BYTES):
                row, feature, value = counted(*seen(texts.slice(a, b - a)), table, max(len(keys), 1))
                out[a + row, feature] = value
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(out), pa.list_(pa.float64()))], names=[*names[1:], "x"])

    rows = in_batches(sample).mapInArrow(describe, "fold int, insult int, contempt int, toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r.fold, r.toxic, tuple(r.x)))
    x = np.array([r.x for r in rows]).reshape(len(rows), len(keys))
    ys = np.array([[r[c] for c in CATEGORIES] for r in rows], float).reshape(len(rows), len(CATEGORIES))
    toxic = ys[:, -1] == 1
    weight = np.where(toxic, ratio[1] / max(toxic.sum(), 1), ratio[0] / max((~toxic).sum(), 1))
    return Chain(keys, x, ys, np.array([r.fold for r in rows]), weight, {f: np.searchsorted(keys, own) for f, own in chosen.items()})


def chain_of(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> Chain:
    counts = {r.t: r.n for r in labels.filter("doc_id is not null and toxic is not null").groupBy((F.col("toxic") > 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect()}
    return trained(stored(sampled(docs, labels, text, rows), "sample"), (counts.get(0, 0), counts.get(1, 0)))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, p_insult, p_contempt, p_toxic and toxic of every row of ``docs``, learned from ``labels`` (doc_id, toxic).

    A null text and one without a letter has probabilities 0 and isn't toxic; where one of the labels is missing nothing is
    toxic. Unlabelled rows, null labels and labels of no document teach nothing. Repeated rows are judged alike; an empty
    table gives no row; other columns are ignored. Probabilities are rounded to 6 places.
    """
    chain = chain_of(docs, labels, text, rows)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        table = Table(chain.keys)
        for batch in batches:
            texts, found = blobs(batch.column(1)), [np.zeros((0, len(chain.categories)))]
            for a, b in runs_of_rows(texts, RUN_BYTES):
                data, starts = seen(texts.slice(a, b - a))
                p = chain.judge(b - a, *counted(data, starts, table, max(len(chain.keys), 1)))
                p[np.diff(np.concatenate(([0], np.cumsum(data > 39)))[starts]) == 0] = 0.0
                found.append(p)
            p = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.round(p[:, c], 6)) for c in range(p.shape[1])], pa.array(p[:, -1] >= chain.threshold)], names=["doc_id", *[f"p_{c}" for c in chain.categories], "toxic"])

    kept = docs.select("doc_id", F.col(text).alias("text"))
    return in_batches(kept).mapInArrow(work, f"doc_id {kept.dtypes[0][1]}, p_insult double, p_contempt double, p_toxic double, toxic boolean")
