"""Periodic runs of words by seeds and diagonals.

A run of smallest period q and of ``least`` words and ``repeats`` periods at least agrees with itself q words further over
(repeats - 1) q words: that is the guaranteed overlap on the diagonal of lag q. Lags are taken in classes [a, 1.5 a), each with an
index of k-grams of the overlap that its smallest lag guarantees. Such a gram spans two periods of any lag in the class, so the
next occurrence of a gram of a run is one period on and no nearer (two periods in a stretch that spans both have their greatest
common divisor as a period too): the pairs of neighbouring occurrences hold every run, and a word that stands a thousand times
gives a thousand pairs, not their square. Seeds lie sorted by lag and place; one that continues its diagonal's seed is
covered by that one's extension and suppressed, the others are extended to both sides as far as words agree.

Only words whose shortest gram stands twice in the document are indexed for longer ones. A document is worked on as a whole by
one task: arrays of eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.llm.shared import blobs, in_batches, release, runs_of_rows
from terrier.llm.tokens import Stretches, Tokens, mixed

LEAST, REPEATS = 6, 4
RUN_BYTES = 1 << 20
_ROW = np.uint64(0xA24BAED4963EE407)

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def guaranteed(low: int, beyond: int, least: int = LEAST, repeats: int = REPEATS) -> int:
    """Words that a run with a period from ``low`` up to ``beyond`` shares with itself one period on, at least."""
    turn = least // repeats  # up to here the shortest run has ``least`` words and shares fewer of them the longer its period
    return min(max(least, repeats * q) - q for q in {min(max(x, low), beyond - 1) for x in (low, turn, turn + 1)})


def classes(longest: int, least: int = LEAST, repeats: int = REPEATS) -> Iterator[tuple[int, int, int]]:
    """(smallest lag, first lag beyond, gram) for the periods of runs of up to ``longest`` words."""
    low = 1
    while max(least, repeats * low) <= longest:
        beyond = max(low + 1, -(-3 * low // 2))
        yield low, beyond, guaranteed(low, beyond, least, repeats)
        low = beyond


def neighbours(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending in ``at``) with the same key, each with the next one."""
    order = np.argsort(key, kind="stable")
    sorted_, place = key[order], at[order]
    same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    return place[same], place[same + 1]


def agreeing(hashes: Stretches, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on (or, with ``back``, before them), up to ``most``; by halving."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_] + 1) >> 1
        x, y = (a[open_] - mid, b[open_] - mid) if back else (a[open_], b[open_])
        same = hashes.of(x, mid) == hashes.of(y, mid)
        lo[open_[same]] = mid[same]
        hi[open_[~same]] = mid[~same] - 1
    return lo


def runs(words: Tokens, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of every run, by row, start and period; start counts from the row's first word."""
    if repeats < 4:
        raise ValueError("runs of under four periods aren't told by neighbouring occurrences")
    none = np.zeros(0, np.int64)
    short = guaranteed(1, least + 1, least, repeats)
    at = np.flatnonzero(words.left >= short)
    if not len(at):
        return none, none, none, none
    hashes = Stretches(words.hash)
    salt = words.row.astype(np.uint64) * _ROW
    repeated = np.zeros(len(words.hash) + 1, bool)
    for side in neighbours(mixed(hashes.of(at, short) + salt[at]), at):
        repeated[side] = True
    ends = np.flatnonzero(repeated[:-1] & ~repeated[1:]) + 1
    spots = np.flatnonzero(repeated)
    if not len(spots):
        return none, none, none, none
    reach = ends[np.searchsorted(ends, spots, side="right")] - spots + short - 1  # words from a place on that lie in repeated grams
    reach = np.minimum(reach, words.left[spots])
    found = []
    for low, beyond, gram in classes(int(words.count[words.row[spots]].max()), least, repeats):
        at = spots[reach >= gram]
        here, there = neighbours(mixed(hashes.of(at, gram) + salt[at]), at)
        lag = there - here
        seed = (lag >= low) & (lag < beyond) & (words.row[here] == words.row[there])
        here, lag = here[seed], lag[seed]
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        fresh = np.append(True, (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1))[: len(here)]
        here, lag = here[fresh], lag[fresh]
        first = words.first[words.row[here]]
        start = here - agreeing(hashes, here, here + lag, here - first, True)
        overlap = here - start + agreeing(hashes, here, here + lag, words.left[here] - lag, False)
        long_ = overlap + lag >= np.maximum(least, repeats * lag)
        found.append(np.stack((words.row[here], start - first, overlap + lag, lag))[:, long_])
    all_ = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), np.int64)
    all_ = all_[:, np.lexsort((all_[3], all_[1], all_[0]))]
    return all_[0], all_[1], all_[2], all_[3]


def collapsed(words: Tokens, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Of which words stay: those that no run holds after its first period."""
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, words.first[row] + start + period, 1)
    np.add.at(step, words.first[row] + start + length, -1)
    return np.cumsum(step[:-1]) == 0


def periodic(docs: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and collapsed (the text without what repeats, one space between words) of every row of ``docs``.

    A run is a stretch of words with smallest period q, of ``least`` words and ``repeats`` times q at least, that no neighbouring
    word extends. A null or empty text has no words, no run and an empty collapsed text. Rows are judged one by one, so repeated
    rows and ids alike; an empty table gives no row; a text of any length is read whole; other columns are ignored.
    """
    kept = docs.select("doc_id", F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = blobs(batch.column(1))
            for a, b in runs_of_rows(column, RUN_BYTES):
                words = Tokens(column.slice(a, b - a))
                row, start, length, period = runs(words, least, repeats)
                offsets = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(_RUN))
                own = [batch.column(0).slice(a, b - a), pa.array(words.count, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), words.kept(collapsed(words, row, start, length, period))]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "n_words", "runs", "collapsed"])
        release()

    return in_batches(kept).mapInArrow(work, f"doc_id {kept.dtypes[0][1]}, n_words long, runs {RUNS}, collapsed string")


def strongest(found: Column) -> Column:
    """Of the runs of a row that of greatest exponent (length by period, compared exactly); of several the first by start, then period. Null without runs."""
    return F.reduce(found, F.get(found, 0), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """The rows of ``periodic`` as counts, the strongest run and digests."""
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text of every row, where one text in ten (by a checksum of the id) gets a periodic tail made of its own words: from word a on, its next p words again and again."""
    t, h = F.col(text), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, w = F.expr("_h div 10"), F.col("_w")
    n = F.size("_w").cast("long")
    parts = docs.select("doc_id", t.alias("_t"), h.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("_t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    parts = parts.withColumns({"_n": n, "_a": F.when(n > 0, g % n)}).withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)"))
    a, p, rest = F.col("_a").cast("int"), F.col("_p").cast("int"), (F.col("_n") - F.col("_a")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), (rest / p).cast("int") + 1)), 1, rest)
    return parts.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(F.concat(F.slice(w, 1, a), tail), " ")).otherwise(F.col("_t")).alias("text"))
