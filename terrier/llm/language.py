"""Language ID by prediction by partial matching over bytes.

For each language a context tree of bytes up to ``ORDER`` is counted on labelled text and then frozen. A byte is
coded in its longest known context; if it was never seen there, an escape is coded and the context loses its
first byte (PPM, escape method C, no exclusions; below order 0 all bytes are alike). The language in which a
whole text has the shortest exact code wins.

The trees of all languages are merged into one table for each order: for a (context, byte) that any language has
seen, the code lengths in all languages, escapes included. A byte is looked up in the longest order first, so most
bytes cost one lookup. Many languages are merged ``GROUP`` by ``GROUP``, so that tables grow with the languages
and not with their square; a language's code doesn't depend on which others it is merged with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrier.llm.shared import blobs, flat, in_batches, release, runs_of_rows, stored

#: Bytes of context.
ORDER = 4
#: Most labelled rows of a language that the trees are counted on; which ones, a hash of doc_id decides.
SAMPLE_ROWS = 400
#: Rows of all languages together: with more languages than ten, each has fewer, but ``LEAST_ROWS`` or what it has.
SAMPLE_TOTAL, LEAST_ROWS = 4_000, 20
#: Bytes of text after which no more rows of a language are taken; its trees can't outgrow them by more than one text.
SAMPLE_BYTES = 4 << 20
#: Languages whose trees are merged into one table, and groups that a worker holds at once.
GROUP, HELD_GROUPS = 8, 4
#: Sampled ids up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000
RUN_BYTES = 1 << 20
#: Code lengths (bytes times languages) that are held at once.
STEP_CELLS = 2 << 20
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes as the model sees them: lower case, and one space for all that is neither a letter nor a byte of one.
_SEEN = np.full(256, 32, np.uint8)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[39] = 39
_SEEN[128:] = np.arange(128, 256)


def seen(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The model's bytes of all rows, each row led by a space, and where each row starts (and the end)."""
    data, offsets = flat(column)
    rows = len(column)
    out = np.insert(_SEEN[data], offsets[:-1], 32) if rows else _SEEN[data]
    starts = offsets + np.arange(rows + 1)
    upper = np.flatnonzero(out[:-1] == 0xC3) + 1  # Latin-1 capitals of two bytes
    out[upper] = np.where((out[upper] >= 0x80) & (out[upper] <= 0x9E) & (out[upper] != 0x97), out[upper] + 0x20, out[upper])
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[starts[:-1]] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], at[starts]


def grams(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs of ``size`` that lie within a row, packed into integers, and the place of each one's last byte."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = data[:n].astype(np.uint64)
    for k in range(1, size):
        packed = packed << np.uint64(8) | data[k : n + k]
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = row[:n] == row[size - 1 :]
    return packed[inside], np.flatnonzero(inside) + size - 1


class Table:
    """From packed byte runs to rows, by hashing into slots; what finds its slot taken goes to the next level."""

    def __init__(self, keys: np.ndarray):
        self.levels, left = [], np.arange(len(keys))
        while len(left):
            bits = max(4, int(len(left) * 2).bit_length())
            mult = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * len(self.levels) & (1 << 64) - 1 | 1)
            slot = self._slot(keys[left], mult, bits)
            held, rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            rows[slot] = left
            mine = rows[slot] == left
            held[slot[mine]] = keys[left[mine]]
            self.levels.append((mult, bits, held, rows))
            left = left[~mine]

    @staticmethod
    def _slot(keys, mult, bits):
        with np.errstate(over="ignore"):
            return (keys * mult >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        out, todo = np.full(len(keys), -1, np.int32), None
        for mult, bits, held, rows in self.levels:
            own = keys if todo is None else keys[todo]
            slot = self._slot(own, mult, bits)
            got = np.where(held[slot] == own, rows[slot], -1)
            if todo is None:
                out = got
                todo = np.flatnonzero((got < 0) & (rows[slot] >= 0))
            else:
                out[todo] = got
                todo = todo[(got < 0) & (rows[slot] >= 0)]
            if not len(todo):
                break
        return out


class Model:
    """Frozen trees of several languages. ``counts``: for each language and order, the byte runs and how often each occurred."""

    def __init__(self, languages: list[str], counts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.languages, self.order = languages, order
        n = len(languages)
        self.runs, self.bits, self.contexts, self.escapes = {}, {}, {}, {}
        below_keys, below = np.arange(256, dtype=np.uint64), np.full((256, n), 8.0)
        for k in range(order + 1):
            keys = np.unique(np.concatenate([counts[i, k][0] for i in range(n)])) if n else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            times = np.zeros((len(keys), n))
            for i in range(n):
                times[np.searchsorted(keys, counts[i, k][0]), i] = counts[i, k][1]
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            total, distinct = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, of, times)
            np.add.at(distinct, of, times > 0)
            known = total > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(known, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(times / (total + distinct)[of])
            # one byte less of context; its run is known if any language knows it, else what it costs is found from below
            shorter = keys & np.uint64((1 << (8 * max(k, 1))) - 1)
            place = np.minimum(np.searchsorted(below_keys, shorter), len(below_keys) - 1)
            lower = below[place]
            bits = np.where(times > 0, own, escape[of] + lower)
            self.runs[k], self.bits[k] = Table(keys), bits.astype(np.float32)
            self.contexts[k], self.escapes[k] = Table(contexts), escape.astype(np.float32)
            below_keys, below = keys, bits
        self.fallback = np.float32(8.0)

    def code_lengths(self, data: np.ndarray, starts: np.ndarray, step: int = STEP_CELLS) -> np.ndarray:
        """Bits of each row in each language; the leading space of a row is context only. Long rows are coded piece by piece."""
        n = len(self.languages)
        step = max(self.order + 1, step // max(n, 1))
        total = np.zeros((len(starts) - 1, n))
        for a in range(0, len(data), step):
            lo, hi = max(0, a - self.order), min(len(data), a + step)
            own = np.clip(starts - lo, 0, hi - lo)
            open_ = np.arange(lo, hi) >= a
            first = starts[:-1][np.diff(starts) > 0]
            open_[first[(first >= a) & (first < hi)] - lo] = False
            cost = self._costs(data[lo:hi], own, open_)
            sums = np.concatenate((np.zeros((1, n)), np.cumsum(cost, axis=0, dtype=np.float64)))
            total += sums[own[1:]] - sums[own[:-1]]
        return total

    def _costs(self, data: np.ndarray, starts: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Bits of each byte that is open."""
        cost = np.zeros((len(data), len(self.languages)), np.float32)
        for k in range(self.order, -1, -1):
            packed, at = grams(data, starts, k + 1)
            own = open_[at]
            packed, at = packed[own], at[own]
            row = self.runs[k].find(packed)
            hit = row >= 0
            cost[at[hit]] += self.bits[k][row[hit]]
            open_[at[hit]] = False
            miss = ~hit
            if miss.any():
                context = self.contexts[k].find(packed[miss] >> np.uint64(8))
                known = context >= 0
                cost[at[miss][known]] += self.escapes[k][context[known]]
        cost[open_] += self.fallback
        return cost


class Models:
    """The models of all languages, a broadcast for each group of them in order of name."""

    def __init__(self, languages: list[str], groups: list[Broadcast]):
        self.languages, self.groups = languages, groups

    def each(self) -> Iterator[Model]:
        for group in self.groups:
            yield group.value
            if len(self.groups) > HELD_GROUPS:
                group.__dict__.pop("_value", None)  # else the worker would keep all groups; it is read again from its file

    def code_lengths(self, data: np.ndarray, starts: np.ndarray, step: int = STEP_CELLS) -> np.ndarray:
        """Bits of each row in each language."""
        return np.concatenate([np.zeros((len(starts) - 1, 0)), *[m.code_lengths(data, starts, step) for m in self.each()]], axis=1)

    def best(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language of the shortest code of each row, its bits and its share of probability; groups are summed up one by one."""
        rows = len(starts) - 1
        at, least, total, first = np.zeros(rows, np.int64), np.full(rows, np.inf), np.zeros(rows), 0
        for model in self.each():
            bits = model.code_lengths(data, starts)
            own = bits.min(axis=1)
            at = np.where(own < least, first + bits.argmin(axis=1), at)
            now = np.minimum(least, own)
            total = total * np.exp2(np.maximum(now - least, -1000)) + np.exp2(np.maximum(now[:, None] - bits, -1000)).sum(axis=1)
            least, first = now, first + len(model.languages)
        return at, least, 1 / total


def sampled(docs: DataFrame, text: str, lang: str, rows: int) -> DataFrame:
    """Up to ``rows`` labelled rows and about ``SAMPLE_BYTES`` of each language, those of smallest hash; ids first, then the texts of these ids.

    A language's count says below which hash twice ``rows`` are to be expected, so few more than are wanted are ranked
    in one place, however many the language has.
    """
    ids = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select("doc_id", F.col(lang).alias("lang"), F.xxhash64("doc_id").alias("h")).distinct()
    counts = stored(ids.groupBy("lang").count(), "languages")
    n_languages = counts.count()
    rows = min(rows, max(LEAST_ROWS, SAMPLE_TOTAL // max(n_languages, 1)))
    shares = counts.select("lang", F.least(F.lit(1.0), F.lit(2 * rows + 100) / F.col("count")).alias("share"))
    likely = ids.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 32)) < F.col("share") * float(1 << 32)).select("doc_id", "lang", "h")
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 32)), "doc_id")
    picked = likely.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows).select("doc_id", "lang")
    labelled = docs.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang"))
    few = rows * n_languages <= BROADCAST_IDS
    found = labelled.join(F.broadcast(picked) if few else picked, ["doc_id", "lang"], "left_semi").filter("text is not null")
    # an id that many rows share counts once
    one = found.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    before = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("before", F.sum(F.octet_length("text")).over(before)).filter(F.coalesce("before", F.lit(0)) < SAMPLE_BYTES).drop("before")


def trained(labelled: DataFrame, order: int = ORDER) -> Models:
    """The models of rows (text, lang): byte runs are counted in tasks and summed by key; the driver gets the sums of one group of languages at a time."""
    spark = labelled.sparkSession
    languages = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    place = spark.sparkContext.broadcast({lang: i for i, lang in enumerate(languages)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = blobs(batch.column(0)), np.array([place.value[x] for x in batch.column(1).to_pylist()], np.int32)
            for lang in np.unique(langs):
                own = texts.take(pa.array(np.flatnonzero(langs == lang)))
                for a, b in runs_of_rows(own, RUN_BYTES):
                    data, starts = seen(own.slice(a, b - a))
                    for k in range(order + 1):
                        keys, n = np.unique(grams(data, starts, k + 1)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), lang, np.int32)), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "k", "run", "n"])

    summed = in_batches(labelled.select("text", "lang")).mapInArrow(count, "lang int, k int, run long, n long").groupBy("lang", "k", "run").agg(F.sum("n").alias("n"))
    if len(languages) > GROUP:
        summed = stored(summed, "runs")
    groups = []
    for first in range(0, len(languages), GROUP):
        names = languages[first : first + GROUP]
        got = summed.filter(F.col("lang").between(first, first + len(names) - 1)).toPandas()
        counts = {}
        for i in range(len(names)):
            for k in range(order + 1):
                own = got[(got["lang"] == first + i) & (got["k"] == k)]
                keys = own["run"].to_numpy(np.int64).view(np.uint64)
                sort = np.argsort(keys)
                counts[i, k] = keys[sort], own["n"].to_numpy(np.int64)[sort]
        groups.append(spark.sparkContext.broadcast(Model(names, counts, order)))
    return Models(languages, groups)


def has_letter(body: bytes) -> bool:
    """Whether a character of the Unicode categories of letters is in the text; other numerals than digits (², ½, Ⅷ) are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(body.decode(errors="replace")))


def predicted(docs: DataFrame, model: Models, text: str = "text") -> DataFrame:
    """doc (the columns of ``docs`` in a struct), lang_pred, score and bits_per_byte."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.languages, UNKNOWN]
        for batch in batches:
            texts, langs, scores, rates = blobs(batch.column(0).field(text)), [], [], []
            for a, b in runs_of_rows(texts, RUN_BYTES):
                run = texts.slice(a, b - a)
                data, starts = seen(run)
                lettered = np.concatenate(([0], np.cumsum((data >= 97) & (data < 123))))[starts]
                plain = np.diff(lettered) > 0
                ok = plain | np.array([not p and has_letter(run[i].as_py()) for i, p in enumerate(plain)], bool)
                if model.languages:
                    best, least, score = model.best(data, starts)
                    rate = least / np.maximum(np.diff(starts) - 1, 1)
                else:
                    best, score, rate, ok = np.zeros(b - a, int), np.zeros(b - a), np.zeros(b - a), np.zeros(b - a, bool)
                langs += [names[i] for i in np.where(ok, best, len(model.languages))]
                scores.append(np.where(ok, score, 0.0))
                rates.append(np.where(ok, rate, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [[]])), pa.array(np.concatenate(rates or [[]]))], names=["doc", "lang_pred", "score", "bits_per_byte"])
        release()

    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    schema = StructType(list(packed.schema.fields)).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return in_batches(packed).mapInArrow(work, schema)


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: CRC32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def model_of(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Models:
    """The models learned from ``docs``, only from rows that are not held out and have a text and a language."""
    return trained(stored(sampled(docs.filter(~held_out(F.col("doc_id"))), text, lang, rows), "sample"))


def languages(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every row of ``docs``.

    score: the winner's share of probability if all languages are as likely beforehand. A null text, and one without
    a letter, is ``und`` with score 0; so is every text if there is nothing to learn from. Equal codes go to the
    language first by name. A null doc_id isn't held out. Repeated rows are judged alike; other columns are ignored.
    """
    model = model_of(docs, text, lang, rows)
    got = predicted(docs.select("doc_id", F.col(text).alias("text")), model)
    return got.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
