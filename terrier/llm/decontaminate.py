"""Benchmark decontamination by suffix arrays over training shards.

Every shard of training text (a bounded run of rows inside a task) gets a suffix array over all its words, made by prefix
doubling: suffixes in the order of their words, told apart to the length of the longest test item. The windows of the test
items are binary-searched in it, each distinct one once and only if its first words stand in the shard at all, which each place of the
shard looks up in a table: the work goes with the training text, whatever the tests. The range of suffixes that begin with a window
is every place where it stands word for word. A test suffix whose window stands in a row is then searched at its full length
in the row's part of the array; the neighbours of the place where it belongs share most words with it, which gives its longest
verbatim match and where that is.

A row goes to its shard once and brings back its hits, so the training side is never shuffled. The test side is dealt into
blocks of at most ``BLOCK_BYTES`` by a global prefix sum of sizes; a block is broadcast for one pass. One block, the usual case,
is a single pass; with more, each pass writes the rows it hit and its broadcast is dropped, so neither the driver nor a worker
ever holds two blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrier.llm.prefix import with_prefix
from terrier.llm.shared import blobs, flat, in_batches, release, runs_of_rows, stored
from terrier.llm.tokens import Stretches, hashes, mixed

WINDOW = 10
#: Words at the beginning of a window that are looked up before it is searched, and window texts that a worker keeps.
HEAD, MOST_TEXTS = 5, 1 << 16
#: Bytes of test text that one pass broadcasts.
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 2 << 20

#: What is a word byte: all but \x00-\x2F, \x3A-\x60 and \x7B-\x7F after A-Z are lower-cased; other bytes belong to letters.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False

_P = 0x9E3779B97F4A7C15
_SIZE = np.uint64(0xA24BAED4963EE407)

#: A row's longest match: words, the place in the row, the item and the place in the item; null where nothing is hit.
MATCH = "struct<words:long,word:long,item:string,item_word:long>"
_MATCH = pa.struct([("words", pa.int64()), ("word", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])


class Words:
    """The words of a run of texts: lower-cased bytes, starts, ends, the row of each, a 64-bit hash of each and of any run of them."""

    def __init__(self, column: pa.LargeBinaryArray):
        data, offsets = flat(column)
        self.data = _LOWER[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _WORD[self.data]
        edge = inside.copy()
        edge[1:] ^= inside[:-1]
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[inside[cut] & inside[cut - 1]]  # a text ends and the next begins within word bytes
        marks = np.flatnonzero(edge)
        self.starts = np.sort(np.concatenate((marks[inside[marks]], cut)))
        self.ends = np.sort(np.concatenate((marks[~inside[marks]], cut)))
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(offsets) - 1))
        self.count = np.diff(np.append(self.first, len(self.starts)))
        #: Words from each word to the end of its row.
        self.left = (self.first + self.count)[self.row] - np.arange(len(self.row))
        self.hash = hashes(self.data, self.starts, self.ends)

    def runs(self) -> None:
        """Sums from which the hash of any run of words follows; made when the first search asks for it."""
        if not hasattr(self, "stretches"):
            self.stretches = Stretches(self.hash, _P)

    def run(self, at: np.ndarray, n) -> np.ndarray:
        return self.stretches.of(at, n)

    def named(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A number for each run of words that tells its length too."""
        return mixed(self.run(at, n) + n.astype(np.uint64) * _SIZE)

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True))


class TestSuffixes:
    """The suffixes of a block of test items, as a search needs them: in arrays, some 25 bytes for each byte of text."""

    def __init__(self, ids: list[str | None], texts: list[bytes], window: int = WINDOW):
        self.ids, self.window = ids, window
        self.words = w = Words(pa.array(texts, pa.large_binary()))
        w.runs()
        whole = w.count[w.row] < window
        #: Only a suffix that holds a window is searched: of an item shorter than a window, the item itself.
        self.at = np.flatnonzero(np.where(whole, w.left == w.count[w.row], w.left >= window))
        left = w.left[self.at]
        self.size, self.item = np.minimum(left, window), w.row[self.at]
        self.longest = int(left.max()) if len(self.at) else 0
        #: Equal windows are searched once: ``one`` is a suffix for each, ``members`` by ``bounds`` the suffixes that begin with it.
        _, self.one, same = np.unique(w.named(self.at, self.size), return_index=True, return_inverse=True)
        self.members = np.argsort(same, kind="stable")
        self.bounds = np.searchsorted(same[self.members], np.arange(len(self.one) + 1))
        #: Which suffix is preferred: by item (one without an id last), then by place.
        by_id = np.empty(len(ids), np.int64)
        by_id[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or ""))] = np.arange(len(ids))
        self.rank = np.empty(len(self.at), np.int64)
        self.rank[np.lexsort((self.at, by_id[self.item]))] = np.arange(len(self.at))
        #: Equal suffixes stand for each other: ``like`` says which of ``whole`` a suffix equals, the preferred one of its like.
        in_order = np.argsort(self.rank)
        _, lead, like = np.unique(w.named(self.at, left)[in_order], return_index=True, return_inverse=True)
        self.whole = in_order[lead]
        self.like = np.empty(len(self.at), np.int64)
        self.like[in_order] = like
        #: The first words of each distinct window, by how many they are: names in order, the windows they begin, and a filter of bits.
        self.heads = {}
        head = np.minimum(self.size[self.one], HEAD)
        for n in np.unique(head).tolist():
            own = np.flatnonzero(head == n)
            names = w.named(self.at[self.one[own]], np.full(len(own), n))
            order = np.argsort(names)
            bits = max(10, int(16 * len(own)).bit_length())
            may = np.zeros(1 << bits, bool)
            may[names >> np.uint64(64 - bits)] = True
            self.heads[n] = names[order], own[order], np.uint64(64 - bits), may
        self._texts: dict[int, bytes] = {}

    def begun(self, words: Words) -> np.ndarray:
        """The distinct windows whose first words stand in a shard; no other can. Each place of the shard is looked up, so the work goes with the shard."""
        out = [np.zeros(0, np.int64)]
        for n, (names, own, shift, may) in self.heads.items():
            at = np.flatnonzero(words.left >= n)
            there = words.named(at, np.full(len(at), n))
            there = np.unique(there[may[there >> shift]])
            lo, hi = np.searchsorted(names, there), np.searchsorted(names, there, side="right")
            k = hi - lo
            out.append(own[np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)] if k.sum() else out[0])
        return np.sort(np.concatenate(out))

    def window_text(self, suffix: int) -> bytes:
        if suffix not in self._texts:
            if len(self._texts) >= MOST_TEXTS:
                self._texts.clear()
            self._texts[suffix] = self.words.text(int(self.at[suffix]), int(self.size[suffix]))
        return self._texts[suffix]


#: The last block's suffixes; a worker that runs several tasks makes them once.
_READY: dict[str, TestSuffixes] = {}


def _tests(name: str, block: tuple[list[str | None], list[bytes]], window: int) -> TestSuffixes:
    if name not in _READY:
        _READY.clear()
        _READY[name] = TestSuffixes(*block, window)
    return _READY[name]


def suffix_array(words: Words, depth: int) -> np.ndarray:
    """Places of all suffixes of a shard in the order of their first ``depth`` words (by hash; the end of a row comes first).

    Prefix doubling: suffixes are ranked by one word, two, four and so on; a round sorts only those that still tie.
    """
    n = len(words.hash)
    _, rank = np.unique(words.hash, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    new = np.append(True, rank[order][1:] != rank[order][:-1])[:n]
    step, open_ = 1, np.arange(n)
    while True:
        leads = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank[order[open_]] = open_[leads]
        open_ = open_[~(new & np.append(new[1:], True)[: len(new)])]
        if step >= depth or not len(open_):
            return order
        at = order[open_]
        after = np.where(words.left[at] > step, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        sort = np.argsort(key, kind="stable")
        key = key[sort]
        order[open_] = at[sort]
        new = np.append(True, key[1:] != key[:-1])
        step *= 2


def common(words: Words, place: np.ndarray, tests: Words, at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words, up to ``most``, the suffixes of the shard share with test suffixes; by halving on the hashes of runs."""
    most = np.minimum(most, words.left[place])
    lo, hi = np.zeros(len(place), np.int64), most.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_] + 1) >> 1
        same = words.run(place[open_], mid) == tests.run(at[open_], mid)
        lo[open_[same]] = mid[same]
        hi[open_[~same]] = mid[~same] - 1
    return lo


def bound(words: Words, array: np.ndarray, tests: Words, at: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """Binary search for each test suffix of ``size`` words between ``lo`` and ``hi`` of the array: the first place of what isn't less, or with ``after`` of what is greater."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        place, own, n = array[mid], at[open_], size[open_]
        k = common(words, place, tests, own, n)
        ended = k >= words.left[place]
        less = ended | (words.hash[np.where(ended, 0, place + k)] < tests.hash[np.minimum(own + k, len(tests.hash) - 1)])
        less = np.where(k == n, after, less)
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


def search(words: Words, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shard's suffix array, and (distinct window, range of the suffixes that begin with it) for those that stand in the shard."""
    none = np.zeros(0, np.int64)
    if not len(words.hash) or not len(tests.one):
        return none, none, none, none
    t = tests.words
    words.runs()
    array = suffix_array(words, tests.longest)
    which = tests.begun(words)
    at, size = tests.at[tests.one[which]], tests.size[tests.one[which]]
    # suffixes that begin with one word stand together: a window is searched among those of its first
    heads = words.hash[array]
    lo, hi = np.searchsorted(heads, t.hash[at]), np.searchsorted(heads, t.hash[at], side="right")
    low = bound(words, array, t, at, size, lo, hi, False)
    near = np.flatnonzero(low < hi)
    near = near[common(words, array[low[near]], t, at[near], size[near]) == size[near]]
    high = bound(words, array, t, at[near], size[near], low[near], hi[near], True)
    return array, which[near], low[near], high


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, number in it) of every number of the ranges."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(which))


def occurrences(words: Words, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The array, and (window, place) of each verbatim occurrence of a distinct window; equal hashes are held against the texts."""
    array, windows, low, high = search(words, tests)
    which, at = _spread(low, high)
    which, place = windows[which], array[at]
    true = np.fromiter((words.text(p, int(tests.size[s])) == tests.window_text(s) for s, p in zip(tests.one[which].tolist(), place.tolist(), strict=True)), bool, len(place))
    return array, which[true], place[true]


def longest(words: Words, tests: TestSuffixes, array: np.ndarray, which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, test suffix, words, first and last but one of their places in the array by rows) of the longest verbatim match of each distinct test suffix in each row that has its window, and that array.

    The suffix array is parted by rows, those that are hit, in each in its order. A test suffix is binary-searched at full
    length in the part of the row; the neighbours of where it belongs share most words with it, and as many are shared by the whole range round them.
    """
    hit = np.zeros(len(words.count), bool)
    hit[words.row[place]] = True
    parted = array[hit[words.row[array]]]
    parted = parted[np.argsort(words.row[parted], kind="stable")]
    pairs = np.unique(words.row[place] * len(tests.one) + which)
    row, w = pairs // len(tests.one), pairs % len(tests.one)
    k, member = _spread(tests.bounds[w], tests.bounds[w + 1])
    pairs = np.unique(row[k] * len(tests.whole) + tests.like[tests.members[member]])
    row, own = pairs // len(tests.whole), tests.whole[pairs % len(tests.whole)]
    at, t = tests.at[own], tests.words
    lo, hi = np.searchsorted(words.row[parted], row), np.searchsorted(words.row[parted], row, side="right")
    to = bound(words, parted, t, at, t.left[at], lo, hi, False)
    shared = np.maximum(*[common(words, parted[np.clip(to + d, lo, hi - 1)], t, at, t.left[at]) for d in (-1, 0)])
    low = bound(words, parted, t, at, shared, lo, hi, False)
    return row, own, shared, low, bound(words, parted, t, at, shared, low, hi, True), parted


def best_matches(words: Words, tests: TestSuffixes, array: np.ndarray, which: np.ndarray, place: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """For each row hit its longest match: (place, words, test suffix); of several the first place, then the preferred suffix."""
    row, own, shared, low, high, parted = longest(words, tests, array, which, place)
    most = np.zeros(len(words.count), np.int64)
    np.maximum.at(most, row, shared)
    top = np.flatnonzero(shared == most[row])
    first = np.minimum.reduceat(parted[_spread(low[top], high[top])[1]], np.cumsum(high[top] - low[top]) - (high[top] - low[top]))
    order = np.lexsort((tests.rank[own[top]], first, row[top]))
    lead = order[np.unique(row[top][order], return_index=True)[1]]
    return {int(row[top[i]]): (int(first[i]), int(shared[top[i]]), int(own[top[i]])) for i in lead.tolist()}


def shard_hits(column: pa.LargeBinaryArray, tests: TestSuffixes) -> list[tuple[int, bytes | None, list[str | None], dict | None]]:
    """For each row of a shard: words, a bit for each word that a window covers (null: none), the items with a window in it, and its longest match.

    A row's longest match is the longest run of words, a window at least, that it shares with an item; of several, the first in
    the row, then that with the first item by id (one without an id last), then the first in the item.
    """
    words = Words(column)
    array, which, place = occurrences(words, tests)
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + tests.size[tests.one[which]], -1)
    hit = np.cumsum(step[:-1]) > 0
    best = best_matches(words, tests, array, which, place) if len(place) else {}
    pairs = np.unique(np.stack((words.row[place], which)), axis=1)
    edges = np.searchsorted(pairs[0], np.arange(len(column) + 1))
    out: list = []
    for r in range(len(column)):
        n, f, own = int(words.count[r]), int(words.first[r]), pairs[1, edges[r] : edges[r + 1]].tolist()
        if not own:
            out.append((n, None, [], None))
            continue
        items = {tests.ids[tests.item[s]] for w in own for s in tests.members[tests.bounds[w] : tests.bounds[w + 1]].tolist()}
        p, size, s = best[r]
        item = int(tests.item[s])
        match = {"words": size, "word": p - f, "item": tests.ids[item], "item_word": int(tests.at[s] - tests.words.first[item])}
        out.append((n, np.packbits(hit[f : f + n]).tobytes(), sorted(items, key=lambda x: (x is None, x or "")), match))
    return out


def _block(rows: DataFrame) -> tuple[list[str | None], list[bytes]]:
    got = rows.select("item", "text").collect()
    return [r.item for r in got], [r.text.encode() for r in got]


def blocks_of(benchmark: DataFrame, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[list[str | None], list[bytes]]]:
    """The test items in blocks of about ``most`` bytes (an item that is longer ends its block); the driver fetches one after the other."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("size", (F.octet_length("text") + 1).cast("long"))
    total = items.agg(F.sum("size")).first()[0]
    if (total or 0) <= most:
        yield _block(items)
        return
    dealt = stored(with_prefix(stored(items, "items"), [F.col("item"), F.xxhash64("text")], {"start": "size"}).withColumn("block", F.floor(F.col("start") / most)), "blocks")
    for k in sorted(r.block for r in dealt.select("block").distinct().collect()):
        yield _block(dealt.filter(F.col("block") == k))


def _count(bits: list[bytes]) -> int:
    """Words hit in any of a row's passes."""
    return int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in bits])).sum()) if bits else 0


def _scan(spark, block, text: str, window: int, hit_only: bool):
    """A pass over rows (doc, row): (doc, n_words, n_hit, items, match) of each, or (row, hits, items, match) of those that are hit."""
    shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _tests(name, shared.value, window)
        for batch in batches:
            column, got = blobs(batch.column(0).field(text)), []
            for a, b in runs_of_rows(column, SHARD_BYTES):
                got += shard_hits(column.slice(a, b - a), tests)
            n, bits, items, match = ([g[k] for g in got] for k in range(4))
            strings, matches = pa.list_(pa.string()), _MATCH
            if hit_only:
                keep = np.flatnonzero([x is not None for x in bits])
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep)), pa.array([bits[i] for i in keep], pa.binary()), pa.array([items[i] for i in keep], strings), pa.array([match[i] for i in keep], matches)], names=["row", "hits", "items", "match"])
            else:
                hit = [_count([x]) if x is not None else 0 for x in bits]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, strings), pa.array(match, matches)], names=["doc", "n_words", "n_hit", "items", "match"])
        release()

    return work, shared


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc (the columns of ``docs`` in a struct), n_words, n_hit (words that a window of a test item covers), items (the ids of the
    items with a window in it, once each, null for those without one) and match (the longest, see ``shard_hits``) of every row.

    Null and empty texts have no words and are never hit; without test items no row is. Equal rows are judged alike.
    """
    spark = docs.sparkSession
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    blocks = blocks_of(benchmark, "text", block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        schema = StructType([*packed.schema.fields, *StructType.fromDDL(f"n_words long, n_hit long, items array<string>, match {MATCH}").fields])
        return in_batches(packed).mapInArrow(_scan(spark, first, text, window, False)[0], schema)
    rows = stored(packed.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = None
    while first is not None:
        work, shared = _scan(spark, first, text, window, True)
        own = stored(in_batches(rows).mapInArrow(work, f"row long, hits binary, items array<string>, match {MATCH}"), "hits")
        shared.destroy()
        found = own if found is None else found.union(own)
        first, second = second, next(blocks, None)
    # a row has at most one entry for each pass
    longest_first = F.struct((-F.col("match.words")).alias("a"), F.col("match.word").alias("b"), F.col("match.item").isNull().alias("c"), F.col("match.item").alias("d"), F.col("match.item_word").alias("e"))
    merged = found.groupBy("row").agg(F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.min_by("match", longest_first).alias("match"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_count(b) for b in batch.column(1).to_pylist()], pa.int64()), batch.column(2), batch.column(3)], names=["row", "n_hit", "items", "match"])

    merged = stored(merged.mapInArrow(count, f"row long, n_hit long, items array<string>, match {MATCH}"), "merged")
    n_words = F.coalesce(F.regexp_count(F.col("doc")[text], F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")
    in_order = F.array_sort(F.filter("items", lambda x: x.isNotNull()))
    items = F.when(F.exists("items", lambda x: x.isNull()), F.array_append(in_order, F.lit(None).cast("string"))).otherwise(in_order)
    return rows.join(merged, "row", "left").select("doc", n_words.alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(items, F.array().cast("array<string>")).alias("items"), "match")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest match (match_words, match_word, match_item,
    match_item_word) of every row of ``docs``.

    Null and empty texts have no words and no hit; test items without words match nothing. Items that share an id are one item,
    and so are those without an id: they hit and count as one, but have no place in the list of ids. Repeated rows are judged
    alike. Without test items nothing is hit. A text of any length is searched whole. Other columns are ignored.
    """
    got = with_hits(docs.select("doc_id", F.col(text).alias("text")), benchmark, window=window, block_bytes=block_bytes)
    ids: Column = F.array_join(F.filter("items", lambda x: x.isNotNull()), ",")
    return got.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("match.words", F.lit(0).cast("long")).alias("match_words"), F.col("match.word").alias("match_word"), F.col("match.item").alias("match_item"), F.col("match.item_word").alias("match_item_word"),
    )


def locations(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, word, item_id, item_word, n_words): for each row that is hit and each distinct test suffix whose window stands in it, the
    longest verbatim match, found in the shard's suffix array, and where it stands first. Equal suffixes of several items are given once, as the preferred one's."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, word long, item_id string, item_word long, n_words long"

    def scan(block):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = _tests(name, shared.value, window)
            for batch in batches:
                column, rows = blobs(batch.column(1)), []
                for lo, hi in runs_of_rows(column, SHARD_BYTES):
                    words = Words(column.slice(lo, hi - lo))
                    array, which, place = occurrences(words, tests)
                    if not len(which):
                        continue
                    *found, parted = longest(words, tests, array, which, place)
                    for r, s, n, a, z in zip(*(x.tolist() for x in found), strict=True):
                        item = int(tests.item[s])
                        rows.append((batch.column(0)[lo + r].as_py(), int(parted[a:z].min() - words.first[r]), tests.ids[item], int(tests.at[s] - tests.words.first[item]), int(n)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [batch.schema.types[0], pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "word", "item_id", "item_word", "n_words"])

        return work, shared

    out = None
    for block in blocks_of(benchmark, "text", block_bytes):
        work, shared = scan(block)
        one = stored(in_batches(docs.select("doc_id", F.col(text).alias("text"))).mapInArrow(work, schema), "locations")
        shared.destroy()
        out = one if out is None else out.union(one)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs``, columns unchanged, without the rows that hold a window of a test item; null and empty texts, and ties of any kind, stay. An empty table stays empty."""
    return with_hits(docs, benchmark, text, window).filter("n_hit = 0").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
