"""SimHash near-duplicates by an inverted index over bytes at their positions, with count filtering.

A fingerprint of 64 bits is eight bytes, each a token (position, value). Two fingerprints that differ in at most four bits differ in
at most four bytes, so they share at least four of the eight tokens. The index is made of posting lists: a fingerprint is posted
under sets of three of its tokens, namely the 20 of ``POSTED`` (of any four positions, three are one of these, so no pair is missed).
Within a list the positional bytes that each pair shares are tallied; pairs that don't reach the guaranteed minimum of four are
dropped, and the rest are verified bit by bit. Lists of single bytes would hold 1/256 of all fingerprints each, whatever the
corpus; lists of three tokens hold about one in 16 million.

No list is compared that is longer than ``LIST_LIMIT``: lists are counted before they are dealt out, and the members of a longer one
are posted again under finer sets instead, each with one more of its tokens (a pair that keeps its chance shares a fourth), and
if that is still too long by four of the eight half-bytes that are left open. What shares such a set agrees in 48 bits, so there
are at most 65,536 of it. A list gives a spanning star of each of its linked groups, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.shared import blobs, in_batches, release, runs_of_rows, stored

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Positional bytes that a pair within MAX_BITS shares at least.
MIN_SHARED = 8 - MAX_BITS
#: Longest list that is compared at once.
LIST_LIMIT = 1024
#: Lists beyond the limit up to which their keys are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_LISTS = 500_000
SLICE = 65_536


def _mask(units: tuple[int, ...], width: int) -> int:
    return sum(((1 << width) - 1) << (width * u) for u in units)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Three groups of positions. Sets of three are those within a group, and two of a group with one of the next: a set of any four
#: positions holds one of these 20.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
POSTED = [c for g in _GROUPS for c in combinations(g, 3)] + [(*c, x) for i, g in enumerate(_GROUPS) for c in combinations(g, 2) for x in _GROUPS[(i + 1) % 3]]
SETS = [_mask(c, 8) for c in POSTED]


def _finer(mask: int) -> list[int]:
    """The finer sets of a list that is too long: each with one more byte, or where four bytes agree with four of the eight half-bytes left."""
    if mask.bit_count() == 24:
        return [mask | _mask((u,), 8) for u in range(8) if not mask >> (8 * u) & 255]
    open_units = [u for u in range(16) if not mask >> (4 * u) & 15]
    return [mask | _mask(c, 4) for c in combinations(open_units, len(open_units) - MAX_BITS)]


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text: a bit is 1 if it is set in over half of the shingles' hashes; no words: zero."""
    found = text.lower().split()  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not found:
        return 0
    width = min(words, len(found))
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - width + 1
    digest, tally = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        to = min(n, at + SLICE)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
        tally += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * tally > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (the fingerprint as a signed long) for every row; null text is an empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = blobs(batch.column(len(keep))), []
            for a, b in runs_of_rows(texts, 8 << 20):
                found += [fingerprint(x, words) for x in texts.slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.array(found, np.uint64).view(np.int64))], names=[*keep, "fp"])
        release()

    kept = docs.select(*keep, F.col(text).alias("_text"))
    types = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1])
    return in_batches(kept).mapInArrow(work, f"{types}, fp long")


def tallied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positional bytes that each pair of fingerprints shares."""
    return ((a ^ b)[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (the smallest member known of each one's group) after the links i to j."""
    while (unlike := np.flatnonzero(label[i] != label[j])).size:
        i, j = i[unlike], j[unlike]
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(nearer := label[label], label):
            label = nearer
    return label


def _linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each run of equal keys: a spanning star (member, smallest member) of each group that links make. Links are merged as they are met, so memory is that of the members."""
    n, at, lag, label = len(fps), np.arange(len(fps)), 1, np.arange(len(fps))
    while True:
        at = at[at + lag < n]
        at = at[keys[at] == keys[at + lag]]
        if not len(at):
            break
        kept = at[tallied(fps[at], fps[at + lag]) >= MIN_SHARED]
        kept = kept[np.bitwise_count(fps[kept] ^ fps[kept + lag]) <= MAX_BITS]
        label = _joined(label, kept, kept + lag)
        lag += 1
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


#: Every way in which up to ``MAX_BITS`` of 16 bits differ, the fewest first.
_NEAR = np.array(sorted((sum(1 << i for i in c) for n in range(1, MAX_BITS + 1) for c in combinations(range(16), n)), key=int.bit_count), np.uint16)


def _linked_by_table(mask: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one list of distinct fingerprints that differ in 16 bits only: each looks its neighbours up by their bits, so the work goes with the members and not with their pairs.

    What differs in up to four bits shares four bytes at least, so no link falls to the count filter.
    """
    value = np.zeros(len(fps), np.uint16)
    for k, u in enumerate(u for u in range(16) if not mask >> (4 * u) & 15):
        value |= ((fps >> np.uint64(4 * u)) & np.uint64(15)).astype(np.uint16) << np.uint16(4 * k)
    own = np.arange(len(fps))
    place = np.full(1 << 16, -1, np.int64)
    place[value] = own
    label = own.copy()
    for way in _NEAR:
        other = place[value ^ way]
        kept = np.flatnonzero(other > own)
        label = _joined(label, kept, other[kept])
        if not label.any():  # all are one group
            break
    moved = np.flatnonzero(label != own)
    return fps[moved], fps[label[moved]]


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (mask, fp) sorted by list: edges (a, b). What is held are the rows of one batch and of the list it breaks off in."""
    held_m, held_f = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def done(m: np.ndarray, f: np.ndarray, last: bool):
        keys = f & m
        bounds = np.concatenate(([0], np.flatnonzero((m[1:] != m[:-1]) | (keys[1:] != keys[:-1])) + 1, [len(m)]))
        upto = len(bounds) - 1 if last else len(bounds) - 2
        sizes = np.diff(bounds[: upto + 1])
        large = [k for k in np.flatnonzero(sizes > LIST_LIMIT).tolist() if int(m[bounds[k]]).bit_count() == 48]
        pairs = sizes > 1
        pairs[large] = False
        some = np.repeat(pairs, sizes)
        found = [_linked(np.repeat(np.arange(len(sizes)), sizes)[some], f[: bounds[upto]][some]), *(_linked_by_table(int(m[bounds[k]]), f[bounds[k] : bounds[k + 1]]) for k in large)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]), m[bounds[upto] :], f[bounds[upto] :]

    for batch in batches:
        if batch.num_rows:
            m, f = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            out, held_m, held_f = done(np.concatenate((held_m, m)), np.concatenate((held_f, f)), False)
            yield out
    if len(held_m):
        yield done(held_m, held_f, True)[0]


def links(fps: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all that differ in up to four bits; stars, not all pairs.

    At each level the lists that are too long are known by their counts, which are summed before they are shuffled, and only
    shorter ones are dealt out whole; so one set of bytes that very many fingerprints share never meets in one task.
    """
    rows, edges = fps.select(F.explode(F.array(*[F.lit(_signed(m)) for m in SETS])).alias("mask"), "fp"), None
    masks, key = SETS, F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    while True:
        posted = rows.select("mask", key, "fp")
        final = masks[0].bit_count() == 48
        long = None if final else stored(posted.groupBy("mask", "key").count().filter(F.col("count") > limit).select("mask", "key"), "long")
        n_long = 0 if final else long.count()
        if n_long:
            long = F.broadcast(long) if n_long <= BROADCAST_LISTS else long
            posted = posted.join(long, ["mask", "key"], "left_anti")
        found = posted.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "fp").mapInArrow(_scan_lists, "a long, b long")
        edges = found if edges is None else edges.union(found)
        if not n_long:
            return edges.distinct()
        finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in _finer(m)]))])
        rest = rows.select("mask", key, "fp").join(long, ["mask", "key"], "left_semi")
        rows = stored(rest.select(F.explode(finer[F.col("mask")]).alias("mask"), "fp").distinct(), "posted")
        masks = sorted({y for m in masks for y in _finer(m)})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't a root itself; the root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each
    round is a written table, so a lost executor costs one round at most.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def least_of(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    was = state(e)
    while was[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least_of(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v").distinct()
        least = least_of(large)
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "edges")
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(prints: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp) of a written table.

    component_id: the smallest doc_id reachable by links of up to four bits, itself included. Rows with
    equal fingerprints are linked; a null doc_id is never the smallest unless all of its group are null.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    star = components(links(nodes.select("fp"), limit))
    member = star.select(F.col("node").alias("fp"), "root").union(star.select(F.col("root").alias("fp"), "root").distinct())
    placed = member.join(nodes, "fp")
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = placed.join(least, "root").select("fp", "component_id")
    # a table, so the last join stands alone and a fingerprint that many rows share can be split
    label = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "labels")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows stay
    rows of one group; an empty table gives none; further columns, whatever their names, are ignored.
    """
    prints = stored(with_fingerprints(docs, text), "prints")
    return grouped(prints, limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
