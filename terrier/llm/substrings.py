"""Removal of word windows that an earlier document has, by Rabin-Karp hashes.

Documents are dealt into pieces of bounded size by a hash. A task rolls two 64-bit Rabin-Karp hashes over the words of a piece: of
every window of ``width`` words the one says which bucket it goes to, the other stands for it there; with 2 to the b buckets a
window is told from others by 64 + b bits, so the hash grows with the corpus. A piece sends each distinct window once, with the
smallest id of its documents that has it; a passage that a third of all documents share is sent once by each piece. A bucket
counts its windows over all pieces and answers each piece with a bit for every window sent: whether a document of another
piece, with a smaller id, has it too. The piece rolls its hashes again, puts bits and own ids together, and repeated windows merge
into maximal intervals of words to remove. Texts are shuffled once: both passes over the pieces read the same shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.shared import blobs, fixed, release, runs_of_rows
from terrier.llm.tokens import Tokens, mixed, rolling

WIDTH = 50
#: Bytes of text of a piece, and windows of a bucket, that are aimed at.
PIECE_BYTES = 4 << 20
BUCKET_WINDOWS = 1 << 21
RUN_BYTES = 1 << 20
#: Odd bases of the two rolling hashes.
_BASES = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)
#: A null id ranks after all others.
_LAST = np.iinfo(np.int64).max

_SENT = "piece long, bucket int, ids binary, counts binary, windows binary"
_ANSWER = "piece long, bucket int, earlier binary"
_INTERVALS = "array<struct<start:long,end:long>>"
_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _stable(x: np.ndarray, beyond: int) -> np.ndarray:
    """Places of ``x``, all from 0 and under ``beyond``, in ascending order, ties as they were; small numbers are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if beyond <= 1 << 16 else x, kind="stable")


def _distinct(window: np.ndarray, bucket: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal windows the place of one and the smallest owner; and of every window which of these it is."""
    order = np.argsort(window)
    w, b = window[order], bucket[order]
    new = np.append(True, (w[1:] != w[:-1]) | (b[1:] != b[:-1]))[: len(order)]
    lead = np.flatnonzero(new)
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(new) - 1
    return order[lead], np.minimum.reduceat(owner[order], lead) if len(lead) else owner[:0], same


class Piece:
    """The windows of the documents of a piece: of each its document's rank by id, and the distinct ones in the order of (bucket, smallest id, hash), however the rows lie."""

    def __init__(self, ids: pa.Array, texts: pa.LargeBinaryArray, width: int, buckets: int):
        owner, bucket, window = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
        self.runs = []
        self.ids, rank = np.unique(ids.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False), return_inverse=True)
        for a, b in runs_of_rows(texts, RUN_BYTES):
            words = Tokens(texts.slice(a, b - a))
            at = np.flatnonzero(words.left >= width)
            deal, name = (mixed(rolling(words.hash, width, base)[at]) for base in _BASES)
            owner.append(rank[a + words.row[at]].astype(np.int32))
            bucket.append((deal % np.uint64(buckets)).astype(np.int32))
            window.append(name)
            self.runs.append((a, b, len(at)))
        self.owner, bucket, window = np.concatenate(owner), np.concatenate(bucket), np.concatenate(window)
        #: Of each window its distinct one; of each distinct one the smallest owner, and which comes where.
        lead, self.least, self.same = _distinct(window, bucket, self.owner)
        order = _stable(self.least, len(self.ids))
        self.order = order[_stable(bucket[lead][order], buckets)]
        self.sent = bucket[lead][self.order], self.least[self.order], window[lead][self.order]


def _sent(piece: int, of: Piece) -> Iterator[tuple]:
    """A message for each bucket: ids ascending, how many windows each is the smallest id of, and those windows."""
    bucket, owner, window = of.sent
    edges = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]).tolist(), len(bucket)]
    for a, b in itertools.pairwise(edges):
        ranks, counts = np.unique(owner[a:b], return_counts=True)
        yield piece, int(bucket[a]), of.ids[ranks].tobytes(), counts.astype(np.uint32).tobytes(), window[a:b].tobytes()


def _answers(rows: dict[str, list]) -> Iterator[tuple]:
    """For each message of a bucket a bit for each of its windows: whether a smaller id than its own has sent it. No bit, no answer."""
    windows = [np.frombuffer(x, np.uint64) for x in rows["windows"]]
    owners = [np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.uint32)) for i, n in zip(rows["ids"], rows["counts"], strict=True)]
    ends = np.cumsum([len(x) for x in windows])
    window, owner = np.concatenate(windows), np.concatenate(owners)
    _, least, same = _distinct(window, np.zeros(len(window), np.int8), owner)
    earlier = least[same] < owner
    for k, bits in enumerate(np.split(earlier, ends[:-1])):
        if bits.any():
            yield rows["piece"][k], rows["bucket"][k], np.packbits(bits).tobytes()


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _covered(words: Tokens, at: np.ndarray, gone: np.ndarray, width: int) -> np.ndarray:
    """Which words a removed window (the ``at`` where ``gone``) covers."""
    step = np.zeros(len(words.hash) + 1, np.int64)
    step[at[gone]] += 1
    step[at[gone] + width] -= 1
    return np.cumsum(step[:-1]) > 0


def _intervals(words: Tokens, gone: np.ndarray) -> pa.ListArray:
    """The stretches of covered words of each row."""
    edge_in = gone & np.append(True, ~gone[:-1] | (words.row[1:] != words.row[:-1]))[: len(gone)]
    edge_out = gone & np.append(~gone[1:] | (words.row[1:] != words.row[:-1]), True)[: len(gone)]
    start, end = np.flatnonzero(edge_in), np.flatnonzero(edge_out)
    row = words.row[start]
    offsets = np.searchsorted(row, np.arange(len(words.count) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start - words.first[row]), pa.array(end + 1 - words.first[row])], fields=list(_INTERVAL)))


def without_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, piece_bytes: int = PIECE_BYTES, bucket_windows: int = BUCKET_WINDOWS, parts: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, removed (intervals of words, start and end, as wide as they get) and kept (the other words, one space between) of every row of ``docs``.

    A word is removed if a window of ``width`` words that covers it has a word sequence that also starts in a row with a smaller
    integer doc_id. Null ids rank after all others. Rows with the same id, repeated rows too, take nothing from each other and lose
    the same. Null and empty texts, and those of fewer words, lose nothing; a text of any length is read whole. An empty table
    gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_pieces, n_buckets = max(1, size // piece_bytes), fixed(parts, spark)
    while n_buckets * bucket_windows < size // 4:  # words have some four bytes at least, white space included
        n_buckets *= 2
    # the split of the input is in the key, so that a row that is repeated very often is spread
    piece = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.spark_partition_id()), F.lit(n_pieces))
    pieces = rows.withColumn("piece", piece).repartition(fixed(parts, spark), "piece")
    out_type = f"doc_id {rows.dtypes[0][1]}, n_words long, n_removed long, removed {_INTERVALS}, kept string"
    sent_schema = [("piece", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("windows", pa.binary())]
    answer_schema = [("piece", pa.int64()), ("bucket", pa.int32()), ("earlier", pa.binary())]

    def send(table: pa.Table) -> pa.Table:
        of = Piece(table.column("doc_id").combine_chunks(), blobs(table.column("text")), width, n_buckets)
        got = pa.Table.from_batches([_batch(list(_sent(table.column("piece")[0].as_py(), of)), sent_schema)])
        release()
        return got

    def answer(table: pa.Table) -> pa.Table:
        got = pa.Table.from_batches([_batch(list(_answers(table.to_pydict())), answer_schema)])
        release()
        return got

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids = blobs(table.column("text")), table.column("doc_id").combine_chunks()
        of = Piece(ids, texts, width, n_buckets)
        own, bucket = np.zeros(len(of.order), bool), of.sent[0]
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("earlier").to_pylist(), strict=True):
            a, z = np.searchsorted(bucket, [b, b + 1])
            own[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a)
        earlier = np.empty(len(own), bool)
        earlier[of.order] = own
        gone = earlier[of.same] | (of.owner > of.least[of.same])
        out, at = [], 0
        for a, b, n in of.runs:
            words = Tokens(texts.slice(a, b - a))
            covered = _covered(words, np.flatnonzero(words.left >= width), gone[at : at + n], width)
            at += n
            removed = np.bincount(words.row[covered], minlength=b - a).astype(np.int64)
            out.append(pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(words.count, pa.int64()), pa.array(removed), _intervals(words, covered), words.kept(~covered)], names=["doc_id", "n_words", "n_removed", "removed", "kept"]))
        release()
        return pa.Table.from_batches(out)

    answers = pieces.groupBy("piece").applyInArrow(send, _SENT).groupBy("bucket").applyInArrow(answer, _ANSWER)
    return pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(finish, out_type)
