"""An index of three-letter runs for the search: rows stored by buckets of their id, runs stored by buckets of their own.

A search with wildcards on both sides has no prefix that a scan could be pruned by. Here it reads the postings of the rarest
runs of its words, and then only the buckets of rows that these name, where the rows are held against the whole pattern.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from terrier.operators.catalog import SEARCHED, _pattern, search

BUCKETS = 64
#: Runs whose postings are read; a row must be in all of them.
RAREST = 3
#: Bytes of text whose runs are sorted at a time.
PIECE = 4 << 20
#: Between two columns; no run goes over it, as it isn't ASCII.
_BETWEEN = "\u0080"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)  # which np.unique would do with a hash table, far slower
    return keys[np.diff(keys, prepend=-1) != 0]


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(run, row) of the distinct runs of three ASCII characters of each text, by run, then row; a run is a number of three times 7 bits."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    starts, found = starts - starts[0], [np.zeros(0, np.int64)]
    for at in range(0, len(data) - 2, PIECE):
        b = data[at : at + PIECE + 2]
        own = np.clip(starts, at, at + len(b))
        row = np.repeat(np.arange(len(whole), dtype=np.int32), np.diff(own))
        kept = ((b[:-2] | b[1:-1] | b[2:]) < 128) & (row[:-2] == row[2:])
        code = b[:-2].astype(np.int32) << 14 | b[1:-1].astype(np.int32) << 7 | b[2:]
        found.append(_distinct(code[kept].astype(np.int64) << 32 | row[:-2][kept]))
    keys = _distinct(np.concatenate(found))
    return keys >> 32, keys & 0xFFFFFFFF


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, ids) of batches of (id, text): a row for each run of a batch."""
    for batch in batches:
        runs, rows = _runs(batch.column(1))
        heads = np.flatnonzero(np.diff(runs, prepend=-1))
        codes = runs[heads]
        letters = np.stack([codes >> 14, codes >> 7 & 127, codes & 127], axis=1).astype(np.uint8)
        names = pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(np.arange(0, 3 * len(codes) + 1, 3, dtype=np.int32)), pa.py_buffer(letters.tobytes())])
        ids = pa.ListArray.from_arrays(pa.array(np.append(heads, len(runs)).astype(np.int32)), batch.column(0).take(pa.array(rows)))
        yield pa.RecordBatch.from_arrays([names, ids], ["run", "ids"])


def wanted(text: str) -> list[str]:
    """The runs that a row must have, in any of its searched columns, to match a search."""
    pieces = re.split(r"\\.|[%_]|[^\x00-\x7f]", _pattern(text).lower(), flags=re.S)
    return sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})


def write_index(docs: DataFrame, folder: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Store ``docs`` and the runs of their searched columns in ``folder``.

    A run's postings are rows of many ids, one for each batch of ``docs`` that has it, so what is shuffled and sorted are not single
    pairs of run and id; those of a frequent run are dealt over files, so no task holds all of them. Rows with a null or repeated id
    are kept; rows of one id share a bucket.
    """
    # an empty table has no buckets, hence no files that tell its columns
    docs.limit(0).write.mode("overwrite").parquet(f"{folder}/columns")
    docs.withColumn("row_bucket", _bucket(F.col(key), buckets)).repartition("row_bucket").write.mode("overwrite").partitionBy("row_bucket").parquet(f"{folder}/rows")
    text = F.lower(F.concat_ws(_BETWEEN, *[c for c in SEARCHED if c in docs.columns]))
    posts = docs.select(F.col(key).cast("long").alias("id"), text.alias("text")).mapInArrow(_posted, "run string, ids array<long>")
    posts = posts.withColumn("bucket", F.pmod(F.crc32(F.col("run").cast("binary")), F.lit(buckets)).cast("int"))
    posts.repartition("bucket", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(8))).sortWithinPartitions("bucket", "run").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/runs")


def _blocks(spark: SparkSession, folder: str, runs: list[str], buckets: int) -> DataFrame:
    posts = spark.read.schema("ids array<long>, run string, bucket int").parquet(f"{folder}/runs")
    return posts.filter(F.col("bucket").isin([zlib.crc32(r.encode()) % buckets for r in runs]) & F.col("run").isin(runs))


def postings(spark: SparkSession, folder: str, runs: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(id, run) of some runs; other buckets' files aren't opened."""
    return _blocks(spark, folder, runs, buckets).select(F.explode("ids").alias("id"), "run")


def candidates(spark: SparkSession, folder: str, text: str, buckets: int = BUCKETS) -> DataFrame | None:
    """(id) of the rows that have the rarest runs of a search; None if it has no run, so that any row may match."""
    runs = wanted(text)
    if not runs:
        return None
    # one row for each run of the pattern
    counts = {r.run: r.n for r in _blocks(spark, folder, runs, buckets).groupBy("run").agg(F.sum(F.size("ids")).alias("n")).collect()}
    rarest = sorted(runs, key=lambda r: (counts.get(r, 0), r))[:RAREST]
    return postings(spark, folder, rarest, buckets).groupBy("id").agg(F.countDistinct("run").alias("n")).filter(F.col("n") == len(rarest)).select("id")


def search_index(spark: SparkSession, folder: str, text: str, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """The stored rows that :func:`terrier.operators.catalog.search` finds for a text, in no order.

    Words of under three ASCII characters have no run; a search of such words only reads all rows, as does a blank one.
    """
    rows = spark.read.schema(spark.read.parquet(f"{folder}/columns").schema.add("row_bucket", IntegerType())).parquet(f"{folder}/rows")
    hits = candidates(spark, folder, text, buckets)
    if hits is not None:
        hits = hits.withColumn("row_bucket", _bucket(F.col("id"), buckets))
        named = [r.row_bucket for r in hits.select("row_bucket").distinct().collect()]  # as many as there are buckets at most
        rows = rows.filter(F.col("row_bucket").isin(named))
        rows = rows.join(hits.select(F.col("id").alias("_hit")), rows[key].eqNullSafe(F.col("_hit")), "left_semi")
    return search(rows.drop("row_bucket"), text=text)
