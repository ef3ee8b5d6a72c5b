"""Helpers that several operations share: the job's folder, tables that cut lineage, Arrow text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_C = ctypes.CDLL(None)
_FOLDER = "spark.terrier.folder"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of texts where the session doesn't say; Spark's own bound lets a task hold several times 64 MB.
BATCH_BYTES = 8 << 20


def job_folder(spark: SparkSession) -> str:
    """The session's own folder in the shared one that the cluster names in ``spark.checkpoint.dir``. It is removed when the driver ends.

    Where the setting is missing, a local master takes a temporary folder; a cluster, whose executors couldn't see that, gets an error.
    """
    context = spark.sparkContext
    found = spark.conf.get(_FOLDER, None)
    if found:
        return found
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    found = f"{shared.rstrip('/')}/{context.applicationId}-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    spark.conf.set(_FOLDER, found)
    return found


def clear(spark: SparkSession) -> None:
    """Remove the tables that operations of this session wrote; frames that read them can't be used any more."""
    found = spark.conf.get(_FOLDER, None)
    if found:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        spark.conf.unset(_FOLDER)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the job's folder and read it again: later stages restart from files, not from lineage."""
    spark = df.sparkSession
    path = f"{job_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(texts: DataFrame) -> DataFrame:
    """``texts`` as they are, in a session that hands them to Python in batches of about ``BATCH_BYTES``, unless it has a bound of its own. A longer text is a batch by itself."""
    conf = texts.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return texts


def blobs(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """UTF-8 bytes of a text column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def runs_of_rows(column: pa.LargeBinaryArray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``most`` bytes of text; a longer text is a run by itself."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def release() -> None:
    """Give what Arrow and numpy no longer use back to the machine; Spark keeps a worker, and its memory, for the next stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):  # of glibc
        _C.malloc_trim(0)


def flat(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and where each row starts (one more entry: the end)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def n_words(text) -> F.col:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; null has none, an empty text neither; all of a text counts, however long."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fixed(parts: int | None, spark: SparkSession) -> int:
    """Number of partitions: the caller's, or the session's ``spark.sql.shuffle.partitions``, which is to be set for the data's size."""
    return parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
