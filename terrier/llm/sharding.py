"""Contiguous shards of near-equal bytes, cut from a global prefix sum of sizes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.prefix import with_prefix
from terrier.llm.shared import stored

SHARDS = 8


def shards(docs: DataFrame, n_shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``.

    Rows lie in the order of doc_id (null first), then checksum and size. A row goes to the shard in whose
    equal share of all bytes its middle byte lies, so shards are contiguous and none is off its share by more
    than one row. size: UTF-8 bytes plus 1; a null text has none and the checksum of no bytes. Repeated rows
    stay rows; equal rows take neighbouring slots. An empty table gives no row. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")), "sizes")
    laid = with_prefix(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], {"start": "size"})
    cut = laid.withColumn("shard", F.expr(f"cast((2 * start + size) * {n_shards} div (2 * start_total) as int)"))
    first = cut.groupBy("shard").agg(F.min("row_index").alias("first"))
    return cut.join(F.broadcast(first), "shard").select(  # n_shards rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
