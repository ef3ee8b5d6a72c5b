"""Deeds as they arrive: a file stream whose batches are extracted and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrier.functions.scripts import with_script
from terrier.operators.extract import certificates

SCHEMA = "id long, raw_text string, state string, district string, document_type string, ocr_confidence double, arrived timestamp"


def digitised(deeds: DataFrame) -> DataFrame:
    """``deeds`` with script, lang, certificate and status; stateless, so for batches and streams alike."""
    told = with_script(deeds, "raw_text")
    made = certificates(told.withColumn("_row", F.struct(*told.columns)), "_row", "raw_text", F.col("lang"), F.col("script"), F.col("state"), F.col("district"), F.col("document_type"), F.col("ocr_confidence"))
    return made.select("_row.*", "certificate", F.when(F.length("_row.raw_text") > 0, "DIGITIZED").otherwise("FAILED").alias("status"))


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Follow Parquet files under ``source`` and append certificates to ``target`` until what is there is done."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return digitised(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def arrivals(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Deeds by window of arrival and status, with a watermark for late ones."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", window), "status").agg(F.count("*").alias("n"))
