"""Certificates stored as variants: a document of any shape in one column, read by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_certificates(df: DataFrame, folder: str, certificate: str = "certificate") -> None:
    """``df`` with its certificates as variants; a null certificate stays null. Fields may be added later without a change of schema."""
    df.withColumn(certificate, F.to_variant_object(certificate)).write.mode("append").parquet(folder)


def read_certificates(spark: SparkSession, folder: str, paths: dict[str, tuple[str, str]], certificate: str = "certificate") -> DataFrame:
    """The stored rows with a column for each of ``paths`` (name: path, type); null where a certificate lacks the path or it is of another type."""
    got = spark.read.parquet(folder)
    return got.withColumns({name: F.try_variant_get(certificate, path, kind) for name, (path, kind) in paths.items()}).drop(certificate)
