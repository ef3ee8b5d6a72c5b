"""The queries over the given tables, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by its keys, where its files give fewer splits than there are cores; a table of many splits is left as it is.

    By keys rather than in turn, which would sort the rows first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` parted by its keys, however large it is: rows made of its rows that are grouped by them need no other shuffle.

    A split becomes sixteen parts, so that what is made of a part can be sorted in memory.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 16 * df.rdd.getNumPartitions()), *keys)


from terrier.plans import deeds, functions, pages, register, runs, scans  # noqa: E402, F401  they fill the two tables
