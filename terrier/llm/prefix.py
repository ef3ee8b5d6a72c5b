"""Global prefix sums: running sums inside range partitions, shifted by the totals of the partitions before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.shared import fixed, stored


def with_prefix(table: DataFrame, keys: list[Column], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Add to each row of the written ``table``, in the order of ``keys``: ``row_index`` and, for each name in
    ``sums``, the sum of that column over all rows before; ``<name>_total`` is the sum over all rows.

    Rows that tie in all keys are ordered by their place in the table, so one key that holds most rows is still
    cut into even ranges. What is gathered in one place is one row of totals for each partition.
    """
    placed = table.withColumn("_place", F.monotonically_increasing_id())
    dealt = stored(placed.repartitionByRange(fixed(parts, table.sparkSession), *keys, "_place").withColumn("_part", F.spark_partition_id()), "ranges")
    whole = Window.orderBy("_part")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    shifts = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        *[x for k in sums for x in (F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_before"), F.sum(f"_{k}").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{k}_total"))],
    )
    inside = Window.partitionBy("_part").orderBy(*keys, "_place")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({"row_index": F.row_number().over(inside) - 1} | {k: F.sum(c).over(run) - F.col(c) for k, c in sums.items()})
    out = out.join(F.broadcast(shifts), "_part")  # one row for each partition
    out = out.withColumns({"row_index": F.col("row_index") + F.col("_n_before")} | {k: F.col(k) + F.col(f"_{k}_before") for k in sums})
    return out.drop("_place", "_part", "_n_before", *[f"_{k}_before" for k in sums])
