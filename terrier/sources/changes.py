"""The register of documents as a log of changes: appended, folded when it is read, and compacted a bucket at a time.

A change (id, at, kind, set_fields and the columns it sets) goes to one of ``buckets`` by its id. What is read is a fold: of each
column the value of the last change that set it, by (at, number), since the document was last inserted; deleted documents are gone.
Every change keeps the stamps of the columns it sets, and a compacted row those of the changes that won, so folding is
idempotent: a change may come late, come twice, or be read beside the row it is already part of. Compaction writes
only the buckets that have changes since the last one; the files of others stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrier.sources.uploads import table_schema

BUCKETS = 64
#: Files of a bucket: its rows are dealt by id, so that no task sorts a whole bucket.
PARTS = 8
#: The columns that changes set; id is the key, and what dates a document follows from its changes.
KEPT = ("id", "created_at", "updated_at")
KINDS = ("insert", "patch", "start", "result", "delete")
RESULTS = ("processed_file_path", "detected_language", "detected_script", "raw_text", "ocr_confidence", "extracted_data")
_STAMP = "struct<at:timestamp,number:long>"


def columns() -> dict[str, str]:
    """Name and type of every column that a change can set."""
    return {f.name: f.dataType.simpleString() for f in table_schema().fields if f.name not in KEPT}


def _stamp() -> Column:
    return F.struct(F.col("at").cast("timestamp").alias("at"), F.col("number").cast("long").alias("number"))


def change(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (id, at, number, columns of the kind) as changes, with a stamp for each column that they set.

    insert sets all columns (status PENDING where it isn't given), patch those that its array set_fields names, start the status; result sets the
    result's columns and DIGITIZED where there is text, and only FAILED where ``error`` isn't null or there is none; delete sets none.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is no kind of change")
    has, typed = rows.columns, columns()
    value = {c: F.col(c).cast(t) if c in has else F.lit(None).cast(t) for c, t in typed.items()}
    sets = {c: F.lit(kind == "insert") for c in typed}
    if kind == "insert":
        value["status"] = F.coalesce(value["status"], F.lit("PENDING"))
    elif kind == "patch":
        sets = {c: F.coalesce(F.array_contains("set_fields", c), F.lit(False)) for c in typed}
    elif kind == "start":
        value["status"], sets["status"] = F.lit("PROCESSING"), F.lit(True)
    elif kind == "result":
        fine = F.col("error").isNull() if "error" in has else F.lit(True)
        value["status"], sets["status"] = F.when(fine & (F.length(value["raw_text"]) > 0), "DIGITIZED").otherwise("FAILED"), F.lit(True)
        sets |= {c: fine & F.lit(c in has) for c in RESULTS}
    out = rows.select(F.col("id").cast("long").alias("id"), F.lit(kind).alias("kind"), _stamp().alias("stamp"), *[F.struct(v.alias("value"), F.when(sets[c], _stamp()).alias("stamp")).alias(c) for c, v in value.items()])
    marks = {"born": F.when(F.col("kind") == "insert", F.col("stamp")), "died": F.when(F.col("kind") == "delete", F.col("stamp"))}
    return out.withColumns(marks).drop("kind")


def schema() -> StructType:
    """Columns of the log and of the compacted table."""
    return StructType.fromDDL(f"id long, stamp {_STAMP}, " + ", ".join(f"{c} struct<value:{t},stamp:{_STAMP}>" for c, t in columns().items()) + f", born {_STAMP}, died {_STAMP}")


def append(log: str, changes: DataFrame, buckets: int = BUCKETS) -> None:
    """Add changes to the log as a batch of its own, without a shuffle; nothing that is there is read or written. Changes without an id or a time are nobody's and left out."""
    kept = changes.filter("id is not null and stamp.at is not null").withColumns({"bucket": F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"), "batch": F.lit(uuid.uuid4().hex)})
    kept.write.mode("append").partitionBy("batch").parquet(f"{log}/changes")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder) or not any(s.isDirectory() for s in files.listStatus(folder)):
        return None
    return spark.read.schema(StructType([*schema().fields, *StructType.fromDDL("bucket int, batch string").fields])).option("basePath", path).parquet(path)


def folded(rows: DataFrame) -> DataFrame:
    """One row for each bucket and id: of every column the last value that was set, with its stamp. Every insert sets all columns, so no value is older than it.

    One shuffle, of the rows as they are: their fold would carry every stamp twice. What comes out lies by bucket, in at most ``PARTS`` tasks of each.
    """
    marks = [F.max(c).alias(c) for c in ("stamp", "born", "died")]
    dealt = rows.withColumn("part", F.pmod(F.hash("id"), F.lit(PARTS))).repartition("bucket", "part")
    return dealt.groupBy("bucket", "part", "id").agg(*marks, *[F.max_by(c, F.col(c)["stamp"]).alias(c) for c in columns()]).drop("part")


def compact(spark: SparkSession, log: str) -> list[int]:
    """Fold the log's changes into the compacted table and drop them from the log; the buckets that were written, at most as many as there are.

    If it stops half way, what is read is the same: a change that is in both counts once.
    """
    changes = _read(spark, f"{log}/changes")
    if changes is None:
        return []
    batches = [r.batch for r in changes.select("batch").distinct().collect()]  # one for each call of append since the last compaction
    touched = sorted(r.bucket for r in changes.select("bucket").distinct().collect())
    old = _read(spark, f"{log}/rows")
    rows = changes.drop("batch") if old is None else changes.drop("batch").unionByName(old.drop("batch").filter(F.col("bucket").isin(touched)))
    # buckets are replaced when all tasks are done, so those that are read can be written
    folded(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{log}/rows")
    for batch in batches:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/changes/batch={batch}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return touched


def replayed(spark: SparkSession, log: str) -> DataFrame:
    """The register as the log and the compacted table say: the columns of ``table_schema``.

    created_at is the time of the last insert, updated_at that of the last change. Changes to a document that isn't there, or is deleted, do nothing.
    """
    parts = [p.drop("batch") for p in (_read(spark, f"{log}/rows"), _read(spark, f"{log}/changes")) if p is not None]
    if not parts:
        return spark.createDataFrame([], table_schema())
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    alive = folded(rows).filter("born is not null and (died is null or died < born)")
    last = F.greatest(F.col("born"), *[F.col(c)["stamp"] for c in columns()])["at"]
    made = {c: F.col(c)["value"] for c in columns()} | {"created_at": F.col("born.at"), "updated_at": last}
    return alive.select("id", *[made[f.name].alias(f.name) for f in table_schema().fields if f.name != "id"])
