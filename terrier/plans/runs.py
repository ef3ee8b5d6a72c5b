"""The events table as runs over documents, one for each user: their history of status, in a batch and in a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrier.operators.components import shared_folder
from terrier.plans.registry import query, table
from terrier.streaming import runs

KIND = {"signup": "upload", "view": "start", "purchase": "done", "error": "error"}


def as_runs(events):
    kind = F.col("event_type")
    for said, meant in KIND.items():
        kind = F.when(F.col("event_type") == said, meant).otherwise(kind)
    return events.select("event_id", F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))


def _history_sql(until: str) -> str:
    return f"""WITH ends AS (SELECT {until} AS until FROM events),
e AS (SELECT user_id AS id, ts AS t, event_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'DIGITIZED' WHEN 'error' THEN 'FAILED' END AS status FROM events, ends WHERE ts <= until),
said AS (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY t, event_id) AS next FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, event_id) AS n FROM e WHERE status IS NOT NULL) WHERE n = 1 OR status <> 'PENDING'),
steps AS (SELECT id, t, 1 AS turn, event_id, status FROM said UNION ALL SELECT id, t + INTERVAL 1 HOUR, 2, NULL, 'FAILED' FROM said, ends WHERE status = 'PROCESSING' AND t + INTERVAL 1 HOUR <= until AND (next IS NULL OR next > t + INTERVAL 1 HOUR))
SELECT id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS "at", status, was, event_id FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY t, turn, event_id) AS was FROM steps) WHERE was IS DISTINCT FROM status"""


def _shown(history):
    return history.select("id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "status", "was", "event_id")


@query(_history_sql("max(ts)"))
def doc_status_history(spark, sf_dir):
    events = as_runs(table(spark, sf_dir, "events"))
    return _shown(runs.history(events, events.agg(F.max("at")).first()[0]))


#: What a stream has given out when its last batch is done: all up to its watermark, which is in whole milliseconds.
@query(_history_sql("date_trunc('milliseconds', max(ts) FILTER (WHERE event_type <> 'click')) - INTERVAL 10 MINUTE"))
def doc_status_stream(spark, sf_dir):
    """The events read as a stream until all that is there is done, written as a table and read again."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events")
    # a stream follows a folder: that of the table's files, or the one that its only file is in
    named = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    whole = named.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(named).isDirectory()
    files = spark.readStream.schema(source.schema)
    stream = files.parquet(f"{sf_dir}/events.parquet") if whole else files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    followed = runs.followed(as_runs(stream))
    followed.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return _shown(spark.read.schema(followed.schema).parquet(f"{path}/rows"))
