"""A document's status from the events of its runs: as a batch plan, and as a stream with timers that gives the same rows.

An event (event_id, id, at, kind) is an upload, a start, a result (done) or an error; other kinds say nothing. A start makes a document
PROCESSING, done DIGITIZED, error FAILED, an upload PENDING if it is the document's first event. A run that has brought nothing after
``limit`` has crashed: the document is FAILED from then on, until another event says otherwise. Events count in the order of
(at, event_id), each once.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUS = {"upload": "PENDING", "start": "PROCESSING", "done": "DIGITIZED", "error": "FAILED"}
LIMIT_SECONDS = 3600
#: Documents whose ids differ in the last so many bits only share a row of the stream's state.
SHARED_BITS = 5
HISTORY = "id long, at timestamp, status string, was string, event_id long"


def _status(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, s in STATUS.items():
        out = F.when(kind == k, s).otherwise(out)
    return out


def history(events: DataFrame, until: datetime.datetime | None, limit: int = LIMIT_SECONDS) -> DataFrame:
    """(id, at, status, was, event_id) of every change of status up to ``until`` (null: none); event_id is null where a run has crashed.

    Events without id, time or number, and those of other kinds, are left out; of a repeated number the earliest counts. One shuffle
    for repeated numbers, one by id. An event at the very end of the limit is in time.
    """
    at, until = F.col("at").cast("timestamp"), F.lit(until).cast("timestamp")
    known = events.filter("id is not null and at is not null and event_id is not null").select(F.col("id").cast("long").alias("id"), at.alias("at"), "event_id", _status(F.col("kind")).alias("status")).filter(F.col("status").isNotNull() & (F.col("at") <= until))
    once = known.groupBy("event_id").agg(F.min(F.struct("at", "id", "status")).alias("e")).select("e.*", "event_id")
    one = Window.partitionBy("id").orderBy("at", "event_id")
    said = once.withColumn("n", F.row_number().over(one)).filter("n = 1 or status <> 'PENDING'").withColumn("next", F.lead("at").over(one))
    end = F.col("at") + F.make_dt_interval(secs=F.lit(limit))
    crashed = (F.col("status") == "PROCESSING") & (end <= until) & (F.col("next").isNull() | (F.col("next") > end))
    own = F.struct("at", F.lit(1).alias("turn"), "event_id", "status")
    crash = F.struct(end.alias("at"), F.lit(2).alias("turn"), F.lit(None).cast("long").alias("event_id"), F.lit("FAILED").alias("status"))
    steps = said.select("id", F.inline(F.when(crashed, F.array(own, crash)).otherwise(F.array(own))))
    return steps.withColumn("was", F.lag("status").over(Window.partitionBy("id").orderBy("at", "turn", "event_id"))).filter(~F.col("was").eqNullSafe(F.col("status"))).select("id", "at", "status", "was", "event_id")


def _follow(limit_us: int):
    def work(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else []
        docs = {i: (status, since, {number: (us, kind) for number, us, kind in waiting}) for i, status, since, waiting in kept}
        for frame in frames:
            for i, number, kind, us in zip(*(frame[c].tolist() for c in ("id", "event_id", "kind", "us")), strict=True):
                pending = docs.setdefault(i, (None, None, {}))[2]
                if number not in pending or us < pending[number][0]:
                    pending[number] = (us, kind)
        now, out, kept, due = state.getCurrentWatermarkMs() * 1000, [], [], []
        for i, (status, since, pending) in docs.items():
            for us, number, kind in sorted((us, number, kind) for number, (us, kind) in pending.items() if us <= now):
                del pending[number]
                if status == "PROCESSING" and since + limit_us < us:
                    out.append((i, since + limit_us, "FAILED", status, None))
                    status = "FAILED"
                to = STATUS[kind]
                if to != "PENDING" or status is None:
                    since = us if to == "PROCESSING" else since
                    if to != status:
                        out.append((i, us, to, status, number))
                        status = to
            if status == "PROCESSING" and since + limit_us <= now:
                out.append((i, since + limit_us, "FAILED", status, None))
                status = "FAILED"
            kept.append((i, status, since, [(number, us, kind) for number, (us, kind) in pending.items()]))
            due += [us for us, _ in pending.values()] + ([since + limit_us] if status == "PROCESSING" else [])
        state.update((json.dumps(kept),))
        if due:  # in whole milliseconds, and never before the watermark
            state.setTimeoutTimestamp(max(-(-min(due) // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "us", "status", "was", "event_id"]).astype({"id": "int64", "us": "int64", "event_id": "Int64"})

    return work


def followed(events: DataFrame, late: str = "10 minutes", limit: int = LIMIT_SECONDS) -> DataFrame:
    """The same rows from a stream of events, each given out when the watermark has passed it: ``late`` after its time at the soonest.

    A document's events wait in the state until then, so they count in their own order however they come; a timer wakes documents of which
    a run is overdue. Events that come later than that are dropped, and so is an event that has been counted. The state holds each document's status and what came within
    ``late``; documents of neighbouring ids share a row of it, as calling Python for a row costs far more than a document's events do.
    """
    known = events.filter("id is not null and at is not null and event_id is not null").filter(F.col("kind").isin(list(STATUS)))
    rows = known.withWatermark("at", late).select(F.col("id").cast("long").alias("id"), "at", F.col("event_id").cast("long").alias("event_id"), "kind", F.unix_micros("at").alias("us"))
    rows = rows.withColumn("shared", F.shiftright("id", SHARED_BITS))
    got = rows.groupBy("shared").applyInPandasWithState(_follow(limit * 1_000_000), "id long, us long, status string, was string, event_id long", "docs string", "append", "EventTimeTimeout")
    return got.select("id", F.timestamp_micros("us").alias("at"), "status", "was", "event_id")
