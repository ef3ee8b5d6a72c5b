import datetime
import random

from pyspark.sql import functions as F

from terrier.streaming import runs

START = datetime.datetime(2025, 1, 1)
SCHEMA = "event_id long, id long, at timestamp, kind string"


def plain(events, until, limit):
    """The history of every document, event by event."""
    first = {}
    for number, i, at, kind in events:
        if None not in (number, i, at) and kind in runs.STATUS and at <= until and (number not in first or (at, i, kind) < first[number]):
            first[number] = (at, i, kind)
    out = []
    for i in {i for _, i, _ in first.values()}:
        status, since = None, None
        own = sorted((at, number, kind) for number, (at, j, kind) in first.items() if j == i)
        for k, (at, number, kind) in enumerate([*own, (until, None, None)]):
            if status == "PROCESSING" and (since + limit < at or kind is None and since + limit <= until):
                out.append((i, since + limit, "FAILED", status, None))
                status = "FAILED"
            to = runs.STATUS.get(kind)
            if kind is None or to == "PENDING" and k:
                continue
            since = at if to == "PROCESSING" else since
            if to != status:
                out.append((i, at, to, status, number))
                status = to
    return sorted(out, key=str)


def some_events(rng, n):
    at = lambda k: START + datetime.timedelta(minutes=k * 3 + rng.choice([0, 0, 1]), microseconds=rng.randrange(1000) * 1000)
    return [(k, rng.randrange(9), at(k), rng.choice(["upload", "start", "start", "done", "error", "seen"])) for k in range(n)]


def test_history(spark):
    rng = random.Random(4)
    events = some_events(rng, 300)
    events += [rng.choice(events) for _ in range(20)] + [(None, 1, START, "start"), (900, None, START, "start"), (901, 1, None, "start"), (902, 50, START, "upload"), (903, 51, START, "start"), (904, 51, START + datetime.timedelta(minutes=40), "done")]
    for limit in (60, 2400):
        until = START + datetime.timedelta(minutes=700)
        got = runs.history(spark.createDataFrame([(*e, 1) for e in events], SCHEMA + ", status int"), until, limit).collect()
        assert sorted(map(tuple, got), key=str) == plain(events, until, datetime.timedelta(seconds=limit))
    assert {r.status for r in got if r.id == 51} == {"PROCESSING", "DIGITIZED"}  # a result at the very end of the limit is in time
    assert runs.history(spark.createDataFrame([], SCHEMA), None).count() == 0


def streamed(spark, tmp_path, batches, late, limit):
    """What the stream has given out after each of the batches, a file each."""
    source, out, told = tmp_path / "in", tmp_path / "out", []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = runs.followed(spark.readStream.schema(SCHEMA).parquet(f"file://{source}"), late, limit)
        stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{out}").awaitTermination()
        told.append(sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"file://{out}").collect()), key=str) if k >= 0 else [])
    return told


def test_stream_gives_what_the_batch_does(spark, tmp_path):
    rng, limit, late = random.Random(6), 1500, 10
    events = some_events(rng, 160)
    batches = [events[a : a + 40] for a in range(0, 160, 40)]
    for a, b in zip(batches, batches[1:], strict=False):  # out of order, and over the edge of a batch
        a[-1], b[0] = b[0], a[-1]
        rng.shuffle(a)
        b.append(a[-1] if a[-1][2] > max(e[2] for e in a) - datetime.timedelta(minutes=late) else b[0])  # one comes twice
    told = streamed(spark, tmp_path, batches, f"{late} minutes", limit)
    seen = []
    for batch, got in zip(batches, told, strict=True):
        seen += batch
        last = max(e[2] for e in seen if e[3] in runs.STATUS) - datetime.timedelta(minutes=late)
        assert got == plain([e for e in seen if e[2] <= last], last, datetime.timedelta(seconds=limit))
    assert any(r[4] is None for r in told[-1]) and len(told[0]) < len(told[-1])


def test_a_crashed_run_is_told_by_the_clock_of_others(spark, tmp_path):
    minute = lambda m: START + datetime.timedelta(minutes=m)
    batches = [[(1, 7, minute(0), "start"), (2, 8, minute(1), "upload")], [(3, 8, minute(200), "start")], [(4, 7, minute(201), "done"), (5, 8, minute(30), "error"), (6, 9, minute(500), "upload")]]
    told = streamed(spark, tmp_path, batches, "5 minutes", 3600)
    assert (7, minute(60), "FAILED", "PROCESSING", None) in told[1]  # nothing of 7 itself had come
    want = [(7, minute(0), "PROCESSING", None, 1), (7, minute(60), "FAILED", "PROCESSING", None), (7, minute(201), "DIGITIZED", "FAILED", 4), (8, minute(1), "PENDING", None, 2), (8, minute(200), "PROCESSING", "PENDING", 3), (8, minute(260), "FAILED", "PROCESSING", None)]
    assert told[2] == sorted(want, key=str)  # the error of minute 30 came too late


def test_neighbours_share_a_row_of_the_state(spark, tmp_path):
    rng = random.Random(8)
    ids = [*range(-40, 300), -(1 << 62), (1 << 62) + 1]
    events = [(k, ids[k % len(ids)], START + datetime.timedelta(minutes=rng.randrange(300)), rng.choice(["upload", "start", "done", "error"])) for k in range(900)]
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in (events[:500], events[500:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = runs.followed(spark.readStream.schema(SCHEMA).parquet(source), "6 hours", 3600)
        done = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(out)
        done.awaitTermination()
    spark.createDataFrame([(9999, 7, START + datetime.timedelta(days=1), "start")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    done = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(out)
    done.awaitTermination()
    got = sorted(map(tuple, spark.read.schema(stream.schema).parquet(out).collect()), key=str)
    last = START + datetime.timedelta(hours=18)
    assert got == plain(events, last, datetime.timedelta(hours=1))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress) <= 340 // 32 + 1 + 3


def test_statuses_are_those_of_the_register(spark):
    assert list(runs.STATUS.values()) == ["PENDING", "PROCESSING", "DIGITIZED", "FAILED"]
    assert runs.followed(spark.createDataFrame([], SCHEMA)).filter(F.lit(False)).columns == ["id", "at", "status", "was", "event_id"]
