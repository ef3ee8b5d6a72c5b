import datetime
import os
import random

from terrier.operators.components import shared_folder
from terrier.sources import changes

DAY = datetime.datetime(2025, 1, 1)


def plain(events):
    """The register after all events in the order of (at, number)."""
    docs = {}
    for at, number, kind, i, fields in sorted(events, key=lambda e: e[:2]):
        if kind == "insert":
            docs[i] = {"title": None, "status": "PENDING", "district": None, "raw_text": None, "updated_at": at} | fields
        elif kind == "delete":
            docs.pop(i, None)
        elif i in docs:
            if kind == "patch":
                docs[i] |= fields
            elif kind == "start":
                docs[i]["status"] = "PROCESSING"
            elif fields["error"]:
                docs[i]["status"] = "FAILED"
            else:
                docs[i] |= {"raw_text": fields["raw_text"], "status": "DIGITIZED" if fields["raw_text"] else "FAILED"}
            if kind != "patch" or fields:
                docs[i]["updated_at"] = at
    return docs


def written(spark, log, events, buckets=8):
    """The events as batches of their kinds."""
    for kind in changes.KINDS:
        own = [e for e in events if e[2] == kind]
        if not own:
            continue
        rows = [(i, at, number, list(f) if kind == "patch" else None, f.get("title"), f.get("district"), f.get("raw_text"), f.get("error")) for at, number, _, i, f in own]
        frame = spark.createDataFrame(rows, "id long, at timestamp, number long, set_fields array<string>, title string, district string, raw_text string, error string")
        changes.append(log, changes.change(frame if kind != "insert" else frame.drop("raw_text", "error"), kind), buckets)


def told(spark, log):
    return {r.id: {"title": r.title, "status": r.status, "district": r.district, "raw_text": r.raw_text, "updated_at": r.updated_at} for r in changes.replayed(spark, log).collect()}


def some_events(rng, n):
    out = []
    for number in rng.sample(range(10_000), n):
        kind = rng.choice(["insert", "insert", "patch", "patch", "start", "result", "delete"])
        fields = {"insert": {"title": f"t{number}", "district": rng.choice([None, "d"])}, "patch": {k: rng.choice([None, f"p{number}"]) for k in rng.sample(["title", "district"], rng.randint(1, 2))}, "result": {"raw_text": rng.choice(["", None, "text"]), "error": rng.choice([None, None, "broke"])}}.get(kind, {})
        out.append((DAY + datetime.timedelta(hours=rng.randrange(30)), number, kind, rng.randrange(25), fields))
    return out


def test_random_changes_late_and_twice(spark, tmp_path):
    rng, log = random.Random(2), f"file://{tmp_path}/log"
    events, seen = some_events(rng, 160), []
    assert changes.replayed(spark, log).count() == 0 and changes.compact(spark, log) == []
    for k in range(4):  # of any time in any batch, some of a batch before once more
        batch = events[k * 40 : k * 40 + 40]
        written(spark, log, batch + rng.sample(seen, min(5, len(seen))))
        seen += batch
        if k % 2:
            changes.compact(spark, log)
        assert told(spark, log) == plain(seen)
    assert changes.compact(spark, log) == [] and told(spark, log) == plain(seen)


def test_compaction_leaves_other_buckets_alone(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    written(spark, log, [(DAY, i, "insert", i, {"title": str(i)}) for i in range(200)])
    first = changes.compact(spark, log)
    assert len(first) == 8
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "log" / "rows") for f in fs if f.endswith(".parquet")}
    before = files()
    written(spark, log, [(DAY + datetime.timedelta(days=1), 900, "patch", 7, {"title": "new"})])
    (touched,) = changes.compact(spark, log)
    after = files()
    kept = {f for f in before if f"bucket={touched}" not in f}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert {f for f in after if f not in before} and all(f"bucket={touched}/" in f for f in set(after) ^ set(before))
    got = told(spark, log)
    assert len(got) == 200 and got[7]["title"] == "new" and got[8]["title"] == "8"


def test_a_stop_between_writing_and_dropping_changes_nothing(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    written(spark, log, [(DAY, 1, "insert", 1, {"title": "a"}), (DAY, 2, "insert", 2, {"title": "b"})])
    changes.folded(changes._read(spark, f"{log}/changes").drop("batch")).write.partitionBy("bucket").parquet(f"{log}/rows")  # the changes are still there
    want = plain([(DAY, 1, "insert", 1, {"title": "a"}), (DAY, 2, "insert", 2, {"title": "b"})])
    assert told(spark, log) == want
    changes.compact(spark, log)
    assert told(spark, log) == want


def test_rows_are_shuffled_and_written_once(spark, tmp_path):
    """An append deals nothing, a fold deals rows before it puts them together, a compaction keeps no second copy."""
    log = f"file://{tmp_path}/log"
    tables = lambda: {d for d, _, _ in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if "/rdd-" in d}
    shared_folder(spark)
    before = tables()
    frame = spark.range(300).coalesce(1).selectExpr("id", "timestamp '2025-01-01' AS at", "id AS number", "concat('t', id) AS title")
    changes.append(log, changes.change(frame, "insert"), 8)
    batch = [f for d, _, fs in os.walk(tmp_path / "log" / "changes") for f in fs if f.endswith(".parquet")]
    assert len(batch) == 1
    assert changes.compact(spark, log) == list(range(8)) and tables() == before
    written(spark, log, [(DAY, 900 + i, "patch", i, {"title": "new"}) for i in range(5)])
    plan = changes.folded(changes._read(spark, f"{log}/changes").drop("batch"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("Aggregate")
    assert changes.compact(spark, log) and tables() == before
    got = told(spark, log)
    assert len(got) == 300 and {i: r["title"] for i, r in got.items()} == {i: "new" if i < 5 else f"t{i}" for i in range(300)}


def test_odd_changes(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    written(spark, log, [(DAY, 1, "patch", 5, {"title": "nobody"}), (DAY, 2, "delete", 6, {}), (None, 3, "insert", 7, {"title": "never"}), (DAY, 4, "insert", None, {"title": "no id"})])
    assert told(spark, log) == {}
    try:
        changes.change(spark.range(1), "merge")
    except ValueError as e:
        assert "merge" in str(e)
    else:
        raise AssertionError
