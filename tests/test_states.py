"""Scan states as a stream with state and timers, and as a batch."""

import datetime as dt
import random

import pytest

from reuselens.operators import catalogue
from reuselens.sources import files
from reuselens.streaming import feed, states

SCHEMA = "scan_id long, event_id long, ts timestamp, event string"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def some_events(rng, first, n):
    return [(rng.randrange(4), first + k, START + dt.timedelta(seconds=first + k), rng.choice(catalogue.STATES)) for k in range(n)]


def folded(events):
    status, out = {}, set()
    for i, e, ts, event in sorted(events, key=lambda r: (r[2], r[1])):
        ok = event in catalogue.TRANSITIONS[status.get(i, "Idle")]
        status[i] = event if ok else status.get(i, "Idle")
        out.add((i, e, ts, event, status[i], ok))
    return out


def run(spark, tmp_path, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = states.scan_states(stream, **more).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_a_restart_goes_on(rocks, tmp_path):
    rng, every = random.Random(1), []
    for part in range(4):
        events = some_events(rng, 100 * part, 60)
        every += events
        rocks.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part in (1, 3):
            got = run(rocks, tmp_path)
            assert got == folded(every)
    batch = catalogue.status_log(rocks.createDataFrame(every, SCHEMA)).select("scan_id", "event_id", "ts", "event", "status", "accepted")
    assert {tuple(r) for r in batch.collect()} == got


def test_a_silent_scan_is_aborted(rocks, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    for events in ([(1, 1, at(0), "Started"), (1, 2, at(1), "Running"), (2, 3, at(1), "Started")], [(2, 4, at(200), "Running")], [(2, 5, at(230), "Finished")], [(3, 6, at(400), "Started")], [(3, 7, at(401), "Aborted")]):
        rocks.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run(rocks, tmp_path, patience=60, late="0 seconds")
    assert (1, None, at(61), "Aborted", "Aborted", True) in got
    assert {r[4] for r in got if r[0] == 2} == {"Started", "Running", "Finished"} and len(got) == 8


def test_the_table_before_its_first_version(spark, tmp_path):
    assert feed.latest(spark, str(tmp_path / "nothing")).count() == 0
    assert feed.latest(spark, str(tmp_path / "nothing"), "k string, at long").columns == ["k", "at"]


def test_what_is_left_out_is_told(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("small.c", "int x;")
        z.writestr("large.c", "x" * 2000)
    assert [(r.path, r.bytes) for r in files.skipped_zips(spark, str(tmp_path), 1000).collect()] == [("large.c", 2000)]
    assert [r.path for r in files.scan_zips(spark, str(tmp_path), 1000).collect()] == ["small.c"]
    assert files.scan_zips(spark, str(tmp_path), None).count() == 2
    buffers = {"a.cpp": "int x;", "b.cpp": "y" * 50, "c.bin": "z"}
    assert [r.path for r in files.scan_buffers(spark, buffers, 20).collect()] == ["a.cpp"]
    assert [r.path for r in files.oversized(spark.createDataFrame(list(buffers.items()), "path string, content string"), 20).collect()] == ["b.cpp"]
