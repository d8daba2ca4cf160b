"""Job events as a stream: files in order, a restart, timeouts with and without later events, retries."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pactlake.operators import jobs
from pactlake.streaming import lifecycle

EVENT = "batch_id string, job_id string, event string, at timestamp, seq bigint, stage string, error string"
BEGAN = datetime(2024, 5, 1, 8)


@pytest.fixture
def own(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def rows(*events):
    return [(b, j, e, BEGAN + timedelta(minutes=m), i, *(more or (None, None))) for i, (b, j, e, m, *more) in enumerate(events)]


def played(own, folder, *files):
    """Last state of each batch after the files, each a stream run of its own over what has arrived (so: restarts)."""
    for i, events in enumerate(files):
        own.createDataFrame(events, EVENT).coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = own.readStream.schema(EVENT).parquet(f"{folder}/in/*")
        last = lifecycle.replay(stream, f"{folder}/out", f"{folder}/checkpoint")
    return {r["batch_id"]: r for r in last.collect()}


def test_a_batch_runs_to_its_end(own, tmp_path):
    first = rows(("b", "1", "created", 0), ("b", "2", "created", 0), ("b", "3", "created", 0), ("b", "1", "started", 1), ("b", "1", "step", 2, "llm1", None), ("b", "9", "started", 2), ("b", "2", "succeeded", 2))
    found = played(own, tmp_path, first)["b"]
    assert (found["status"], found["total_files"], found["queued_count"], found["processing_count"]) == ("processing", 3, 2, 1)
    one = {f["job_id"]: f for f in found["files"]}["1"]
    assert (one["status"], one["stage"], one["progress"], one["attempt"]) == ("processing", "llm1", 80, 0)
    second = rows(("b", "1", "succeeded", 5), ("b", "2", "started", 5), ("b", "2", "cached", 6), ("b", "3", "started", 6), ("b", "3", "failed", 7, None, "no text"))
    found = played(own, str(tmp_path) + "/again", first, second)["b"]
    assert (found["status"], found["succeeded_count"], found["cached_count"], found["failed_count"]) == ("completed", 1, 1, 1)
    assert found["finished"] - found["started"] == 6 * 60_000_000
    assert {f["job_id"]: (f["progress"], f["error"]) for f in found["files"]} == {"1": (100, None), "2": (100, None), "3": (5, "no text")}


def test_timeouts(own, tmp_path):
    """Two hours for a batch's first attempts, one for a retry; by a timer or, if it comes first, by the next event."""
    first = rows(("a", "1", "created", 0), ("a", "1", "started", 0), ("b", "1", "created", 0), ("b", "2", "created", 0), ("b", "1", "started", 10), ("b", "2", "started", 100))
    second = rows(("a", "1", "succeeded", 121), ("b", "1", "retried", 131), ("b", "1", "started", 132), ("c", "1", "created", 135))
    third = rows(("c", "1", "started", 600))
    states = played(own, tmp_path, first, second)
    assert [(f["status"], f["error"]) for f in states["a"]["files"]] == [("failed", "timed out")] and states["a"]["status"] == "failed"
    two = {f["job_id"]: f for f in states["b"]["files"]}
    assert two["2"]["error"] == "timed out" and two["2"]["finished"] - states["b"]["started"] == 2 * lifecycle.HOUR  # the batch's time, not its own
    assert (two["1"]["status"], two["1"]["attempt"]) == ("processing", 1)
    states = played(own, str(tmp_path) + "/again", first, second, third)
    one = {f["job_id"]: f for f in states["b"]["files"]}["1"]
    assert (one["status"], one["error"], one["finished"] - one["started"]) == ("failed", "timed out", lifecycle.HOUR)  # a timer: no event came
    assert states["b"]["status"] == "failed" and states["c"]["status"] == "processing"


def test_state_equals_the_batch_rollup(spark, own, tmp_path):
    """The streamed counts and status are those of the job table that the stream's files make up."""
    rng = random.Random(4)
    kinds = ["created"] * 3 + ["started"] * 3 + ["step", "succeeded", "failed", "retried", "cached"]
    events = rows(*[(f"b{rng.randrange(9)}", f"j{rng.randrange(3)}", rng.choice(kinds), i) for i in range(240)])
    states = played(own, tmp_path, events[:100], events[100:200], events[200:])
    files = spark.createDataFrame([(b, f["status"]) for b, r in states.items() for f in r["files"]], "batch_id string, status string")
    counts = jobs.status_counts(files)
    total = F.col("queued_count") + F.col("processing_count") + F.col("succeeded_count") + F.col("failed_count") + F.col("cached_count")
    for r in jobs.rollup_status(counts, total).collect():
        assert {k: states[r["batch_id"]][k] for k in r.asDict()} == r.asDict()
    assert len({f["status"] for r in states.values() for f in r["files"]}) >= 3


def test_only_fitting_events_change_a_job():
    at = 7
    queued = lifecycle.after(None, "created", at, None, None)
    assert lifecycle.after(None, "started", at, None, None) is None and lifecycle.after(queued, "created", at, None, None) is queued
    assert all(lifecycle.after(queued, e, at, None, None) is queued for e in ("step", "succeeded", "failed", "cached", "retried"))
    running = lifecycle.after(queued, "started", at, None, None)
    assert lifecycle.after(running, "started", 9, None, None) is running and lifecycle.after(running, "step", 9, "strange", None)["progress"] == 50
    failed = lifecycle.after(running, "failed", 9, None, "boom")
    assert failed["error"] == "boom" and lifecycle.after(failed, "retried", 10, None, None) == queued | {"attempt": 1}


def test_run_log_of_a_stream(spark, tmp_path):
    """Rows and observed metrics of every batch add up to those of the files."""
    import time

    from pactlake.streaming import ingest

    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.txt").write_text("words " * (i + 1))
    log = ingest.RunLog()
    spark.streams.addListener(log)
    try:
        pages = ingest.text_stream(spark, str(tmp_path / "in"), 2).observe("pages", F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
        query = ingest.start(pages, lambda df: df.select("source"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
        query.awaitTermination()
        waited = time.monotonic()
        while not log.ended and time.monotonic() < waited + 20:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    done = [b for b in log.batches if b["rows"]]
    assert [b["rows"] for b in done] == [2, 2, 1] and all(b["seconds"] >= 0 for b in done)
    assert log.totals("pages") == {"n": 5, "chars": 6 * 15} and log.ended[0]["error"] is None
