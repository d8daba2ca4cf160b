"""Life of file jobs as keyed state over a stream of job events (T1, E13, K7 to K9, A3), with timeouts as timers.

events: batch_id, job_id, event, at (timestamp), seq (order of events of one time), stage, error. Kinds of event:
created, started, step, cached, succeeded, failed, retried. Events that don't fit a job's status change nothing: only
a queued job starts, only a processing one steps or ends, only a failed one is retried.

The key is the batch (at most ten files), its state a map from job to status and a value for the batch itself. A batch
has BATCH_HOURS from its first start for the first attempts of its jobs, a retried job has FILE_HOURS of its own. A job
still processing then fails; an event-time timer at the earliest such moment does that where no further event comes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BATCH_HOURS, FILE_HOURS, HOUR = 2, 1, 3_600_000_000
TIMED_OUT = "timed out"
#: Progress that a stage stands for; fixed values.
STEP_PROGRESS = {"load": 10, "normalize": 20, "segment": 30, "llm1": 80, "merge": 93, "coverage": 94, "filter": 94, "local_exact": 95, "llm2": 97, "export": 98}
STEP_UNKNOWN, STARTED, ENDED, MOST = 50, 5, 100, 99

_JOB = "status string, stage string, progress int, started bigint, finished bigint, error string, attempt int"
_BATCH = "started bigint, finished bigint, version bigint"
_FILE = "job_id string, " + _JOB
OUTPUT = f"batch_id string, version bigint, status string, total_files int, queued_count int, processing_count int, succeeded_count int, failed_count int, cached_count int, started bigint, finished bigint, files array<struct<{_FILE.replace(' ', ':').replace(',:', ',')}>>"

_ENDS = {"cached": "cached", "succeeded": "success", "failed": "failed"}


def deadline(job: dict, batch_started: int | None) -> int | None:
    """Microsecond at which a processing job fails."""
    if job["status"] != "processing":
        return None
    return job["started"] + FILE_HOURS * HOUR if job["attempt"] else batch_started + BATCH_HOURS * HOUR


def after(job: dict | None, event: str, at: int, stage: str | None, error: str | None) -> dict | None:
    """The job after an event; the same object if nothing changes."""
    status = job and job["status"]
    if event == "created" and job is None:
        return {"status": "queued", "stage": "queued", "progress": 0, "started": None, "finished": None, "error": None, "attempt": 0}
    if event == "started" and status == "queued":
        return job | {"status": "processing", "stage": "processing", "progress": STARTED, "started": at, "finished": None, "error": None}
    if event == "step" and status == "processing":
        return job | {"stage": stage or "processing", "progress": max(0, min(MOST, STEP_PROGRESS.get(stage, STEP_UNKNOWN)))}
    if event in _ENDS and status == "processing":
        ended = _ENDS[event]
        return job | {"status": ended, "stage": ended, "finished": at, "error": error if ended == "failed" else None, "progress": job["progress"] if ended == "failed" else ENDED}
    if event == "retried" and status == "failed":
        return {"status": "queued", "stage": "queued", "progress": 0, "started": None, "finished": None, "error": None, "attempt": job["attempt"] + 1}
    return job


def expired(jobs: dict[str, dict], batch_started: int | None, now: int) -> set[str]:
    """Fail the jobs whose deadline has come; their ids."""
    late = {j: due for j, job in jobs.items() if (due := deadline(job, batch_started)) is not None and due <= now}
    for j, due in late.items():
        jobs[j] = after(jobs[j], "failed", due, None, TIMED_OUT)
    return set(late)


def rollup(key: str, jobs: dict[str, dict], batch: dict) -> Row:
    """A3: counts, status and times of a batch with its files."""
    n = {s: sum(j["status"] == s for j in jobs.values()) for s in ("queued", "processing", "success", "failed", "cached")}
    total = len(jobs)
    if total and n["success"] + n["failed"] + n["cached"] == total:
        status = "failed" if n["failed"] == total else "completed"
    else:
        status = "processing" if n["processing"] else "queued"
    files = [Row(job_id=j, **job) for j, job in sorted(jobs.items())]
    return Row(batch_id=key, version=batch["version"], status=status, total_files=total, queued_count=n["queued"], processing_count=n["processing"], succeeded_count=n["success"], failed_count=n["failed"], cached_count=n["cached"], started=batch["started"], finished=batch["finished"] if status in ("completed", "failed") else None, files=files)


class Jobs(StatefulProcessor):
    """State of one batch: jobs by id, and when it began and ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", _JOB)
        self.batch = handle.getValueState("batch", _BATCH)

    def _load(self) -> tuple[dict[str, dict], dict]:
        jobs = {k[0]: dict(zip([f.split()[0] for f in _JOB.split(", ")], v, strict=True)) for k, v in self.jobs.iterator()}
        batch = dict(zip(("started", "finished", "version"), self.batch.get(), strict=True)) if self.batch.exists() else {"started": None, "finished": None, "version": 0}
        return jobs, batch

    def _store(self, key: str, jobs: dict[str, dict], changed: set[str], batch: dict) -> Iterator[Row]:
        ends = [j["finished"] for j in jobs.values() if j["status"] in ("success", "failed", "cached")]
        batch["finished"] = max(ends) if ends and len(ends) == len(jobs) else None
        batch["version"] += 1
        for j in changed:
            self.jobs.updateValue((j,), tuple(jobs[j].values()))
        self.batch.update(tuple(batch.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [d for j in jobs.values() if (d := deadline(j, batch["started"])) is not None]
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        yield rollup(key, jobs, batch)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        jobs, batch = self._load()
        changed: set[str] = set()
        for at, _, job_id, event, stage, error in sorted((r.at_us, r.seq, r.job_id, r.event, r.stage, r.error) for r in rows):
            changed |= expired(jobs, batch["started"], at)
            job = after(jobs.get(job_id), event, at, stage, error)
            if job is not jobs.get(job_id):
                if job["status"] == "processing" and batch["started"] is None:
                    batch["started"] = at
                jobs[job_id] = job
                changed.add(job_id)
        if changed:
            yield from self._store(key[0], jobs, changed, batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        jobs, batch = self._load()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        changed = expired(jobs, batch["started"], now * 1000)
        if changed:
            yield from self._store(key[0], jobs, changed, batch)

    def close(self) -> None:
        pass


def batches(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Changes of batches, newest by version; needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    rows = events.select(F.col("batch_id").cast("string").alias("batch_id"), "job_id", "event", "at", "seq", F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("error", F.lit("")).alias("error"), F.unix_micros("at").alias("at_us"))
    rows = rows.filter("batch_id is not null and job_id is not null and event is not null and at is not null")
    return rows.withWatermark("at", delay).groupBy("batch_id").transformWithState(Jobs(), OUTPUT, "Update", "EventTime")


def replay(events: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes") -> DataFrame:
    """Run a finished stream of events through the state to its end and return the last state of each batch.

    A micro-batch that is repeated after a failure overwrites its own folder, so each change is there once.
    """
    spark = events.sparkSession

    def write(changes: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{out}/number={number}")

    query = batches(events, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return newest(spark.read.schema(OUTPUT + ", number int").parquet(out).drop("number"))


def newest(changes: DataFrame) -> DataFrame:
    """The last state of each batch from its changes."""
    last = Window.partitionBy("batch_id").orderBy(F.desc("version"))
    return changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
