"""Job and cache tables as DataFrames."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.operators.snapshots import BUCKETS, KeyedTable

MAX_FILES, MAX_PARALLEL = 10, 5
JOB = "id string, batch_id string, filename string, input_path string, file_hash string, config_hash string, status string, stage string, progress int, output_path string, total_pages int, total_segments int, keyword_groups int, error string, created_at string, updated_at string, started_at string, finished_at string"
CACHE_KEY = ["file_hash", "config_hash"]


#: The tables of a JobStore: keys and columns.
BATCH = "id string, status string, total_files int, max_parallel_files int, config_hash string, created_at string, updated_at string, started_at string, finished_at string, queued_count bigint, processing_count bigint, succeeded_count bigint, failed_count bigint, cached_count bigint"
CACHE = "file_hash string, config_hash string, output_path string, total_pages int, total_segments int, keyword_groups int, created_at string, updated_at string"


class JobStore:
    """Batches, file jobs and the result cache as keyed tables of a folder; every change is one new version (K5 to K9)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        table = lambda name, keys, schema: KeyedTable(spark, f"{folder.rstrip('/')}/{name}", keys, schema, buckets)
        self.batches, self.jobs, self.cache = table("batches", ("id",), BATCH), table("jobs", ("id",), JOB), table("cache", tuple(CACHE_KEY), CACHE)

    def create(self, batch: DataFrame, jobs: DataFrame) -> None:
        """K5: file jobs first, so that a batch that is there has its files; a repeated call changes nothing."""
        zero = {c: F.lit(0).cast("bigint") for c in ("processing_count", "succeeded_count", "failed_count", "cached_count")}
        absent = lambda old, new: old.unionByName(new.join(old.select("id"), "id", "left_anti").select(*old.columns))
        self.jobs.merge(jobs, absent)
        self.batches.merge(batch.withColumns({"queued_count": F.col("total_files").cast("bigint"), **zero}), absent)

    def update(self, changes: DataFrame, now: str, order: str | None = None) -> int:
        """K7: set fields of file jobs by id; a progress stays within 0 to 99 unless the job has ended."""
        fixed = changes
        if "progress" in changes.columns:
            ended = F.col("status").isin("success", "cached") if "status" in changes.columns else F.lit(False)
            fixed = changes.withColumn("progress", F.when(ended, F.col("progress")).otherwise(progress(F.col("progress"))))
        return self.jobs.set_fields(fixed.withColumn("updated_at", F.lit(now)), order)

    def retry(self, ids: DataFrame, now: str) -> int:
        """K8: the failed ones of the jobs named in ids (id) go back to the queue."""
        return self.jobs.merge(ids.select("id"), lambda old, new: reset_failed(old, new, now))

    def remember(self, rows: DataFrame) -> int:
        """K6: results by file and configuration; an entry that is replaced keeps created_at."""
        return self.cache.upsert(rows, "updated_at", kept=("created_at",))

    def refresh(self, now: str) -> int:
        """K9, A3: counts, status and times of all batches from their jobs."""
        jobs = self.jobs.read()
        return self.batches.merge(self.batches.read().select("id"), lambda old, _: refresh_batches(old, jobs, now).select(*old.columns))


def create_batch(spark: SparkSession, batch_id: str, files: list[tuple[str, str, str]], config_hash: str, now: str, parallel: int = 2) -> tuple[DataFrame, DataFrame]:
    """K5: (batch, file jobs) for files (name, path, hash), all queued."""
    if not 1 <= len(files) <= MAX_FILES:
        raise ValueError(f"a batch holds 1 to {MAX_FILES} files")
    if not 1 <= parallel <= MAX_PARALLEL:
        raise ValueError(f"parallel files must be 1 to {MAX_PARALLEL}")
    batch = spark.createDataFrame([(batch_id, "queued", len(files), parallel, config_hash, now, now, None, None)], "id string, status string, total_files int, max_parallel_files int, config_hash string, created_at string, updated_at string, started_at string, finished_at string")
    jobs = [(f"{batch_id}-{i}", batch_id, name, path, digest, config_hash, "queued", "queued", 0, None, 0, 0, 0, None, now, now, None, None) for i, (name, path, digest) in enumerate(files)]
    return batch, spark.createDataFrame(jobs, JOB)


def progress(x: Column) -> Column:
    """K7: 0 to 99."""
    return F.greatest(F.lit(0), F.least(F.lit(99), x))


def upsert_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """K6: rows replace entries with their key, which keep created_at; the last of several rows for a key wins."""
    fields = [c for c in rows.columns if c not in CACHE_KEY]
    newest = rows.groupBy(*CACHE_KEY).agg(F.max_by(F.struct(*fields), "updated_at").alias("r")).select(*CACHE_KEY, "r.*")
    old = cache.select(*CACHE_KEY, F.col("created_at").alias("_created"))
    merged = newest.join(old, CACHE_KEY, "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")
    return cache.join(newest.select(*CACHE_KEY), CACHE_KEY, "left_anti").unionByName(merged.select(*cache.columns))


def probe_cache(jobs: DataFrame, cache: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Jobs with cached_output, null if their file and configuration are new, or their output is gone.

    existing: (path) of the outputs that are there, as `documents.paths_under` lists them; without it entries are trusted.
    """
    known = cache.select(*CACHE_KEY, F.col("output_path").alias("cached_output"))
    if existing is not None:
        place = lambda c: F.regexp_replace(c, "^file:/+", "/").alias("_place")  # noqa: E731  file:/a and file:///a are /a
        known = known.withColumn("_place", place("cached_output")).join(existing.select(place("path")), "_place", "left_semi").drop("_place")
    return jobs.join(known, CACHE_KEY, "left")


def reset_failed(jobs: DataFrame, ids: list[str] | DataFrame, now: str) -> DataFrame:
    """K8: the named jobs go back to the queue if they failed; ids: a list, or a table with the column id."""
    if isinstance(ids, DataFrame):
        jobs = jobs.join(ids.select("id", F.lit(True).alias("_named")).distinct(), "id", "left")
        named = F.coalesce("_named", F.lit(False))
    else:
        named = F.col("id").isin(*ids)
    hit = named & (F.col("status") == "failed")
    cleared = {"status": F.lit("queued"), "stage": F.lit("queued"), "progress": F.lit(0), "total_pages": F.lit(0), "total_segments": F.lit(0), "keyword_groups": F.lit(0), "updated_at": F.lit(now)}
    empty = {c: F.lit(None).cast("string") for c in ("error", "output_path", "started_at", "finished_at")}
    judged = jobs.withColumn("_hit", hit)
    return judged.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in (cleared | empty).items()}).drop("_hit", "_named")


def status_counts(jobs: DataFrame, batch: str = "batch_id", status: str = "status") -> DataFrame:
    """A3: the counts of the five states of each batch."""
    names = {"queued": "queued_count", "processing": "processing_count", "success": "succeeded_count", "failed": "failed_count", "cached": "cached_count"}
    return jobs.groupBy(batch).agg(*[F.count_if(F.col(status) == s).alias(n) for s, n in names.items()])


def rollup_status(counts: DataFrame, total: Column) -> DataFrame:
    """A3: failed only if all failed; completed once all ended; processing if any; else queued."""
    ended = F.col("succeeded_count") + F.col("failed_count") + F.col("cached_count")
    state = F.when(ended == total, F.when(F.col("failed_count") == total, "failed").otherwise("completed")).when(F.col("processing_count") > 0, "processing").otherwise("queued")
    return counts.withColumn("status", state)


def refresh_batches(batches: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """A3, K9: batches with fresh counts, status and times; a batch without jobs stays as it is."""
    counts = rollup_status(status_counts(jobs).withColumnRenamed("batch_id", "id").join(batches.select("id", "total_files"), "id"), F.col("total_files")).drop("total_files").withColumnRenamed("status", "_status")
    joined = batches.drop("queued_count", "processing_count", "succeeded_count", "failed_count", "cached_count").join(counts, "id", "left").withColumn("status", F.coalesce("_status", "status"))
    ended = F.col("status").isin("completed", "failed")
    started = F.when(F.col("status") == "processing", F.coalesce("started_at", F.lit(now))).otherwise(F.col("started_at"))
    return joined.withColumns({"started_at": started, "finished_at": F.when(ended, F.coalesce("finished_at", F.lit(now))), "updated_at": F.lit(now)}).drop("_status")


def list_jobs(jobs: DataFrame, batch_id: str | None = None, states: tuple[str, ...] = ()) -> DataFrame:
    """L10, O8"""
    rows = jobs if batch_id is None else jobs.filter(F.col("batch_id") == batch_id)
    rows = rows.filter(F.col("status").isin(*states)) if states else rows
    return rows.orderBy("created_at", "id")


def batches_with_files(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each batch with its files in order."""
    files = jobs.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "filename", "status"))).alias("files"))
    return batches.join(files.withColumnRenamed("batch_id", "id"), "id", "left")


def file_hash(content: Column) -> Column:
    """X11"""
    return F.sha2(content, 256)


def config_hash(config: dict, version: str) -> str:
    """sha256 of the sorted compact JSON without keys, plus the version."""
    clean = {k: v for k, v in config.items() if not k.endswith("_api_key")} | {"cache_version": version}
    return hashlib.sha256(json.dumps(clean, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
