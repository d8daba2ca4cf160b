"""Keyed tables: whole versions only, interrupted and competing merges, job store, cache with missing outputs."""

import os

import pytest
from pyspark.sql import functions as F

from pactlake.operators import jobs, snapshots
from pactlake.sources import documents

SCHEMA = "id string, value int, note string"


@pytest.fixture
def table(spark, tmp_path):
    return snapshots.KeyedTable(spark, f"file://{tmp_path}/t", ("id",), SCHEMA, buckets=4)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_and_untouched_buckets(spark, table):
    assert table.version() == 0 and table.read().collect() == []
    first = [(str(i), i, None) for i in range(40)]
    assert table.upsert(rows(spark, *first), "value") == 1
    assert content(table.read()) == sorted(first, key=str)
    before = table._places(1)
    assert table.upsert(rows(spark, ("7", 70, "x"), ("7", 71, "y"), (None, 5, "no key")), "value") == 2
    after = table._places(2)
    assert sum(before.get(b) != p for b, p in after.items()) <= 2  # other buckets are shared, not copied
    assert ("7", 71, "y") in content(table.read()) and content(table.read(1)) == sorted(first, key=str)
    assert table.set_fields(spark.createDataFrame([("7", None), ("8", 9), ("new", 1)], "id string, value int")) == 3
    found = {r["id"]: (r["value"], r["note"]) for r in table.read().collect()}
    assert found["7"] == (None, "y") and found["8"] == (9, None) and "new" not in found and len(found) == 41
    assert table.merge(rows(spark).limit(0), lambda old, new: old) == 3  # nothing touched, no version
    assert table.vacuum(keep=1) > 0 and table.versions() == [3] and len(table.read().collect()) == 41


def test_an_interrupted_merge_leaves_the_old_version(spark, table):
    table.upsert(rows(spark, ("a", 1, None), ("b", 2, None)), "value")

    def broken(old, new):
        return old.withColumn("value", F.raise_error(F.lit("lost")).cast("int"))

    with pytest.raises(Exception, match="lost"):
        table.merge(rows(spark, ("a", 5, None)), broken)
    assert table.version() == 1 and content(table.read()) == [("a", 1, None), ("b", 2, None)]
    with pytest.raises(ValueError, match="moved rows"):
        table.merge(rows(spark, ("a", 5, None)), lambda old, new: old.withColumn("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: i.cast("string")))))
    assert table.version() == 1 and table.vacuum() > 0 and content(table.read()) == [("a", 1, None), ("b", 2, None)]
    assert table.upsert(rows(spark, ("a", 5, None)), "value") == 2  # the retry


def test_competing_merges_lose_nothing(spark, table):
    """A writer that finds its version taken starts again from the new one."""
    table.upsert(rows(spark, ("a", 1, None)), "value")
    raced = []

    def rule(old, new):
        if not raced:
            raced.append(table.upsert(rows(spark, ("a", 10, "other")), "value"))
        return old.withColumn("value", F.col("value") + 1)

    assert table.merge(rows(spark, ("a", 0, None)), rule) == 3
    assert content(table.read()) == [("a", 11, "other")]
    assert not [n for n in table._names("versions") if n.startswith(".draft")]

    def always(old, new):
        table.upsert(rows(spark, ("a", 10, "other")), "value")
        return old

    with pytest.raises(snapshots.Conflict):
        table.merge(rows(spark, ("a", 0, None)), always)


def test_job_store(spark, tmp_path):
    store = jobs.JobStore(spark, f"file://{tmp_path}/store", buckets=2)
    batch, files = jobs.create_batch(spark, "b", [("x.txt", "/x", "hx"), ("y.txt", "/y", "hy")], "c", "t0")
    store.create(batch, files)
    store.create(batch, files)
    assert store.jobs.read().count() == 2 and store.batches.read().first()["queued_count"] == 2
    store.update(spark.createDataFrame([("b-0", "processing", "llm1", 400)], "id string, status string, stage string, progress int"), "t1")
    store.update(spark.createDataFrame([("b-1", "failed", "boom")], "id string, status string, error string"), "t1")
    store.refresh("t2")
    one = store.batches.read().first()
    assert (one["status"], one["processing_count"], one["failed_count"], one["started_at"]) == ("processing", 1, 1, "t2")
    by_id = {r["id"]: r for r in store.jobs.read().collect()}
    assert (by_id["b-0"]["progress"], by_id["b-0"]["filename"], by_id["b-1"]["error"]) == (99, "x.txt", "boom")
    store.update(spark.createDataFrame([("b-0", "success", 100)], "id string, status string, progress int"), "t3")
    store.retry(spark.createDataFrame([("b-0",), ("b-1",), ("b-9",)], "id string"), "t3")
    by_id = {r["id"]: r for r in store.jobs.read().collect()}
    assert (by_id["b-0"]["status"], by_id["b-0"]["progress"]) == ("success", 100)  # only failed jobs are retried
    assert (by_id["b-1"]["status"], by_id["b-1"]["error"], by_id["b-1"]["progress"]) == ("queued", None, 0)
    assert [r["id"] for r in jobs.list_jobs(store.jobs.read(), "b", ("queued",)).collect()] == ["b-1"]
    listed = jobs.batches_with_files(store.batches.read(), store.jobs.read()).first()
    assert [f["filename"] for f in listed["files"]] == ["x.txt", "y.txt"]
    entry = lambda now, out: spark.createDataFrame([("hx", "c", out, 1, 2, 3, now, now)], jobs.CACHE)
    store.remember(entry("t4", "/out/1.json"))
    store.remember(entry("t5", "/out/2.json"))
    kept = store.cache.read().collect()
    assert [(r["output_path"], r["created_at"], r["updated_at"]) for r in kept] == [("/out/2.json", "t4", "t5")]


def test_cache_entries_without_output_are_none(spark, tmp_path):
    os.makedirs(tmp_path / "out" / "deep")
    (tmp_path / "out" / "deep" / "a_result.json").write_text("{}")
    cache = spark.createDataFrame([("a", "c", f"{tmp_path}/out/deep/a_result.json"), ("b", "c", f"{tmp_path}/out/b_result.json"), ("d", "c", f"file://{tmp_path}/out/deep/a_result.json")], "file_hash string, config_hash string, output_path string")
    wanted = spark.createDataFrame([(h, "c") for h in "abde"], "file_hash string, config_hash string")
    there = documents.paths_under(spark, f"{tmp_path}/out", "*_result.json")
    found = {r["file_hash"]: r["cached_output"] is not None for r in jobs.probe_cache(wanted, cache, there).collect()}
    assert found == {"a": True, "b": False, "d": True, "e": False}
    assert {r["file_hash"]: r["cached_output"] is not None for r in jobs.probe_cache(wanted, cache).collect()}["b"]
