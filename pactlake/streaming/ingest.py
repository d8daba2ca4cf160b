"""Streaming ingest (T1, T2): new text files of a folder become pages, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from pactlake.sources.documents import file_name


def text_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Pages of the text files that arrive in a folder."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("doc_id"), file_name(path).alias("source"), F.lit(1).alias("page"), F.lit("1").alias("page_label"), F.lit(1).alias("total_pages"), F.col("value").alias("text"))


def start(pages: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False):
    """Run `process` on every batch of pages and append its rows to Parquet under batch=<id>.

    A batch that is repeated after a failure overwrites its own folder, so each row is written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(query) -> list[dict]:
    """Batches done so far with their input rows."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]

class RunLog(StreamingQueryListener):
    """T4: what the batches of streams report: number, rows, seconds and observed metrics; no job of its own.

    spark.streams.addListener(log); a stream's metrics come from DataFrame.observe under their name.
    """

    def __init__(self) -> None:
        self.batches: list[dict] = []
        self.ended: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.batches.append({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000, "metrics": seen})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append({"query": str(event.id), "error": event.exception})

    def totals(self, metrics: str) -> dict[str, float]:
        """Sums of the metrics of one name over all batches."""
        out: dict[str, float] = {}
        for batch in self.batches:
            for k, v in batch["metrics"].get(metrics, {}).items():
                out[k] = out.get(k, 0) + (v or 0)
        return out
