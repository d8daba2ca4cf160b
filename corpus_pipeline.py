"""Corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm import language_id
from pactlake.llm.common import table, written
from pactlake.llm.decontaminate import decontaminate_rows
from pactlake.llm.mixing import drawn
from pactlake.llm.ngram_join import keep_first
from pactlake.llm.sharding import shard_by_bytes

#: A document of which no language covers this share is rejected.
LEAST_SHARE = 0.3
#: Near copies: words of a shingle, and the least Jaccard similarity in percent (op10_ngram_join has its own).
COPY_WIDTH, COPY_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no letter, or no language with LEAST_SHARE of the words.

    Without any labelled document all with a letter stay.
    """
    training = docs.filter(~F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False)))
    model = language_id.fit(training)
    if not model.langs:  # nothing is labelled, so nothing can be told from the rest
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = language_id.predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("judged")), model, text_col="judged")
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id."""
    return keep_first(docs, width=COPY_WIDTH, percent=COPY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    return decontaminate_rows(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most twice, towards even shares; no document is lost."""
    return drawn(docs).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; slots are shuffled, so that a document's repeats stand apart."""
    return shard_by_bytes(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("sharding", sharding),
]

#: Language identification and components of a similarity graph are beyond SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
