"""Exports: compact result rows, JSON output, ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions import text


def primary(g, field: str) -> Column:
    """H11"""
    return text.blank_to_null(F.get(g["evidences"], 0)[field])


def exact_text(g) -> Column:
    """K3: the group's, else its evidence's; the context only for groups without any evidence."""
    bare = F.coalesce(F.size(g["evidences"]), F.lit(0)) <= 0
    return F.coalesce(text.blank_to_null(g["exact_text"]), primary(g, "exact_text"), F.when(bare, text.blank_to_null(g["context_text"])))


def compact_groups(groups: DataFrame) -> DataFrame:
    """K2 to K4: the five exported fields; empty ones are null, which to_json leaves out."""
    g = {c: F.col(c) for c in groups.columns}
    related = F.when(F.size("related_keywords") > 0, F.col("related_keywords"))
    meta = F.struct(F.coalesce(F.col("meta.page"), F.get("evidences", 0)["page"]).alias("page"), F.col("meta.clause_no").alias("clause_no"))
    meta = F.when(meta["page"].isNotNull() | meta["clause_no"].isNotNull(), meta)
    return groups.select("doc_id", "pos", text.blank_to_null(F.col("representative_keyword")).alias("representative_keyword"), related.alias("related_keywords"), F.coalesce(text.blank_to_null(F.col("context_text")), primary(g, "context_text")).alias("context_text"), exact_text(g).alias("exact_text"), meta.alias("metadata"))


FIELDS = ("representative_keyword", "related_keywords", "context_text", "exact_text", "metadata")


def results(groups: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row a document: total_keyword_groups and the ordered groups (and stats by doc_id)."""
    compact = compact_groups(groups)
    rows = compact.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *FIELDS))).alias("gs"))
    rows = rows.select("doc_id", F.size("gs").alias("total_keyword_groups"), F.transform("gs", lambda g: F.struct(*[g[c].alias(c) for c in FIELDS])).alias("keyword_groups"))
    return rows if stats is None else stats.join(rows, "doc_id", "left")


def write_results(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: JSON lines, one document a line."""
    rows.write.mode(mode).json(path)


def ground_truth(groups: DataFrame) -> DataFrame:
    """The six fields of a truth entry."""
    compact = compact_groups(groups)
    return compact.join(groups.select("doc_id", "pos", "provision_type"), ["doc_id", "pos"])


def is_json_upload(name: Column, content: Column) -> Column:
    """K13"""
    return F.lower(name).endswith(".json") & F.try_parse_json(content).isNotNull()
