"""Report and result tables as shown to readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions import text

COUNTS = {"expected_items": "expected", "predicted_items": "found", "matched_items": "matched"}
LISTS = {"missing_items": "missing", "extra_items": "extra"}
PUBLIC = ("id", "representative_keyword", "grouped_keywords", "context_text", "exact_information", "page", "source")


def field(df: DataFrame, name: str, kind: str = "double") -> Column:
    """A column that older or newer reports may lack."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def report_summary(reports: DataFrame) -> DataFrame:
    """A4: one row a report (filename and the report's fields): new-style fields, else their old-style names, else 0.

    `summary` is a struct of the new-style counts; old reports hold expected, found, matched and the arrays
    missing and extra. Columns that no report has may be absent.
    """
    inner = reports.schema["summary"].dataType.names if "summary" in reports.columns else []
    new = lambda c: F.col(f"summary.{c}").cast("bigint") if c in inner else F.lit(None).cast("bigint")
    listed = lambda c: F.when(F.col(c).isNotNull(), F.size(c)) if c in reports.columns else F.lit(None)
    zero = F.lit(0)
    return reports.select(
        "filename", field(reports, "document_name", "string").alias("document_name"), field(reports, "processing_time_seconds").alias("processing_time_seconds"),
        F.coalesce(field(reports, "overall_accuracy_percent"), field(reports, "accuracy_percent")).alias("overall_accuracy_percent"),
        *[F.coalesce(field(reports, c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        *[F.coalesce(new(c), field(reports, old, "bigint"), zero).cast("bigint").alias(c) for c, old in COUNTS.items()],
        *[F.coalesce(new(c), listed(old), zero).cast("bigint").alias(c) for c, old in LISTS.items()],
    )


def number_of(filename: Column) -> Column:
    """The number before the first underscore of a file name; 0 where there is none."""
    prefix = F.split(filename, "_")[0]
    return F.when(prefix.rlike("^[0-9]{1,18}$"), prefix.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def percent(x: Column) -> Column:
    """Two decimals and a percent sign; null counts as 0."""
    return F.format_string("%.2f%%", F.coalesce(x.cast("double"), F.lit(0.0)))


def with_runs(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Reports with the run of their number (runs: number, result_file, truth_file), null where there is none."""
    return reports.withColumn("number", number_of(F.col("filename"))).join(runs, "number", "left")


def public_items(items: DataFrame, keyed: bool = True) -> DataFrame:
    """The fields of an item that a report shows; missing and extra items also show their key."""
    grouped = F.coalesce("grouped_keywords", text.no_strings()).alias("grouped_keywords")
    return items.select("eval_id", "idx", *[grouped if c == "grouped_keywords" else c for c in PUBLIC], *(["normalized_key"] if keyed else []))


def performance(results: DataFrame) -> DataFrame:
    """A10: seconds a page, a segment and a keyword group, null for none of them, in order of time."""
    rate = lambda c: F.round(F.try_divide(F.col("processing_time_seconds"), F.when(F.col(c) != 0, F.col(c))), 2)
    rows = results.select(
        "filename", "document_name", "processing_time_seconds", "total_pages", "total_segments", "total_keyword_groups",
        rate("total_pages").alias("seconds_per_page"), rate("total_segments").alias("seconds_per_segment"), rate("total_keyword_groups").alias("seconds_per_keyword_group"),
    )
    return rows.orderBy(F.col("processing_time_seconds").asc_nulls_last(), "filename")


def finished(jobs: DataFrame) -> DataFrame:
    """jobs whose result can be opened."""
    return jobs.filter(F.col("status").isin("success", "cached") & text.blank_to_null(F.col("output_path")).isNotNull())


def preview(names: Column, most: int = 8) -> Column:
    """the first names that are shown."""
    return F.slice(F.coalesce(names, text.no_strings()), 1, most)


def beginning(x: Column, full: bool = False, most: int = 1000) -> Column:
    """The first `most` characters, or all."""
    return x if full else F.substring(x, 1, most)


def shortened(x: Column, most: int = 260) -> Column:
    """White space squeezed, cut to `most` characters with three dots."""
    clean = text.squeeze(x)
    return F.when(F.length(clean) > most, F.concat(F.regexp_replace(F.substring(clean, 1, most - 3), r"(?U)\s+$", ""), F.lit("..."))).otherwise(clean)


def joined_names(names: Column) -> Column:
    """Names joined by commas, white space squeezed, each once whatever its case, blank ones left out."""
    clean = F.filter(F.transform(F.coalesce(names, text.no_strings()), text.squeeze), lambda s: s != "")
    once = F.aggregate(clean, text.no_strings(), lambda acc, s: F.when(F.exists(acc, lambda a: text.folded(a) == text.folded(s)), acc).otherwise(F.array_append(acc, s)))
    return F.array_join(once, ", ")


def page_samples(pages: DataFrame, full: bool = False, most: int = 1000) -> DataFrame:
    """Pages with their text's length and its beginning."""
    return pages.select("doc_id", "page", F.length("text").alias("text_length"), beginning(F.col("text"), full, most).alias("text"))


def segment_samples(segments: DataFrame) -> DataFrame:
    """Segments as they are looked at: id, title, page, metadata and whole text."""
    meta = F.struct("source", "parent_section_title", "token_count", "chunk_index", "chunk_total", "is_continuation")
    return segments.select("doc_id", "segment_id", "title", "page", meta.alias("metadata"), "text")
