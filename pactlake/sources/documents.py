"""Scans: text files, page fragments of PDFs, JSON results and reports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlake.functions import text
from pactlake.sources import pdf

PAGE = "doc_id string, source string, page int, page_label string, total_pages int, text string"
SUPPORTED = (".txt", ".pdf")
ROW_GAP = 6.0


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def load_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """L1: pages of text and PDF files, by suffix; missing files and other suffixes raise."""
    found = []
    for kind, scan in ((".txt", text_pages), (".pdf", pdf_pages)):
        if mine := [p for p in paths if PurePosixPath(p).suffix.lower() == kind]:
            found.append(scan(spark, mine))
    if odd := [p for p in paths if PurePosixPath(p).suffix.lower() not in SUPPORTED]:
        raise ValueError(f"unsupported file type: {odd[0]}")
    if not found:
        raise ValueError("no input files")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def text_pages(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Every file is one page."""
    df = spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return df.select(F.col("path").alias("doc_id"), file_name(F.col("path")).alias("source"), F.lit(1).alias("page"), F.lit("1").alias("page_label"), F.lit(1).alias("total_pages"), "text")


def pdf_fragments(spark: SparkSession, paths: list[str] | str, range_bytes: int | None = None) -> DataFrame:
    """L3: (doc_id, source, page, total_pages, plain, x, y, text) of all text fragments (see pactlake.sources.pdf).

    Files are scanned as binary rows, from any store that Spark reads. With range_bytes they are named files of a
    store that pyarrow opens, and those of more bytes are read by several tasks, a range of pages each.
    """
    if range_bytes is not None:
        spark.dataSource.register(pdf.PdfFragments)
        names = json.dumps([paths] if isinstance(paths, str) else list(paths))
        return spark.read.format(pdf.PdfFragments.name()).option("paths", names).option("range_bytes", range_bytes).load()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in pdf.FRAGMENT.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(pdf.fragment_tuples(path, content)), columns=columns)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, pdf.FRAGMENT)


def fragment_rows(fragments: Column, gap: float = ROW_GAP) -> Column:
    """Rows of a page's fragments (x, y, text): top down, joined within the gap of the row's running mean; left to right inside."""
    kind = "array<struct<y:double,items:array<struct<x:double,text:string>>>>"
    ordered = F.array_sort(F.transform(fragments, lambda f, i: F.struct((-f["y"]).alias("down"), f["x"].alias("x"), i.alias("i"), f["text"].alias("text"))))

    def step(acc: Column, f: Column) -> Column:
        y = -f["down"]
        near = F.filter(F.transform(acc, lambda r, i: F.struct(i.alias("i"), F.abs(r["y"] - y).alias("d"))), lambda c: c["d"] <= gap)
        at = F.get(near, 0)["i"]
        item = F.struct(f["x"].alias("x"), f["text"].alias("text"))
        grown = F.transform(acc, lambda r, i: F.when(i == at, F.struct(((r["y"] + y) / 2).alias("y"), F.array_append(r["items"], item).alias("items"))).otherwise(r))
        return F.when(F.size(near) > 0, grown).otherwise(F.array_append(acc, F.struct(y.alias("y"), F.array(item).alias("items")))).cast(kind)

    rows = F.aggregate(ordered, F.expr(f"cast(array() as {kind})"), step)
    return F.transform(rows, lambda r: F.array_join(F.transform(F.array_sort(F.transform(r["items"], lambda t, i: F.struct(t["x"].alias("x"), i.alias("i"), text.squeeze(t["text"]).alias("text")))), lambda t: t["text"]), " "))


def needs_plain(fragments: Column) -> Column:
    """More than 12 words at the bottom edge that are no source footer."""
    low = F.filter(fragments, lambda f: (f["y"] <= 1.0) & ~F.lower(text.squeeze(f["text"])).startswith("source:"))
    return F.coalesce(F.aggregate(low, F.lit(0), lambda a, f: a + text.token_count(f["text"])), F.lit(0)) > 12


def layout_pages(fragments: DataFrame) -> DataFrame:
    """L4: pages whose text follows the layout, or the plain text where that fails."""
    found = fragments.groupBy("doc_id", "source", "page", "total_pages").agg(F.first("plain").alias("plain"), F.collect_list(F.when(text.squeeze(F.col("text")) != "", F.struct("x", "y", "text"))).alias("fs"))
    layout = F.array_join(fragment_rows(F.col("fs")), "\n")
    out = F.when((F.size("fs") == 0) | needs_plain(F.col("fs")), F.coalesce("plain", F.lit(""))).otherwise(layout)
    return found.select("doc_id", "source", "page", F.col("page").cast("string").alias("page_label"), "total_pages", out.alias("text"))


def pdf_pages(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return layout_pages(pdf_fragments(spark, paths))


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file, with its name and modification time."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.select("*", F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_modification_time").alias("modified"))


def safe_name(name: str) -> str:
    """The bare file name; a path out of the folder raises."""
    if not name or name != PurePosixPath(name.replace("\\", "/")).name or name in (".", ".."):
        raise FileNotFoundError(name)
    return name


def numeric_prefix(name: Column) -> Column:
    """R2: the number before the first underscore, last if there is none."""
    head = F.substring_index(name, "_", 1)
    return F.coalesce(F.when(head.rlike(r"^\d+$"), head.try_cast("bigint")), F.lit(10**9).cast("bigint"))


def newest_results(files: DataFrame) -> DataFrame:
    """(number, filename): of the results named N_result.json or N_k_result.json the one modified last."""
    rows = files.withColumn("number", F.regexp_extract("filename", r"^(\d+)(?:_\d+)?_result\.json$", 1)).filter("number <> ''")
    return rows.groupBy("number").agg(F.max_by("filename", F.struct("modified", "filename")).alias("filename"))


def free_names(uploads: DataFrame) -> DataFrame:
    """(upload_id, filename) with stem_1, stem_2, ... where a name comes again; earlier uploads keep theirs."""
    nth = F.row_number().over(Window.partitionBy("filename").orderBy("upload_id")) - 1
    stem, suffix = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 2)
    return uploads.select("upload_id", "filename", F.when(nth == 0, F.col("filename")).otherwise(F.concat(stem, F.lit("_"), nth.cast("string"), suffix)).alias("stored_as"))


def number_of(name: str) -> str | None:
    found = re.match(r"\d+", name)
    return found[0] if found else None


def listing(spark: SparkSession, folder: str, pattern: str = "*_eval_report.json") -> DataFrame:
    """(filename, path, length, modified) of the files of a folder that fit the pattern, by number and name.

    Names only, contents are not read: files without a number come last. A folder without such files gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    prefix = F.split(name, "_")[0]
    number = F.when(prefix.rlike("^[0-9]{1,18}$"), prefix.cast("bigint")).otherwise(F.lit(10**9).cast("bigint"))
    return files.select(name.alias("filename"), "path", "length", F.col("modificationTime").alias("modified")).orderBy(number, "filename")


def paths_under(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files below a folder, however deep; names only, contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))
