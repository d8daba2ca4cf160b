"""Suffix dedup: remove every byte covered by a `length`-byte string that starts anywhere else as well.

All `length`-byte prefixes of suffixes are compared, by names instead of bytes. Positions are sampled by
content: the smallest hash among the `gram`-byte strings of a window is the window's sample, so equal windows
have their sample at the same place inside them (a residue cover would sample the same way at a fixed rate,
with many more rows). Window starts are then named in cells, by sample and distance to it:

1. every cell of `CELLS[0]` neighbouring starts gets the name of what all its windows share (inner) and the
   name of all that they span (outer, with how the text's ends cut it);
2. an inner name that occurs once rules out all starts of the cell; an outer name that occurs again settles
   that all of them repeat;
3. the cells left over, and one representative of every different outer name beside them, are cut into
   smaller cells and named again, down to single starts, whose name is that of the window itself.

Names are 64-bit hashes, counted and joined in Spark with partial aggregation, so a passage with thousands
of copies is settled by one count. Removed spans are the unions of the repeating windows, judged on the input.

The same pass names windows of `passage` words (A-Z folded, parted by ASCII white space), with words in the
bytes' place, to count the words of passages that other documents hold as well. Those are reported and not
removed, as they may be shorter than `length` bytes. Here a cell is settled only if two documents hold it, so what a
text repeats within itself does not count; rows with equal id and text are one document.

Null text counts as empty. Texts shorter than `length` lose nothing. Exact copies of a long enough text are
removed whole, all of them. Repeated rows are copies too. An empty table gives no rows. Other input columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm import bytewise
from pactlake.llm.common import discard, written

LENGTH, GRAM = 400, 32
#: Words of a passage, and of the strings that are its samples.
PASSAGE, PASSAGE_GRAM = 50, 16
#: What a name's window is made of; SEVERAL: words, in a cell that stands for those of several documents.
BYTES, WORDS, SEVERAL = 0, 1, 3
#: Starts in a cell, level by level.
CELLS = {BYTES: (128, 16, 1), WORDS: (35, 5, 1)}
LEVELS = 3
#: at: the sample's place a, kind and cell c, as a << 20 | kind << 16 | c.
_NAMES = "id bigint, h int, at bigint, inner bigint, outer bigint"


class Rule(NamedTuple):
    """Windows of so many bytes or words, sampled by strings of gram."""

    kind: int
    length: int
    gram: int


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def cell_names(prefix: np.ndarray, a: np.ndarray, c: np.ndarray, base: np.ndarray, end: np.ndarray, cell: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Inner and outer names of the cells c (of so many starts) of samples a in rows base:end."""
    high = a - c * cell
    low = high - (cell - 1)
    salt = bytewise.mixed((c + 1).astype(np.uint64) | np.uint64(rule.kind << 32))
    inner = bytewise.span_hashes(prefix, high, low + rule.length) ^ salt
    first, last = np.maximum(low, base), np.minimum(high + rule.length, end)
    cut = ((first - low) * 4096 + (high + rule.length - last)).astype(np.uint64)
    outer = bytewise.mixed(bytewise.span_hashes(prefix, first, last) ^ salt ^ bytewise.mixed(cut))
    return inner.view(np.int64), outer.view(np.int64)


def batch_of(ids, hs, at, inner, outer) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    columns = [pa.array(x, t) for x, t in zip((ids, hs, at, inner, outer), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["id", "h", "at", "inner", "outer"])


def unit_prefix(rule: Rule, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes over the bytes or words of the rows at offsets, and the rows' bounds in those."""
    if rule.kind == BYTES:
        return bytewise.prefix_hashes(data), offsets
    hashes, bounds = bytewise.word_hashes(data, offsets)
    up, _ = bytewise.powers(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=prefix[1:])
    return prefix, bounds


def first_cells(batches: Iterator[pa.RecordBatch], rules: list[Rule]) -> Iterator[pa.RecordBatch]:
    """Cells of the first level of all texts: (id, h, text) -> names."""
    for batch in batches:
        ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, hi, data, bounds in bytewise.slices(batch.column(2)):
            for rule in rules:
                cell, length, gram = CELLS[rule.kind][0], rule.length, rule.gram
                prefix, offsets = unit_prefix(rule, data, bounds)
                n = len(prefix) - 1
                long_enough = np.diff(offsets) >= length
                if n < length or not long_enough.any():
                    continue
                at = np.arange(n - gram + 1)
                grams = bytewise.span_hashes(prefix, at, at + gram)
                smallest = sliding_min((grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), length - gram + 1)
                sample = (smallest & np.uint64(0xFFFFFFFF)).astype(np.int64)
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, offsets[:-1][long_enough], 1)
                np.add.at(change, offsets[1:][long_enough] - length + 1, -1)
                starts = np.flatnonzero(np.cumsum(change)[: len(sample)] > 0)
                sample = sample[starts]
                c = (sample - starts) // cell
                new = np.ones(len(starts), bool)
                new[1:] = (sample[1:] != sample[:-1]) | (c[1:] != c[:-1])
                sample, c = sample[new], c[new]
                row = np.searchsorted(offsets, sample, "right") - 1
                base, end = offsets[row], offsets[row + 1]
                inner, outer = cell_names(prefix, sample, c, base, end, cell, rule)
                yield batch_of(ids[lo:hi][row], hs[lo:hi][row], sample - base << 20 | rule.kind << 16 | c, inner, outer)


def smaller_cells(batches: Iterator[pa.RecordBatch], level: int, rules: list[Rule]) -> Iterator[pa.RecordBatch]:
    """(id, h, text, cells: at of the level above) -> names of the level's cells in those."""
    for batch in batches:
        ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cells, bounds_of = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
        bounds_of = bounds_of - bounds_of[0]
        for lo, hi, data, bounds in bytewise.slices(batch.column(2)):
            packed, owner = cells[bounds_of[lo] : bounds_of[hi]], np.repeat(np.arange(hi - lo), np.diff(bounds_of[lo : hi + 1]))
            for rule in rules:
                mine = (packed >> 16 & WORDS) == rule.kind
                if not mine.any():
                    continue
                cell = CELLS[rule.kind][level]
                ratio = CELLS[rule.kind][level - 1] // cell
                row, above = np.repeat(owner[mine], ratio), np.repeat(packed[mine], ratio)
                a, c = above >> 20, (above & 0xFFFF) * ratio + np.tile(np.arange(ratio), int(mine.sum()))
                prefix, offsets = unit_prefix(rule, data, bounds)
                high = a - c * cell
                keep = (high >= 0) & (high - (cell - 1) <= np.diff(offsets)[row] - rule.length)
                row, a, c, kind = row[keep], a[keep], c[keep], above[keep] >> 16 & SEVERAL
                base, end = offsets[row], offsets[row + 1]
                inner, outer = cell_names(prefix, base + a, c, base, end, cell, rule)
                yield batch_of(ids[lo:hi][row], hs[lo:hi][row], a << 20 | kind << 16 | c, inner, outer)


def repeated_starts(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """texts (id, h, text) -> (id, h, kind, first, last): ranges of starts whose windows start elsewhere too.

    Elsewhere is anywhere for windows of bytes, in another document (another id) for windows of words.
    """
    for rule in rules:
        if not CELLS[rule.kind][0] + rule.gram <= rule.length + 1 or rule.length >= 0xFFFF:
            raise ValueError(f"{rule}: length must be from {CELLS[rule.kind][0] + rule.gram - 1} to 65534")
    kind = F.shiftright("at", 16).bitwiseAND(F.lit(SEVERAL).cast("bigint"))
    shared = F.when(F.max(kind) == BYTES, F.count("*") > 1).otherwise((F.min("id") < F.max("id")) | (F.max(kind) == SEVERAL))
    names = written(texts.mapInArrow(lambda b: first_cells(b, rules), _NAMES), "repeat-names-0")
    ranges = []
    for level in range(LEVELS):
        # Tables are written before joins, so that the joins' hot keys can be split.
        again = written(names.groupBy("inner").agg(((F.count("*") > 1) & shared).alias("again")).filter("again").select("inner"), f"repeat-again-{level}")
        cells = written(names.join(again, "inner"), f"repeat-cells-{level}")
        discard(names, again)
        same = cells.groupBy("inner", "outer").agg(F.count("*").alias("n"), shared.alias("sure"), F.min(F.struct("id", "h", "at")).alias("one"))
        same = written(same, f"repeat-same-{level}")
        several = same.filter("n > 1").select("inner", "outer", "sure")
        met = written(cells.join(several, ["inner", "outer"]).select("id", "h", "at", "sure", F.expr("if(sure, null, inner)").alias("inner")), f"repeat-met-{level}")
        discard(cells)
        cell = F.when(kind == BYTES, CELLS[BYTES][level]).otherwise(CELLS[WORDS][level])
        high = (F.shiftright("at", 20) - F.col("at").bitwiseAND(F.lit(0xFFFF).cast("bigint")) * cell).cast("int")
        ranges.append(met.filter("sure").select("id", "h", F.when(kind == BYTES, BYTES).otherwise(WORDS).alias("kind"), (high - (cell - 1)).alias("first"), high.alias("last")))
        if level + 1 == LEVELS:
            discard(same)
            break
        open_ = written(same.groupBy("inner").agg(F.min("sure").alias("least"), F.count("*").alias("kinds")).filter("not least and kinds > 1").select("inner"), f"repeat-open-{level}")
        # Of settled cells one, for the others to meet; of open ones all.
        at = F.col("one.at")
        several_of = F.when(F.col("sure") & (at.bitwiseAND(F.lit(WORDS << 16).cast("bigint")) > 0), at.bitwiseOR(F.lit(SEVERAL << 16).cast("bigint"))).otherwise(at)
        one = same.filter("n = 1 or sure").select("inner", "one.id", "one.h", several_of.alias("at"))
        left = one.unionByName(met.filter("not sure").select("inner", "id", "h", "at")).join(open_, "inner")
        lists = left.groupBy("id", "h").agg(F.collect_list("at").alias("cells"))  # at most a text's length
        found = texts.join(lists, ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "h", "text", "cells")
        names = written(found.mapInArrow(lambda b, level=level: smaller_cells(b, level + 1, rules), _NAMES), f"repeat-names-{level + 1}")
        discard(same, open_)
    return reduce(DataFrame.unionByName, ranges)


def runs_of(first: np.ndarray, last: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that windows with starts first..last (clipped to n bytes or words) cover."""
    first, last = np.maximum(first, 0), np.minimum(last, n - length)
    first, last = first[first <= last], last[first <= last]
    order = np.argsort(first)
    first, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    return first[new], end[np.append(new[1:], True)] if len(first) else end


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", starts_of: Callable[[DataFrame], DataFrame] | None = None, passage: int = PASSAGE) -> DataFrame:
    """What the removal leaves of every row: sizes, spans and the digest of the kept bytes; words of shared passages.

    starts_of: another way from texts (id, h, text) to ranges of repeated starts, as suffix_order.repeated_starts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(named, text, F.octet_length(text)).alias("id"), F.hash(named, text, F.lit(7)).alias("h"), text.alias("text"))
    texts = keyed.select("id", "h", "text")
    long_enough = F.octet_length("text") >= length
    words = Rule(WORDS, passage, PASSAGE_GRAM)
    some = texts.filter(long_enough | (F.octet_length("text") >= 2 * passage - 1))
    if starts_of is None:
        ranges = repeated_starts(some, [Rule(BYTES, length, gram), words])
    else:
        ranges = repeated_starts(some, [words]).unionByName(written(starts_of(texts.filter(long_enough)), "repeat-ranges").withColumn("kind", F.lit(BYTES)))
    lists = written(ranges.groupBy("id", "h").agg(F.collect_list(F.struct("kind", "first", "last")).alias("ranges")), "repeat-lists")  # a text's own ranges
    discard(ranges)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = raw.as_buffer().to_pybytes()
                kind, first, last = (ranges.values.field(k).to_numpy() for k in range(3))
                starts, ends = (x.tolist() for x in runs_of(first[kind == BYTES], last[kind == BYTES], len(raw), length))
                kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))
                more = runs_of(first[kind == WORDS], last[kind == WORDS], len(raw.split()), passage)
                found.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), int((more[1] - more[0]).sum())))
            out = {"doc_id": batch.column(0)}
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            for name, values in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"), columns, strict=True):
                out[name] = pa.array(values, pa.string() if name == "kept_sha256" else pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint"
    keys = lists.select("id", "h")
    cut_rows = keyed.join(lists, ["id", "h"]).select("doc_id", "text", "ranges").mapInArrow(cut, schema)
    whole = keyed.select("doc_id", "id", "h", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")).join(keys, ["id", "h"], "left_anti")
    none = F.lit(0).cast("bigint")
    whole = whole.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept_sha256", none.alias("n_passage_words"))
    return cut_rows.unionByName(whole).withColumnRenamed("doc_id", id_col)
