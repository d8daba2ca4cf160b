"""LM scoring: stupid backoff over n-grams counted in the corpus, summed per document.

The unit is the word (runs without white space, A-Z folded, as 64-bit hashes), the
order WORD_ORDER. Counts are whole, and a document is scored with its own counts left out, so an n-gram counts
as seen only if another row holds it. With c the counts of the other rows and N their words, the word at a
place scores c(uvw) / c(uv) if uvw is seen, else `backoff` times c(vw) / c(v) if vw is, else `backoff` squared
times c(w) / N, else `backoff` cubed times 1 / N; a text's first words start at the order that they have. Rows
are dealt by hash into buckets of about `bucket_bytes`. A bucket's distinct n-grams of every order, as sorted
56-bit hashes with counts, are cut into hash ranges; each range is summed over all buckets and the sums go
back to the buckets in the order in which they were sent, so that only counts return.

Null, empty and blank texts have no n-grams, log_score 0 and a null mean. Repeated rows get equal scores, and
count as often as they occur. A very long text is a bucket of its own, hashed whole in one task (about 100 bytes
a word). An empty table gives no rows. Other input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.llm import bytewise
from pactlake.llm.common import written

WORD_ORDER, BACKOFF, WORD_BUCKET_BYTES, PART_BYTES = 3, 0.4, 6 << 20, 16 << 20
_GRAM_BITS = 56


def planes(x: np.ndarray) -> bytes:
    """Numbers as packed byte planes: high bytes are mostly zero or few."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(4, "big") + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def unplanes(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "big")
    raw = pa.decompress(packed[4:], 8 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def word_grams(texts: pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 1..order the k-gram that ends at every word (of less than k words at a text's start, a shorter one), and each row's number of words."""
    salts = bytewise.mixed(np.arange(1, order + 1, dtype=np.uint64)) | np.uint64(1)
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in bytewise.slices(texts):
        h, bounds = bytewise.word_hashes(data, offsets)
        hashes.append(h)
        sizes.append(np.diff(bounds))
    h, n = np.concatenate(hashes), np.concatenate(sizes)
    depth = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    total, grams = np.zeros(len(h), np.uint64), []
    for back in range(order):
        there = depth >= back
        total[there] += h[np.flatnonzero(there) - back] * salts[back]
        grams.append(bytewise.mixed(total) >> np.uint64(64 - _GRAM_BITS))
    return grams, n


def range_bounds(grams: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted grams are cut into equal hash ranges."""
    edges = np.array([(i << _GRAM_BITS) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(grams, edges), [len(grams)]))


def left_out(grams: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often its own row holds each gram (grams: numbers of distinct ones)."""
    pair = row * (int(grams.max(initial=0)) + 1) + grams
    _, where, n = np.unique(pair, return_inverse=True, return_counts=True)
    return n[where]


def score_words(docs: DataFrame, order: int = WORD_ORDER, backoff: float = BACKOFF, bucket_bytes: int = WORD_BUCKET_BYTES, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_grams (words), log_score (sum of natural logarithms) and mean_log_score of every row."""
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, ranges = max(1, math.ceil(size / bucket_bytes)), max(1, math.ceil(size / part_bytes))
    dealt = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(id_col, text), F.lit(buckets)).cast("int").alias("bucket"))

    def count(rows: pa.Table) -> pa.Table:
        out = []
        for k, grams in enumerate(word_grams(rows.column("text"), order)[0], 1):
            g, n = np.unique(grams, return_counts=True)
            cuts = range_bounds(g, ranges)
            for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if b > a:
                    out.append((k, part, b - a, planes(np.diff(g[a:b], prepend=np.uint64(0))), planes(n[a:b])))
        bucket = rows.column("bucket")[0].as_py() if len(rows) else 0
        ks, parts, sizes, grams, counts = zip(*out, strict=True) if out else ((), (), (), (), ())
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32()), "k": pa.array(ks, pa.int32()), "part": pa.array(parts, pa.int32()), "size": pa.array(sizes, pa.int32()), "grams": pa.array(grams, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def total(rows: pa.Table) -> pa.Table:
        grams = np.concatenate([np.cumsum(unplanes(x.as_py()), dtype=np.uint64) for x in rows.column("grams")] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([unplanes(x.as_py()) for x in rows.column("counts")] or [np.zeros(0, np.uint64)])
        _, where = np.unique(grams, return_inverse=True)
        sums = np.bincount(where, counts).astype(np.int64)[where] if len(where) else np.zeros(0, np.int64)
        ends = np.cumsum(rows.column("size").to_numpy()).tolist()
        spans = list(zip([0, *ends], ends))
        return pa.table({"bucket": rows.column("bucket"), "k": rows.column("k"), "part": rows.column("part"), "own": pa.array([int(counts[a:b].sum()) for a, b in spans], pa.int64()), "sums": pa.array([planes(sums[a:b]) for a, b in spans], pa.binary())})

    held = dealt.groupBy("bucket").applyInArrow(count, "bucket int, k int, part int, size int, grams binary, counts binary")
    sums = written(held.groupBy("k", "part").applyInArrow(total, "bucket int, k int, part int, own bigint, sums binary"), "lm-sums")
    all_words = sums.filter("k = 1").agg(F.sum("own")).first()[0] or 0

    def add(rows: pa.Table, table: pa.Table) -> pa.Table:
        grams, n = word_grams(rows.column("text"), order)
        row = np.repeat(np.arange(len(n)), n)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        rest = (all_words - n)[row]  # words of the other rows
        ks, parts, sent = table.column("k").to_numpy(), table.column("part").to_numpy(), table.column("sums")
        least = np.maximum(rest, 1)
        value = 1 / least * backoff ** (np.minimum(depth, order - 1) + 1.0)
        before = rest
        for k in range(1, order + 1):
            mine = np.flatnonzero(ks == k)
            known = np.concatenate([unplanes(sent[int(i)].as_py()) for i in mine[np.argsort(parts[mine])]] or [np.zeros(0, np.uint64)]).astype(np.int64)
            _, where = np.unique(grams[k - 1], return_inverse=True)
            others = known[where] - left_out(where, row) if len(where) else np.zeros(0, np.int64)
            at = np.flatnonzero((others > 0) & (depth >= k - 1))
            value[at] = others[at] / (before[at - 1] if k > 1 else rest[at]) * backoff ** (np.minimum(depth[at], order - 1) + 1.0 - k)
            before = others
        sums = np.bincount(row, np.log(value), len(n))  # adds in the row's own order: equal rows, equal sums
        mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
        return pa.table({"doc_id": rows.column("doc_id"), "n_grams": n, "log_score": sums, "mean_log_score": mean})

    kind = docs.schema[id_col].dataType.simpleString()
    scores = dealt.groupBy("bucket").cogroup(sums.drop("own").groupBy("bucket")).applyInArrow(add, f"doc_id {kind}, n_grams bigint, log_score double, mean_log_score double")
    return scores.withColumnRenamed("doc_id", id_col)
