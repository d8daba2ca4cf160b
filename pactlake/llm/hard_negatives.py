"""Hard negatives by distributed radix selection over integer scores.

Components become integers (floor(scale * x)); a score is an integer inner product, at most the largest squared norm.
A window is an anchor with a range of scores and the rows it may hold: first each anchor with all rows of its label
(its positives), then each anchor-positive pair with the rows of other labels that score between `lowest` and `highest`
percent of the positive. In every round a task takes the matrix product of a chunk of rows and a block of anchors and
counts the scores of each open window in 2**DIGIT buckets, best scores first; the counts are summed, the bucket that
holds the k-th score is found, and the next round counts inside it, one digit finer. A window is closed as soon as
the rows down to the end of its bucket are few (`slack`) or the bucket is one score wide. Only then are rows gathered:
those down to the end of the bucket, k of a chunk at most, as no more of a chunk can be among the k best.

A chunk counts only buckets down to its own k-th row: the k-th row of all can't lie lower. So a chunk sends at most k
counts a window, and a label, score or vector that very many rows share makes no more of them. Rows are dealt to chunks
by hash. Blocks of anchors meet every chunk in a join on the block's number (broadcast while they are small, else
shuffled); scores are never written.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Of rows that
share a vec_id the one with the smallest (label, vector) stands. Vectors of different lengths have no score. Ties go to
the smaller vec_id. Anchors without positives, and pairs without negatives (so all with a negative score), give no
rows. Squared norms of 2**58 and more raise an error, as scores would not fit. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import bounded_broadcast, discard, once, written

POSITIVES, NEGATIVES, LOWEST, HIGHEST, SCALE = 5, 5, 80, 100, 256
CHUNK, BLOCK, DIGIT, SLACK = 2048, 512, 8, 24

_PACK = "dim int, {0} int, ids binary, labels binary, vs binary"


def prepared(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v array<int>, dim) of the rows that take part, one for each vec_id."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.when(~bad, F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double"))).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v", F.size("r.v").alias("dim"))


def packed(rows: DataFrame, number: str) -> DataFrame:
    """Rows of one (dim, number) as one row of binary columns, sorted by vec_id."""

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        flat = t["v"].combine_chunks().flatten().to_numpy().astype(np.int32)
        columns = [t["vec_id"].to_numpy().tobytes(), t["label"].to_numpy().tobytes(), flat.tobytes()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]], ["dim", number, "ids", "labels", "vs"])

    return rows.select("dim", number, "vec_id", "label", "v").groupBy("dim", number).applyInArrow(pack, _PACK.format(number))


def with_windows(packs: DataFrame, state: DataFrame) -> DataFrame:
    """Anchor packs with the windows to look at, as binary columns; blocks without a window are left out."""
    names = ("at", "positive", "low", "high", "edge")

    def pack(anchors: pa.Table, windows: pa.Table) -> pa.Table:
        if not len(windows) or not len(anchors):
            return pa.table({f.name: pa.array([], f.type) for f in schema})
        ids = np.frombuffer(anchors["ids"][0].as_py(), np.int64)
        columns = [np.searchsorted(ids, windows["anchor_id"].to_numpy()), *[windows[c].to_numpy() for c in ("positive_id", "low", "high", "edge")]]
        own = {c: anchors[c] for c in ("dim", "block", "ids", "labels", "vs")}
        return pa.table({**{k: v.combine_chunks() for k, v in own.items()}, **{n: pa.array([c.astype(np.int64).tobytes()], pa.binary()) for n, c in zip(names, columns, strict=True)}}, schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "vs", *names)]])
    text = _PACK.format("block") + "".join(f", {n} binary" for n in names)
    keys = ["dim", "block"]
    return packs.groupBy(*keys).cogroup(state.select(*keys, "anchor_id", "positive_id", "low", "high", "edge").groupBy(*keys)).applyInArrow(pack, text)


def scores_of(row: dict, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores (windows by rows of the chunk) as offsets from the window's upper end, those that are no match as -1."""
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    aids, alabels = np.frombuffer(row["aids"], np.int64), np.frombuffer(row["alabels"], np.int64)
    at, positive, low, high = (np.frombuffer(row[c], np.int64) for c in ("at", "positive", "low", "high"))
    v, a = np.frombuffer(row["vs"], np.int32).reshape(len(ids), -1), np.frombuffer(row["avs"], np.int32).reshape(len(aids), -1)
    exact = np.float64 if row["floats"] else np.int64  # floats hold every partial sum below 2**53
    scores = (a.astype(exact) @ v.T.astype(exact)).astype(np.int64)
    fits = (labels == alabels[:, None]) == same
    if same:
        fits &= ids != aids[:, None]
    at_scores = scores[at]
    offset = high[:, None] - at_scores
    offset[~fits[at] | (offset < 0) | (at_scores < low[:, None])] = -1
    return aids[at], positive, ids, offset


def histogram(shift: int, k: int, same: bool):
    """Counts of the open windows: (dim, block, anchor_id, positive_id, bucket, n), down to the chunk's own k-th row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                anchors, positive, _, offset = scores_of(row, same)
                start = np.frombuffer(row["edge"], np.int64)
                bucket = (offset - start[:, None]) >> shift
                window, column = np.nonzero((offset >= start[:, None]) & (bucket < 1 << DIGIT))
                n = np.bincount((window << DIGIT) + bucket[window, column], minlength=len(anchors) << DIGIT).reshape(len(anchors), -1)
                window, found = np.nonzero((n > 0) & (n.cumsum(axis=1) - n < k))
                same_key = [pa.array(np.full(len(window), row[c]), pa.int32()) for c in ("dim", "block")]
                yield pa.RecordBatch.from_arrays([*same_key, pa.array(anchors[window]), pa.array(positive[window]), pa.array(found, pa.int32()), pa.array(n[window, found])], ["dim", "block", "anchor_id", "positive_id", "bucket", "n"])

    return count


def gathering(k: int, same: bool):
    """Rows down to the window's last offset, the k best of the chunk."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                anchors, positive, ids, offset = scores_of(row, same)
                last, high = np.frombuffer(row["edge"], np.int64), np.frombuffer(row["high"], np.int64)
                window, column = np.nonzero((offset >= 0) & (offset <= last[:, None]))
                order = np.lexsort((ids[column], offset[window, column], window))
                window, column = window[order], column[order]
                first = np.searchsorted(window, window)  # place of the window's first row
                best = np.arange(len(window)) - first < k
                window, column = window[best], column[best]
                same_key = [pa.array(np.full(len(window), row[c]), pa.int32()) for c in ("dim", "block")]
                yield pa.RecordBatch.from_arrays([*same_key, pa.array(anchors[window]), pa.array(positive[window]), pa.array(ids[column]), pa.array(high[window] - offset[window, column])], ["dim", "block", "anchor_id", "positive_id", "vec_id", "score"])

    return gather


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


class Search:
    """Chunks of rows and blocks of anchors, between which windows are settled."""

    def __init__(self, rows: DataFrame, is_anchor: Column, chunk: int, block: int):
        facts = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), F.max("dim").alias("dim")).first()
        self.norm = int((facts["norm"] or 0.0) * (1 + 1e-9)) + 1
        if self.norm >= 1 << 58:
            raise ValueError("squared norms of 2**58 and more have no exact scores")
        rows = rows.withColumn("v", F.transform("v", lambda x: x.cast("int"))).withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False)))
        sizes = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / chunk)).cast("int").alias("chunks"), F.ceil(F.count_if("is_anchor") / block).cast("int").alias("blocks"))
        sizes = bounded_broadcast(written(sizes, "negatives-sizes"), 16)
        number = lambda n, of: F.pmod(F.xxhash64("vec_id", F.lit(of)), F.col(n)).cast("int")
        placed = rows.join(sizes, "dim")
        self.chunks = written(packed(placed.withColumn("chunk", number("chunks", "chunk")), "chunk"), "negatives-chunks")
        self.packs = written(packed(placed.filter("is_anchor").withColumn("block", number("blocks", "block")), "block"), "negatives-anchors")
        blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        self.met = self.chunks.join(sizes.filter("blocks > 0"), "dim").select("dim", "ids", "labels", "vs", blocks)
        self.pack_bytes = block * (4 * (facts["dim"] or 1) + 16 + POSITIVES * 40)
        self.anchors = placed.filter("is_anchor").select("dim", number("blocks", "block").alias("block"), F.col("vec_id").alias("anchor_id"))

    def over(self, state: DataFrame, work, schema: str) -> tuple[DataFrame, DataFrame]:
        """work on every chunk for the windows of `state`; also the written packs, to be deleted later."""
        packs = written(with_windows(self.packs, state), "negatives-windows")
        named = packs.withColumnsRenamed({"ids": "aids", "labels": "alabels", "vs": "avs"})
        met = self.met.join(bounded_broadcast(named, self.pack_bytes), ["dim", "block"]).withColumn("floats", F.lit(self.norm < 1 << 52))
        return met.mapInArrow(work, schema), packs

    def settle(self, windows: DataFrame, widest: int, k: int, same: bool, slack: int) -> DataFrame:
        """The k best rows of every window (dim, block, anchor_id, positive_id, low, high), with their rank."""
        shift = max(0, max(1, widest).bit_length() - DIGIT)
        state = windows.select("dim", "block", "anchor_id", "positive_id", "low", "high", F.lit(0).cast("bigint").alias("start"), F.lit(k).alias("rest"), F.lit(0).cast("bigint").alias("held"), F.lit(None).cast("bigint").alias("last"))
        state = written(state, "negatives-state")
        keys = ["dim", "block", "anchor_id", "positive_id"]
        while True:
            open_ = state.filter("last is null")
            counts, packs = self.over(open_.withColumn("edge", F.col("start")), histogram(shift, k, same), "dim int, block int, anchor_id bigint, positive_id bigint, bucket int, n bigint")
            summed = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("counts"))  # 2**DIGIT entries at most
            following = written(self.refined(state.join(summed, keys, "left"), shift, slack), "negatives-state")
            discard(state, packs)
            state = following
            if shift == 0 or state.filter("last is null").isEmpty():
                break
            shift = max(0, shift - DIGIT)
        found, packs = self.over(state.filter("last >= 0").withColumn("edge", F.col("last")), gathering(k, same), "dim int, block int, anchor_id bigint, positive_id bigint, vec_id bigint, score bigint")
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        best = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "negatives-best")
        discard(state, packs)
        return best

    @staticmethod
    def refined(counted: DataFrame, shift: int, slack: int) -> DataFrame:
        """The next state: the bucket of the k-th row, or the window's end where it holds fewer than k."""
        begin = F.struct(F.lit(0).cast("bigint").alias("above"), F.lit(-1).alias("bucket"), F.lit(0).cast("bigint").alias("n"))

        def step(a: Column, c: Column) -> Column:
            here = (a["bucket"] < 0) & (a["above"] + c["n"] >= F.col("rest"))
            passed = (a["bucket"] < 0) & ~here
            return F.struct(F.when(passed, a["above"] + c["n"]).otherwise(a["above"]).alias("above"), F.when(here, c["bucket"]).otherwise(a["bucket"]).alias("bucket"), F.when(here, c["n"]).otherwise(a["n"]).alias("n"))

        none = F.expr("cast(array() as array<struct<bucket:int,n:bigint>>)")
        rows = once(counted, _found=F.aggregate(F.coalesce("counts", none), begin, step))  # a column of its own: inside a lambda, names would mean the new columns
        hit, above = F.col("_found.bucket") >= 0, F.col("_found.above")
        start = F.col("start") + F.when(hit, F.shiftleft(F.col("_found.bucket").cast("bigint"), shift)).otherwise(F.lit(0))
        few = (F.col("held") + above + F.col("_found.n") <= slack) | F.lit(shift == 0)
        last = F.when(~hit, F.when(above > 0, F.col("high") - F.col("low")).otherwise(F.lit(-1))).when(few, start + (1 << shift) - 1)
        new = {"start": start, "rest": F.col("rest") - above.cast("int"), "held": F.col("held") + above, "last": last}
        settled = F.col("last").isNotNull()
        return rows.select("dim", "block", "anchor_id", "positive_id", "low", "high", *[F.when(settled, F.col(c)).otherwise(x).alias(c) for c, x in new.items()])


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, scale: int = SCALE, chunk: int = CHUNK, block: int = BLOCK, slack: int = SLACK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor is a condition on vec_id,
    label an expression over the input (default: its column label)."""
    rows = written(prepared(vectors, F.col("label") if label is None else label, scale), "negatives-rows")
    search = Search(rows, is_anchor, chunk, block)
    whole = search.anchors.select("dim", "block", "anchor_id", F.lit(0).cast("bigint").alias("positive_id"), F.lit(-search.norm).alias("low"), F.lit(search.norm).alias("high"))
    near = search.settle(whole, 2 * search.norm, positives, True, slack)
    score = F.col("score")
    windows = near.select("dim", "block", "anchor_id", F.col("vec_id").alias("positive_id"), F.ceil(score * lowest / F.lit(100).cast("decimal(3,0)")).cast("bigint").alias("low"), F.floor(score * highest / F.lit(100).cast("decimal(3,0)")).cast("bigint").alias("high"))
    windows = windows.filter("low <= high")
    widest = windows.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    found = search.settle(windows, widest or 0, negatives, False, slack)
    discard(search.chunks, search.packs, rows)
    positive = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positive, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle() -> str:
    return f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(e, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM r),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOWEST} * p.score <= 100 * s.score AND 100 * s.score <= {HIGHEST} * p.score)
SELECT * FROM n WHERE rank <= {NEGATIVES}"""
