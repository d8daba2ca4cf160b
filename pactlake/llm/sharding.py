"""Sharding by Karmarkar-Karp differencing: near-equal bytes with equal texts kept together.

Equal texts form one indivisible group. Groups are dealt by hash to buckets; inside each bucket the largest
differencing method repeatedly joins the two partial partitions with the largest spread, one in descending
and one in ascending order, until one k-way partition is left. The buckets' partitions are then joined by the
same rule, `fan` of them a task, level by level; the driver joins the last `fan` at most (k sums each). That
decides how each bucket's k parts map to shards. Slots are a seeded shuffle of a shard's rows, in which copies of a row stand
apart: each row gets a number when it is read, its hash a cell (about `rows_per_cell` rows), and slots come from
per-(shard, cell) counts and a row number inside a cell, so no shard is ever sorted in one task.

Null texts form one group of size 1 each row, empty texts another. Repeated rows are separate rows with
their own slots. An empty table gives no rows. Other input columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import bounded_broadcast, discard, written


def differencing(items: list[tuple[list[int], list]], k: int) -> list[tuple[int, list]]:
    """Join partial k-way partitions; items: (k sums, k linked lists [head, tail] or None). Returns k (sum, list)."""
    heap, n = [], 0
    for sums, bins in items:
        order = sorted(range(k), key=lambda i: (-sums[i], i))
        parts = [(sums[i], bins[i]) for i in order]
        heap.append((parts[-1][0] - parts[0][0], n, parts))
        n += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        parts = []
        for (x, p), (y, q) in zip(a, reversed(b), strict=True):
            parts.append((x + y, chained(p, q)))
        parts.sort(key=lambda part: -part[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
        n += 1
    return heap[0][2] if heap else [(0, None)] * k


def chained(p, q):
    """Concatenate two linked lists ([head, tail] of [value, next] cells) in constant time."""
    if p is None:
        return q
    if q is None:
        return p
    p[1][1] = q[0]
    return [p[0], q[1]]


def members(linked) -> list:
    out, cell = [], linked[0] if linked else None
    while cell is not None:
        out.append(cell[0])
        cell = cell[1]
    return out


def single(value):
    cell = [value, None]
    return [cell, cell]


def joined(sums: DataFrame, shards: int, fan: int) -> DataFrame:
    """Join the partitions of `fan` buckets at a time: (_bucket, _part, bytes) -> (_bucket, _part, _parent, _up, bytes)."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        placed = joined_parts(pdf["_bucket"].tolist(), pdf["_part"].tolist(), pdf["bytes"].tolist(), shards)
        size = dict(zip(zip(pdf["_bucket"], pdf["_part"], strict=True), pdf["bytes"], strict=True))
        return pd.DataFrame([(b, p, pdf["_parent"].iloc[0], up, size[b, p]) for b, p, up in placed], columns=["_bucket", "_part", "_parent", "_up", "bytes"])

    return sums.withColumn("_parent", F.floor(F.col("_bucket") / fan).cast("int")).groupBy("_parent").applyInPandas(join, "_bucket int, _part int, _parent int, _up int, bytes long")


def joined_parts(buckets: list, parts: list, sizes: list, shards: int) -> list[tuple]:
    """(bucket, part, shard) of the rows of some buckets, by differencing their partitions."""
    sums: dict[int, list[int]] = {}
    for b, p, n in sorted(zip(buckets, parts, sizes, strict=True)):
        sums.setdefault(b, [0] * shards)[p] = n
    items = [(s, [single((b, p)) if n else None for p, n in enumerate(s)]) for b, s in sums.items()]
    return [(b, p, i) for i, (_, linked) in enumerate(differencing(items, shards)) for b, p in members(linked)]


def shard_by_bytes(docs: DataFrame, shards: int = 8, groups_per_bucket: int = 20_000, fan: int = 4096, rows_per_cell: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row; see the module's docstring."""
    text = F.col(text_col)
    raw = F.encode(text, "UTF-8")
    rows = docs.select(
        F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("_group"), F.monotonically_increasing_id().alias("_row"),
    )
    groups = written(rows.groupBy("_group").agg(F.sum("size").alias("bytes")), "shard-groups")
    buckets = max(256, math.ceil(groups.count() / groups_per_bucket))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "_group"], ascending=[False, True], kind="stable")
        bucket = pdf["_bucket"].iloc[0]
        zeros, nothing = [0] * (shards - 1), [None] * (shards - 1)
        items = [([b, *zeros], [single(g), *nothing]) for g, b in zip(pdf["_group"].tolist(), pdf["bytes"].tolist(), strict=True)]
        found = [(g, i) for i, (_, linked) in enumerate(differencing(items, shards)) for g in members(linked)]
        return pd.DataFrame({"_group": [g for g, _ in found], "_bucket": bucket, "_part": [i for _, i in found]})

    keyed = groups.select("_group", "bytes", F.pmod(F.hash("_group", F.lit("bucket")), F.lit(buckets)).alias("_bucket"))
    parts = written(
        keyed.groupBy("_bucket").applyInPandas(local, "_group long, _bucket int, _part int").join(groups, "_group"),
        "shard-parts",
    )
    spark = docs.sparkSession
    sums = parts.groupBy("_bucket", "_part").agg(F.sum("bytes").alias("bytes"))
    levels = []
    while buckets > fan:
        levels.append(written(joined(sums, shards, fan), "shard-level"))
        sums = levels[-1].groupBy(F.col("_parent").alias("_bucket"), F.col("_up").alias("_part")).agg(F.sum("bytes").alias("bytes"))
        buckets = math.ceil(buckets / fan)
    last = sums.collect()  # at most fan * shards rows
    placed = joined_parts([r["_bucket"] for r in last], [r["_part"] for r in last], [r["bytes"] for r in last], shards)
    place = F.broadcast(spark.createDataFrame(placed, "_bucket int, _part int, shard int"))
    for level in reversed(levels):
        place = level.join(place.select(F.col("_bucket").alias("_parent"), F.col("_part").alias("_up"), "shard"), ["_parent", "_up"]).select("_bucket", "_part", "shard")
    assigned = parts.join(place, ["_bucket", "_part"]).select("_group", "shard")
    settled = written(rows.join(assigned, "_group").withColumn("_order", F.xxhash64(id_col, "_group", "_row")).drop("_group", "_row"), "shard-rows")
    discard(groups, parts, *levels)
    cells = max(64, math.ceil(settled.count() / shards / rows_per_cell))
    settled = settled.withColumn("_cell", F.pmod(F.col("_order"), F.lit(cells)))
    counts = settled.groupBy("shard", "_cell").count()
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("shard", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")), "shard-starts")  # shards * cells rows
    inside = Window.partitionBy("shard", "_cell").orderBy("_order")
    return settled.join(bounded_broadcast(starts, 64), ["shard", "_cell"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.row_number().over(inside) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
