"""Suffix order of a corpus by a distributed difference-cover algorithm (cover {1, 2} modulo 3).

The texts are laid end to end, each followed by a mark. Positions that are 1 or 2 modulo 3 are sampled; their
triples of symbols are sorted over range partitions and named by their place among the distinct triples. Unless
all names differ, the names make a string of two thirds of the length, whose suffixes are ordered in the same
way. The other suffixes are ordered by (symbol, rank of the next), and merged with the sampled ones by two
sorts, against each residue in the form that makes them comparable. Every step is a sort, a join or a running
count in Spark, and every table is written; no string is held in one task.

repeated_starts compares the prefixes of adjacent suffixes: a `length`-byte string occurs again exactly if a
neighbour in suffix order has it too. Prefixes are compared by 64-bit hashes. There is a row for every byte, so
this costs far more than pactlake.llm.repeats, which gives the same ranges; the README has measured figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm import bytewise
from pactlake.llm.common import discard, written

#: Positions whose neighbours are looked up in one window partition.
BLOCK = 1 << 16


def ordered(df: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """df (of bigint columns) sorted by keys over range partitions, with `name` (dense, from 1, equal keys share it), `at` (rows before) and `before` (sum of `value` over those)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, rows, total = None, 0, 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(names.index(k)).to_numpy() for k in keys]
            new = np.ones(batch.num_rows, np.int64)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            new[0] = last != tuple(int(c[0]) for c in cols)
            last = tuple(int(c[-1]) for c in cols)
            v = batch.column(names.index(value)).to_numpy()
            sums = np.cumsum(v)
            own = {"name_": n + np.cumsum(new), "at_": rows + np.arange(len(new)), "before_": total + sums - v, "part_": np.full(len(new), part)}
            n, rows, total = n + int(new.sum()), rows + len(new), total + int(sums[-1])
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(names)} | {k: pa.array(x, pa.int64()) for k, x in own.items()})

    schema = ", ".join(f"`{c}` bigint" for c in [*names, "name_", "at_", "before_", "part_"])
    held = written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(count, schema), label)
    sizes = held.groupBy("part_").agg(F.max("name_").alias("n"), F.count("*").alias("rows"), F.sum(value).alias("total"))  # a row a partition
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part_", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_") for c in ("n", "rows", "total")])
    met = held.join(F.broadcast(starts), "part_")
    return met.select(*names, (F.col("name_") + F.col("n_")).alias("name"), (F.col("at_") + F.col("rows_")).alias("at"), (F.col("before_") + F.col("total_")).alias("before"))


def followed(df: DataFrame, key: str, away: int, *columns: str) -> DataFrame:
    """df (rows by a dense key) with the columns of the rows 1 to `away` keys on, as c1, c2..; null beyond the end."""
    block = F.floor(F.col(key) / BLOCK)
    twice = F.when((F.col(key) % BLOCK < away) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    rows = df.withColumn("block_", F.explode(twice))
    over = Window.partitionBy("block_").orderBy(key)
    more = [F.lead(c, i).over(over).alias(f"{c}{i}") for c in columns for i in range(1, away + 1)]
    return rows.select("*", *more).filter(F.col("block_") == block).drop("block_")


def suffix_ranks(symbols: DataFrame, n: int, level: int = 0) -> DataFrame:
    """symbols (pos, a) with pos 0..n-1 and a >= 1 -> (pos, rank) of every suffix, from 0; a written table."""
    zero = F.lit(0).cast("bigint")
    near = followed(symbols, "pos", 2, "a")
    triples = near.filter("pos % 3 <> 0").select("pos", "a", F.coalesce("a1", zero).alias("b"), F.coalesce("a2", zero).alias("c"))
    dummy = n % 3 == 1  # an empty suffix ends the first half of the shortened string
    if dummy:
        triples = triples.unionByName(symbols.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("pos"), zero.alias("a"), zero.alias("b"), zero.alias("c")))
    named = written(ordered(triples.withColumn("v", zero), ["a", "b", "c"], "v", f"suffix-triples-{level}").select("pos", "name"), f"suffix-names-{level}")
    size, kinds = named.agg(F.count("*"), F.coalesce(F.max("name"), F.lit(0))).first()
    if kinds == size:
        ranks = named.select("pos", F.col("name").alias("r"))
    else:
        half = (n - 1 + dummy - 1) // 3 + 1  # positions 1 modulo 3
        place = F.when(F.col("pos") % 3 == 1, F.floor((F.col("pos") - 1) / 3)).otherwise(half + F.floor((F.col("pos") - 2) / 3))
        below = suffix_ranks(named.select(place.alias("pos"), F.col("name").alias("a")), size, level + 1)
        back = F.when(F.col("pos") < half, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - half) + 2)
        ranks = below.select(back.alias("pos"), (F.col("rank") + 1).alias("r"))
    rows = symbols.join(ranks, "pos", "left")
    rows = written(followed(rows, "pos", 2, "a", "r"), f"suffix-rows-{level}")
    known = lambda c: F.coalesce(F.col(c), zero)  # noqa: E731  nothing stands beyond the end
    other = (F.col("pos") % 3 == 0).cast("bigint").alias("other")
    first = ordered(rows.filter("pos % 3 < 2").select("pos", "a", known("r1").alias("x"), other, known("r").alias("r")), ["a", "x"], "other", f"suffix-first-{level}")
    second = ordered(rows.filter("pos % 3 <> 1").select("pos", "a", known("a1").alias("b"), known("r2").alias("x"), other, known("r").alias("r")), ["a", "b", "x"], "other", f"suffix-second-{level}")
    own = F.col("r") - 1 - int(dummy)
    sampled = first.filter("other = 0").unionByName(second.filter("other = 0").select(*first.columns)).select("pos", (own + F.col("before")).alias("rank"))
    left = first.filter("other = 1").select("pos", F.col("at").alias("one")).join(second.filter("other = 1").select("pos", (F.col("at") - F.col("before")).alias("two")), "pos")
    out = written(sampled.unionByName(left.select("pos", (F.col("one") + F.col("two")).alias("rank"))), f"suffix-ranks-{level}")
    discard(named, rows)
    return out


def repeated_starts(texts: DataFrame, length: int) -> DataFrame:
    """texts (id, h, text) -> (id, h, first, last): ranges (of one start each) whose length-byte strings start elsewhere too."""
    sized = texts.select("id", F.col("h").cast("bigint").alias("h"), (F.octet_length("text") + 1).cast("bigint").alias("size"))
    order = ordered(sized, ["id", "h"], "size", "suffix-texts")
    starts = written(order.groupBy("id", "h").agg(F.collect_list("before").alias("starts")), "suffix-starts")  # equal (id, h): repeated rows
    total = order.agg(F.sum("size")).first()[0] or 0
    base = texts.dropDuplicates(["id", "h"]).withColumn("h", F.col("h").cast("bigint")).join(starts, ["id", "h"]).select("id", "h", "text", F.explode("starts").alias("start"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for _, _, data, _ in bytewise.slices(batch.column(2).slice(i, 1)):
                    n = len(data)
                    at = np.arange(max(0, n - length + 1))
                    prints = np.zeros(n + 1, np.int64)
                    prints[: len(at)] = bytewise.span_hashes(bytewise.prefix_hashes(data), at, at + length).view(np.int64)
                    symbol = np.concatenate((data.astype(np.int64) + 2, [1]))
                    full = np.zeros(n + 1, np.int64)
                    full[: len(at)] = 1
                    yield pa.RecordBatch.from_pydict({"id": pa.array(np.full(n + 1, batch.column(0)[i].as_py()), pa.int64()), "h": pa.array(np.full(n + 1, batch.column(1)[i].as_py()), pa.int64()), "own": pa.array(np.arange(n + 1), pa.int64()), "pos": pa.array(batch.column(3)[i].as_py() + np.arange(n + 1), pa.int64()), "a": pa.array(symbol, pa.int64()), "full": pa.array(full, pa.int64()), "print": pa.array(prints, pa.int64())})

    spelt = written(base.mapInArrow(spell, "id bigint, h bigint, own bigint, pos bigint, a bigint, full bigint, print bigint"), "suffix-spelt")
    ranks = suffix_ranks(spelt.select("pos", "a"), total)
    rows = ranks.join(spelt.select("pos", "full", "print"), "pos")
    beside = followed(rows, "rank", 1, "pos", "full", "print").filter((F.col("full") == 1) & (F.col("full1") == 1) & (F.col("print") == F.col("print1")))
    again = beside.select(F.explode(F.array("pos", "pos1")).alias("pos")).distinct()
    return again.join(spelt.select("pos", "id", F.col("h").cast("int").alias("h"), F.col("own").cast("int").alias("own")), "pos").select("id", "h", F.col("own").alias("first"), F.col("own").alias("last"))
