"""Exact top-k by inner product with a pivot-distance index.

Components become integers (floor(scale * x)). Largest inner product turns into nearest neighbour by one more
coordinate, sqrt(M - |v|^2) with M the largest squared norm (0 for queries): then
2 <q, v> = |q|^2 + M - dist(q, v)^2. Vectors are keyed by their nearest pivot and the ring (annulus) of their
distance to it; by the triangle inequality a vector in ring [lo, hi) of pivot p is at least
max(lo - d(q, p), d(q, p) - hi, 0) away from q. Each query first searches the cells nearest by that bound;
its k-th score then closes all cells whose bound can't beat or tie it, and only the remaining ones are
searched. Bounds are rounded towards searching more, scores are integers, so results are exact.

Cells are cut into chunks of about `chunk` vectors and queries into blocks of about `block`; chunk and block
meet in a join on needed (chunk, block) pairs, so the work is a matrix product per pair and no cell, however
hot, is gathered in one task. Pivots are `pivots` vectors with the smallest id hashes and travel to all tasks.

Vectors that are null, empty or hold null or non-finite components take no part. Vectors of different lengths
have no inner product: each length is searched by itself. Components beyond 2**62 after scaling are cut to it;
scores beyond the range of a long are cut to its ends, ties among those go by vec_id like all others. Null ids
take no part. Repeated vec_ids each count as a row; a query skips candidates with its own id. Ties go to the
smaller vec_id. Fewer than k candidates give fewer rows, an empty table gives none. Other input columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactlake.llm.common import written

K, SCALE, PIVOTS, RINGS, CHUNK, BLOCK, FIRST_CELLS = 5, 256, 32, 16, 2048, 512, 3


def quantised(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>) of the vectors that take part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(~bad, x).alias("e")).filter(F.col("vec_id").isNotNull() & (F.size("e") > 0))
    most = F.lit(float(1 << 62))
    return rows.select("vec_id", F.transform("e", lambda c: F.greatest(-most, F.least(most, F.floor(c.cast("double") * scale).cast("double"))).cast("bigint")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow array of equally long lists as rows of floats (exact for integers below 2**53)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lifted(v: np.ndarray, most: float | None) -> np.ndarray:
    """One more coordinate, so that all rows have squared norm `most` (None: a query's 0)."""
    extra = np.zeros(len(v)) if most is None else np.sqrt(np.maximum(0.0, most - (v * v).sum(axis=1)))
    return np.hstack((v, extra[:, None]))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: by floats or longs where they hold them exactly, else by Python's integers, cut to a long's range."""
    largest = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1])
    if largest < 2**52:
        return (q.astype(float) @ v.T.astype(float)).astype(np.int64)
    if largest < 2**62:
        return q @ v.T
    exact = q.astype(object) @ v.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T))


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, rings: int = RINGS, chunk: int = CHUNK, block: int = BLOCK, first_cells: int = FIRST_CELLS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row for which is_query (a condition on vec_id) holds."""
    rows = written(quantised(vectors, scale, id_col, vector_col), "topk-rows")
    widths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # one, unless lengths are mixed
    found = [top_k_of(rows.filter(F.size("v") == n) if len(widths) > 1 else rows, is_query, k, pivots, rings, chunk, block, first_cells) for n in widths]
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found, empty) if len(found) != 1 else found[0]


def top_k_of(rows: DataFrame, is_query, k: int, pivots: int, rings: int, chunk: int, block: int, first_cells: int) -> DataFrame:
    """top_k for quantised rows (vec_id, v) of one length."""
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.sum(is_query.cast("bigint")).alias("q")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not facts["n"] or not facts["q"]:
        return empty
    most = float(facts["most"]) * (1 + 1e-12)  # a sum of rounded squares
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]  # a bounded sample
    centres = lifted(np.array(chosen, float), most)
    width = max(1.0, 2 * math.sqrt(most) / rings)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(lifted(matrix(batch.column(1)), most), centres)
            pivot = d.argmin(axis=1)
            ring = np.minimum((d[np.arange(len(d)), pivot] / width).astype(np.int64), 2 * rings)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "v": batch.column(1), "cell": pa.array(pivot * 1000 + ring, pa.int32())})

    index = written(rows.mapInArrow(place, "vec_id bigint, v array<bigint>, cell int"), "topk-index")
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))  # pivots * rings rows at most
    keyed = index.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "part": [pdf["part"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vs": [v.tobytes()]})

    chunks = written(keyed.select("cell", "part", "vec_id", "v").groupBy("cell", "part").applyInPandas(pack, "cell int, part int, ids binary, vs binary"), "topk-chunks")
    blocks = max(1, math.ceil(facts["q"] / block))
    queries = rows.filter(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int"))

    def pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "qs": [v.tobytes()]})

    packs = written(queries.groupBy("block").applyInPandas(pack_queries, "block int, qids binary, qs binary"), "topk-queries")
    cells = sorted(r["cell"] for r in sizes.select("cell").collect())
    pivot_of = np.array([c // 1000 for c in cells])
    low = np.array([(c % 1000) * width for c in cells])
    high = np.array([(c % 1000 + 1) * width if c % 1000 < 2 * rings else np.inf for c in cells])

    def bounds(q: np.ndarray) -> np.ndarray:
        """Least distance of every query to every cell, a little too small."""
        d = distances(lifted(q, None), centres)[:, pivot_of]
        return np.maximum(0.0, np.maximum(low - d, d - high) - 1e-6 * (1.0 + d))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, qids, qs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                q = np.frombuffer(qs, np.int64).reshape(len(qids) // 8, -1).astype(float)
                order = np.argsort(bounds(q), axis=1, kind="stable")[:, :first_cells]
                for c in np.unique(order):
                    out.append((cells[c], b, np.flatnonzero((order == c).any(axis=1)).astype(np.int32).tobytes()))
            yield needs(out)

    def needs(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"cell": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([x[1] for x in out], pa.int32()), "wanted": pa.array([x[2] for x in out], pa.binary())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], []]
            for wanted, ids, vs, qids, qs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                v = np.frombuffer(vs, np.int64).reshape(len(ids), -1)
                some = np.frombuffer(wanted, np.int32)
                q, qids = np.frombuffer(qs, np.int64).reshape(len(qids), -1)[some], qids[some]
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v[order]
                scores = products(q, v)
                for i, row in enumerate(scores):
                    others = np.flatnonzero(ids != qids[i])
                    if len(others) > k:
                        mine = row[others]
                        least = np.partition(mine, len(mine) - k)[len(mine) - k]
                        others = others[mine >= least]
                    best = others[np.argsort(-row[others], kind="stable")][:k]
                    found[0].append(np.full(len(best), qids[i]))
                    found[1].append(ids[best])
                    found[2].append(row[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    schema = "query_id bigint, vec_id bigint, score bigint"
    want = "cell int, block int, wanted binary"

    def searched(wanted: DataFrame) -> DataFrame:
        met = wanted.join(chunks, "cell").join(packs, "block").select("wanted", "ids", "vs", "qids", "qs")
        return best_of(met.mapInArrow(search, schema))

    def best_of(scores: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first_needs = written(packs.mapInArrow(nearest, want), "topk-near")
    first = written(searched(first_needs), "topk-first")
    reached = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    limits = queries.select("vec_id", "block").distinct().join(reached, "vec_id", "left").groupBy("block").agg(F.collect_list(F.struct("vec_id", "least")).alias("limits"))  # as many as a block has queries
    seen = first_needs.groupBy("block").agg(F.collect_list(F.struct("cell", "wanted")).alias("seen"))

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of = {c: i for i, c in enumerate(cells)}
        for batch in batches:
            out = []
            for b, qids, qs, limits_, seen_ in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(qids, np.int64)
                q = np.frombuffer(qs, np.int64).reshape(len(ids), -1).astype(float)
                least = {x["vec_id"]: x["least"] for x in limits_}
                least = np.array([-np.inf if least.get(i) is None else least[i] for i in ids.tolist()], float)
                top = ((q * q).sum(axis=1)[:, None] + most - bounds(q) ** 2) / 2
                open_ = top + 1e-6 * (1.0 + np.abs(top)) >= least[:, None]
                for x in seen_ or ():
                    open_[np.frombuffer(x["wanted"], np.int32), place_of[x["cell"]]] = False
                for c in np.flatnonzero(open_.any(axis=0)):
                    out.append((cells[c], b, np.flatnonzero(open_[:, c]).astype(np.int32).tobytes()))
            yield needs(out)

    rest = packs.join(limits, "block").join(seen, "block", "left").select("block", "qids", "qs", "limits", "seen").mapInArrow(remaining, want)
    second = searched(written(rest, "topk-rest")).drop("rank")
    return best_of(first.drop("rank").unionByName(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle() -> str:
    return f"""
WITH r AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(e, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM r),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s) WHERE rank <= {K}"""
