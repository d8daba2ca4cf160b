"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Shares p of the sources' tokens are raised to an exponent in [0, 1] and normalised. The exponent is bisected
to the largest smoothing allowed: with `max_repeats`, the smallest exponent at which no source is repeated
more than that often; with `target_entropy` (nats), the exponent at which the weights have that entropy.
The default budget is the smallest at which every source is used whole (so mixing only repeats, it loses no
document); a given `budget` in tokens may also cut sources.

Each source is drawn in blocks: a block is one permutation of the source's rows by a seeded hash. Full blocks
repeat the source; the last block stops before its tokens pass what is left of the source's budget. Running
tokens inside a block come from sums per (source, hash cell) plus a running sum inside a cell, so a hot
source is never ordered in one task.

A null source is a source of its own, a null text has no tokens. A source without tokens, and a table with
none at all, is drawn once whole. Repeated rows are drawn as separate rows. An empty table gives no rows.
The bisection runs over one row that holds the sources' sums, 16 bytes and a name for each, which suits up to
millions of sources. Other columns travel in the struct `row`, whatever their names. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import bounded_broadcast, once, written

MAX_REPEATS, STEPS, CELLS, SEED = 2.0, 50, 1024, "mix-1"
#: Bytes of a row of a source's few columns in memory, at most about (longer names make no table wrong, only larger).
_ROW_BYTES = 400


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_weights(sums: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """sums: (_source, tokens), one row each -> _source, tokens, exponent, weight, goal (tokens to draw)."""
    packed = sums.filter("tokens > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("_source", "tokens"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["tokens"])
    packed = once(packed.filter(F.size("s") > 0), total=total)
    packed = once(packed, p=F.transform("s", lambda x: x["tokens"] / F.col("total")))
    top = F.array_max("p")

    def powers(a: Column) -> Column:
        return F.transform("p", lambda x: F.pow(x / top, a))

    def entropy(a: Column) -> Column:
        z = F.aggregate(powers(a), F.lit(0.0), lambda acc, x: acc + x)
        return F.aggregate(powers(a), F.lit(0.0), lambda acc, x: acc - x / z * F.log(x / z))

    def allowed(a: Column) -> Column:  # true above the exponent that is looked for
        if target_entropy is not None:
            return entropy(a) <= F.lit(float(target_entropy))
        if max_repeats is None:
            return F.lit(True)
        if budget is None:  # repeats of the smallest source if the largest is drawn once
            return F.pow(F.array_min("p") / top, a - 1.0) <= F.lit(float(max_repeats))
        z = F.aggregate(powers(a), F.lit(0.0), lambda acc, x: acc + x)
        return F.pow(F.array_min("p") / top, a) / z * F.lit(float(budget)) / (F.array_min("p") * F.col("total")) <= F.lit(float(max_repeats))

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2.0
        ok = allowed(mid)
        return F.struct(F.when(ok, state["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(state["hi"]).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.when(allowed(F.lit(0.0)), F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["hi"])
    packed = once(packed, exponent=found)
    packed = once(packed, v=powers(F.col("exponent")))
    z = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    packed = once(packed, z=z)
    rows = packed.select("exponent", "z", "total", F.array_max(F.transform("s", lambda x: x["tokens"])).alias("most"), F.posexplode("s").alias("i", "x"), "v")
    weight = F.get("v", F.col("i")) / F.col("z")
    whole = F.col("most") * F.get("v", F.col("i")) if budget is None else F.lit(float(budget)) * weight
    rows = rows.select(F.col("x._source").alias("_source"), F.col("x.tokens").alias("tokens"), "exponent", weight.alias("weight"), F.round(whole).cast("long").alias("goal"))
    dry = sums.filter("tokens = 0").select("_source", "tokens", F.lit(None).cast("double").alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("goal"))
    return rows.unionByName(dry)


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, cells: int = CELLS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How often every row is drawn: (row: a struct of docs' columns, tokens, exponent, weight, place, copies: 0 if cut).

    Rows of one source with equal id and token count share one place in a permutation.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")).alias("_source"),
        token_count(F.col(text_col)).alias("_tokens"), order.alias("_place"),
    )
    base = base.withColumn("_cell", F.floor(F.conv(F.substring("_place", 1, 4), 16, 10).cast("int") * cells / 65536).cast("int"))
    narrow = base.select("_source", "_cell", "_tokens", "_place")
    cell_sums = written(narrow.groupBy("_source", "_cell").agg(F.sum("_tokens").alias("t")), "mix-cells")  # sources * cells rows
    weights = written(source_weights(cell_sums.groupBy("_source").agg(F.sum("t").alias("tokens")), max_repeats, target_entropy, budget), "mix-weights")
    wet = F.col("tokens") > 0
    full = F.when(wet, F.floor(F.col("goal") / F.col("tokens"))).otherwise(1).cast("long")
    weights = weights.withColumn("_full", full).withColumn("_rest", F.when(wet, F.col("goal") - F.col("_full") * F.col("tokens")).otherwise(0))
    # the last block reaches into one cell of each source; only that cell's rows are put in order
    before = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    running = cell_sums.withColumn("_before", F.coalesce(F.sum("t").over(before), F.lit(0))).join(weights.select("_source", "_rest"), "_source")
    edges = running.filter((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("t") > F.col("_rest"))).select("_source", "_cell", "_before", "_rest")
    edges = written(edges.filter("_rest > 0"), "mix-edges")
    upto = F.col("_before") + F.sum("_tokens").over(Window.partitionBy("_source", "_cell").orderBy("_place", "_tokens"))
    inside = narrow.join(bounded_broadcast(edges, _ROW_BYTES), ["_source", "_cell"]).withColumn("_upto", upto).filter("_upto <= _rest")
    last = inside.groupBy("_source").agg(F.max(F.struct("_place", "_tokens")).alias("_last"))
    cuts = weights.join(edges.select("_source", F.col("_cell").alias("_edge")), "_source", "left").join(last, "_source", "left")
    cuts = written(cuts.select("_source", "exponent", "weight", "_full", "_edge", "_last"), "mix-cuts")
    joined = base.join(bounded_broadcast(cuts, _ROW_BYTES), "_source", "left")
    more = (F.col("_cell") < F.col("_edge")) | ((F.col("_cell") == F.col("_edge")) & (F.struct("_place", "_tokens") <= F.col("_last")))
    copies = F.col("_full") + F.coalesce(more, F.lit(False)).cast("long")
    return joined.select("row", F.col("_tokens").alias("tokens"), "exponent", "weight", F.col("_place").alias("place"), copies.alias("copies"))


def drawn(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mixture: every row as often as it is drawn: row, tokens, exponent, weight, block (from 0) and key.

    Sorted by block and key, the rows run through one permutation a block. `row.*` are the columns of docs.
    """
    rows = mix(docs, seed=seed, **options).filter("copies > 0")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("row", "tokens", "exponent", "weight", "block", F.md5(F.concat_ws("|", "place", "block")).alias("key"))


def oracle() -> str:
    return f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n, md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
t AS (SELECT s, sum(n)::BIGINT AS tokens FROM d GROUP BY s),
m AS (SELECT max(tokens) AS most, min(tokens) AS least, sum(tokens) AS total FROM t WHERE tokens > 0),
a AS (SELECT *, CASE WHEN least = most THEN 0.0 ELSE greatest(0.0, 1.0 + ln({MAX_REPEATS}) / ln(least::DOUBLE / most)) END AS a FROM m),
v AS (SELECT s, tokens, a, most, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE / most, a) ELSE 0 END AS v FROM t, a),
g AS (SELECT *, v / sum(v) OVER () AS weight, CASE WHEN tokens > 0 THEN round(most * v)::BIGINT ELSE 0 END AS goal FROM v),
f AS (SELECT *, CASE WHEN tokens > 0 THEN goal // tokens ELSE 1 END AS full_blocks FROM g),
r AS (SELECT *, CASE WHEN tokens > 0 THEN goal - full_blocks * tokens ELSE 0 END AS rest FROM f),
o AS (SELECT d.*, weight, a, full_blocks, rest, tokens, sum(n) OVER (PARTITION BY s ORDER BY place, n) AS upto FROM d JOIN r USING (s)),
c AS (SELECT *, full_blocks + (rest > 0 AND upto <= rest)::BIGINT AS copies FROM o)
SELECT * EXCLUDE place, md5(place || '|' || block::VARCHAR) AS block_key FROM (SELECT doc_id, source, n AS n_tokens, CASE WHEN tokens > 0 THEN round(a, 6) END AS exponent, round(weight, 6) AS weight, unnest(range(0, copies)) AS block, place FROM c)"""
