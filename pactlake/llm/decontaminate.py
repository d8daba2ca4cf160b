"""Benchmark decontamination by winnowing.

Both sides are cut into words once; words become 64-bit hashes, which stand for them from then on. Hashes of
`gram` consecutive words are winnowed: of every `window - gram + 1` neighbouring ones the smallest is kept as a
fingerprint. Any `window` consecutive words hold one whole selection window, so training and test text that
share `window` words share a fingerprint, whatever stands around them. Rows that share a fingerprint with an
item are candidates; there the hit is extended: each of the row's windows is looked up among the windows of the
items, and the words of all windows found are hit. This is linear in the row's words, however often a gram
repeats on either side.

Items shorter than a window (but not empty) form one window of their own length, which may hold no fingerprint;
rows that hold the item's word with the largest hash are candidates for those.

Null text and text without words: no hits, empty item list. Null items and items with a null id take no part.
Repeated rows get the same result each; repeated item rows count as one item. Empty tables on either side give
n_hit 0 or no rows. Other input columns are ignored by decontaminate and kept as they are by decontaminate_rows,
whatever their names. A row's words are an array in one task (about 50 bytes a word while it is built).
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import bounded_broadcast, discard, once, row_key, spare, words_of, written

WINDOW, GRAM = 10, 5
#: Bytes of a row of keys in memory, at most about.
_KEY_BYTES = 120


def grams(hashes: Column, n: int) -> Column:
    """Hash of every n consecutive words, by start. hashes is read n times a place: make it a column of its own first."""
    none = F.array().cast("array<bigint>")
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - n, F.lit(0)))
    return F.when(F.size(hashes) >= n, F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))).otherwise(none)


def winnowed(hashes: Column, keep_of: int) -> Column:
    """Distinct smallest hashes of every keep_of neighbours; arrays shorter than that give nothing."""
    none = F.array().cast("array<bigint>")
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - keep_of, F.lit(0)))
    return F.when(F.size(hashes) >= keep_of, F.array_distinct(F.transform(starts, lambda i: F.least(*[F.get(hashes, i + j) for j in range(keep_of)])))).otherwise(none)


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def find_hits(tokens: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """tokens (key, hs) -> (hits: key, start, length, print; items: print, length, item_id).

    A hit is one window of an item that stands in a row, in words from `start`; several items may have it.
    """
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("hs")).filter((F.size("hs") > 0) & F.col("item_id").isNotNull())
    items = written(items.distinct(), "leak-items")
    lengths = sorted({window} | {r["n"] for r in items.filter(F.size("hs") < window).select(F.size("hs").alias("n")).distinct().collect()})  # at most `window`
    short = lengths[:-1]
    sides = [items.filter((F.size("hs") >= n) if n == window else (F.size("hs") == n)) for n in lengths]
    own = [side.select(F.explode(grams(F.col("hs"), n)).alias("print"), F.lit(n).alias("length"), "item_id") for n, side in zip(lengths, sides, strict=True)]
    windows = written(reduce(DataFrame.unionByName, own).distinct(), "leak-windows")
    prints = winnowed(F.col("gs"), window - gram + 1)
    probes = once(sides[-1], gs=grams(F.col("hs"), gram)).select(F.explode(prints).alias("fp"))
    if short:
        probes = probes.unionByName(items.filter(F.size("hs") < window).select(F.array_max("hs").alias("fp")))
        prints = F.concat(prints, F.array_distinct("hs"))
    probes = written(probes.distinct(), "leak-prints")
    sought = once(tokens, gs=grams(F.col("hs"), gram)).select("key", F.explode(prints).alias("fp")).join(bounded_broadcast(probes, 32), "fp", "left_semi")
    keys = written(sought.select("key").distinct(), "leak-candidates")
    held = written(tokens.join(bounded_broadcast(keys, _KEY_BYTES), "key", "left_semi").dropDuplicates(["key"]), "leak-held")
    places = reduce(DataFrame.unionByName, [held.select("key", F.posexplode(grams(F.col("hs"), n)).alias("start", "print"), F.lit(n).alias("length")) for n in lengths])
    known = written(windows.select("print", "length").distinct(), "leak-known")
    hits = written(places.join(bounded_broadcast(known, 48), ["print", "length"], "left_semi").select("key", "start", "length", "print"), "leak-hits")
    discard(items, probes, keys, held, known)
    return hits, windows


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hit words and items of every row."""
    keyed = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    tokens = once(keyed, hs=word_hashes(F.col("text"))).select("id", "key", F.size("hs").cast("long").alias("n_words"), "hs")
    tokens = written(tokens, "leak-tokens")
    hits, windows = find_hits(tokens.select("key", "hs"), benchmark, window, gram)
    rows = written(tokens.select("id", "key", "n_words"), "leak-rows")
    discard(tokens)
    at = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))
    words = hits.select("key", at.alias("at")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    found = hits.select("key", "print", "length").distinct().join(windows, ["print", "length"]).select("key", F.col("item_id").cast("string").alias("item")).distinct()
    items = found.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))  # a row of the result holds them all
    joined = rows.join(written(words.join(items, "key"), "leak-found"), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without a hit, with all their columns."""
    key = spare(docs, "leak_key")
    named = row_key(F.col(id_col), F.col(text_col))
    tokens = written(docs.select(named.alias("key"), word_hashes(F.col(text_col)).alias("hs")), "leak-tokens")
    hits, windows = find_hits(tokens, benchmark, window, gram)
    dirty = written(hits.select(F.col("key").alias(key)).distinct(), "leak-dirty")
    discard(tokens, hits, windows)
    return docs.withColumn(key, named).join(bounded_broadcast(dirty, _KEY_BYTES), key, "left_anti").drop(key)


def oracle() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
sizes AS (SELECT DISTINCT n FROM i),
dw AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
h AS (SELECT rid, item_id, k, n FROM dw JOIN iw USING (n, g)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM h) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""
