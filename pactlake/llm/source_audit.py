"""How far the sources of each language differ in their words: dense term-block tiles, summed and merged.

Terms are runs of ASCII letters and non-ASCII characters, A-Z folded. A language keeps the terms that stand in at
least `least_docs` of its documents. A group is a (lang, source); p = 1 + floor(10**9 * (count + 2) / (N + 2 V)) for
every group (and each language) and kept term, with N the sum of its counts over the V kept terms, and
f(p, q) = floor((p - q)**2 / (p + q)).

One pass counts terms and documents for each group inside the scan (a table of at most `entries` terms a task,
sent on when full), so that a hot group or word is summed before any shuffle. Kept terms fall into blocks by hash,
about `cells` / groups terms each and `most_terms` at most. A task makes an int64 tile of groups by terms of one
block, takes f of its groups with all groups by broadcasting, adds it up over the block's terms, and keeps the `ranks`
best terms of every group. The pair sums of the blocks are added and the term heaps merged by Spark. Where a language
has many sources, tiles get narrower and the groups whose sums a task makes are dealt into bands, so that neither
holds more than `cells` numbers; the list of groups reaches the tiles by a shuffle.

10**9 * x / d is divided in three steps of 1000, so nothing overflows while N + 2 V stays below 2**53.

Null text, lang and source are ''. Every group occurs, even without terms; a language without kept terms (V = 0) has
pair rows of value 0 and no term rows; a language of one group has no pair rows. Ties go to the smaller item in
UTF-8 order. Repeated rows count each time; texts of any length are read whole. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import discard, written

LEAST_DOCS, RANKS = 10, 10
ENTRIES, CELLS, MOST_TERMS = 400_000, 1 << 18, 1024
UNIT, SMOOTH = 10**9, 2

#: Bytes of UTF-8 that are no part of a term become blanks, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(lang, source, term, n, docs) in partial sums; each group has at least one row, that of the empty term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def sums() -> pa.RecordBatch:
            rows = [(g, t, x) for g, (n, _) in groups.items() for t, x in n.items()]
            found = [groups[g][1][t] for g, t, _ in rows]
            out = [pa.array([g[0] for g, _, _ in rows], pa.binary()).cast(pa.string()), pa.array([g[1] for g, _, _ in rows], pa.binary()).cast(pa.string()), pa.array([t for _, t, _ in rows], pa.binary()).cast(pa.string()), pa.array([x for _, _, x in rows], pa.int64()), pa.array(found, pa.int64())]
            groups.clear()
            return pa.RecordBatch.from_arrays(out, ["lang", "source", "term", "n", "docs"])

        held = 0
        for batch in batches:
            langs, sources, texts = (batch.column(i).cast(pa.binary()).to_pylist() for i in range(3))
            for lang, source, text in zip(langs, sources, texts, strict=True):
                n, found = groups.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                before, own = len(n), Counter(text.translate(_FOLD).split())
                n.update(own)
                found.update(own.keys())
                held += len(n) - before
                if held >= entries:
                    yield sums()
                    held = 0
        if groups:
            yield sums()

    some = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(some("lang"), some("source"), some("text")).mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), by long division."""
    divisor = total + SMOOTH * terms
    rest, share = count + SMOOTH, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        share = share * 1000 + rest // divisor
        rest = rest % divisor
    return share + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def best(values: np.ndarray, terms: list[bytes], k: int) -> list[int]:
    """Places of the k largest values; ties go to the smaller term."""
    if len(values) > k:
        places = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    else:
        places = np.arange(len(values))
    return sorted(places.tolist(), key=lambda i: (-values[i], terms[i]))[:k]


_TILE = "lang string, source string, part string, item string, value bigint"


def tile_of(ranks: int, most_terms: int, cells: int):
    """cogroup function: the counts of one block of terms and the groups of its language, of which those marked
    `own` get their pair sums and best terms here."""

    def tile(counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, terms_kept = groups["lang"][0].as_py(), groups["terms"][0].as_py()
        sources, totals = groups["source"].to_pylist(), groups["total"].to_numpy()
        own = np.flatnonzero(groups["own"].to_numpy(zero_copy_only=False))
        place = {s: i for i, s in enumerate(sources)}
        row = np.array([place[s] for s in counts["source"].to_pylist()], np.int64)
        names = np.array(counts["term"].cast(pa.binary()).to_pylist(), dtype=object)
        vocabulary, column = np.unique(names, return_inverse=True) if len(names) else (names, np.zeros(0, np.int64))
        order = np.argsort(column, kind="stable")
        row, column, n = row[order], column[order], counts["n"].to_numpy()[order]
        wide = max(1, min(most_terms, cells // len(sources)))
        sums = np.zeros((len(own), len(sources)), np.int64)
        found: list[tuple] = []
        for start in range(0, len(vocabulary), wide):
            lo, hi = np.searchsorted(column, (start, start + wide))
            terms = vocabulary[start : start + wide].tolist()
            dense = np.zeros((len(sources), len(terms)), np.int64)
            dense[row[lo:hi], column[lo:hi] - start] = n[lo:hi]
            p = shares(dense, totals[:, None], terms_kept)
            q = shares(dense.sum(axis=0), totals.sum(), terms_kept)
            for k, i in enumerate(own):
                sums[k] += divergence(p[i], p).sum(axis=1)
                rising = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                value = divergence(p[i, rising], q[rising])
                found += [(sources[i], terms[rising[j]], int(value[j])) for j in best(value, [terms[t] for t in rising], ranks)]
        mine, other = np.nonzero(own[:, None] != np.arange(len(sources)))
        source = [sources[i] for i in own[mine]] + [x[0] for x in found]
        item = [sources[i].encode() for i in other] + [x[1] for x in found]
        value = np.concatenate((sums[mine, other], np.array([x[2] for x in found], np.int64)))
        part = ["pair"] * len(mine) + ["term"] * len(found)
        return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.binary()).cast(pa.string()), "value": pa.array(value, pa.int64())})

    return tile


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, entries: int = ENTRIES, cells: int = CELLS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = written(term_counts(docs, entries).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-counts")
    terms = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term")
    kept = written(counts.filter("term <> ''").join(terms, ["lang", "term"]).select("lang", "source", "term", "n"), "audit-kept")
    n_terms = kept.groupBy("lang", "term").count().groupBy("lang").agg(F.count("*").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(n_terms, "lang", "left")
    most = F.least(F.lit(most_terms), F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("groups"))))
    sizes = written(sizes.select("lang", "groups", F.coalesce("terms", F.lit(0)).alias("terms"), F.greatest(F.lit(1), F.ceil(F.coalesce("terms", F.lit(0)) / most)).cast("int").alias("blocks")), "audit-sizes")
    bands = F.ceil(F.col("groups") / F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("groups")))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = kept.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), every(bands).alias("band"), "source", "term", "n")
    right = groups.join(sizes, "lang").select("lang", every(F.col("blocks")).alias("block"), "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", F.pmod(F.xxhash64("source"), bands).cast("int").alias("home"), bands.alias("bands"))
    right = right.select("*", every(F.col("bands")).alias("band")).withColumn("own", F.col("band") == F.col("home"))
    keys = ["lang", "block", "band"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile_of(ranks, most_terms, cells), _TILE)
    tiles = written(tiles, "audit-tiles")
    discard(counts, kept, sizes)
    pairs = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = lambda df: df.withColumn("rank", F.row_number().over(ranked))
    return rank(pairs).unionByName(rank(tiles.filter("part = 'term'")).filter(F.col("rank") <= ranks))


def oracle() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + ({UNIT} * (n + {SMOOTH})::HUGEINT) // ((sum(n) OVER (PARTITION BY lang, source)) + {SMOOTH} * v) AS p,
  sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) + {SMOOTH} * v AS ld FROM dense JOIN v USING (lang)),
pq AS (SELECT *, 1 + ({UNIT} * (ln + {SMOOTH})::HUGEINT) // ld AS q FROM p),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM pq WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= {RANKS}"""
