"""License scans: phrase labels plus an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive lines with words, for a template of m words at most m of them, however long the lines
and whatever stands between. Block and template are sets of words; a block matches a template if it holds at least
`threshold` of the template's words. Template words are ordered by their frequency in the whole corpus, rarest first.

First whole texts are joined with the templates, as no run can hold what its text does not: a match must share a word
with the template's prefix (all but the last required - 1 words), hold enough template words (length filter), and have
enough words left after the shared one on both sides (positional filter); survivors are verified by the exact
intersection. Words that are in no template can't add to an intersection, so sets are kept to template words; the
frequency table and the prefix index hold at most the templates' words and are the only broadcast data.

Then the runs of the texts that are left are counted, for each template. A word of the template adds one to every run
that begins after the line of its last occurrence, and no more than m - 1 lines before its own: an interval of
beginnings. A running sum over the intervals' ends is the number of different template words in each run, so runs need
neither be listed nor limited.

Null text counts as empty: no words, no labels, null first_word and last_word, score 0. Texts of any length are read
whole. Repeated rows get the same result each; labels that match equally well all stay. An empty table gives no rows.
Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import WORD, ascii_lower, bounded_broadcast, once, row_key, words_of, written

#: phrase -> label
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: label -> blocks of words
TEMPLATES = {
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-4": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
THRESHOLD = 0.9
def templates_of(templates: dict[str, list[str]]) -> list[tuple[int, str, list[str]]]:
    blocks = [(label, sorted(set(re.findall(WORD, block)))) for label, found in templates.items() for block in found]
    return [(i, label, words) for i, (label, words) in enumerate(blocks)]


def required(n: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * n, 9)))


def match_blocks(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", lines: bool = True) -> DataFrame:
    """Every (row, block, template) with containment of at least the threshold: _key, block, label, containment.

    Blocks are the lines, or (not lines) the whole text as block 0.
    """
    spark = docs.sparkSession
    blocks = templates_of(templates)
    vocabulary = sorted({w for _, _, words in blocks for w in words})
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = docs.select(F.explode(words_of(text)).alias("w")).filter(F.col("w").isin(vocabulary)).groupBy("w").count()
    frequency = {r["w"]: r["count"] for r in counts.collect()}  # at most the templates' words
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index, least = [], min(required(len(words), threshold) for _, _, words in blocks)
    for i, label, words in blocks:
        ordered, need = sorted(words, key=order.get), required(len(words), threshold)
        index += [(w, i, label, pos, len(ordered), need, [order[x] for x in ordered]) for pos, w in enumerate(ordered[: len(ordered) - need + 1])]
    prefix_index = spark.createDataFrame(index, "w string, template int, label string, pos int, n int, need int, ranks array<int>")
    rank = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.posexplode(F.split(text, "\n") if lines else F.array(text)).alias("block", "line"))
    known = F.array_distinct(F.filter(words_of(F.col("line")), lambda w: w.isin(vocabulary)))
    sets = once(keyed.select("_key", "block", "line"), words=known).filter(F.size("words") >= least)
    sets = sets.select("_key", "block", F.array_sort(F.transform("words", lambda w: rank[w])).alias("ranks"))
    probes = sets.select("_key", "block", F.col("ranks").alias("have"), F.posexplode("ranks").alias("at", "r"))
    inverse = F.create_map(*[x for w, i in order.items() for x in (F.lit(i), F.lit(w))])
    hits = probes.withColumn("w", inverse[F.col("r")]).join(F.broadcast(prefix_index), "w")
    left = F.least(F.col("n") - F.col("pos"), F.size("have") - F.col("at"))
    before = F.least(F.col("pos"), F.col("at"))
    hits = hits.filter((F.size("have") >= F.col("need")) & (before + left >= F.col("need")))
    shared = F.size(F.array_intersect("have", "ranks"))
    found = hits.filter(shared >= F.col("need")).select("_key", "block", "template", "label", (shared / F.col("n")).alias("containment"))
    return found.groupBy("_key", "block", "template").agg(F.first("label").alias("label"), F.max("containment").alias("containment"))


def match_runs(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every (row, template) that a run of lines holds by at least the threshold: _key, label, containment (the best run's)."""
    spark = docs.sparkSession
    blocks = templates_of(templates)
    longest = [len(re.findall(WORD, block)) for found in templates.values() for block in found]
    words = [(i, w, longest[i], len(own), required(len(own), threshold)) for i, _, own in blocks for w in own]
    known = spark.createDataFrame(words, "template int, w string, m int, n int, need int")
    could = written(match_blocks(docs, templates, threshold, id_col, text_col, lines=False).select("_key", "template", "label"), "license-texts")
    texts = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # hashes of keys are small enough to send where texts would be shuffled; the join of hits below is by the key itself
    wanted = could.select(F.xxhash64("_key").alias("_hash")).distinct()
    texts = texts.withColumn("_hash", F.xxhash64("_key")).join(bounded_broadcast(wanted, 32), "_hash", "left_semi").dropDuplicates(["_key"])
    cut = F.filter(F.transform(F.split("_text", "\n"), words_of), lambda ws: F.size(ws) > 0)
    lines = texts.select("_key", F.posexplode(cut).alias("line", "ws")).select("_key", "line", F.explode(F.array_distinct("ws")).alias("w"))
    hits = lines.join(F.broadcast(known), "w").join(could, ["_key", "template"])
    before = F.lag("line").over(Window.partitionBy("_key", "template", "w").orderBy("line"))
    begin = F.greatest(F.coalesce(before + 1, F.col("line") - F.col("m") + 1), F.col("line") - F.col("m") + 1)
    hits = hits.withColumn("begin", begin)
    ends = F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("change")), F.struct((F.col("line") + 1).alias("at"), F.lit(-1).alias("change")))
    changes = hits.select("_key", "template", "label", "n", "need", F.explode(ends).alias("e")).select("_key", "template", "label", "n", "need", "e.at", "e.change")
    changes = changes.groupBy("_key", "template", "label", "n", "need", "at").agg(F.sum("change").alias("change"))
    held = F.sum("change").over(Window.partitionBy("_key", "template").orderBy("at"))
    best = changes.withColumn("held", held).groupBy("_key", "template", "label", "n", "need").agg(F.max("held").alias("shared"))
    return best.filter(F.col("shared") >= F.col("need")).groupBy("_key", "label").agg(F.max(F.col("shared") / F.col("n")).alias("containment"))


def starts_of(words: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    whole = F.size(words) - F.lit(len(parts))
    at = lambda i: [F.get(words, i + j) == part for j, part in enumerate(parts)]

    def here(i: Column) -> Column:
        test = at(i)[0]
        for more in at(i)[1:]:
            test = test & more
        return test

    none = F.array().cast("array<int>")
    return F.when((whole >= 0) & F.array_contains(words, max(parts, key=len)), F.filter(F.sequence(F.lit(0), F.greatest(whole, F.lit(0))), here)).otherwise(none)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels of every row. score: the best containment of a matched block, 1 where a phrase stands, else 0."""
    matched = written(match_runs(docs, templates, threshold, id_col, text_col), "license-runs")
    matched = matched.groupBy("_key").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    keyed = docs.select(F.col(id_col), row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    df = once(keyed, words=words_of(F.col("_text"))).select(id_col, "_key", "words")
    spots = {label: starts_of(F.col("words"), phrase) for phrase, label in phrases.items()}
    names = [f"_at{i}" for i in range(len(spots))]
    df = once(df.withColumn("n_words", F.size("words").cast("long")), **dict(zip(names, spots.values(), strict=True)))
    every = F.concat(*[F.col(n) for n in names])
    base = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, spots, strict=True)]))
    df = df.select(
        id_col, "_key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(base)).alias("_base"),
    )
    joined = df.join(matched, "_key", "left")
    more = F.coalesce(F.col("_more"), F.array().cast("array<string>"))
    return joined.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
        F.greatest(F.coalesce("_best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle() -> str:
    words = "regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + WORD + "')"
    starts = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        test = " AND ".join(f"w[i + {j + 1}] = '{p}'" for j, p in enumerate(parts))
        starts.append(f"SELECT rid, '{label}' AS label, i AS pos FROM (SELECT rid, w, unnest(range(0, len(w) - {len(parts) - 1})) AS i FROM d WHERE list_contains(w, '{parts[0]}')) WHERE {test}")
    lengths = [len(re.findall(WORD, block)) for found in TEMPLATES.values() for block in found]
    values = ", ".join(f"({i}, '{label}', {own}::VARCHAR[], {required(len(own), THRESHOLD)}, {lengths[i]})" for i, label, own in templates_of(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, {words.format(t="text")} AS w FROM documents),
base AS ({" UNION ALL ".join(starts)}),
b AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
t(tid, label, tw, need, m) AS (VALUES {values}),
could AS (SELECT rid, text, t.* FROM d, t WHERE len(list_intersect(list_distinct(w), tw)) >= need),
cut AS (SELECT rid, k, {words.format(t="ls[k]")} AS lw FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT DISTINCT rid, string_split(text, chr(10)) AS ls FROM could))),
lines AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k) AS ln, lw FROM cut WHERE len(lw) > 0),
runs AS (SELECT c.rid, c.tid, any_value(c.label) AS label, any_value(c.need) AS need, any_value(len(c.tw)) AS n, len(list_intersect(list_distinct(flatten(list(b.lw))), any_value(c.tw))) AS shared
  FROM could c JOIN lines a ON a.rid = c.rid AND len(list_intersect(a.lw, c.tw)) > 0 JOIN lines b ON b.rid = a.rid AND b.ln BETWEEN a.ln AND a.ln + c.m - 1 GROUP BY c.rid, c.tid, a.ln),
m AS (SELECT rid, label, shared / n::DOUBLE AS c FROM runs WHERE shared >= need),
allof AS (SELECT rid, label FROM m UNION SELECT rid, label FROM base),
l AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM allof GROUP BY rid),
s AS (SELECT rid, max(c) AS best FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, greatest(coalesce(s.best, 0.0), CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)"""
