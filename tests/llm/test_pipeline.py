"""The corpus pipeline against a brute-force version of its stages, and every registered query's columns."""

import importlib.util
import os
import re

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from tests.llm.test_operators import brute_components, words

    spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 90").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert corpus_pipeline.language(spark, docs, str(tmp_path)).columns == docs.columns
    stage = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert {i for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)} >= stage and len(stage) > 80
    left = sorted(stage)
    left = [i for i, n, c in brute_components([(i, rows[i]) for i in left]) if not n or c == i]
    bench = [words(r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    grams = {tuple(b[k : k + 10]) for b in bench for k in range(len(b) - 9)}
    left = [i for i in left if not any(tuple(w[k : k + 10]) in grams for w in [words(rows[i])] for k in range(len(w) - 9))]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(left)
    copies = out.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= copies <= 3 and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, ties, a very long text, columns that clash; then nothing at all."""
    import corpus_pipeline

    clean = "the quick brown fox jumps over the lazy dog near the old river bank while seven children watch from the bridge"
    rows = [(1, clean, "en", "a", 0), (1, clean, "en", "a", 0), (2, clean, "en", "a", 0), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "12 34", None, "a", 0), (None, "another text about gardens and rain in the early spring of the year", "en", None, None)]
    rows += [(10 + i, f"letter {i} tells of " + " ".join(f"topic{i}x{j}" for j in range(20)), "en", "b", 0) for i in range(6)] + [(30, "long " + " ".join(f"word{j}" for j in range(30_000)), "en", "b", 0)]
    rows += [(40, "Q: " + " ".join(f"bench{j}" for j in range(12)) + " end", "en", "b", 0)]
    clash = {"lang_pred": "x", "score": "y", "copy_key": "z", "_group": "g", "row": "r", "judged": "j", "tokens": "t"}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(v) for c, v in clash.items()})
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([("b", " ".join(f"bench{j}" for j in range(12))), ("n", None)], "item_id string, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").select("doc_id").collect()}
    assert ids >= {1, None, 30} | set(range(10, 16)) and not ids & {2, 3, 4, 5, 40}
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_copies_stage(spark):
    """Five words and 0.8: brute force of its own, with pairs that 3 words and 0.9 leave apart."""
    import random

    import corpus_pipeline

    rng = random.Random(8)
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for k in range(12):
        base = make(150)
        at = rng.randrange(20, 130)
        rows += [base, base[:at] + make(5 + 3 * k) + base[at:], [w if i % 75 else f"e{k}" for i, w in enumerate(base)]]
    rows += [make(30), make(3), []]
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in enumerate(rows)}
    comp = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                comp = {k: min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for k, c in comp.items()}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {i for i, c in comp.items() if i == c} and 15 < len(kept) < 30


def test_queries_are_registered():
    from pactlake.llm import queries

    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert importlib.util.find_spec("corpus_pipeline")
