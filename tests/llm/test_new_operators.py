"""Source audit, hard negatives and token counts against brute force, edge cases included."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pactlake.llm import hard_negatives, source_audit, token_counts

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---- source audit ----


def brute_audit(rows, least_docs, ranks):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    groups, found = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups[lang or "", source or ""].update(terms)
        found[lang or ""].update(set(terms))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in found[lang].items() if n >= least_docs]
        all_of = sum((c for (other, _), c in groups.items() if other == lang), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(source2, sum(f(p(own, t), p(c, t)) for t in kept)) for (lang2, source2), c in groups.items() if lang2 == lang and source2 != source]
        terms = [(t, f(p(own, t), p(all_of, t))) for t in kept if own[t] and p(own, t) > p(all_of, t)]
        for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, rank + 1) for rank, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def audited():
    """A hot source, nulls everywhere, repeated rows, ties between terms, a language without kept terms, a long text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abÀé語Z") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = lambda n: ", ".join(rng.choice(words) + rng.choice(["", "7", "-x"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), rng.choice(["en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 5}", 0) for i in range(150)]
    rows += [(200, None, "en", "no text", 0), (201, "", "en", None, 0), (202, "", "xx", "alone", 0), (203, "rare words", "fr", "a", 0), (204, None, "fr", "b", 0), (None, text(30), "en", "hot", 0)]
    rows += [(300, text(20_000), "de", "s1", 0)] + [(301, "tie1 twin tier", "de", "ties", 0)] * 12
    return rows


@pytest.mark.parametrize(("entries", "cells", "most_terms"), [(400_000, 1 << 18, 1024), (50, 16, 3)])
def test_audit(spark, audited, entries, cells, most_terms):
    docs = spark.createDataFrame(audited, DOC).withColumns({"term": F.lit("x"), "count": F.lit(1), "value": F.lit(0), "terms": F.lit(1)}).repartition(3)
    found = source_audit.audit(docs, least_docs=5, entries=entries, cells=cells, most_terms=most_terms).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, found)) == brute_audit(audited, 5, 10)


def test_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], DOC)).collect() == []


def test_shares_of_huge_counts():
    import numpy as np

    counts = np.array([0, 1, 10**15, 3 * 10**15], np.int64)
    got = source_audit.shares(counts, np.int64(4 * 10**15 + 1), 10**6).tolist()
    assert got == [1 + 10**9 * (int(c) + 2) // (4 * 10**15 + 1 + 2 * 10**6) for c in counts]


# ---- hard negatives ----

VECTOR = "vec_id bigint, embedding array<float>, label int"


def brute_negatives(rows, every=10):
    import math

    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in kept.items() if i != a and len(w) == len(v)}
        best = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:5]  # noqa: B023, E731
        for p in best([i for i in score if kept[i][0] == label]):
            fits = [i for i in score if kept[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(best(fits))]
    return sorted(out)


def mined(vectors, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(vectors, F.col("vec_id") % 10 == 0, label, **more)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize(("chunk", "block", "slack"), [(2048, 512, 24), (16, 3, 5)])
def test_hard_negatives(spark, chunk, block, slack):
    """A vector that a third of the rows share (ties by id), a hot label, nulls, mixed lengths, repeated ids, one-row labels."""
    rng = random.Random(11)
    point = lambda n=6: [rng.uniform(-1, 1) for _ in range(n)]
    hot = [0.5, -0.25, 0.75, 0.1, 0.0, 0.3]
    rows = [(i, hot if i % 3 == 0 else [x + rng.uniform(-0.3, 0.3) for x in hot] if i % 3 == 1 else point(), 1 if i % 4 == 0 else rng.randint(0, 3)) for i in range(200)]
    rows += [(500, None, 1), (510, hot, None), (520, [0.1, None] * 3, 1), (530, [float("nan")] + hot[1:], 1), (540, [float("inf")] + hot[1:], 2), (550, [], 1), (None, hot, 1)]
    rows += [(600 + i, point(3), i % 2) for i in range(30)] + [(700, hot, 9), (710, [0.0] * 6, 1)] + [(0, hot, 1), (720, hot, 2), (720, hot, 2), (721, point(), 3), (721, point(), 2)]
    rows += [(730, [-x for x in hot], 8), (731, hot, 8)]  # a negative score
    vectors = spark.createDataFrame(rows, VECTOR).withColumns({"v": F.lit(1), "dim": F.lit(2), "block": F.lit(3), "is_anchor": F.lit(False)}).repartition(3)
    found = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    assert mined(vectors, chunk=chunk, block=block, slack=slack) == brute_negatives(found)


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    assert mined(spark.createDataFrame([], VECTOR)) == []
    assert mined(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], VECTOR)) == []  # no anchor
    with pytest.raises(ValueError, match="squared norms"):
        mined(spark.createDataFrame([(10, [3e30], 1)], VECTOR))


# ---- token counts ----


def test_token_counts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    texts = [None, "", " ", "   a", "▁a▁ x", "<s> </s> <unk> <0x41>", "a\x00b", "\n\t\n", "é ﬁ １ 日本語 😀😀", "a" * 5000, "ab" * 500 + " " * 40, "=" * 300, "don't,stop.\nNow; (really)!", "the words " * 20_000]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     \n\t.,▁é日😀<>/s=-'0") for _ in range(rng.randrange(150))) for _ in range(400)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, "   a", "en", "s", 0), (None, "x y", None, None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"n_tokens": F.lit(0), "n_bytes": F.lit(0)})
    found = [tuple(r) for r in token_counts.count_tokens(docs, MODEL).collect()]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(spark.createDataFrame([], DOC), MODEL).collect() == []


def test_token_cache_is_bounded():
    merger = token_counts.Merger(token_counts.model_bytes(MODEL), cached_words=10)
    text = " ".join(f"wörd{i}" for i in range(100))
    assert merger.count(text) == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text))
    assert len(merger.of_word) <= 10 and len(merger.of_part) <= 10


def test_token_model_must_have_bytes(tmp_path):
    (tmp_path / "large").write_bytes(b"\x00" * (token_counts.MODEL_BYTES + 1))
    with pytest.raises(ValueError, match="larger"):
        token_counts.model_bytes(str(tmp_path / "large"))
