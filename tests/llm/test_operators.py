"""Training-data operators against brute force on small fixtures, edge cases included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pactlake.llm import components, decontaminate, language_id, license_scan, lm_score, mixing, ngram_join, repeats, sharding, topk_search, url_filter

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Null and empty texts, null ids, copies, near copies, repeated rows, a very long text; a hot source."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = make(220)
    rows = [(i, make(rng.randint(1, 160))) for i in range(30)]
    near = base.split(" ")
    for i in range(6):
        edited = list(near)
        edited[rng.randrange(200)] = "edit" + str(i)
        rows.append((100 + i, " ".join(edited)))
    rows += [(200, base), (201, base), (201, base), (202, base.upper()), (210, None), (211, ""), (212, " \n "), (213, "One two"), (214, "one  TWO"), (None, make(50)), (215, "x" * 1000), (216, make(20_000)), (217, "Released under the MIT License.\n" + make(40) + "\ncc by nc cc by nc")]
    return spark.createDataFrame([(i, t, "en", "src0" if k % 3 else f"src{k % 7}", len(t or "")) for k, (i, t) in enumerate(rows)], DOC).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOC)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_lm_score_words(spark, docs):
    """Words in place of bytes, whole counts, own counts left out; shuffled words score below fluent ones."""
    found = [(r["doc_id"], r["n_grams"], r["log_score"]) for r in lm_score.score_words(docs, bucket_bytes=20_000, part_bytes=30_000).collect()]
    data = [(i, re.findall(r"[^ \t-\r]+", lower(t or ""))) for i, t in rows_of(docs)]
    grams = lambda w, k: Counter(tuple(w[j - k + 1 : j + 1]) for j in range(k - 1, len(w)))
    all_of = {k: sum((grams(w, k) for _, w in data), Counter()) for k in (1, 2, 3)}
    size, want = sum(len(w) for _, w in data), []
    for i, w in data:
        own = {k: grams(w, k) for k in (1, 2, 3)}
        c = lambda *g, own=own: all_of[len(g)][g] - own[len(g)][g]
        rest, total = max(size - len(w), 1), 0.0
        for j in range(len(w)):
            top = min(j + 1, 3)
            k = next((k for k in range(top, 0, -1) if c(*w[j - k + 1 : j + 1]) > 0), 0)
            value = c(*w[j - k + 1 : j + 1]) / (c(*w[j - k + 1 : j]) if k > 1 else rest) if k else 1 / rest
            total += math.log(value * 0.4 ** (top - k))
        want.append((i, len(w), total))
    by = lambda rows: sorted((str(a), b, round(c, 4)) for a, b, c in rows)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(by(found), by(want), strict=True))
    assert lm_score.score_words(empty(spark)).count() == 0
    fluent = "the quick brown fox jumps over the lazy dog and runs far away".split()
    texts = [" ".join(fluent)] * 3 + [" ".join(reversed(fluent))]
    own = {r["doc_id"]: r["log_score"] for r in lm_score.score_words(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC)).collect()}
    assert own[0] == own[1] == own[2] > own[3] + 10


def test_language_id(spark):
    rng = random.Random(1)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, make("abcde" if i % 2 else "vwxyzü", 30), "aa" if i % 2 else "zz", "s", 0) for i in range(120)]
    rows += [(504, "½ ²", None, "s", 0), (505, "Ⅳ Ⅷ", None, "s", 0), (506, "ª", "aa", "s", 0)] + [(507, make("abcde", 30), "aa", "s", 0)] * 3
    rows += [(508, make("vwxyzü", 60_000), "zz", "s", 0)]
    rows += [(500, None, "aa", "s", 0), (501, "", "aa", "s", 0), (502, "12 34 -- 5", None, "s", 0), (503, make("abcde", 20) + " " + make("vwxyzü", 60), None, "s", 0), (None, make("abcde", 9), "aa", "s", 0)]
    df = spark.createDataFrame(rows, DOC)
    found = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(found[i]["lang_pred"] == k for i, _, k, _, _ in rows[:120])
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows[:120])
    assert [found[i]["lang_pred"] for i in (500, 501, 502, 504, 505)] == ["und"] * 5 and found[500]["score"] == 0
    assert found[506]["lang_pred"] != "und" and found[507]["lang_pred"] == "aa" and found[508]["lang_pred"] == "zz"
    clash = df.withColumns({"lang_pred": F.lit("x"), "held_out": F.lit(1), "score": F.lit("y"), "has a letter": F.lit(2), "n_langs": F.lit(3)})
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(clash).collect()} == {i: r["lang_pred"] for i, r in found.items()}
    assert found[503]["lang_pred"] == "zz" and 0.6 < found[503]["score"] < 0.9 and found[503]["n_langs"] == 2
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(empty(spark)).count() == 0


def test_license_scan(spark, docs):
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(docs.withColumn("words", F.lit(1)).withColumn("label", F.lit("x"))).collect()}
    r = found[217]
    assert (r["base_labels"], r["labels"], r["score"]) == ("cc-by-nc,mit", "cc-by-nc,mit", 1.0)
    assert r["n_base"] == 3 and r["first_word"] == 1 and r["last_word"] == len(words(dict(rows_of(docs))[217])) - 3
    assert found[210]["n_words"] == 0 and found[210]["first_word"] is None and found[210]["labels"] == "" and found[210]["score"] == 0
    text = "This WORK is licensed, under the GNU general public license version 3!\nno license here"
    own = license_scan.scan_licenses(spark.createDataFrame([(1, text, None, None, 0)], DOC)).first()
    assert (own["base_labels"], own["labels"], own["score"]) == ("", "gpl-3", 1.0)
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_license_headers_wrap(spark):
    """Templates wrapped at 70 columns, as plain text and as comments with blank lines between; scattered words are none."""
    import textwrap

    rng = random.Random(4)
    rows, want = [], {}
    for label, blocks in license_scan.TEMPLATES.items():
        for block in blocks:
            filler = " ".join(f"f{rng.randrange(99)}" for _ in range(rng.randint(8, 13)))
            lines = textwrap.wrap(f"{filler} {block} {filler}", 70)
            cut = block.split(" ")
            for text in ("\n".join(lines), "\n".join(f"# {x}\n#" for x in lines), "\r\n".join(f"rem {x}" for x in lines), "x y\n" + "\n".join(cut)):
                want[len(rows)] = label
                rows.append((len(rows), text, None, None, 0))
            want[len(rows)] = None
            rows.append((len(rows), ("\n" + "z " * 99 + "\n").join(cut), None, None, 0))
    rows += [(None, "\n\n", None, None, 0), (None, None, None, None, 0)]
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOC)).collect()}
    for i, label in want.items():
        assert (label in found[i]["labels"].split(",") and found[i]["score"] == 1.0) if label else not found[i]["labels"], (i, label)


def test_line_breaks_do_not_decide(spark):
    """A template with 150 words in its middle: found on one line, and with line breaks anywhere in the filler."""
    block = license_scan.TEMPLATES["apache-2"][1].split(" ")
    filler = [f"z{i}" for i in range(150)]
    one = " ".join(block[:9] + filler + block[9:])
    rows = [(0, one), (1, one.replace(" z70 ", "\nz70 ")), (2, one.replace(" z7 ", "\n\n z7 ").replace(" z99 ", " \r\n# \nz99 "))]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOC)
    assert {(r["labels"], r["score"]) for r in license_scan.scan_licenses(df).collect()} == {("apache-2", 1.0)}


def test_runs_of_lines_equal_brute_force(spark):
    rng = random.Random(8)
    templates = {"a": ["t1 t2 t3 t4 t5 t6"], "b": ["t3 t4 u1", "v1 v2 v1 v3"]}
    pool = sorted({w for ts in templates.values() for t in ts for w in t.split()}) + ["z1", "z2", "--", ""]
    texts = ["\n".join(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    texts += [None, "", "\n\n", texts[0], "t1 t2 t3 t4 t5 t6\n" * 50]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)] + [(3, texts[3], "x", None, 0)], DOC).withColumns({"w": F.lit(1), "template": F.lit(2), "line": F.lit("z")})
    found = {(int(r["_key"].split(":")[0]), r["label"], round(r["containment"], 6)) for r in license_scan.match_runs(df, templates, 0.6).collect()}
    want = set()
    for i, t in enumerate(texts):
        lines = [set(words(line)) for line in (t or "").split("\n") if words(line)]
        for label, blocks in templates.items():
            held = []
            for block in blocks:
                own, m = set(block.split()), len(block.split())
                most = max((len(set().union(*lines[k : k + m]) & own) for k in range(len(lines))), default=0)
                if most >= math.ceil(round(0.6 * len(own), 9)):
                    held.append(most / len(own))
            if held:
                want.add((i, label, round(max(held), 6)))
    assert found == want and len(want) > 50


def test_block_matches_equal_brute_force(spark):
    rng = random.Random(3)
    templates = {"a": ["t1 t2 t3 t4 t5 t6 t7 t8 t9 t10"], "b": ["t3 t4 u1 u2 u3"]}
    pool = sorted({w for ts in templates.values() for t in ts for w in t.split()}) + ["z1", "z2"]
    texts = ["\n".join(" ".join(rng.sample(pool, rng.randint(1, 14))) for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC)
    found = {(int(r["_key"].split(":")[0]), r["block"], r["label"], round(r["containment"], 6)) for r in license_scan.match_blocks(df, templates, 0.6).collect()}
    want = set()
    for i, t in enumerate(texts):
        for b, line in enumerate(t.split("\n")):
            for label, (template,) in templates.items():
                share = len(set(words(line)) & set(template.split())) / len(set(template.split()))
                if share >= 0.6:
                    want.add((i, b, label, round(share, 6)))
    assert found == want and want


def test_mixing(spark, docs):
    rows = mixing.drawn(docs).collect()
    tokens = lambda t: len(re.findall(r"[^ \t\n\v\f\r]+", t or ""))
    base = [(r["doc_id"], r["source"], tokens(r["text"])) for r in docs.collect()]
    size, drawn = Counter(), Counter()
    for _, s, n in base:
        size[s] += n
    for r in rows:
        drawn[r["row"]["source"]] += r["tokens"]
    assert {(r["row"]["doc_id"], r["row"]["source"]) for r in rows} == {(i, s) for i, s, _ in base}  # nothing is lost
    most = max(size.values())
    a = max(0.0, 1 + math.log(2) / math.log(min(size.values()) / most))
    for s, n in size.items():
        goal = round(most * (n / most) ** a)
        assert n <= drawn[s] <= max(goal, n) and goal - drawn[s] <= max(x for _, k, x in base if k == s)
        assert drawn[s] <= 2 * n + 1
    cut = mixing.mix(docs, max_repeats=None, target_entropy=99.0, budget=sum(size.values()) // 2).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert cut <= sum(size.values()) // 2 + len(size)
    assert mixing.drawn(empty(spark)).count() == 0
    clash = docs.withColumns({"_tokens": F.lit(7), "_source": F.lit("x"), "copies": F.lit(9), "tokens": F.lit(8)})
    again = mixing.drawn(clash).select("row.*", F.col("block").alias("b")).collect()
    assert len(again) == len(rows) and {(r["_tokens"], r["_source"], r["copies"], r["tokens"]) for r in again} == {(7, "x", 9, 8)}
    assert len({(r["block"], r["key"]) for r in rows}) >= len({(r["row"]["doc_id"], r["block"]) for r in rows})
    dry = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, "s", 0)], DOC)
    assert mixing.drawn(dry).count() == 2


def test_sharding(spark, docs):
    rows = sharding.shard_by_bytes(docs).collect()
    base = Counter((i, len((t or "").encode()) + 1) for i, t in rows_of(docs))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == base
    loads, slots, homes = Counter(), {}, {}
    texts = dict(rows_of(docs))
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        if r["doc_id"] is not None:
            homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        assert 0 <= r["shard"] < 8 and r["law"] == "bytes" and r["grown_shard"] is None
        if texts.get(r["doc_id"]) is not None:
            assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert all(len(h) == 1 for h in homes.values())
    groups = Counter()
    for i, t in rows_of(docs):
        groups[t if t is not None else ("null",)] += len((t or "").encode()) + 1
    ideal = sum(groups.values()) / 8  # the best partition is no better than the mean, nor than the largest group
    assert max(loads.values()) <= max(max(groups.values()), 1.35 * ideal), loads
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(empty(spark)).count() == 0
    clash = docs.withColumns({"_group": F.lit(1), "size": F.lit(2), "shard": F.lit(3), "_row": F.lit(4)})
    assert Counter((r["doc_id"], r["size"]) for r in sharding.shard_by_bytes(clash).collect()) == base


def test_sharding_balances_many_groups(spark):
    """1000 texts of 1 to 3000 bytes: the law itself, loads a few bytes apart, and repeats of a row far apart."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 3000))) for _ in range(1000)] + ["same text"] * 64
    df = spark.createDataFrame([(i if i < 1000 else 1000, t, None, None, 0) for i, t in enumerate(texts)], DOC)
    loads, places = Counter(), []
    for r in sharding.shard_by_bytes(df).collect():
        loads[r["shard"]] += r["size"]
        if r["doc_id"] == 1000:
            places.append((r["shard"], r["slot"]))
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 64, loads
    assert len({s for s, _ in places}) == 1 and sum(b[1] == a[1] + 1 for a, b in zip(sorted(places), sorted(places)[1:])) < 50


@pytest.mark.parametrize("fan", [3, 100])
def test_sharding_joins_buckets_in_levels(spark, fan):
    """The law holds when the buckets are joined level by level; ties, copies and nulls included."""
    rng = random.Random(fan)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 3000))) for _ in range(1200)] + ["tie"] * 40 + [None] * 30 + ["abc", "acb", "bca"]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC)
    rows = sharding.shard_by_bytes(df, fan=fan).collect()
    loads, homes, slots = Counter(), {}, {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(texts) and all(len(h) == 1 for h in homes.values())
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 1024, loads
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_differencing_balances():
    rng = random.Random(2)
    sizes = [rng.randint(1, 10_000) for _ in range(500)]
    parts = sharding.differencing([([s, *[0] * 7], [sharding.single(i), *[None] * 7]) for i, s in enumerate(sizes)], 8)
    assert sorted(i for _, p in parts for i in sharding.members(p)) == list(range(500))
    assert all(sum(sizes[i] for i in sharding.members(p)) == load for load, p in parts)
    assert max(x for x, _ in parts) - min(x for x, _ in parts) <= 20


def test_topk(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, [0.25] * 6) for i in range(120)] + [(600, None), (650, [float("nan")] * 6), (700, []), (750, [1.0, 2.0]), (None, [0.1] * 6), (800, [None] + [0.1] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0, chunk=32, block=4, pivots=6).collect()]
    import numpy as np

    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and i < 600}
    want = []
    for q in good:
        if q % 50 == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(found) == sorted(want)
    huge = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, -2.0]), (2, [3e30, 0.0]), (2, [3e30, 0.0]), (50, [1.0, 1.0, 1.0]), (51, [2.0, 0.5, -1.0])], "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1))
    rows_ = [tuple(r) for r in topk_search.top_k(huge, F.col("vec_id") % 50 == 0).collect()]
    assert [r for r in rows_ if r[0] == 50] == [(50, 1, 51, 256 * 512 + 256 * 128 - 256 * 256)]
    assert [r[1:] for r in sorted(rows_) if r[0] == 0] == [(1, 1, (1 << 63) - 1), (2, 2, (1 << 63) - 1), (3, 2, (1 << 63) - 1)]  # beyond a long: cut, by vec_id
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.top_k(df.filter("vec_id in (0, 7)"), F.col("vec_id") % 50 == 0).count() == 1


def test_decontaminate(spark, docs):
    texts = dict(rows_of(docs))
    long = words(texts[216])
    items = [(1, " ".join(long[500:515])), (2, " ".join(long[-12:])), (3, "nothing of this stands anywhere in any of the documents at all"), (4, "one TWO"), (5, None), (6, " . "), (4, "one TWO"), (7, " ".join(long[505:511]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.decontaminate(docs, bench).collect())
    want = []
    for i, t in rows_of(docs):
        w, hit, names = words(t), set(), set()
        for name, item in items:
            v = words(item)
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    names.add(str(name))
        want.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert found == sorted(want) and sum(x[2] > 0 for x in want) >= 3
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert not decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count()
    left = decontaminate.decontaminate_rows(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[5] for x in want)


def test_decontaminate_repeated_grams(spark):
    """The same word over and over on both sides costs no more than its places; extra columns keep their values."""
    import time

    rows = spark.createDataFrame([(1, "the " * 3000 + "end", None, "k", 0), (2, "an other text of a dozen words that no item holds at all", None, "k", 0)], DOC).withColumn("leak_key", F.lit("mine"))
    bench = spark.createDataFrame([(1, "the " * 1000), (2, "of a dozen")], "item_id bigint, text string")
    began = time.time()
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(rows, bench).collect()}
    assert found == {1: (3001, 3000, 1), 2: (13, 3, 1)} and time.time() - began < 60
    left = decontaminate.decontaminate_rows(rows, bench.filter("item_id = 1")).collect()
    assert [(r["doc_id"], r["leak_key"]) for r in left] == [(2, "mine")]


def test_suffix_order(spark):
    """Ranks against sorted suffixes; repeated starts against counting."""
    from pactlake.llm import suffix_order

    for text in (b"banana$", b"aaaaaaa", b"mississippi", b"ab", b"a"):
        rows = [(i, b + 1) for i, b in enumerate(text)]
        found = {r["pos"]: r["rank"] for r in suffix_order.suffix_ranks(spark.createDataFrame(rows, "pos bigint, a bigint"), len(text)).collect()}
        want = {p: k for k, p in enumerate(sorted(range(len(text)), key=lambda p, text=text: text[p:]))}
        assert found == want, text
    rng = random.Random(6)
    passage = "".join(rng.choice("xyz ") for _ in range(260))
    texts = ["ab " + passage + " cd", passage[5:250], "é" * 140, "q", "ab " + passage + " cd"]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id bigint, h int, text string")
    found = {(r["id"], r["first"]) for r in suffix_order.repeated_starts(df, 200).collect()}
    raw = [t.encode() for t in texts]
    counts = Counter(x[k : k + 200] for x in raw for k in range(len(x) - 199))
    assert found == {(i, k) for i, x in enumerate(raw) for k in range(len(x) - 199) if counts[x[k : k + 200]] > 1}
    out = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(df.withColumnRenamed("id", "doc_id"), length=200).collect()}
    other = repeats.remove_repeats(df.withColumnRenamed("id", "doc_id"), length=200, starts_of=lambda t: suffix_order.repeated_starts(t, 200))
    assert out == {r["doc_id"]: r["n_removed"] for r in other.collect()} and out[0] == len(raw[0])


def test_repeats_of_named_rows(spark):
    """Ids of any type, null ids with equal hashes, extra columns."""
    long = "".join(random.Random(3).choice("abc ") for _ in range(700))
    rows = [("x", long), ("y", "!" + long[:450]), (None, "short"), (None, long[300:])]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"h": F.lit(1), "inner": F.lit(2)})
    found = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.remove_repeats(df).collect()}
    assert found == {("x", 700): 700, ("y", 451): 450, (None, 5): 0, (None, 400): 400}


def test_estimate_equals_plain_em():
    """Expectation-maximisation and backward elimination, row by row in plain Python."""
    import numpy as np

    rng = np.random.default_rng(4)
    logs, bounds = rng.normal(0, 3, (60, 3)), np.array([0, 0, 1, 12, 30, 60])

    def em(likes, active):
        pi = [a / sum(active) for a in active]
        for _ in range(12):
            sums = [0.0] * len(pi)
            for row in likes:
                joint = [p * x for p, x in zip(pi, row)]
                sums = [s + j / sum(joint) for s, j in zip(sums, joint)]
            pi = [s / len(likes) for s in sums]
        return pi, sum(math.log(sum(p * x for p, x in zip(pi, row))) for row in likes)

    found = language_id.estimate(logs, bounds, 1.0, 12)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if a == b:
            assert not found[i].any()
            continue
        likes = [[math.exp(x - max(row)) + 1e-12 for x in row] for row in logs[a:b].tolist()]
        active = [1.0] * 3
        pi, fit = em(likes, active)
        while sum(active) > 1:
            weakest = min((p, k) for k, p in enumerate(pi) if active[k])[1]
            tried = [0.0 if k == weakest else x for k, x in enumerate(active)]
            new, new_fit = em(likes, tried)
            if new_fit + math.log(max(b - a, 2)) / 2 < fit:
                break
            active, pi, fit = tried, new, new_fit
        assert np.allclose(found[i], pi, atol=1e-9), i


def test_repeats(spark, docs):
    passage = "ab" * 30 + "".join(random.Random(9).choice("xyz ") for _ in range(500))
    more = spark.createDataFrame([(300, "head é " + passage + " tail", None, None, 0), (301, passage[100:520] + "!" + passage[:450], None, None, 0)], DOC)
    df = docs.unionByName(more)
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect())
    data = [(i, (t or "").encode()) for i, t in rows_of(df)]
    counts = Counter(raw[k : k + 400] for _, raw in data for k in range(len(raw) - 399))
    want = []
    for i, raw in data:
        gone = bytearray(len(raw))
        for k in range(len(raw) - 399):
            if counts[raw[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append((str(i), len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert found == sorted(want) and sum(x[2] > 0 for x in want) >= 6
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_shared_passages(spark, docs):
    """Words of 50-word passages that other documents hold, most of them under 400 bytes, against counting windows."""
    rng = random.Random(12)
    say = lambda n: ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    p, q, own = say(51), say(90), say(60)
    texts = [
        say(30) + p + say(40), p[:30] + ["\n"] + p[30:] + say(7), say(9) + [x.upper() for x in p[1:]], say(3) + p[2:] + say(3),  # 51, 51, 50 and 49 words of it
        own + say(4) + own, own + say(5), own[:55] + say(2) + own[:55],  # also twice in one text
        say(5) + q + say(1) + q[3:70] + say(2) + q[:60], q[20:] + say(50), q[10:75],
        say(70) + ["x"] + say(20), (w := say(80)) + w, ["la"] * 300, ["la"] * 120, ["lo"] * 200,
    ]
    df = docs.unionByName(spark.createDataFrame([(400 + i, " ".join(t), None, None, 0) for i, t in enumerate(texts)], DOC))
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_passage_words"]) for r in repeats.remove_repeats(df).collect())
    data = [((i, t), re.findall(r"[^ \t-\r]+", lower(t or ""))) for i, t in rows_of(df)]
    holders = {}
    for key, words in data:
        for k in range(len(words) - 49):
            holders.setdefault(tuple(words[k : k + 50]), set()).add(key)
    want = []
    for (i, t), words in data:
        hit = {j for k in range(len(words) - 49) if len(holders[tuple(words[k : k + 50])]) > 1 for j in range(k, k + 50)}
        want.append((str(i), len((t or "").encode()), len(hit)))
    assert found == sorted(want)
    of = {i: n for i, _, n in want}
    assert [of[str(400 + i)] for i in (0, 1, 2, 3, 4, 5, 6, 10, 11, 12, 13, 14)] == [51, 51, 50, 0, 120, 60, 110, 0, 0, 300, 120, 0]


def test_url_filter(spark):
    urls = [None, "", "no scheme/com/en/", "http://A.Example.COM/en/712?x", "https://example.com/en/6", "http://notexample.com/en/", "http://xcom/en/", "ftp://b.net/de/", "http://q.example.net/de/8#f", "http://c.org/es", "http://x.io/porn/a", "http://x.io/xporn", "http://x.io/casino/poker", "http://x.io/casino-casino", "http://user:p@x.io:80"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert found[0] == found[1] == ("", "", None, "allow") and found[2][:3] == ("", "", None)
    assert found[3] == ("a.example.com", "/en/712", "example.com/en/7", "allow")
    assert found[4][2:] == ("com/en/", "block") and found[5][2:] == ("com/en/", "block") and found[6][2:] == (None, "allow")
    assert found[7][2:] == ("net/de/", "allow") and found[8] == ("q.example.net", "/de/8", "example.net/de/8", "block") and found[9][2:] == (None, "allow")
    assert [found[i][3] for i in (10, 11, 12, 13)] == ["block", "allow", "block", "allow"] and found[14][:2] == ("user:p@x.io:80", "")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def shingles(t):
    w = re.findall(r"[^ \t-\r]+", lower(t or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for k, (x, _) in enumerate(rows) if root(k) == root(i) and x is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return out


def test_ngram_join(spark, docs):
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs).collect())
    want = sorted((str(a), b, c) for a, b, c in brute_components(rows_of(docs)))
    assert found == want and len({x[2] for x in want}) < len(want)
    assert ngram_join.join_documents(empty(spark)).count() == 0
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    best = {c for _, n, c in brute_components(rows_of(docs)) if n}
    assert sorted(str(r["doc_id"]) for r in kept.collect() if shingles(r["text"])) == sorted(str(c) for c in best)


def test_columns_that_clash(spark, docs):
    """Other columns may have the names that the operators use inside."""
    names = ("cno", "gid", "token", "key", "n", "comp", "copy_key", "word", "gram", "count", "bucket", "ranges", "words")
    clash = docs.withColumns({c: F.lit("x") for c in names})
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(ngram_join.join_documents(clash)) == plain(ngram_join.join_documents(docs))
    assert plain(ngram_join.keep_first(clash).select("doc_id", "text")) == plain(ngram_join.keep_first(docs).select("doc_id", "text"))
    assert plain(lm_score.score_words(clash)) == plain(lm_score.score_words(docs))


def test_ngram_join_chain(spark):
    """A chain of single edits: the ends do not link, but belong together."""
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w)))
        w[5 + i * 9] = f"e{i}"
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOC)
    assert {r["component_id"] for r in ngram_join.join_documents(df).collect()} == {0}


def family(rng, n, own, shared=170, start=0):
    """Texts of `shared` common words with `own` words of their own in one place: they share nearly all, most link with none."""
    base = [f"s{i}" for i in range(shared)]
    rows = []
    for k in range(n):
        at, many = rng.randrange(shared), own + rng.randrange(3)
        rows.append((start + k, " ".join(base[:at] + [f"o{start + k}x{j}" for j in range(many)] + base[at:])))
    return rows


@pytest.mark.parametrize("hot_pairs", [1, 200])
def test_families_that_share_much(spark, docs, hot_pairs):
    """Families around the limit, and the fixture, with the classes of nearly every shingle ordered anew."""
    rng = random.Random(hot_pairs)
    rows = family(rng, 60, 16) + family(rng, 40, 6, start=100) + family(rng, 30, 7, shared=150, start=200) + rows_of(docs)
    rows += [(300 + i, t + " " + " ".join(f"e{i}{j}" for j in range(i % 9))) for i, (_, t) in enumerate(family(rng, 40, 2, start=400))]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOC)
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(df, hot_pairs=hot_pairs).collect())
    assert found == sorted((str(a), b, c) for a, b, c in brute_components(rows))


def test_a_large_family_without_links(spark):
    """Four thousand texts that share all but sixteen words: none links, and no square of them is gone through."""
    rows = family(random.Random(3), 4000, 16, shared=186)
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOC).repartition(4)
    found = ngram_join.join_documents(df).collect()
    assert len(found) == 4000 and all(r["component_id"] == r["doc_id"] for r in found)


def test_a_family_with_many_links_is_contracted(spark, monkeypatch):
    """Copies with two readings at each of twelve places, linked where at most three differ: about one pair in fourteen, and no centre."""
    rng, rows = random.Random(4), []
    for k in range(400):
        read = [f"s{i}" for i in range(200)]
        for at in range(8, 200, 16):
            read[at] += rng.choice("ab")
        rows.append((k, " ".join(read)))
    tested, overlaps = [], ngram_join.overlaps
    monkeypatch.setattr(ngram_join, "overlaps", lambda pairs, *more: (tested.append(pairs.count()), overlaps(pairs, *more))[1])
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOC)
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(df, hot_pairs=200).collect())
    assert found == sorted((str(a), b, c) for a, b, c in brute_components(rows))
    assert sum(tested) < 8 * len(rows), tested


def test_ngram_join_writes_few_tables(spark, docs, monkeypatch):
    """A table costs a file for each shuffle partition, however small it is; found components are not gone through link by link again."""
    tables, graphs, written, connect = [], [], ngram_join.written, ngram_join.components
    for module in (ngram_join, components):
        monkeypatch.setattr(module, "written", lambda df, label: (tables.append(label), written(df, label))[1])
    monkeypatch.setattr(ngram_join, "components", lambda links: (graphs.append(links.count()), connect(links))[1])
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs).collect())
    assert found == sorted((str(a), b, c) for a, b, c in brute_components(rows_of(docs)))
    assert graphs[0] > 0 and graphs[1] == 0, graphs
    assert len(tables) < 30, tables


@pytest.mark.parametrize("few", [True, False])
def test_components_against_union_find(spark, monkeypatch, few):
    """Random sparse graphs, with labels that are broadcast and with labels that are not."""
    monkeypatch.setattr(components, "MOST_BROADCAST", 1 << 20 if few else 0)
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(70)] + [(5, 5)]
    least = {x: x for link in links for x in link}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    frame = spark.createDataFrame(links, "a int, b int")
    apart = {x for a, b in links for x in (a, b) if a != b}
    assert {r["id"]: r["comp"] for r in components.components(frame).collect()} == {x: least[x] for x in apart}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert set(found.values()) == {0, 100} and len(found) == 44
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0
