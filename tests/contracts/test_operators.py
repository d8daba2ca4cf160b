"""Contract operators on hand-written rows."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from pactlake.operators import coverage, evaluate, evidence, export, filters, jobs, merge, model_io, segment
from pactlake.plans import catalog, config
from pactlake.sources import documents

SMALL = "/root/testdata/sf0.001"
SEGMENT = "doc_id string, seg_no int, segment_id string, text string, title string, page int, source string, parent_section_title string, token_count int, chunk_index int, chunk_total int, is_continuation boolean"


def seg(n, body, title=None, page=1, source="a.txt", parent=None, doc="d"):
    return (doc, n, f"seg_{n:03d}", body, title, page, source, parent, len(body.split()), 1, 1, False)


def group(pos, name, related=(), context="", exact=None, kind="other", doc="d", **meta):
    fields = ("page", "source", "id", "segment_id", "clause_no", "parent_section_title", "coverage_source", "token_count", "chunk_index", "chunk_total", "is_continuation")
    return (doc, pos, name, kind, list(related), context, exact, [], tuple(meta.get(f) for f in fields))


def groups(spark, *rows):
    return spark.createDataFrame(list(rows), merge.GROUP)


def by_pos(df):
    return sorted(df.collect(), key=lambda r: r["pos"])


def test_segments_keep_titles_with_bodies(spark):
    body = "MASTER AGREEMENT\nIt opens here.\n1. Parties\nAcme and Bolt.\n2. Payment\n2.1 Fees: monthly.\n(a) by wire\n3. Empty\n4. Last\nDone now."
    pages = spark.createDataFrame([("d", "a.txt", 1, body)], "doc_id string, source string, page int, text string")
    found = sorted(segment.segment_pages(pages).collect(), key=lambda r: r["seg_no"])
    assert [r["title"] for r in found] == [None, "1. Parties", "2.1 Fees:", "(a)", "4. Last"]
    assert [r["parent_section_title"] for r in found] == [None, None, "2. Payment", "2.1 Fees:", None]
    assert found[1]["text"] == "1. Parties\nAcme and Bolt." and found[-1]["segment_id"] == "seg_005"


def test_merge_parties_and_payment(spark):
    intro = "This is made between Acme and Bolt, the Client."
    df = groups(spark, group(0, "Contracting Parties", ["Buyer"], intro, id="s1"), group(1, "Client", [], intro + " service provider", "exact", id="s1"), group(2, "Client", [], "The client pays.", id="s2"), group(3, "Fees", ["Invoice"], "x", id="s2"), group(4, "Net 30", ["invoice"], "y", id="s2"), group(5, "Invoice", [], "z", id="s3"))
    out = by_pos(merge.merge_groups(df))
    assert [r["representative_keyword"] for r in out] == ["Parties", "Client", "Payment Terms", "Payment Terms"]
    assert out[0]["related_keywords"] == ["Buyer", "Contracting Parties", "Client"] and out[0]["exact_text"] == "exact"
    assert out[2]["related_keywords"] == ["Invoice", "Fees", "Net 30"] and [r["pos"] for r in out] == [0, 2, 3, 5]


def test_synonyms_keep_the_first_name(spark):
    out = by_pos(merge.merge_groups(groups(spark, group(0, "Indemnity"), group(1, "Hold Harmless"), group(2, "Other Thing"))))
    assert [(r["representative_keyword"], r["related_keywords"]) for r in out] == [("Indemnity", ["Hold Harmless"]), ("Other Thing", [])]


def test_filter(spark):
    df = groups(
        spark,
        group(0, "Net 30 Payment Terms", context="The client pays.", kind="payment"),
        group(1, "Net 30 Payment Terms", context="Terms are net 30.", kind="payment"),
        group(2, "Liability", context="Signature: print name", kind="liability"),
        group(3, "Liability", context="Exhibit A, entered into by both", kind="liability"),
        group(4, "Parties", context="Exhibit A, entered into by both", kind="parties"),
        group(5, "Audit Rights", context="nothing of the kind", kind="services", coverage_source="deterministic"),
    )
    assert [r["pos"] for r in by_pos(filters.filter_groups(df))] == [1, 4]


def test_coverage_adds_up_to_its_limit(spark):
    segments = spark.createDataFrame([seg(1, "This is made between A and B.", "1. Parties"), seg(2, "Late payment on overdue accounts.", "2. Late Payment"), seg(3, "Notices must be sent by registered mail.", "3. Notices"), seg(4, "Force majeure, acts of God.", "4. Force Majeure")], SEGMENT)
    have = groups(spark, group(0, "Parties"))
    added = by_pos(coverage.coverage_pass(have, segments, 2).filter("added"))
    assert len(added) == 2 and all(r["meta"]["coverage_source"] == "deterministic" for r in added) and [r["pos"] for r in added] == [1, 2]
    names = {r["representative_keyword"] for r in coverage.coverage_pass(have, segments, 12).filter("added").collect()}
    assert {"Late Payment", "Notices", "Force Majeure"} <= names and "Parties" not in names
    assert coverage.coverage_pass(have, segments, 12, "off").filter("added").count() == 0


def test_local_evidence(spark):
    segments = spark.createDataFrame([seg(1, "1. Payment\nThe Client shall pay within Net 30 days. Other words stand here."), seg(2, "Weather was fine.")], SEGMENT)
    df = groups(spark, group(0, "Payment Terms", ["Payment"], "", id="seg_001", page=4), group(1, "Governing Law", [], "Nothing here", id="seg_002"), group(2, "Delivery Duty", ["Delivery"], "The seller shall make each delivery on time.", id="seg_002"))
    out = by_pos(evidence.with_local_evidence(df, segments))
    assert [r["resolved"] for r in out] == [True, False, True]
    assert out[0]["exact_text"] == "The Client shall pay within Net 30 days." and out[0]["evidences"][0]["confidence"] == 0.99 and out[0]["evidences"][0]["page"] == 4
    assert all(r["exact_text"] in r["context_text"] for r in out if r["resolved"])


class Echo:
    def __init__(self, reply):
        self.reply = reply

    def invoke(self, prompt):
        if "boom" in prompt:
            raise RuntimeError("no")
        return self.reply


def test_keyword_stage(spark):
    segments = spark.createDataFrame([seg(1, "1. Notices\nSend mail.", "1. Notices"), seg(2, "2. Term. It ends.", "2. Term."), seg(1, "boom", doc="e")], SEGMENT)
    batches = model_io.with_keyword_prompts(model_io.keyword_batches(segments, 50))
    reply = "```json\n" + json.dumps({"keyword_groups": [{"representative_keyword": "Notice", "provision": "notice", "reason": "x", "related_keywords": [" a ", ""], "metadata": {"id": "seg_001"}}, {"representative_keyword": "Cure", "related_keywords": ["breach"], "metadata": {"id": "zzz"}}, {"representative_keyword": " "}]}) + "\n```"
    sent = model_io.invoke(batches.unionByName(batches), lambda: Echo(reply), 2).cache()
    assert sent.count() == 2  # equal prompts are sent once
    answered = model_io.with_replies(batches, sent).cache()
    assert {r["doc_id"]: r["error"] for r in answered.collect()} == {"d": None, "e": "no"}
    out = by_pos(model_io.keyword_groups(batches, answered.filter("error is null").select("doc_id", "batch", "response")))
    assert [(r["representative_keyword"], r["provision_type"], r["related_keywords"]) for r in out] == [("Notice", "notices", ["a"]), ("Cure", "termination", ["breach"])]
    assert out[0]["context_text"] == "Send mail." and out[0]["meta"]["clause_no"] == "1" and out[0]["meta"]["page"] == 1
    with pytest.raises(ValueError):
        model_io.keyword_batches(segments, 0)
    table = answered.select(F.sha2("prompt", 256).alias("prompt_hash"), "response").filter("response is not null")
    assert model_io.replay(batches, table).filter("response is not null").count() == 1


def test_evidence_stage(spark):
    segments = spark.createDataFrame([seg(1, "one", page=1), seg(2, "two", page=2), seg(3, "three", page=2)], SEGMENT)
    df = groups(spark, group(0, "A", context="own words", id="seg_009"), group(1, "B", page=2), group(2, "C", id="seg_001"), group(3, "D"))
    cand = sorted((r["pos"], r["segment_id"]) for r in model_io.candidate_segments(df, segments, 2).collect())
    assert cand == [(0, "seg_001"), (0, "seg_002"), (1, "seg_002"), (1, "seg_003"), (2, "seg_001"), (3, "seg_001"), (3, "seg_002")]
    batch = model_io.evidence_batches(df, segments, 50, 2).first()
    assert [s["id"] for s in batch["segments"]] == ["seg_009", "seg_002", "seg_003", "seg_001"] and len(batch["keyword_groups"]) == 4
    reply = json.dumps({"keyword_groups": [{"representative_keyword": " a ", "evidences": [{"exact_text": "own", "confidence": 7, "validation_status": "odd"}]}, {"representative_keyword": "B", "exact_text": "top", "context_text": "the top"}]})
    replies = spark.createDataFrame([("d", 0, reply)], "doc_id string, batch int, response string")
    out = by_pos(model_io.merge_replies(df.withColumn("batch", F.lit(0)), replies))
    assert [(r["exact_text"], r["evidences"][0]["validation_status"], r["evidences"][0]["confidence"]) for r in out] == [("own", "not_found", 1.0), ("top", "passed", 0.0), ("", "not_found", 0.0), ("", "not_found", 0.0)]


def test_export(spark):
    df = groups(spark, group(0, "A", ["x"], "ctx", page=3), group(1, "B", [], "ctx"))
    out = export.results(df).first()
    assert out["total_keyword_groups"] == 2 and out["keyword_groups"][0]["exact_text"] == "ctx" and out["keyword_groups"][0]["metadata"]["page"] == 3
    assert out["keyword_groups"][1]["related_keywords"] is None and out["keyword_groups"][1]["metadata"] is None


def items(spark, kind, entries):
    df = spark.createDataFrame([(json.dumps({"keyword_groups": entries}),)], "j string").select(F.lit("e").alias("eval_id"), F.from_json("j", evaluate.TRUTH).alias("t")).select("eval_id", "t.*")
    return evaluate.item_records(evaluate.truth_groups(df), kind)


def test_evaluation(spark):
    truth = items(spark, "truth", [{"representative_keyword": "Non-Recourse", "context_text": "no recourse at all", "page": 2}, {"representative_keyword": "Term", "context_text": "it ends"}])
    pred = items(spark, "predicted", [{"representative_keyword": "No Recourse", "context_text": "no recourse at all", "page": 2}, {"representative_keyword": "Payment", "context_text": "pay up"}])
    out = evaluate.compare(pred, truth)
    s = out["summary"].first()
    assert (s["expected_items"], s["matched_items"], s["missing_items"], s["extra_items"], s["precision"], s["recall"]) == (2, 1, 1, 1, 0.5, 0.5)
    assert [r["normalized_key"] for r in out["missing"].collect()] == ["term"] and [r["normalized_key"] for r in out["extra"].collect()] == ["payment"]
    assert out["matched"].first()["overall_score"] >= 0.85
    provisions = spark.createDataFrame([(json.dumps({"document": {"provisions": [{"provision": "p", "specific_keywords": ["Fees", "Rates"], "text": "t"}]}}),)], "j string").select(F.lit("e").alias("eval_id"), F.from_json("j", evaluate.TRUTH).alias("t")).select("eval_id", "t.*")
    item = evaluate.item_records(evaluate.truth_groups(provisions), "truth").first()
    assert item["representative_keyword"] == "Fees" and "rate" in item["aliases"] and item["context_text"] == "t"


def test_highlights_count_nulls_as_zero(spark):
    rows = [(1, "a", 50.0, 3.0), (2, "b", None, None), (3, "c", 0.0, 9.0), (4, "d", 90.0, 0.5)]
    reports = spark.createDataFrame(rows, "ord bigint, document_name string, overall_accuracy_percent double, processing_time_seconds double")
    assert evaluate.highlights(reports).first().asDict() == {"best": "d", "worst": "b", "fastest": "b", "slowest": "c"}
    none = evaluate.highlights(reports.filter("document_name = 'b'")).first().asDict()
    assert set(none.values()) == {"b"} and set(evaluate.highlights(reports.limit(0)).first()) == {None}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_queries_read_whole_tables(spark):
    """report_highlights keeps reports without accuracy, cov_added_groups keeps the groups of all segments."""
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_totalprice").collect()
    rows = sorted((k, float(k % 101) if k % 13 else 0.0, float(math.floor(x))) for k, x in orders)
    want = {"best": max(rows, key=lambda r: r[1]), "worst": min(rows, key=lambda r: r[1]), "fastest": min(rows, key=lambda r: r[2]), "slowest": max(rows, key=lambda r: r[2])}
    assert catalog.report_highlights(spark, SMALL).first().asDict() == {k: f"doc{r[0]}" for k, r in want.items()}
    held = {(r["doc_id"], k) for r in catalog.groups_of(spark, SMALL).collect() for k in [r["representative_keyword"]]}
    added = {(r["doc_id"], r["representative_keyword"]) for r in catalog.cov_added_groups(spark, SMALL).collect()}
    assert added and not added & held


def test_contracts_hold_all_items(spark, tmp_path):
    """A hot order keeps all its line items, ahead of the footer of the page."""
    spark.sql("SELECT 1L AS o_orderkey, 7.0D AS o_totalprice, DATE'2020-01-02' AS o_orderdate, 1L AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS c_custkey, 'C' AS c_name, 1L AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 1L AS n_nationkey, 'N' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("SELECT 1L AS l_orderkey, id AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, 2.0D AS l_quantity, 3.0D AS l_extendedprice FROM range(500)").write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = [(r["page"], r["text"]) for r in sorted(catalog.lines_of(spark, str(tmp_path)).collect(), key=lambda r: r["line_no"])]
    items = [i for i, (_, t) in enumerate(lines) if " Part " in t]
    assert [lines[i][1].split(" ")[2] for i in items] == [str(i) for i in range(500)]
    first = [t for p, t in lines if p == 1]
    assert first[-2:] == ["Confidential draft 1", "1"] and items == list(range(items[0], items[0] + 500))


def test_jobs(spark):
    batch, rows = jobs.create_batch(spark, "b", [(f"f{i}", "p", f"h{i}") for i in range(3)], "c", "t0")
    states = rows.withColumn("status", F.when(F.col("id") == "b-0", "failed").otherwise("success"))
    done = jobs.refresh_batches(batch, states, "t1").first()
    assert (done["status"], done["succeeded_count"], done["failed_count"], done["finished_at"]) == ("completed", 2, 1, "t1")
    assert jobs.reset_failed(states, ["b-0", "b-1"], "t2").filter("status = 'queued'").count() == 1
    with pytest.raises(ValueError):
        jobs.create_batch(spark, "b", [("f", "p", "h")] * 11, "c", "t")
    assert jobs.config_hash({"a": 1, "x_api_key": "s"}, "1") == jobs.config_hash({"a": 1, "x_api_key": "t"}, "1") != jobs.config_hash({"a": 2}, "1")


def test_config():
    c = config.build_config({"KEYWORD_COVERAGE_MODE": "legacy", "MAX_TOTAL_LLM_CALLS": "0", "KEYWORD_FAST_EXACT": "no"}, keyword_batch_size="7", provider="xai")
    assert (c.coverage_mode, c.max_total_llm_calls, c.fast_exact, c.keyword_batch_size, c.provider) == ("broad", 1, False, 7, "grok")
    env = {"KEYWORD_LLM_API_KEY": "shared", "GROQ_API_KEY": "g"}
    base = config.build_config(env)
    assert config.stage_config(base, "LLM1", env).api_key == "shared" and config.stage_config(base, "LLM2", env, provider="groq").api_key == "g"
    assert config.stage_config(base, "LLM2", {}, provider="gemini").api_key is None and config.build_config({}, model="...").model == ""


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    page = documents.load_documents(spark, [str(tmp_path / "a.txt")]).first()
    assert (page["source"], page["page"], page["text"]) == ("a.txt", 1, "one\ntwo")
    with pytest.raises(ValueError):
        documents.load_documents(spark, ["x.docx"])
    frags = spark.createDataFrame([("d", "s", 1, 1, "plain", x, y, t) for x, y, t in [(50.0, 700.0, "world"), (10.0, 703.0, "hello"), (10.0, 600.0, "below")]], "doc_id string, source string, page int, total_pages int, plain string, x double, y double, text string")
    assert documents.layout_pages(frags).first()["text"] == "hello world\nbelow"
    assert documents.safe_name("r.json") == "r.json"
    with pytest.raises(FileNotFoundError):
        documents.safe_name("../r.json")


def test_streaming(spark, tmp_path):
    from pactlake.streaming import ingest

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(f"text {i}")
    query = ingest.start(ingest.text_stream(spark, str(tmp_path / "in"), 2), lambda df: df.select("source", "text"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
