"""Listings, exports, uploads, display and the Markdown report."""

import json

from pyspark.sql import functions as F

from pactlake.operators import evaluate, export, jobs, model_io, normalize, reports
from pactlake.sources import documents


def test_listing_and_result_files(spark, tmp_path):
    for name in ("2_eval_report.json", "10_eval_report.json", "x_eval_report.json", "1_result.json"):
        (tmp_path / name).write_text(json.dumps({"document_name": name[0]}))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "3_result.json").write_text("{}")
    found = documents.listing(spark, str(tmp_path)).collect()
    assert [r["filename"] for r in found] == ["2_eval_report.json", "10_eval_report.json", "x_eval_report.json"]
    rows = documents.json_files(spark, f"{tmp_path}/*_eval_report.json", "document_name string").collect()
    assert {r["filename"]: r["document_name"] for r in rows}["10_eval_report.json"] == "1" and all(r["modified"] for r in rows)
    assert {r["path"].rsplit("/", 1)[1] for r in documents.paths_under(spark, str(tmp_path), "*_result.json").collect()} == {"1_result.json", "3_result.json"}
    assert documents.listing(spark, str(tmp_path), "*.nothing").collect() == []


def test_export_and_uploads(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, [{"representative_keyword": "A"}])], "doc_id string, total_keyword_groups int, keyword_groups array<struct<representative_keyword:string>>")
    export.write_results(rows, f"{tmp_path}/out")
    export.write_results(rows, f"{tmp_path}/out")  # overwrites
    assert [json.loads(r["value"])["keyword_groups"] for r in spark.read.text(f"{tmp_path}/out").collect()] == [[{"representative_keyword": "A"}]]
    uploads = spark.createDataFrame([("a.JSON", "{}"), ("a.json", "{"), ("a.txt", "{}"), ("b.json", None)], "name string, content string")
    assert [bool(r[0]) for r in uploads.select(export.is_json_upload(F.col("name"), F.col("content"))).collect()] == [True, False, False, False]


def test_display(spark):
    df = spark.createDataFrame([(["A  b", "a B", None, " ", "C"], "x " * 200), (None, None), ([], " short ")], "names array<string>, body string")
    found = df.select(reports.joined_names(F.col("names")), reports.shortened(F.col("body"), 20), reports.preview(F.col("names"), 2), reports.beginning(F.col("body"), most=3), reports.beginning(F.col("body"), full=True)).collect()
    assert [tuple(r)[:2] for r in found] == [("A b, C", "x x x x x x x x x..."), ("", ""), ("", "short")]
    assert found[0][2] == ["A  b", "a B"] and found[1][2] == [] and found[0][3] == "x x" and len(found[0][4]) == 400
    names = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "n array<string>").select(model_io.summary(F.col("n"), 2)).collect()
    assert [r[0] for r in names] == ["a, b, +1 more", "a", ""]
    done = spark.createDataFrame([("1", "success", "/o"), ("2", "cached", ""), ("3", "failed", "/o"), ("4", "cached", "/p")], "id string, status string, output_path string")
    assert [r["id"] for r in reports.finished(done).collect()] == ["1", "4"]


def test_samples(spark):
    pages = spark.createDataFrame([("d", 1, "y" * 1500), ("d", 2, None)], "doc_id string, page int, text string")
    assert [(r["text_length"], len(r["text"] or "")) for r in reports.page_samples(pages).collect()] == [(1500, 1000), (None, 0)]
    assert [len(r["text"] or "") for r in reports.page_samples(pages, full=True).collect()] == [1500, 0]


def test_normalize_text_of_one_page(spark):
    text = "Fees are pay-\nable now. ​See\n4\nSource: archive\n2.\nPayment Terms\nthe end"
    found = spark.createDataFrame([(text, 4), (None, None)], "t string, p int").select(normalize.normalize_text(F.col("t"), F.col("p")).alias("x")).collect()
    # one letter comes over the hyphen, as the pattern for cut words says
    assert [r["x"] for r in found] == ["Fees are paya ble now. See\n2. Payment Terms\nthe end", ""]


def test_pairs_names_and_report(spark):
    results = spark.createDataFrame([(1, "1_result.json"), (3, "3_result.json")], "number bigint, filename string")
    truths = spark.createDataFrame([(1, "t1"), (2, "t2")], "number bigint, filename string")
    paired = {r["number"]: r["skipped"] for r in evaluate.pair_files(results, truths).collect()}
    assert paired == {1: None, 2: "missing result", 3: "missing ground truth"}
    files = spark.createDataFrame([("a", {"document_name": "inner"}, "outer"), ("b", None, "outer"), ("c", {"document_name": None}, "outer")], "eval_id string, document struct<document_name:string>, document_name string")
    assert [r["document_name"] for r in evaluate.truth_names(files).orderBy("eval_id").collect()] == ["inner", "outer", None]
    shown = [
        {"filename": "2_eval_report.json", "result_file": "2_result.json", "document_name": "lease", "processing_time_seconds": 3.456, "overall_accuracy_percent": 80.0, "precision": 0.5, "recall": 1.0, "f1": 0.6667, "expected_items": 4, "predicted_items": 8, "matched_items": 4, "missing_items": 0, "extra_items": 4},
        {"filename": "odd.json", "result_file": None, "document_name": None, "processing_time_seconds": None, "overall_accuracy_percent": None, "precision": None, "recall": None, "f1": None, "expected_items": None, "predicted_items": None, "matched_items": None, "missing_items": None, "extra_items": None},
    ]
    table = spark.createDataFrame([tuple(r[c] for c in shown[0]) for r in shown], "filename string, result_file string, document_name string, processing_time_seconds double, overall_accuracy_percent double, precision double, recall double, f1 double, expected_items int, predicted_items int, matched_items int, missing_items int, extra_items int")
    totals = evaluate.aggregate_reports(table).first().asDict()
    lines = evaluate.markdown_report(shown, totals, [{"number": 7, "skipped": "missing result"}]).split("\n")
    assert "| Average overall accuracy | 40.00% |" in lines and "| Total extra items | 4 |" in lines
    assert "| 2 | lease | `2_result.json` | 3.46 | 80.00% | 50.00% | 100.00% | 66.67% | 4 | 8 | 4 | 0 | 4 |" in lines
    assert "| 0 | - | `-` | 0.00 | 0.00% | 0.00% | 0.00% | 0.00% | 0 | 0 | 0 | 0 | 0 |" in lines
    assert "- Best accuracy: file 2 (`2_eval_report.json`) at 80.00%." in lines and "- Lowest accuracy: file 0 (`odd.json`) at 0.00%." in lines and "- Slowest file: file 2 (`2_eval_report.json`) at 3.46s." in lines
    assert "- File 7: missing result" in lines and "- File 2: `2_eval_report.json` from `2_result.json`" in lines
    empty = evaluate.markdown_report([], evaluate.aggregate_reports(table.limit(0)).first().asDict())
    assert "- No evaluation reports." in empty and "## Skipped" not in empty


def test_public_items_show_their_key(spark):
    item = spark.createDataFrame([("e", 0, "i", "Fees", None, "c", "x", "1", "s", "fees")], "eval_id string, idx int, id string, representative_keyword string, grouped_keywords array<string>, context_text string, exact_information string, page string, source string, normalized_key string")
    assert reports.public_items(item).first()["grouped_keywords"] == [] and reports.public_items(item).first()["normalized_key"] == "fees"
    assert "normalized_key" not in reports.public_items(item, keyed=False).columns
    assert jobs.config_hash({"a": 1, "x_api_key": "secret"}, "1") == jobs.config_hash({"a": 1}, "1") != jobs.config_hash({"a": 1}, "2")
