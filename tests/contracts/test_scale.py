"""Work that grows with the corpus: what is shuffled, and that the short cuts leave results alone."""

import re

from pyspark.sql import functions as F

from pactlake.functions import fixed, text
from pactlake.operators import coverage, segment
from pactlake.plans import catalog
from pactlake.sources import contract_view

SMALL = "/root/testdata/sf0.001"


def shuffles(df, key="doc_id"):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"Exchange hashpartitioning\({key}#", plan))


def tables(spark, folder):
    """Two orders of one key, an item without an order, an order without items, a customer without a name."""
    spark.sql("SELECT * FROM VALUES (1L, 7.0D, DATE'2020-01-02', 1L), (1L, 8.0D, DATE'2020-01-03', 1L), (4L, 9.0D, DATE'2021-12-31', 2L), (5L, 9.0D, DATE'2021-12-31', 9L) AS t(o_orderkey, o_totalprice, o_orderdate, o_custkey)").write.parquet(f"{folder}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 'C', 1L), (2L, NULL, 1L) AS t(c_custkey, c_name, c_nationkey)").write.parquet(f"{folder}/customer.parquet")
    spark.sql("SELECT 1L AS n_nationkey, 'N' AS n_name").write.parquet(f"{folder}/nation.parquet")
    spark.sql("SELECT CAST(1 + id % 3 AS BIGINT) AS l_orderkey, id % 7 AS l_partkey, 1L AS l_suppkey, CAST(id % 2 AS INT) AS l_linenumber, CAST(id AS DOUBLE) AS l_quantity, 3.0D AS l_extendedprice FROM range(60)").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_contracts_equal_their_sql(spark, tmp_path):
    for folder in (SMALL, tables(spark, tmp_path)):
        contract_view.register(spark, folder, *contract_view.TABLES)
        want, found = spark.sql(contract_view.lines_sql()), contract_view.raw_lines(spark, folder)
        assert found.count() == want.count() > 0 and found.exceptAll(want).count() == want.exceptAll(found).count() == 0


def test_one_shuffle_by_document(spark):
    """Lines, blocks, segments and pages come out of the shuffle that brings an order and its items together."""
    for made in (contract_view.raw_lines, catalog.lines_of, catalog.blocks_of, catalog.segments_of, catalog.groups_of, contract_view.pages):
        assert shuffles(made(spark, SMALL)) == 1, made.__name__


def test_first_characters_rule_out_no_heading(spark):
    """The long s and the dotless i match letters of signature and structure words whatever the case; digits are those of ASCII."""
    lines = ["ſigned here", "ıN WITNESS WHEREOF", "Annex", "ſection 4", "1. A", "(a) x", "a. b", "A. b", "²1. x", "Other"]
    docs = spark.createDataFrame(list(enumerate(lines)), "i int, text string")
    code = {r["text"]: r["code"] for r in docs.select("text", segment.heading_code(F.col("text")).alias("code")).collect()}
    assert [code[x] for x in lines] == [1, 1, 2, 2, 3, 4, 4, None, None, None]


def test_numbered_titles(spark):
    lines = ["2.1 Taxes. The Client bears all", "1. J. R. Smith. He pays", "3. Plain", "4. Fees: all", "5. v1.2 of it"]
    docs = spark.createDataFrame([(x,) for x in lines], "text string")
    assert [r[0] for r in docs.select(segment.numbered_title(F.col("text"))).collect()] == ["2.1 Taxes.", "1. J. R. Smith.", "3. Plain", "4. Fees:", "5. v1.2 of it"]


def test_needles_stand_in_every_match(spark):
    """Rules are looked for where their needle is; scores equal those of all patterns on all segments."""
    bodies = [(f"{a} {b}{c}", t) for a in ("LICENSE", "x") for b, t in (("Grant of rights", None), ("annual sales quotas", "5 %  Discount"), ("acts\nof God", "Late Payment"), ("technology: the platform", None), ("İannual quota", None), ("sign electronically", "Grants the right to sell")) for c in ("", "; non-renewal", ", amended and indemnified")]
    rows = [("d", i, b, t, "Net 30" if i % 3 == 0 else None) for i, (b, t) in enumerate(bodies)]
    segments = spark.createDataFrame(rows, "doc_id string, seg_no int, text string, title string, parent_section_title string")
    found = {(r["seg_no"], r["rule"]): r["score"] for r in coverage.rule_scores(segments, True).collect()}
    body, title = coverage.search_text(), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("parent_section_title", F.lit("")))
    want = {}
    for i, rule in enumerate(fixed.RULES):
        hits = sum((F.when(text.any_match(body, [p]), 10).otherwise(0) + F.when(text.any_match(title, [p]), 25).otherwise(0) for p in rule[3]), F.lit(0))
        want |= {(r["seg_no"], i): r["h"] for r in segments.select("seg_no", hits.alias("h")).filter("h > 0").collect()}
    assert want and found == {k: v for k, v in want.items() if v >= 1}
