"""Registered queries of the contract operators, and their SQL twins.

The prose tables hold no contracts, so most queries run on contracts rendered from the star tables
(pactlake.sources.contract_view); the same SQL renders them on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlake.functions import fixed, text
from pactlake.operators import coverage, evaluate, evidence, export, filters, jobs, merge, model_io, normalize, reports, segment
from pactlake.plans import pipeline
from pactlake.plans.config import PipelineConfig
from pactlake.plans.scratch import Scratch
from pactlake.sources import contract_view, documents
from pactlake.streaming import lifecycle

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- tables that queries share: lines, blocks, segments and groups of the rendered contracts ----


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contract_view.contracts(spark, sf_dir).select("doc_id", F.posexplode_outer("lines").alias("i", "l")).filter("i is not null")
    return rows.select("doc_id", (F.col("i") + 1).alias("line_no"), "l.page", F.concat("doc_id", F.lit(".txt")).alias("source"), "l.text")


def outlines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, blocks), the parents of the blocks in them."""
    sourced = F.transform("lines", lambda x: F.struct(x["page"].alias("page"), F.concat("doc_id", F.lit(".txt")).alias("source"), x["text"].alias("text")))
    return segment.with_parents(segment.build_blocks(contract_view.contracts(spark, sf_dir).withColumn("lines", sourced)))


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines_of(spark, sf_dir).select("doc_id", F.inline_outer("blocks")).filter("block_no is not null")


def segments_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segments_of(outlines_of(spark, sf_dir))


def groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group a titled segment, named by its title without number; every third keeps a second name."""
    s = segments_of(spark, sf_dir).filter("title is not null")
    name = F.trim(F.regexp_replace("title", r"^[0-9.]+|[.:]+$", ""))
    meta = F.struct("page", "source", F.col("segment_id").alias("id"), "segment_id", F.lit(None).cast("string").alias("clause_no"), "parent_section_title", F.lit(None).cast("string").alias("coverage_source"), "token_count", "chunk_index", "chunk_total", "is_continuation")
    related = F.when(F.col("seg_no") % 3 == 0, F.array(F.lit("Fees"), F.upper(name))).otherwise(F.array(name))
    return s.select("doc_id", F.col("seg_no").alias("pos"), name.alias("representative_keyword"), model_io.infer_provision(F.col("text")).alias("provision_type"), related.alias("related_keywords"), F.col("text").alias("context_text"), F.when(F.col("seg_no") % 4 == 0, F.col("text")).alias("exact_text"), F.expr(f"cast(array() as array<{merge.EVIDENCE}>)").alias("evidences"), meta.cast(merge.META).alias("meta"))


RAW = contract_view.lines_sql("duckdb")
FOLD = "lower(replace(replace(coalesce({0}, ''), 'ẞ', 'ss'), 'ß', 'ss'))"


def key_sql(x: str) -> str:
    return f"trim(regexp_replace({FOLD.format(x)}, '[^a-z0-9]+', ' ', 'g'))"


def upper_sql(x: str) -> str:
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def titled_sql(x: str, most: int) -> str:
    words = f"list_filter(string_split_regex(trim(regexp_replace({x}, '[.]+$', '')), '\\s+'), lambda w: w <> '')"
    capital = f"len(list_filter({words}, lambda w: {upper_sql('w[1]')}))"
    return f"(NOT regexp_matches({x}, '[.;,]$') AND len({words}) > 0 AND len({words}) <= {most} AND ({upper_sql(x)} OR {capital} >= len({words}) - 1))"


CHAIN = f"""
raw AS ({RAW}),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS line_no, page, doc_id || '.txt' AS source, text FROM raw),
kinds AS (SELECT *,
  CASE WHEN regexp_matches(text, '^(IN WITNESS WHEREOF|SIGNATURES?|SIGNED|AGREED AND ACCEPTED|ACCEPTED AND AGREED)\\b', 'i') THEN 'signature'
    WHEN regexp_matches(text, '^(SCHEDULE|EXHIBIT|APPENDIX|ANNEX)\\b', 'i') THEN lower(regexp_extract(text, '^\\S+'))
    WHEN regexp_matches(text, '^(ARTICLE|SECTION)\\b', 'i') THEN 'section'
    WHEN regexp_matches(text, '^(\\d+\\.|\\d+(?:\\.\\d+)+\\.?)\\s+\\S') THEN 'section'
    WHEN regexp_matches(text, '^(\\([A-Za-z0-9]+\\)|[a-z]\\.)\\s+\\S') THEN 'bullet' END AS h_kind,
  regexp_extract(text, '^(\\d+\\.|\\d+(?:\\.\\d+)+\\.?)\\s+(\\S.*)$', 1) AS num, regexp_extract(text, '^(\\d+\\.|\\d+(?:\\.\\d+)+\\.?)\\s+(\\S.*)$', 2) AS body FROM lines),
heads AS (SELECT *,
  CASE WHEN h_kind = 'bullet' THEN regexp_extract(text, '^(\\([A-Za-z0-9]+\\)|[a-z]\\.)', 1)
    WHEN h_kind = 'section' AND num <> '' THEN CASE WHEN regexp_matches(body, '[.:](\\s|$)') THEN num || ' ' || regexp_extract(body, '^(.*?[.:])(\\s|$)', 1) ELSE text END
    WHEN h_kind IS NOT NULL THEN text END AS h_title,
  CASE WHEN h_kind = 'bullet' THEN 99 WHEN h_kind = 'section' AND num <> '' THEN len(string_split(rtrim(num, '.'), '.')) WHEN h_kind IS NOT NULL THEN 1 END AS h_level FROM kinds),
numbered AS (SELECT *, count(h_kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM heads),
packed AS (SELECT doc_id, block_no, list(text ORDER BY line_no) AS ls, min(line_no) AS first_line, arg_min(page, line_no) AS page, any_value(source) AS source, max(h_kind) AS hk, max(h_title) AS ht, max(h_level) AS hl FROM numbered GROUP BY doc_id, block_no),
blocks AS (SELECT doc_id, block_no, ls, page, source, coalesce(hk, CASE WHEN max(block_no) OVER (PARTITION BY doc_id) > 0 THEN 'opening' ELSE 'document' END) AS kind,
  CASE WHEN hk = 'section' AND hl = 1 AND len(ls) > 1 AND {titled_sql('ls[2]', 8)} THEN ht || ' ' || ls[2] ELSE ht END AS title, coalesce(hl, 1) AS level,
  coalesce(len(ls) <= 2 AND ls[1] = ht AND (hk <> 'section' OR hl = 1) AND (len(ls) < 2 OR {titled_sql('ls[2]', 8)}), FALSE) AS dropped FROM packed),
sections AS (SELECT doc_id, block_no, level, title FROM blocks WHERE kind = 'section'),
parents AS (SELECT b.*,
  CASE WHEN kind = 'bullet' THEN (SELECT arg_max(s.title, s.block_no) FROM sections s WHERE s.doc_id = b.doc_id AND s.block_no < b.block_no)
    WHEN kind = 'section' AND level > 1 THEN coalesce(
      (SELECT arg_max(CASE WHEN s.level = b.level - 1 THEN s.title END, s.block_no) FROM sections s WHERE s.doc_id = b.doc_id AND s.block_no < b.block_no AND s.level <= b.level - 1),
      (SELECT arg_max(s.title, s.block_no) FROM sections s WHERE s.doc_id = b.doc_id AND s.block_no < b.block_no AND s.level = 1)) END AS parent FROM blocks b),
segs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS seg_no, array_to_string(ls, chr(10)) AS text, title, page, source, parent FROM parents WHERE NOT dropped),
segments AS (SELECT *, 'seg_' || lpad(seg_no::VARCHAR, 3, '0') AS segment_id, len(regexp_extract_all(text, '\\S+')) AS token_count,
  CASE WHEN parent IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY doc_id, source, parent ORDER BY seg_no) END AS chunk_index,
  CASE WHEN parent IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY doc_id, source, parent) END AS chunk_total FROM segs)"""

INFER = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({{0}}), '{n}')" for n in needles) + f" THEN '{name}'" for name, needles in fixed.PROVISION_NEEDLES) + " ELSE 'other' END"
GROUPS = (
    CHAIN
    + f""",
named AS (SELECT *, trim(regexp_replace(regexp_replace(title, '^[0-9.]+', ''), '[.:]+$', '')) AS name FROM segments WHERE title IS NOT NULL),
groups AS (SELECT doc_id, seg_no AS pos, name, {INFER.format('text')} AS kind, CASE WHEN seg_no % 3 = 0 THEN ['Fees', upper(name)] ELSE [name] END AS related, text AS context, CASE WHEN seg_no % 4 = 0 THEN text END AS exact, segment_id, page FROM named)"""
)


# ---- segmentation ----


@query(f"WITH {CHAIN} SELECT coalesce(h_kind, 'none') AS kind, count(*)::BIGINT AS n_lines, count(DISTINCT doc_id)::BIGINT AS n_docs FROM heads GROUP BY 1")
def seg_heading_kinds(spark, sf_dir):
    rows = segment.detect_headings(lines_of(spark, sf_dir))
    return rows.groupBy(F.coalesce("h_kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"WITH {CHAIN} SELECT doc_id, line_no::INT AS line_no, h_kind, h_title, h_level::INT AS h_level FROM heads WHERE h_kind IS NOT NULL")
def seg_headings(spark, sf_dir):
    return segment.detect_headings(lines_of(spark, sf_dir)).filter("h_kind is not null").select("doc_id", "line_no", "h_kind", "h_title", "h_level")


@query(f"WITH {CHAIN} SELECT doc_id, block_no::BIGINT AS block_no, kind, title, level::INT AS level, len(ls)::INT AS n_lines, dropped FROM blocks")
def seg_blocks(spark, sf_dir):
    return blocks_of(spark, sf_dir).select("doc_id", F.col("block_no").cast("bigint").alias("block_no"), "kind", "title", "level", "n_lines", "dropped")


@query(f"WITH {CHAIN} SELECT doc_id, block_no::BIGINT AS block_no, kind, title, parent AS parent_section_title FROM parents")
def seg_parent_title(spark, sf_dir):
    return blocks_of(spark, sf_dir).select("doc_id", F.col("block_no").cast("bigint").alias("block_no"), "kind", "title", "parent_section_title")


#: Outlines as deep as twelve levels: the lines of a customer's orders as sections and bullets.
OUTLINE = "SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS block_no, CASE WHEN l_suppkey % 6 = 0 THEN 'bullet' WHEN l_suppkey % 17 = 0 THEN 'signature' ELSE 'section' END AS kind, (1 + l_partkey % 12)::INT AS level, l_returnflag || ' ' || l_orderkey || '.' || l_linenumber AS title FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query(
    f"""WITH b AS ({OUTLINE}), s AS (SELECT * FROM b WHERE kind = 'section'),
newest AS (SELECT b.doc_id, b.block_no, arg_max(s.title, s.block_no) AS title FROM b JOIN s ON s.doc_id = b.doc_id AND s.block_no < b.block_no WHERE b.kind = 'bullet' GROUP BY ALL),
above AS (SELECT b.doc_id, b.block_no, arg_max(s.level, s.block_no) AS level, arg_max(s.title, s.block_no) AS title FROM b JOIN s ON s.doc_id = b.doc_id AND s.block_no < b.block_no AND s.level < b.level WHERE b.kind = 'section' GROUP BY ALL),
top AS (SELECT b.doc_id, b.block_no, arg_max(s.title, s.block_no) AS title FROM b JOIN s ON s.doc_id = b.doc_id AND s.block_no < b.block_no AND s.level = 1 WHERE b.kind = 'section' AND b.level > 1 GROUP BY ALL)
SELECT b.doc_id, b.block_no::INT AS block_no, b.kind, b.level, CASE WHEN b.kind = 'bullet' THEN n.title WHEN b.kind = 'section' THEN coalesce(CASE WHEN a.level = b.level - 1 THEN a.title END, t.title) END AS parent_section_title
FROM b LEFT JOIN newest n USING (doc_id, block_no) LEFT JOIN above a USING (doc_id, block_no) LEFT JOIN top t USING (doc_id, block_no)"""
)
def seg_deep_parents(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc_id")), "l_orderkey")
    kind = F.when(F.col("l_suppkey") % 6 == 0, "bullet").when(F.col("l_suppkey") % 17 == 0, "signature").otherwise("section")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    title = F.concat("l_returnflag", F.lit(" "), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    blocks = lines.select("doc_id", number.alias("block_no"), kind.alias("kind"), (1 + F.col("l_partkey") % 12).cast("int").alias("level"), title.alias("title"))
    return segment.parent_titles(blocks).select("doc_id", "block_no", "kind", "level", "parent_section_title")


@query(f"WITH {CHAIN} SELECT kind, count(*)::BIGINT AS n, count_if(dropped)::BIGINT AS n_dropped FROM blocks GROUP BY kind")
def seg_empty_parent_drop(spark, sf_dir):
    return blocks_of(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("dropped").alias("n_dropped"))


@query(f"WITH {CHAIN} SELECT doc_id, segment_id, title, page, source, parent AS parent_section_title, token_count::INT AS token_count, chunk_index::INT AS chunk_index, chunk_total::INT AS chunk_total, chunk_index < chunk_total AS is_continuation, md5(text) AS text_md5 FROM segments")
def seg_numbering(spark, sf_dir):
    return segments_of(spark, sf_dir).select("doc_id", "segment_id", "title", "page", "source", "parent_section_title", "token_count", "chunk_index", "chunk_total", "is_continuation", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::INT AS token_count FROM documents")
def seg_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).alias("token_count"))


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
COUNT = "len(regexp_extract_all({0}, '\\S+'))"
SOME = "list_filter(list_transform({0}, lambda u: " + STRIP.format("u") + "), lambda u: u <> '')"
SENTENCES = SOME.format("string_split(regexp_replace({0}, '([.!?;])\\s+([A-Z0-9(\"])', '\\1' || chr(1) || '\\2', 'g'), chr(1))")


def windows_sql(x: str, most: int) -> str:
    words = f"regexp_extract_all({x}, '\\S+\\s*')"
    part = f"array_to_string({words}[k * {most} + 1:k * {most} + {most}], '')"
    return f"list_transform(range(0, (len({words}) + {most - 1}) // {most}), lambda k: {STRIP.format(part)})"


def packed_sql(pieces: str, joins: str) -> str:
    """Fold of pieces into chunks: state t, piece s, both (done, open, n); `joins` says when s joins the open chunk."""
    states = f"list_transform({pieces}, lambda p: struct_pack(done := []::VARCHAR[], open := p, n := {COUNT.format('p')}))"
    step = f"struct_pack(done := CASE WHEN t.open = '' OR ({joins}) THEN t.done ELSE list_append(t.done, t.open) END, open := CASE WHEN t.open <> '' AND ({joins}) THEN t.open || chr(10) || s.open ELSE s.open END, n := CASE WHEN t.open <> '' AND ({joins}) THEN t.n + s.n ELSE s.n END)"
    return f"list_reduce({states}, lambda t, s: {step}, struct_pack(done := []::VARCHAR[], open := '', n := 0::BIGINT))"


@query(
    f"""WITH d AS (SELECT doc_id, {STRIP.format("text")} AS x FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, x, flatten(list_transform({SOME.format("string_split_regex(x, chr(10) || '[[:space:]]*' || chr(10) || '|' || chr(10))")}, lambda p: CASE WHEN {COUNT.format("p")} <= {segment.MAX_TOKENS} THEN [p] ELSE flatten(list_transform({SENTENCES.format("p")}, lambda s: {windows_sql("s", segment.MAX_TOKENS)})) END)) AS ps FROM d WHERE {COUNT.format("x")} > {segment.MAX_TOKENS}),
packed AS (SELECT doc_id, {packed_sql("ps", f"t.n + s.n <= {segment.MAX_TOKENS}")} AS t FROM pieces), chunks AS (SELECT doc_id, CASE WHEN t.open <> '' THEN list_append(t.done, t.open) ELSE t.done END AS cs FROM packed),
merged AS (SELECT doc_id, {packed_sql("cs", f"s.n < {segment.MIN_TOKENS} AND t.n + s.n <= {segment.MAX_TOKENS}")} AS t FROM chunks), long AS (SELECT doc_id, CASE WHEN t.open <> '' THEN list_append(t.done, t.open) ELSE t.done END AS cs FROM merged),
every AS (SELECT doc_id, cs FROM long UNION ALL SELECT doc_id, [x] FROM d WHERE {COUNT.format("x")} <= {segment.MAX_TOKENS})
SELECT doc_id, (k - 1)::INT AS chunk, {COUNT.format("cs[k]")}::INT AS token_count, md5(cs[k]) AS part_md5 FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS k FROM every)"""
)
def seg_split_long(spark, sf_dir):
    """Chunks of every document under the token limits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.split_by_tokens(F.col("text"))).alias("chunk", "part"))
    return docs.select("doc_id", "chunk", text.token_count(F.col("part")).alias("token_count"), F.md5("part").alias("part_md5"))


# ---- normalisation ----

PAGES = f"""raw AS ({RAW}),
pl AS (SELECT doc_id, page, pos, text, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS down, regexp_replace(lower(text), '\\d+', '#', 'g') AS fk FROM raw),
counts AS (SELECT doc_id, fk, count(DISTINCT page) AS n FROM pl WHERE up <= 3 OR down <= 3 GROUP BY ALL),
rep AS (SELECT doc_id, fk, n FROM counts WHERE n >= 2 AND NOT regexp_matches(fk, '^(article|section|schedule|exhibit|appendix|annex)\\b') AND NOT regexp_matches(fk, '^(?:\\d+\\.|\\d+(?:\\.\\d+)+\\.?|\\([A-Za-z]\\))$')),
gone AS (SELECT pl.*, NOT regexp_matches(text, '^(?:\\d+\\.|\\d+(?:\\.\\d+)+\\.?|\\([A-Za-z]\\))$') AND (text = page::VARCHAR OR regexp_matches(text, '^(?:\\d+\\s+)?Source:\\s+.+$', 'i') OR rep.fk IS NOT NULL) AS gone FROM pl LEFT JOIN rep USING (doc_id, fk))"""


def cleaned_pages(spark, sf_dir):
    return contract_view.pages(spark, sf_dir).withColumn("lines", normalize.clean_lines(F.col("text")))


@query(f"WITH {PAGES} SELECT doc_id, fk AS footer_key, n::BIGINT AS n_pages FROM rep")
def norm_repeated_footer(spark, sf_dir):
    return normalize.repeated_footers(cleaned_pages(spark, sf_dir)).select("doc_id", F.col("key").alias("footer_key"), F.col("n").alias("n_pages"))


@query(f"WITH {PAGES} SELECT doc_id, page, count_if(gone)::INT AS removed FROM gone GROUP BY ALL")
def norm_footer_filter(spark, sf_dir):
    return normalize.normalize_pages(contract_view.pages(spark, sf_dir)).select("doc_id", "page", F.col("removed_footer_count").alias("removed"))


@query(f"WITH {PAGES}, kept AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, page ORDER BY pos) AS prev FROM gone WHERE NOT gone) SELECT doc_id, page, count_if(prev = '2.' AND text = 'Payment Terms')::BIGINT AS repaired FROM kept GROUP BY ALL")
def norm_orphan_repair(spark, sf_dir):
    pages = cleaned_pages(spark, sf_dir).withColumn("repaired", normalize.repair_numbers(F.col("lines")))
    return pages.select("doc_id", "page", F.size(F.filter("repaired", lambda x: x == "2. Payment Terms")).cast("bigint").alias("repaired"))


@query("SELECT doc_id, length(regexp_replace(regexp_replace(translate(replace(text, ' ', chr(160) || chr(8203)), chr(160), ' '), '[​-‏‪-‮⁠﻿]', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'))::INT AS n_chars FROM documents")
def norm_zero_width(spark, sf_dir):
    dirty = F.replace("text", F.lit(" "), F.lit(" ​"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(normalize.strip_invisible(normalize.substitute(dirty))).alias("n_chars"))


@query()
def norm_pages(spark, sf_dir):
    out = normalize.normalize_pages(contract_view.pages(spark, sf_dir))
    return out.select("doc_id", "page", "raw_text_length", "normalized_text_length", "removed_footer_count", F.md5("text").alias("text_md5"))


# ---- keys and tokens ----


@query(f"SELECT doc_id, md5({key_sql('text')}) AS key_md5 FROM documents")
def key_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.keyword_key(F.col("text"))).alias("key_md5"))


CANON = "list_filter(list_transform(string_split({0}, ' '), lambda t: CASE WHEN t = 'non' THEN 'no' WHEN t = 'venue' THEN 'jurisdiction' WHEN ends_with(t, 'ies') AND length(t) > 4 THEN t[:-4] || 'y' WHEN ends_with(t, 's') AND NOT ends_with(t, 'ss') AND length(t) > 3 THEN t[:-2] ELSE t END), lambda t: t <> '' AND t NOT IN ('a', 'an', 'and', 'by', 'for', 'in', 'of', 'or', 'the', 'to'))"


@query(f"SELECT doc_id, md5(array_to_string({CANON.format(key_sql('text'))}, ' ')) AS key_md5 FROM documents")
def key_canonical(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.canonical_key(F.col("text"))).alias("key_md5"))


TOKENS = "list_distinct(regexp_extract_all(" + FOLD + ", '[a-z0-9]+'))"


@query(f"SELECT doc_id, len({TOKENS.format('text')})::INT AS n_tokens FROM documents")
def tok_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query("SELECT sha256(text) AS file_hash, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def dedupe_docs_sha(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", jobs.file_hash(F.encode("text", "UTF-8")).alias("file_hash"))
    return docs.groupBy("file_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


# ---- first model stage ----

BODY = "CASE WHEN title IS NULL THEN text WHEN lower(rtrim(string_split(text, chr(10))[1], '.:;')) = lower(rtrim(title, '.:;')) THEN array_to_string(string_split(text, chr(10))[2:], chr(10)) WHEN starts_with(text, title) THEN regexp_replace(text[length(title) + 1:], '^[ \\t\\r\\n\\-:.;]+', '') ELSE text END"
CLAUSE = "nullif(rtrim(regexp_extract(coalesce({0}, ''), '^\\s*((?:\\d+(?:\\.\\d+)*\\.?)|(?:\\([A-Za-z0-9]+\\))|(?:[A-Za-z]\\.))\\s+', 1), '.'), '')"
INPUTS = f"{CHAIN}, bodies AS (SELECT *, {BODY} AS body FROM segments), inputs AS (SELECT *, coalesce({CLAUSE.format('title')}, {CLAUSE.format('body')}) AS clause_no, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS compact FROM bodies)"


@query(f"WITH {INPUTS} SELECT doc_id, segment_id, clause_no FROM inputs")
def llm1_clause_no(spark, sf_dir):
    return model_io.keyword_inputs(segments_of(spark, sf_dir)).select("doc_id", "segment_id", "clause_no")


@query(f"WITH {INPUTS} SELECT doc_id, segment_id, compact AS text FROM inputs")
def llm1_title_strip(spark, sf_dir):
    return model_io.keyword_inputs(segments_of(spark, sf_dir)).select("doc_id", "segment_id", "text")


@query(f"WITH {CHAIN} SELECT doc_id, ((seg_no - 1) // 5 + 1)::INT AS batch, source, count(*)::INT AS n_segments, string_agg(segment_id, ',' ORDER BY seg_no) AS ids FROM segments GROUP BY ALL")
def llm1_batches(spark, sf_dir):
    rows = model_io.keyword_batches(segments_of(spark, sf_dir), 5)
    return rows.select("doc_id", "batch", "source", F.size("segments").alias("n_segments"), F.array_join(F.col("segments.segment_id"), ",").alias("ids"))


@query("SELECT event_id, CASE WHEN v = 'signature' THEN 'signatures' WHEN v = 'notice' THEN 'notices' WHEN v IN ('payment', 'other') THEN v END AS provision_type FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'signature' WHEN 1 THEN 'notice' WHEN 2 THEN 'payment' WHEN 3 THEN 'other' ELSE event_type END AS v FROM events)")
def prov_clean(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, " Signature! ").when(F.col("event_id") % 5 == 1, "NOTICE").when(F.col("event_id") % 5 == 2, "Payment").when(F.col("event_id") % 5 == 3, "other").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", model_io.clean_provision(raw).alias("provision_type"))


@query(f"WITH {CHAIN} SELECT doc_id, segment_id, {INFER.format('text')} AS provision_type FROM segments")
def prov_infer(spark, sf_dir):
    return segments_of(spark, sf_dir).select("doc_id", "segment_id", model_io.infer_provision(F.col("text")).alias("provision_type"))


# ---- merging and filtering ----

GTEXT = "lower(trim(regexp_replace(name || ' ' || array_to_string(related, ' ') || ' ' || context || ' ' || coalesce(exact, ''), '\\s+', ' ', 'g')))"
INTRO = "((contains({0}, 'service provider:') AND contains({0}, 'client:')) OR (contains({0}, 'company:') AND contains({0}, 'client:')) OR ((" + " OR ".join(f"contains({{0}}, '{p}')" for p in fixed.INTRO_PHRASES) + ") AND (list_has_any(string_split({0}, ' '), ['company', 'client', 'customer', 'affiliate']) OR contains({0}, ' and '))))"
LAWDIS = "((contains({0}, 'governed by') OR contains({0}, 'laws of') OR contains({0}, 'law of')) AND (" + " OR ".join(f"contains({{0}}, '{w}')" for w in fixed.DISPUTE_WORDS) + "))"
quote_all = lambda values: ", ".join(f"'{v}'" for v in values)
MERGE_KEY = (
    f"CASE WHEN k IN ({quote_all(fixed.PARTY_ROLES)}) AND {INTRO.format('gt')} THEN 'parties' WHEN k IN ({quote_all(fixed.PAYMENT_ADJACENT)}) THEN 'payment terms::id:' || segment_id "
    f"WHEN k IN ({quote_all(fixed.LAW_DISPUTE)}) AND {LAWDIS.format('gt')} THEN 'governing law and dispute resolution' "
    + " ".join(f"WHEN k IN ({quote_all(sorted({s.replace('-', ' ') for s in syn}))}) THEN '{syn[0]}'" for syn in fixed.SYNONYMS)
    + " ELSE k END"
)
KEYED = f"{GROUPS}, gk AS (SELECT *, {key_sql('name')} AS k, {GTEXT} AS gt FROM groups), keyed AS (SELECT *, {MERGE_KEY} AS merge_key FROM gk)"


@query(f"WITH {KEYED} SELECT doc_id, pos::INT AS pos, merge_key FROM keyed")
def merge_key(spark, sf_dir):
    g = groups_of(spark, sf_dir)
    return g.select("doc_id", "pos", merge.merge_key({c: F.col(c) for c in g.columns}).alias("merge_key"))


@query(f"WITH {KEYED} SELECT doc_id, min(pos)::INT AS pos, count(*)::BIGINT AS n_merged FROM keyed GROUP BY doc_id, merge_key")
def merge_first_seen(spark, sf_dir):
    return merge.merge_groups(groups_of(spark, sf_dir), counted=True).select("doc_id", "pos", "n_merged")


def distinct_sql(values: str) -> str:
    """The first spelling of each key among the stripped non-blank values."""
    clean = f"list_filter(list_transform({values}, lambda u: trim(coalesce(u, ''))), lambda u: u <> '')"
    return f"list_filter({clean}, lambda v, i: list_position(list_transform({clean}, lambda w: {key_sql('w')}), {key_sql('v')}) = i)"


SPECIAL_NAME = "CASE WHEN k = 'parties' THEN 'Parties' WHEN starts_with(k, 'payment terms::') THEN 'Payment Terms' WHEN k = 'governing law and dispute resolution' THEN 'Governing Law and Dispute Resolution' END"


def points_sql(g: str) -> str:
    words = FOLD.format(f"({g}.context || ' ' || coalesce({g}.exact, ''))")
    needles = (("made between", 4), ("service provider", 2), ("client", 2), ("authorized representative", -3))
    return f"(CASE WHEN coalesce({g}.exact, '') <> '' THEN 5 ELSE 0 END + CASE WHEN {g}.context <> '' THEN 3 ELSE 0 END" + "".join(f" + CASE WHEN contains({words}, '{w}') THEN {n} ELSE 0 END" for w, n in needles) + ")"


def named_sql(g: dict[str, str]) -> str:
    """A group's state under the name that its key asks for."""
    own = f"CASE WHEN {key_sql('trim(' + g['rep'] + ')')} <> {key_sql('special')} THEN [trim({g['rep']})] ELSE []::VARCHAR[] END"
    related = distinct_sql(f"list_concat({g['related']}, {own})")
    return f"struct_pack(rep := coalesce(special, {g['rep']}), kind := {g['kind']}, related := CASE WHEN special IS NOT NULL THEN {related} ELSE {g['related']} END, context := {g['context']}, exact := {g['exact']}, segment := {g['segment']})"


_FIRST = {f: f"gs[1].{f}" for f in ("rep", "kind", "related", "context", "exact", "segment")}
_BETTER = f"{points_sql('s')} > {points_sql('t')}"
_STEP = {"rep": "t.rep", "kind": "t.kind", "related": distinct_sql("list_concat(t.related, s.related, [s.rep])"), "segment": f"CASE WHEN {_BETTER} THEN s.segment ELSE t.segment END"} | {c: f"coalesce(nullif(CASE WHEN {_BETTER} THEN s.{c} ELSE t.{c} END, ''), t.{c})" for c in ("context", "exact")}


@query(
    f"""WITH {KEYED}, states AS (SELECT doc_id, merge_key AS k, min(pos) AS pos, list(struct_pack(rep := name, kind := kind, related := related, context := context, exact := exact, segment := segment_id) ORDER BY pos) AS gs FROM keyed GROUP BY doc_id, merge_key),
special AS (SELECT *, {SPECIAL_NAME} AS special FROM states),
folded AS (SELECT doc_id, pos, list_reduce(gs[2:], lambda t, s: {named_sql(_STEP)}, {named_sql(_FIRST)}) AS g FROM special)
SELECT doc_id, pos::INT AS pos, g.rep AS representative_keyword, g.kind AS provision_type, array_to_string(g.related, '|') AS related, md5(coalesce(g.context, '')) AS context_md5, md5(coalesce(g.exact, '')) AS exact_md5, g.segment AS segment_id FROM folded"""
)
def merge_groups(spark, sf_dir):
    """The folds' results: names, related keywords, context, exact text and segment of every merged group."""
    merged = merge.merge_groups(groups_of(spark, sf_dir))
    return merged.select("doc_id", "pos", "representative_keyword", "provision_type", F.array_join("related_keywords", "|").alias("related"), F.md5(F.coalesce("context_text", F.lit(""))).alias("context_md5"), F.md5(F.coalesce("exact_text", F.lit(""))).alias("exact_md5"), F.col("meta.segment_id").alias("segment_id"))


START = key_sql("substr(b, 1, {0})")
KIND = f"CASE WHEN contains(st, 'signature') OR starts_with(st, 'accepted and agreed') OR contains(st, 'print name') THEN 'signature' WHEN contains(st, 'recitals') OR starts_with(st, 'whereas') THEN 'recitals' WHEN len(regexp_extract_all(b, '\\S+')) < 240 AND (contains(st, 'exhibit') OR contains(st, 'by and between') OR contains(st, 'made between') OR contains(st, 'entered into')) THEN 'opening' ELSE 'body' END"
FILTERED = f"{GROUPS}, gb AS (SELECT *, context || ' ' || coalesce(exact, '') AS b, {key_sql('name')} AS k FROM groups), gs AS (SELECT *, {START.format(600)} AS st FROM gb), gkind AS (SELECT *, {KIND} AS context_kind FROM gs)"


@query(f"WITH {FILTERED} SELECT doc_id, pos::INT AS pos, context_kind FROM gkind")
def filter_context_kind(spark, sf_dir):
    body = F.concat_ws(" ", F.coalesce("context_text", F.lit("")), F.coalesce("exact_text", F.lit("")))
    return groups_of(spark, sf_dir).select("doc_id", "pos", filters.context_kind(body).alias("context_kind"))


ANCHOR = " OR ".join(f"(k = '{k}' AND NOT (" + " OR ".join(f"regexp_matches(b, '{p}', 'is')" for p in ps) + "))" for k, ps in fixed.RISKY_ANCHORS.items())


@query(f"WITH {FILTERED} SELECT doc_id, pos::INT AS pos, CASE WHEN context_kind = 'signature' AND kind NOT IN ('signatures', 'parties') AND k NOT IN ('signatures', 'parties') THEN 'signature' WHEN context_kind IN ('opening', 'recitals') AND kind IN ({quote_all(fixed.BUSINESS_TYPES)}) AND k <> 'parties' THEN 'opening' WHEN {ANCHOR} THEN 'anchor' END AS reason FROM gkind")
def filter_drop_reasons(spark, sf_dir):
    g = groups_of(spark, sf_dir)
    return g.select("doc_id", "pos", filters.drop_reason({c: F.col(c) for c in g.columns}).alias("reason"))


# ---- coverage ----

WEAK = "CASE WHEN contains(st, 'signature') OR starts_with(st, 'accepted and agreed') OR contains(st, 'print name') THEN TRUE WHEN contains(st, 'recitals') OR starts_with(st, 'whereas') THEN TRUE WHEN title IS NULL AND len(regexp_extract_all(b, '\\S+')) < 220 AND (contains(st, 'agreement') OR contains(st, 'exhibit') OR contains(st, 'by and between') OR contains(st, 'entered into')) THEN TRUE ELSE FALSE END"
RULE_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, seg_no, {i} AS rule, sched, {'weak' if coverage.RULE_KEYS[i] in fixed.RISKY_RULES else 'FALSE'} AS risky, {10 if coverage.RULE_KEYS[i] in fixed.HIGH_PRECISION else 25} AS least, "
    + " + ".join(f"10 * regexp_matches(b, '{p}', 'is')::INT + 25 * regexp_matches(t, '{p}', 'is')::INT" for p in rule[3])
    + " AS hits FROM sw"
    for i, rule in enumerate(fixed.RULES)
)
SCORES = f"{CHAIN}, sb AS (SELECT *, concat_ws(chr(10), title, parent, text) AS b, coalesce(title, '') || ' ' || coalesce(parent, '') AS t FROM segments), st AS (SELECT *, {START.format(350)} AS st, regexp_matches(b, '\\b(schedule|exhibit|appendix|annex)\\b', 'i') AS sched FROM sb), sw AS (SELECT *, {WEAK} AS weak FROM st), rr AS ({RULE_ROWS}), scores AS (SELECT doc_id, seg_no, rule, hits + 5 * sched::INT - 30 * risky::INT AS score FROM rr WHERE hits > 0 AND hits + 5 * sched::INT - 30 * risky::INT >= least + 30 * risky::INT)"


@query(f"WITH {SCORES} SELECT doc_id, seg_no::INT AS seg_no, rule::INT AS rule, score::INT AS score FROM scores")
def cov_rule_scores(spark, sf_dir):
    return coverage.rule_scores(segments_of(spark, sf_dir)).select("doc_id", "seg_no", "rule", "score")


@query(f"WITH {SCORES} SELECT doc_id, rule::INT AS rule, score::INT AS score, seg_no::INT AS seg_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY score DESC, seg_no) AS r FROM scores) WHERE r = 1")
def cov_best_segment(spark, sf_dir):
    return coverage.best_segments(coverage.rule_scores(segments_of(spark, sf_dir)))


@query("SELECT o_orderkey, least(5, CASE WHEN s <= 18 AND g >= 12 THEN 2 WHEN s <= 35 AND g >= 18 THEN 3 WHEN g < greatest(8, s // 3) THEN 8 ELSE 5 END)::INT AS k FROM (SELECT o_orderkey, o_orderkey % 60 AS s, o_orderkey % 23 AS g FROM orders)")
def cov_adaptive_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", coverage.adaptive_limit(F.col("o_orderkey") % 60, F.col("o_orderkey") % 23, 5).cast("int").alias("k"))


@query()
def cov_added_groups(spark, sf_dir):
    """Groups that the greedy choice adds to each contract (O2)."""
    segments = segments_of(spark, sf_dir)
    return coverage.coverage_pass(groups_of(spark, sf_dir), segments, 5).filter("added").select("doc_id", "pos", "representative_keyword", "provision_type", F.col("meta.segment_id").alias("segment_id"))


# ---- evidence ----

LABELS = "list_distinct(list_filter(flatten(list_transform(list_concat([name], related), lambda x: regexp_extract_all(lower(x), '[a-z0-9]+'))), lambda t: length(t) > 2 AND t NOT IN (" + quote_all(fixed.KEYWORD_STOPWORDS) + ")))"


@query(f"WITH {GROUPS}, tk AS (SELECT *, {LABELS} AS toks FROM groups) SELECT doc_id, pos::INT AS pos, len(toks)::INT AS n_tokens, list_has_any(toks, [{quote_all(fixed.ENTITY_REQUIRED)}]) AS requires_entity FROM tk")
def ev_entity_gate(spark, sf_dir):
    tokens = text.keyword_tokens(F.concat(F.array("representative_keyword"), "related_keywords"))
    return groups_of(spark, sf_dir).select("doc_id", "pos", F.size(tokens).alias("n_tokens"), evidence.requires_entity(tokens).alias("requires_entity"))


@query(f"WITH {GROUPS}, tk AS (SELECT *, {LABELS} AS toks FROM groups) SELECT doc_id, pos::INT AS pos, len(list_intersect(toks, regexp_extract_all(lower(context), '[a-z0-9]+')))::INT AS overlap FROM tk")
def ev_sentence_overlap(spark, sf_dir):
    tokens = text.keyword_tokens(F.concat(F.array("representative_keyword"), "related_keywords"))
    return groups_of(spark, sf_dir).select("doc_id", "pos", F.size(F.array_intersect(tokens, text.tokens(F.col("context_text")))).alias("overlap"))


@query()
def ev_best_candidate(spark, sf_dir):
    rows = evidence.with_local_evidence(groups_of(spark, sf_dir), segments_of(spark, sf_dir))
    return rows.select("doc_id", "pos", "resolved", F.when(F.col("resolved"), F.col("exact_text")).alias("exact_text"))


@query(
    f"""WITH {GROUPS}, asked AS (SELECT doc_id, pos, segment_id, CASE WHEN pos % 4 = 1 THEN NULL WHEN pos % 12 = 3 THEN page + 90 ELSE page END AS page, CASE WHEN pos % 6 = 5 THEN 'none' WHEN pos % 6 = 1 THEN NULL ELSE doc_id || '.txt' END AS source FROM groups),
met AS (SELECT g.doc_id, g.pos, s.segment_id, s.seg_no, (g.page IS NULL OR g.page = s.page) AND (g.source IS NULL OR g.source = s.source) AS fits FROM asked g JOIN segments s ON s.doc_id = g.doc_id WHERE g.pos % 2 = 1),
tier AS (SELECT *, max(fits) OVER (PARTITION BY doc_id, pos) AS any_fits FROM met),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY seg_no) AS rank FROM tier WHERE fits OR NOT any_fits)
SELECT doc_id, pos::INT AS pos, 1 AS rank, segment_id FROM asked WHERE pos % 2 = 0 UNION ALL SELECT doc_id, pos::INT, rank::INT, segment_id FROM ranked WHERE rank <= 2"""
)
def ev_candidate_segments(spark, sf_dir):
    """Every second group names its segment; the others state page and source, one of them, none, or what no segment has."""
    pos, meta = F.col("pos"), F.col("meta")
    named = pos % 2 == 0
    page = F.when(pos % 4 == 1, None).when(pos % 12 == 3, meta["page"] + 90).otherwise(meta["page"])
    source = F.when(pos % 6 == 5, "none").when(pos % 6 == 1, None).otherwise(meta["source"])
    asked = meta.withField("id", F.when(named, meta["id"])).withField("segment_id", F.when(named, meta["segment_id"])).withField("page", page).withField("source", source)
    return model_io.candidate_segments(groups_of(spark, sf_dir).withColumn("meta", asked), segments_of(spark, sf_dir), 2).select("doc_id", "pos", "rank", "segment_id")


# ---- export ----


@query(f"WITH {GROUPS} SELECT doc_id, pos::INT AS pos, name AS representative_keyword, array_to_string(related, '|') AS related, context AS context_text, coalesce(exact, context) AS exact_text, page FROM groups")
def export_compact(spark, sf_dir):
    return export.compact_groups(groups_of(spark, sf_dir)).select("doc_id", "pos", "representative_keyword", F.array_join("related_keywords", "|").alias("related"), "context_text", "exact_text", F.col("metadata.page").alias("page"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN props WHEN event_id % 2 = 0 THEN NULL ELSE 'ctx' END AS exact_text FROM events")
def export_exact_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    third = F.col("event_id") % 3
    entry = F.struct(F.lit("c").alias("context_text"), F.when(third == 1, F.col("props")).otherwise("").alias("exact_text"))
    evidences = F.when((third == 0) | ((third == 2) & (F.col("event_id") % 2 == 1)), F.filter(F.array(entry), lambda _: F.lit(False))).otherwise(F.array(entry))
    g = {"exact_text": F.when(third == 0, F.col("event_type")).otherwise(""), "context_text": F.lit("ctx"), "evidences": evidences}
    return e.select("event_id", export.exact_text(g).alias("exact_text"))


# ---- evaluation ----


@query(f"SELECT a.doc_id, CASE WHEN n + m = 0 THEN 1.0 WHEN n = 0 OR m = 0 THEN 0.0 ELSE 2.0 * s / (n + m) END::DOUBLE AS f1 FROM (SELECT a.doc_id, len({TOKENS.format('a.text')}) AS n, len({TOKENS.format('b.text')}) AS m, len(list_intersect({TOKENS.format('a.text')}, {TOKENS.format('b.text')})) AS s FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) a")
def eval_token_f1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return docs.join(after, "doc_id").select("doc_id", text.token_f1(F.col("t"), F.col("u")).alias("f1"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 1.0 WHEN l_linenumber % 3 = 1 THEN (l_suppkey % 2 = 0)::INT::DOUBLE ELSE ((l_suppkey % 2 = 0)::INT + (l_returnflag = 'N')::INT) / 2.0 END::DOUBLE AS score FROM lineitem")
def eval_page_score(spark, sf_dir):
    third = F.col("l_linenumber") % 3
    page, truth = F.when(F.col("l_suppkey") % 2 == 0, "7").otherwise("8"), F.when(third > 0, "7")
    score = evaluate.page_score(page, truth, F.col("l_returnflag"), F.when(third == 2, " n "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


def items_of(spark, sf_dir, kind: str) -> DataFrame:
    """Predicted and true items of the contracts: predictions lose every fifth group, truths are renamed."""
    g = groups_of(spark, sf_dir)
    rows = g.filter("pos % 5 <> 0") if kind == "predicted" else g.filter("pos % 7 <> 0")
    name = F.col("representative_keyword") if kind == "predicted" else F.concat(F.lit("The "), F.col("representative_keyword"))
    own = name if kind == "predicted" else F.concat(name, F.lit("s"))
    return rows.select(F.col("doc_id").alias("eval_id"), F.col("pos").alias("idx"), F.lit(kind).alias("source_kind"), own.alias("representative_keyword"), F.col("related_keywords").alias("grouped_keywords"), text.aliases(F.array(own)).alias("aliases"), text.keyword_key(own).alias("normalized_key"), "context_text", F.col("context_text").alias("exact_information"), F.col("meta.page").cast("string").alias("page"), F.col("meta.source").alias("source"), F.col("meta.segment_id").alias("id"))


@query()
def eval_summary(spark, sf_dir):
    """Contracts whose predictions lose every fifth group and whose truths are renamed; tests hold the matching against a plain model."""
    out = Scratch(spark)
    return out.keep_only(evaluate.compare(items_of(spark, sf_dir, "predicted"), items_of(spark, sf_dir, "truth"), out)["summary"])


@query(f"WITH {GROUPS} SELECT doc_id AS eval_id, pos::INT AS idx, {key_sql('name')} AS normalized_key FROM groups WHERE pos % 7 <> 0 AND NOT pos % 5 <> 0")
def eval_missing(spark, sf_dir):
    g = groups_of(spark, sf_dir).select(F.col("doc_id").alias("eval_id"), F.col("pos").alias("idx"), text.keyword_key(F.col("representative_keyword")).alias("normalized_key"))
    matches = g.filter("idx % 5 <> 0").select("eval_id", F.col("idx").alias("truth_index"))
    return evaluate.unmatched(g.filter("idx % 7 <> 0"), matches, "truth_index")




def reports_of(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    accuracy = F.when(F.col("o_orderkey") % 13 > 0, (F.col("o_orderkey") % 101).cast("double"))
    return o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("doc"), F.col("o_orderkey").cast("string")).alias("document_name"), F.floor("o_totalprice").cast("double").alias("processing_time_seconds"), accuracy.alias("overall_accuracy_percent"), ((F.col("o_orderkey") % 5) / 4).alias("precision"), ((F.col("o_orderkey") % 3) / 2).alias("recall"), F.lit(0.5).alias("f1"), (F.col("o_orderkey") % 9).alias("expected_items"), (F.col("o_orderkey") % 8).alias("predicted_items"), (F.col("o_orderkey") % 7).alias("matched_items"), (F.col("o_orderkey") % 2).alias("missing_items"), F.lit(1).alias("extra_items"))


@query("SELECT count(*)::BIGINT AS files_evaluated, round(avg(CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey % 101)::DOUBLE ELSE 0 END), 2) AS average_overall_accuracy_percent, round(avg(floor(o_totalprice)), 2) AS average_processing_time_seconds, round(avg((o_orderkey % 5) / 4.0::DOUBLE * 100), 2) AS average_precision_percent, round(avg((o_orderkey % 3) / 2.0::DOUBLE * 100), 2) AS average_recall_percent, 50.0::DOUBLE AS average_f1_percent, sum(o_orderkey % 9)::BIGINT AS expected_items, sum(o_orderkey % 8)::BIGINT AS predicted_items, sum(o_orderkey % 7)::BIGINT AS matched_items, sum(o_orderkey % 2)::BIGINT AS missing_items, count(*)::BIGINT AS extra_items FROM orders")
def report_aggregate(spark, sf_dir):
    return evaluate.aggregate_reports(reports_of(spark, sf_dir))


@query("WITH r AS (SELECT o_orderkey AS ord, 'doc' || o_orderkey AS d, floor(o_totalprice) AS s, CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey % 101)::DOUBLE ELSE 0 END AS a FROM orders) SELECT (SELECT d FROM r ORDER BY a DESC, ord LIMIT 1) AS best, (SELECT d FROM r ORDER BY a, ord LIMIT 1) AS worst, (SELECT d FROM r ORDER BY s, ord LIMIT 1) AS fastest, (SELECT d FROM r ORDER BY s DESC, ord LIMIT 1) AS slowest")
def report_highlights(spark, sf_dir):
    return evaluate.highlights(reports_of(spark, sf_dir))


@query("SELECT number, filename FROM (SELECT (o_custkey)::VARCHAR AS number, o_custkey || '_' || o_orderkey || '_result.json' AS filename, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_custkey || '_' || o_orderkey || '_result.json' DESC) AS r FROM orders) WHERE r = 1")
def newest_result(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.concat_ws("_", "o_custkey", "o_orderkey", F.lit("result.json")).alias("filename"), F.col("o_orderdate").alias("modified"))
    return documents.newest_results(files)


def raw_reports_of(spark, sf_dir) -> DataFrame:
    """Reports of the newer shape for even orders, of the older one for odd ones."""
    o = table(spark, sf_dir, "orders")
    key, new = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    counts = F.struct((key % 9).alias("expected_items"), (key % 8).alias("predicted_items"), (key % 7).alias("matched_items"), (key % 4).alias("missing_items"), (key % 5).alias("extra_items"))
    names = lambda n: F.when(~new, F.transform(F.sequence(F.lit(0), (key % n).cast("int")), lambda i: i.cast("string")))
    return o.select(
        F.concat(F.col("o_custkey").cast("string"), F.lit("_"), key.cast("string"), F.lit("_eval_report.json")).alias("filename"), F.concat(F.lit("doc"), key.cast("string")).alias("document_name"), F.floor("o_totalprice").cast("double").alias("processing_time_seconds"),
        F.when(new, (key % 101).cast("double")).alias("overall_accuracy_percent"), F.when(~new, (key % 97).cast("double")).alias("accuracy_percent"), F.when(key % 3 > 0, (key % 5) / 4).alias("precision"), ((key % 3) / 2).alias("recall"), F.lit(0.5).alias("f1"),
        F.when(new, counts).alias("summary"), F.when(~new, key % 11).alias("expected"), F.when(~new, key % 10).alias("found"), F.when(~new & (key % 3 > 0), key % 6).alias("matched"), names(4).alias("missing"), names(3).alias("extra"),
    )


@query("SELECT o_custkey || '_' || o_orderkey || '_eval_report.json' AS filename, 'doc' || o_orderkey AS document_name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 101 ELSE o_orderkey % 97 END::DOUBLE AS overall_accuracy_percent, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 5) / 4.0::DOUBLE ELSE 0 END::DOUBLE AS precision, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 ELSE o_orderkey % 11 END::BIGINT AS expected_items, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 8 ELSE o_orderkey % 10 END::BIGINT AS predicted_items, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 WHEN o_orderkey % 3 > 0 THEN o_orderkey % 6 ELSE 0 END::BIGINT AS matched_items, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 ELSE o_orderkey % 4 + 1 END::BIGINT AS missing_items, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 ELSE o_orderkey % 3 + 1 END::BIGINT AS extra_items FROM orders")
def report_summary(spark, sf_dir):
    rows = reports.report_summary(raw_reports_of(spark, sf_dir))
    return rows.select("filename", "document_name", "overall_accuracy_percent", "precision", "expected_items", "predicted_items", "matched_items", "missing_items", "extra_items")


@query("SELECT o_custkey || '_' || o_orderkey || '_eval_report.json' AS filename, o_custkey::BIGINT AS number, CASE WHEN o_custkey % 3 > 0 THEN o_custkey || '_result.json' END AS result_file, printf('%.2f%%', (o_orderkey % 5) * 25.0::DOUBLE) AS shown FROM orders")
def report_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").cast("bigint").alias("number"), F.concat(F.col("c_custkey").cast("string"), F.lit("_result.json")).alias("result_file"))
    names = table(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit("_eval_report.json")).alias("filename"), reports.percent((F.col("o_orderkey") % 5) / 4 * 100).alias("shown"))
    return reports.with_runs(names, runs).select("filename", "number", "result_file", "shown")


@query("SELECT 'r' || o_orderkey AS filename, floor(o_totalprice)::DOUBLE AS processing_time_seconds, round(CASE WHEN o_orderkey % 7 > 0 THEN floor(o_totalprice)::DOUBLE / (o_orderkey % 7) END, 2) AS seconds_per_page, round(CASE WHEN o_orderkey % 40 > 0 THEN floor(o_totalprice)::DOUBLE / (o_orderkey % 40) END, 2) AS seconds_per_segment FROM orders")
def result_performance(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), key.cast("string")).alias("filename"), F.lit("d").alias("document_name"), F.floor("o_totalprice").cast("double").alias("processing_time_seconds"), (key % 7).alias("total_pages"), (key % 40).alias("total_segments"), (key % 11).alias("total_keyword_groups"))
    return reports.performance(rows).select("filename", "processing_time_seconds", "seconds_per_page", "seconds_per_segment")


@query("SELECT count(*)::BIGINT AS total_files, count_if(o_orderstatus = 'F')::BIGINT AS succeeded, count_if(o_orderstatus <> 'F')::BIGINT AS failed, 3 AS max_parallel_files FROM orders")
def batch_response(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return pipeline.batch_response(docs, 3)


# ---- helpers of reports and replies ----


@query(
    "WITH r AS (SELECT o_custkey AS number, max(o_custkey || '_' || o_orderkey || '_result.json') AS result FROM orders GROUP BY 1), t AS (SELECT c_custkey AS number, 'ground_truth_' || c_custkey || '.json' AS truth FROM customer WHERE c_custkey % 3 > 0) SELECT number, result, truth, CASE WHEN result IS NULL THEN 'missing result' WHEN truth IS NULL THEN 'missing ground truth' END AS skipped FROM r FULL JOIN t USING (number)"
)
def report_pairs(spark, sf_dir):
    """Results and truths by number (J11), with the reason why a number is skipped."""
    name = F.concat_ws("_", "o_custkey", "o_orderkey", F.lit("result.json"))
    results = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("number")).agg(F.max(name).alias("filename"))
    truths = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("number"), F.concat(F.lit("ground_truth_"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("filename"))
    return evaluate.pair_files(results, truths)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN 2 WHEN o_orderkey % 7 = 5 THEN 0 END::INT AS n_groups, CASE WHEN o_orderkey % 7 < 3 THEN 'Term ' || o_orderkey END AS first_name, CASE WHEN o_orderkey % 7 < 3 THEN 'a|' || o_custkey END AS related FROM orders")
def reply_parse(spark, sf_dir):
    """Replies as models give them (I7): plain, fenced, inside a sentence, without an object, empty, null."""
    key = F.col("o_orderkey")
    whole = F.format_string('{"keyword_groups": [{"representative_keyword": "Term %s", "related_keywords": ["a", "%s"]}, {"representative_keyword": "Other {}"}]}', key.cast("string"), F.col("o_custkey").cast("string"))
    reply = F.when(key % 7 == 0, whole).when(key % 7 == 1, F.concat(F.lit(" ```json\n"), whole, F.lit("\n``` "))).when(key % 7 == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" Anything else?")))
    reply = reply.when(key % 7 == 3, "I can't see any {clause").when(key % 7 == 4, "").when(key % 7 == 5, '{"keyword_groups": []}')
    groups = model_io.parse_reply(reply)["keyword_groups"]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(groups.isNotNull(), F.size(groups)).alias("n_groups"), F.get(groups, 0)["representative_keyword"].alias("first_name"), F.array_join(F.get(groups, 0)["related_keywords"], "|").alias("related"))


SHORT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(
    f"WITH {GROUPS} SELECT doc_id, pos::INT AS pos, CASE WHEN len(related) = 1 OR lower(name) = 'fees' THEN name ELSE name || ', Fees' END AS names, CASE WHEN length({SHORT.format('context')}) > 60 THEN rtrim(substr({SHORT.format('context')}, 1, 57)) || '...' ELSE {SHORT.format('context')} END AS shown, segment_id || ': ' || substr(context, 1, 40) AS sample FROM groups"
)
def report_display(spark, sf_dir):
    """How a report shows a group (X12): its names once each whatever their case, its context cut short; a sample of its text."""
    names = reports.joined_names(F.concat(F.array("representative_keyword"), "related_keywords"))
    return groups_of(spark, sf_dir).select("doc_id", "pos", names.alias("names"), reports.shortened(F.col("context_text"), 60).alias("shown"), F.concat("meta.segment_id", F.lit(": "), reports.beginning(F.col("context_text"), most=40)).alias("sample"))


CANDIDATE_BODY = "trim(regexp_replace(text, '^(?:\\d+(?:\\.\\d+)*\\.?|\\([A-Za-z]\\))\\s+', ''))"
CANDIDATE_WORDS = "list_filter(string_split_regex(trim(regexp_replace(body, '[.:]+$', '')), '\\s+'), lambda w: w <> '')"


@query(
    f"""WITH raw AS ({RAW}), b AS (SELECT *, {CANDIDATE_BODY} AS body FROM raw), w AS (SELECT *, {CANDIDATE_WORDS} AS ws FROM b)
SELECT doc_id, page, pos, len(ws) > 0 AND len(ws) <= 12 AND NOT regexp_matches(body, '[,;]$') AND (({upper_sql('body')} AND len(ws) <= 10) OR len(list_filter(ws, lambda x: {upper_sql('x[1]')})) >= greatest(1, len(ws) - 1)) AS heading,
  regexp_matches(text, '\\t|\\s{{2,}}|\\$|%|\\b\\d{{1,3}}(?:,\\d{{3}})+\\b') AS tabular, regexp_matches(text, '^(?:\\d+(?:\\.\\d+)*\\.?|\\([A-Za-z]\\))\\s+\\S') OR regexp_matches(text, '^(?:\\d+\\.|\\d+(?:\\.\\d+)+\\.?|\\([A-Za-z]\\))$') OR regexp_matches(text, '^(?:[-*•]|\\([A-Za-z0-9]+\\)|[A-Za-z]\\.)\\s+') OR regexp_matches(text, '\\t|\\s{{2,}}|\\$|%|\\b\\d{{1,3}}(?:,\\d{{3}})+\\b') AS opens FROM w"""
)
def norm_line_kinds(spark, sf_dir):
    """What each line of the contracts is taken for before wrapped lines are joined."""
    line = F.col("text")
    return contract_view.raw_lines(spark, sf_dir).select("doc_id", "page", "pos", normalize.is_heading_candidate(line).alias("heading"), normalize.is_table_like(line).alias("tabular"), normalize.starts_block(line).alias("opens"))


_KEYS = f"list_transform(list_concat([name], related), lambda u: {key_sql('u')})"
ALIASES = f"list_sort(list_distinct(list_filter(list_concat({_KEYS}, list_transform({_KEYS}, lambda u: array_to_string({CANON.format('u')}, ' '))), lambda u: u <> '')))"
_CANONS = "list_distinct(list_filter(list_transform({0}, lambda u: array_to_string(" + CANON.format("u") + ", ' ')), lambda u: u <> ''))"
_SETS = "list_filter(list_transform({0}, lambda u: list_distinct(" + CANON.format("u") + ")), lambda u: len(u) > 0)"


@query(
    f"""WITH {GROUPS}, al AS (SELECT doc_id, pos, {ALIASES} AS a FROM groups), ca AS (SELECT *, {_CANONS.format("a")} AS c, {_SETS.format("a")} AS s FROM al),
pairs AS (SELECT p.doc_id, p.pos, p.a AS pa, t.a AS ta, p.c AS pc, t.c AS tc, p.s AS ps, t.s AS ts FROM ca p JOIN ca t ON t.doc_id = p.doc_id AND t.pos = p.pos + 2)
SELECT doc_id, pos::INT AS pos, CASE WHEN len(ta) = 0 THEN 0.0 ELSE greatest(len(list_intersect(ta, pa))::DOUBLE / len(ta), CASE WHEN len(tc) = 0 THEN 0.0 ELSE len(list_intersect(tc, pc))::DOUBLE / len(tc) * 0.95::DOUBLE END) END::DOUBLE AS grouping,
  coalesce(list_max(flatten(list_transform(ps, lambda x: list_transform(ts, lambda y: len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)))))), 0.0)::DOUBLE AS label_overlap, array_to_string(pa, '|') AS aliases FROM pairs"""
)
def eval_label_scores(spark, sf_dir):
    """Grouping and label scores (C11, C15, U6) of each group against the one two places on."""
    g = groups_of(spark, sf_dir).select("doc_id", "pos", text.aliases(F.concat(F.array("representative_keyword"), "related_keywords")).alias("a"))
    sets = lambda a: F.filter(F.transform(a, lambda x: F.array_distinct(text.canonical_tokens(x))), lambda t: F.size(t) > 0)
    pairs = g.withColumn("at", F.col("pos") + 2).join(g.select("doc_id", F.col("pos").alias("at"), F.col("a").alias("t")), ["doc_id", "at"])
    return pairs.select("doc_id", "pos", evaluate.grouping_score(F.col("a"), F.col("t")).alias("grouping"), evaluate.label_overlap(sets(F.col("a")), sets(F.col("t"))).alias("label_overlap"), F.array_join("a", "|").alias("aliases"))


# ---- the whole chain ----

#: CHAIN over normalised lines: footers gone, the number alone on its line joined to its heading.
NORMAL_CHAIN = PAGES.replace("raw AS", "raw0 AS").replace("FROM raw)", "FROM raw0)") + "," + CHAIN.replace(f"raw AS ({RAW})", "raw AS (SELECT doc_id, page, pos, CASE WHEN text = '2.' THEN '2. Payment Terms' ELSE text END AS text FROM gone WHERE NOT gone AND text <> 'Payment Terms')")


@query(f"WITH {NORMAL_CHAIN} SELECT doc_id, 'success' AS status, 3::BIGINT AS total_pages, count(*)::BIGINT AS total_segments, ((count(*) + 47) // 48)::BIGINT AS keyword_extraction_batches FROM segments GROUP BY doc_id")
def contract_pipeline(spark, sf_dir):
    """Every rendered contract through all stages. No model takes part, so coverage alone makes groups; counters are compared."""
    out = pipeline.run(contract_view.pages(spark, sf_dir))
    return out.scratch.keep_only(out["documents"].join(out["results"], "doc_id").select("doc_id", "status", "total_pages", "total_segments", "keyword_extraction_batches"))


REPLAYED = (
    NORMAL_CHAIN
    + f""",
titled AS (SELECT *, trim(regexp_replace(regexp_replace(title, '^[0-9.]+', ''), '[.:]+$', '')) AS name FROM segments WHERE title IS NOT NULL),
replied AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS pos, name, CASE WHEN seg_no % 3 = 0 THEN ['Fees', upper(name)] ELSE [name] END AS related, trim(text) AS context, NULL::VARCHAR AS exact, segment_id FROM titled WHERE name <> ''),
groups AS (SELECT *, {INFER.format("concat_ws(' ', name, array_to_string(related, ' '))")} AS kind FROM replied),
gk AS (SELECT *, {key_sql('name')} AS k, {GTEXT} AS gt FROM groups), keyed AS (SELECT *, {MERGE_KEY} AS merge_key FROM gk),
states AS (SELECT doc_id, merge_key AS k, min(pos) AS pos, list(struct_pack(rep := name, kind := kind, related := related, context := context, exact := exact, segment := segment_id) ORDER BY pos) AS gs FROM keyed GROUP BY doc_id, merge_key),
special AS (SELECT *, {SPECIAL_NAME} AS special FROM states),
folded AS (SELECT doc_id, pos, list_reduce(gs[2:], lambda t, s: {named_sql(_STEP)}, {named_sql(_FIRST)}) AS g FROM special)"""
)


@query(
    f"WITH {REPLAYED} SELECT doc_id, 'success' AS status, count(*)::INT AS total_keyword_groups, ((count(*) + 49) // 50)::BIGINT AS evidence_extraction_batches, md5(string_agg(concat_ws('|', g.rep, array_to_string(g.related, ','), 'exact ' || g.rep, 'exact ' || g.rep), ';' ORDER BY pos)) AS groups_md5 FROM folded GROUP BY doc_id"
)
def chain_replayed(spark, sf_dir):
    """Every rendered contract through the chain with recorded replies of both model stages; the exported groups are compared.

    The first stage's replies name each titled segment, the second's give each group a text. Coverage, the filter and
    local evidence are off: they have queries of their own.
    """
    off = PipelineConfig(coverage_mode="off", filter_groups=False, fast_exact=False)
    chain = pipeline.Chain(contract_view.pages(spark, sf_dir), config=off)
    prompts = chain["keyword_prompts"]
    name = F.trim(F.regexp_replace("title", r"^[0-9.]+|[.:]+$", ""))
    related = F.when(F.col("seg_no") % 3 == 0, F.array(F.lit("Fees"), F.upper(name))).otherwise(F.array(name))
    group = F.struct(name.alias("representative_keyword"), related.alias("related_keywords"), F.col("text").alias("context_text"), F.struct(F.col("segment_id").alias("id")).alias("metadata"))
    named = chain["segments"].filter("title is not null").select("doc_id", "segment_id", "seg_no", group.alias("g"))
    asked = prompts.select("doc_id", "prompt", F.explode("segments.segment_id").alias("segment_id"))
    packed = asked.join(named, ["doc_id", "segment_id"], "left").groupBy(F.sha2("prompt", 256).alias("prompt_hash"), "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("seg_no", "g")))).alias("gs"))
    reply = lambda gs: F.to_json(F.struct(gs.alias("keyword_groups")))
    first = packed.groupBy("prompt_hash").agg(F.first(reply(F.transform("gs", lambda x: x["g"]))).alias("response"))
    chain.replies = chain.scratch.keep(first, "first-replies")
    entry = lambda g: F.struct(g["representative_keyword"].alias("representative_keyword"), F.concat(F.lit("exact "), g["representative_keyword"]).alias("exact_text"), F.lit(0.5).alias("confidence"))
    second = chain["evidence_prompts"].select(F.sha2("prompt", 256).alias("prompt_hash"), reply(F.transform("keyword_groups", entry)).alias("response")).dropDuplicates(["prompt_hash"])
    chain.replies = chain.replies.unionByName(chain.scratch.keep(second, "second-replies"))
    shown = F.transform("keyword_groups", lambda g: F.concat_ws("|", g["representative_keyword"], F.array_join(g["related_keywords"], ","), g["context_text"], g["exact_text"]))
    rows = chain["documents"].join(chain["results"], "doc_id")
    return chain.scratch.keep_only(rows.select("doc_id", "status", "total_keyword_groups", "evidence_extraction_batches", F.md5(F.array_join(shown, ";")).alias("groups_md5")))


# ---- jobs ----

STATES = "CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 4 = 1 THEN 'cached' WHEN o_orderkey % 4 = 2 THEN 'success' WHEN o_custkey % 2 = 0 THEN 'processing' ELSE 'queued' END"


@query(f"WITH j AS (SELECT o_custkey AS batch_id, {STATES} AS s FROM orders), c AS (SELECT batch_id, count_if(s = 'queued')::BIGINT AS queued_count, count_if(s = 'processing')::BIGINT AS processing_count, count_if(s = 'success')::BIGINT AS succeeded_count, count_if(s = 'failed')::BIGINT AS failed_count, count_if(s = 'cached')::BIGINT AS cached_count, count(*) AS n FROM j GROUP BY 1) SELECT * EXCLUDE n, CASE WHEN succeeded_count + failed_count + cached_count = n THEN CASE WHEN failed_count = n THEN 'failed' ELSE 'completed' END WHEN processing_count > 0 THEN 'processing' ELSE 'queued' END AS status FROM c")
def batch_status_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.expr(STATES).alias("status"))
    counts = jobs.status_counts(rows)
    total = F.col("queued_count") + F.col("processing_count") + F.col("succeeded_count") + F.col("failed_count") + F.col("cached_count")
    return jobs.rollup_status(counts, total)


#: Job events from the table of events: a user's events are a batch of four files, its clock is twenty times faster.
JOB_EVENTS = {
    "batch_id": "user_id", "job_id": "concat(user_id, '-', event_id % 4)", "seq": "event_id",
    "event": "CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'retried' ELSE 'created' END WHEN 'click' THEN 'started' WHEN 'view' THEN 'step' WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'cached' ELSE 'succeeded' END ELSE 'failed' END",
    "stage": "CASE WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN 'load' WHEN 1 THEN 'llm1' WHEN 2 THEN 'export' ELSE 'other' END END", "error": "CASE WHEN event_type = 'error' THEN props END",
}
_DUE = f"(CASE WHEN j.attempt > 0 THEN j.started + {lifecycle.FILE_HOURS * lifecycle.HOUR} ELSE {{began}} + {lifecycle.BATCH_HOURS * lifecycle.HOUR} END)"
_PUT = "struct_pack(job_id := j.job_id, status := {status}, stage := {stage}, progress := {progress}, started := {started}, finished := {finished}, error := {error}, attempt := {attempt})"
_put = lambda **new: _PUT.format(**({"status": "j.status", "stage": "j.stage", "progress": "j.progress", "started": "j.started", "finished": "j.finished", "error": "j.error", "attempt": "j.attempt"} | new))
_expire = lambda jobs, began, now: f"list_transform({jobs}, lambda j: CASE WHEN j.status = 'processing' AND {_DUE.format(began=began)} <= {now} THEN {_put(status=quote_all(['failed']), stage=quote_all(['failed']), finished=_DUE.format(began=began), error=quote_all([lifecycle.TIMED_OUT]))} ELSE j END)"
_STEPS = "CASE e.stage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lifecycle.STEP_PROGRESS.items()) + f" ELSE {lifecycle.STEP_UNKNOWN} END"
_NEW = {"status": "'queued'", "stage": "'queued'", "progress": "0", "started": "NULL::BIGINT", "finished": "NULL::BIGINT", "error": "NULL::VARCHAR"}
_APPLY = f"""list_transform(x.jobs, lambda j: CASE WHEN j.job_id <> e.job_id THEN j
  WHEN e.event = 'started' AND j.status = 'queued' THEN {_put(status="'processing'", stage="'processing'", progress=str(lifecycle.STARTED), started="e.at_us", finished="NULL::BIGINT", error="NULL::VARCHAR")}
  WHEN e.event = 'step' AND j.status = 'processing' THEN {_put(stage="e.stage", progress=_STEPS)}
  WHEN e.event = 'failed' AND j.status = 'processing' THEN {_put(status="'failed'", stage="'failed'", finished="e.at_us", error="e.error")}
  WHEN e.event IN ('cached', 'succeeded') AND j.status = 'processing' THEN {_put(status="CASE e.event WHEN 'cached' THEN 'cached' ELSE 'success' END", stage="CASE e.event WHEN 'cached' THEN 'cached' ELSE 'success' END", progress=str(lifecycle.ENDED), finished="e.at_us", error="NULL::VARCHAR")}
  WHEN e.event = 'retried' AND j.status = 'failed' THEN {_put(**_NEW, attempt="j.attempt + 1")} ELSE j END)"""
_JOBS_TYPE = "STRUCT(job_id VARCHAR, status VARCHAR, stage VARCHAR, progress INT, started BIGINT, finished BIGINT, error VARCHAR, attempt INT)"
_n = lambda state: f"len(list_filter(jobs, lambda j: j.status = '{state}'))::INT"


@query(
    f"""WITH RECURSIVE raw AS (SELECT {', '.join(f'{x} AS {c}' for c, x in JOB_EVENTS.items())}, epoch_us(ts) // 20 AS at_us FROM events), ev AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY at_us, seq) AS n FROM raw),
run AS (SELECT batch_id, 0::BIGINT AS n, []::{_JOBS_TYPE}[] AS jobs, NULL::BIGINT AS began FROM ev WHERE n = 1
  UNION ALL SELECT e.batch_id, e.n, CASE WHEN e.event = 'created' AND len(list_filter(x.jobs, lambda j: j.job_id = e.job_id)) = 0 THEN list_append(x.jobs, struct_pack(job_id := e.job_id, status := 'queued', stage := 'queued', progress := 0, started := NULL::BIGINT, finished := NULL::BIGINT, error := NULL::VARCHAR, attempt := 0)::{_JOBS_TYPE}) ELSE {_APPLY} END,
    coalesce(x.began, CASE WHEN e.event = 'started' AND len(list_filter(x.jobs, lambda j: j.job_id = e.job_id AND j.status = 'queued')) > 0 THEN e.at_us END)
  FROM (SELECT run.batch_id, run.n, run.began, {_expire("run.jobs", "run.began", "f.at_us")}::{_JOBS_TYPE}[] AS jobs FROM run JOIN ev f ON f.batch_id = run.batch_id AND f.n = run.n + 1) x JOIN ev e ON e.batch_id = x.batch_id AND e.n = x.n + 1),
last AS (SELECT batch_id, began, {_expire("jobs", "began", "watermark")} AS jobs FROM run, (SELECT (max(at_us) // 1000 - 600000) * 1000 AS watermark FROM raw) QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY n DESC) = 1),
counts AS (SELECT *, len(jobs)::INT AS total_files, {_n("queued")} AS queued_count, {_n("processing")} AS processing_count, {_n("success")} AS succeeded_count, {_n("failed")} AS failed_count, {_n("cached")} AS cached_count FROM last WHERE len(jobs) > 0),
judged AS (SELECT *, CASE WHEN succeeded_count + failed_count + cached_count = total_files THEN CASE WHEN failed_count = total_files THEN 'failed' ELSE 'completed' END WHEN processing_count > 0 THEN 'processing' ELSE 'queued' END AS status FROM counts)
SELECT batch_id::VARCHAR AS batch_id, status, total_files, queued_count, processing_count, succeeded_count, failed_count, cached_count, began AS started, CASE WHEN status IN ('completed', 'failed') THEN list_max(list_transform(jobs, lambda j: j.finished)) END AS finished,
  array_to_string(list_sort(list_transform(jobs, lambda j: concat_ws(':', j.job_id, j.status, j.stage, j.progress, coalesce(j.error, ''), j.attempt, coalesce(j.started, 0), coalesce(j.finished, 0)))), ' ') AS files FROM judged"""
)
def job_lifecycle(spark, sf_dir):
    """The events of the table replayed as a stream of job events; the last state of every batch."""
    own, out = spark.newSession(), Scratch(spark)  # a session of its own, for the state store's setting
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = own.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    at = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 20)"
    events = stream.selectExpr(*[f"{x} AS {c}" for c, x in JOB_EVENTS.items()], f"{at} AS at")
    last = lifecycle.replay(events, f"{out.folder}/changes", f"{out.folder}/checkpoint")
    entry = lambda j: F.concat_ws(":", j["job_id"], j["status"], j["stage"], j["progress"], F.coalesce(j["error"], F.lit("")), j["attempt"], F.coalesce(j["started"], F.lit(0)), F.coalesce(j["finished"], F.lit(0)))
    files = F.array_join(F.array_sort(F.transform("files", entry)), " ")
    return out.keep_only(last.drop("version").withColumn("files", files))


def cache_of(spark, sf_dir, new: bool) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0" if new else "o_orderkey % 2 = 0")
    mark = "new" if new else "old"
    return o.select(F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("file_hash"), F.lit("c").alias("config_hash"), F.concat(F.lit(f"{mark}-"), F.col("o_orderkey").cast("string")).alias("output_path"), F.lit(mark).alias("created_at"), F.lit(mark).alias("updated_at"))


@query("SELECT 'h' || o_orderkey AS file_hash, 'c' AS config_hash, CASE WHEN o_orderkey % 3 <> 0 THEN 'new-' ELSE 'old-' END || o_orderkey AS output_path, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS created_at, CASE WHEN o_orderkey % 3 <> 0 THEN 'new' ELSE 'old' END AS updated_at FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def cache_upsert(spark, sf_dir):
    return jobs.upsert_cache(cache_of(spark, sf_dir, False), cache_of(spark, sf_dir, True))


@query("SELECT 'h' || o_orderkey AS file_hash, 'c' AS config_hash, CASE WHEN o_orderkey % 2 = 0 THEN 'old-' || o_orderkey END AS cached_output FROM orders WHERE o_orderkey % 3 <> 0")
def cache_probe(spark, sf_dir):
    wanted = cache_of(spark, sf_dir, True).select("file_hash", "config_hash")
    return jobs.probe_cache(wanted, cache_of(spark, sf_dir, False))


@query(
    """WITH j AS (SELECT o_orderkey AS k, o_custkey AS b FROM orders),
states AS (SELECT *, CASE WHEN k % 8 = 0 THEN 'success' WHEN k % 8 = 4 THEN CASE WHEN k % 3 = 0 THEN 'queued' ELSE 'failed' END WHEN k % 2 = 0 THEN 'processing' ELSE 'queued' END AS status FROM j),
counts AS (SELECT b, count(*) AS n, count_if(status = 'queued')::BIGINT AS q, count_if(status = 'processing')::BIGINT AS p, count_if(status = 'success')::BIGINT AS s, count_if(status = 'failed')::BIGINT AS f FROM states GROUP BY b)
SELECT k::VARCHAR AS id, status, CASE WHEN k % 8 = 0 THEN 'success' WHEN k % 8 = 4 THEN CASE WHEN k % 3 = 0 THEN 'queued' ELSE 'export' END WHEN k % 2 = 0 THEN 'processing' ELSE 'queued' END AS stage,
  CASE WHEN k % 8 = 0 THEN 100 WHEN k % 8 = 4 THEN CASE WHEN k % 3 = 0 THEN 0 ELSE 99 END WHEN k % 2 = 0 THEN 5 ELSE 0 END::INT AS progress, CASE WHEN k % 8 = 4 AND k % 3 <> 0 THEN 'no text' END AS error,
  CASE WHEN k % 2 = 0 AND NOT (k % 8 = 4 AND k % 3 = 0) THEN 't1' END AS started_at, CASE WHEN k % 8 = 4 AND k % 3 = 0 THEN 't4' WHEN k % 4 = 0 THEN 't3' WHEN k % 2 = 0 THEN 't1' ELSE 't0' END AS updated_at,
  CASE WHEN s + f = n THEN CASE WHEN f = n THEN 'failed' ELSE 'completed' END WHEN p > 0 THEN 'processing' ELSE 'queued' END AS batch_status, q AS queued_count, f AS failed_count, 6::INT AS versions FROM states JOIN counts USING (b)"""
)
def job_table_merges(spark, sf_dir):
    """The orders as file jobs through the job tables: created, started, stepped, ended, some retried; five merges and a refresh."""
    out = Scratch(spark)
    store = jobs.JobStore(spark, f"{out.folder}/jobs", buckets=8)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("batch_id"))
    zero, none = F.lit(0), F.lit(None).cast("string")
    queued = o.select("id", "batch_id", F.concat("id", F.lit(".txt")).alias("filename"), F.lit("in").alias("input_path"), F.lit("h").alias("file_hash"), F.lit("c").alias("config_hash"), F.lit("queued").alias("status"), F.lit("queued").alias("stage"), zero.alias("progress"), none.alias("output_path"), zero.alias("total_pages"), zero.alias("total_segments"), zero.alias("keyword_groups"), none.alias("error"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at"), none.alias("started_at"), none.alias("finished_at"))
    batch = o.groupBy("batch_id").agg(F.count("*").cast("int").alias("total_files")).select(F.col("batch_id").alias("id"), F.lit("queued").alias("status"), "total_files", F.lit(2).alias("max_parallel_files"), F.lit("c").alias("config_hash"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at"), none.alias("started_at"), none.alias("finished_at"))
    store.create(batch, queued)
    store.create(batch, queued)  # a repeated call changes nothing
    store.update(o.filter("k % 2 = 0").select("id", F.lit("processing").alias("status"), F.lit("processing").alias("stage"), F.lit(5).alias("progress"), F.lit("t1").alias("started_at")), "t1")
    steps = o.filter("k % 4 = 0").select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("llm1").alias("stage"), F.lit(80).alias("progress")), F.struct(F.lit(2).alias("seq"), F.lit("export").alias("stage"), F.lit(250).alias("progress")))).alias("s")).select("id", "s.*")
    store.update(steps, "t2", order="seq")
    ends = o.filter("k % 4 = 0").select("id", F.when(F.col("k") % 8 == 0, "success").otherwise("failed").alias("status"), F.when(F.col("k") % 8 == 0, "success").otherwise("export").alias("stage"), F.when(F.col("k") % 8 == 0, 100).otherwise(99).alias("progress"), F.when(F.col("k") % 8 == 4, "no text").alias("error"))
    store.update(ends, "t3")
    version = store.retry(o.filter("k % 3 = 0").select("id"), "t4")
    store.refresh("t5")
    batches = store.batches.read().select(F.col("id").alias("batch_id"), F.col("status").alias("batch_status"), "queued_count", "failed_count")
    return out.keep_only(store.jobs.read().join(batches, "batch_id").select("id", "status", "stage", "progress", "error", "started_at", "updated_at", "batch_status", "queued_count", "failed_count", F.lit(version).alias("versions")))


@query("SELECT 'h' || o_orderkey AS file_hash, 'c' AS config_hash, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 5 > 0 THEN 'out/' || o_orderkey || '.json' END AS cached_output FROM orders WHERE o_orderkey % 3 <> 0")
def cache_probe_existing(spark, sf_dir):
    """As cache_probe, but an entry whose output is no longer there is none."""
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    keys = [F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("file_hash"), F.lit("c").alias("config_hash")]
    cache = o.filter("o_orderkey % 2 = 0").select(*keys, path.alias("output_path"))
    return jobs.probe_cache(o.filter("o_orderkey % 3 <> 0").select(*keys), cache, o.filter("o_custkey % 5 > 0").select(path.alias("path")))


@query("SELECT upload_id, filename, CASE WHEN n = 0 THEN filename ELSE replace(filename, '.txt', '_' || n || '.txt') END AS stored_as FROM (SELECT o_orderkey AS upload_id, 'file' || o_custkey || '.txt' AS filename, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)")
def upload_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), F.concat(F.lit("file"), F.col("o_custkey").cast("string"), F.lit(".txt")).alias("filename"))
    return documents.free_names(rows)


@query("SELECT conv_id, count(*)::INT AS n_turns, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def conversation_order(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("ts"))
    return rows.select("conv_id", F.size("ts").alias("n_turns"), F.array_join(F.col("ts.role"), ">").alias("roles"))
