"""Model stages: batches, prompts, replies, and what becomes of the replies.

A model is anything with invoke(prompt) -> str; it runs inside mapInPandas, one prompt a row, on as many
partitions as calls may run at once. A replay table (prompt_hash, response) replaces it by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions import fixed, text
from pactlake.operators.merge import EVIDENCE, META

CLAUSE = r"(?U)^\s*((?:\d+(?:\.\d+)*\.?)|(?:\([A-Za-z0-9]+\))|(?:[A-Za-z]\.))\s+"
KEYWORD_PROMPT = (
    "You read clauses of a contract. Name the contract concepts that the text states. Answer with one JSON object that holds a list "
    "`keyword_groups`; every entry has representative_keyword, provision_type, related_keywords, context_text copied from the clause, and "
    "metadata with the clause's id. Use these provision types: " + ", ".join(fixed.PROVISION_TYPES) + "."
)
EVIDENCE_PROMPT = (
    "You receive concept groups and contract segments. For every group return the exact words of a segment that support it. Answer with one "
    "JSON object that holds a list `keyword_groups`; every entry repeats representative_keyword and lists evidences with context_text, "
    "exact_text, page, id, segment_id, source, validation_status (passed, not_found or invalid) and confidence."
)
REPLY = (
    "keyword_groups array<struct<representative_keyword:string,provision_type:string,provision:string,related_keywords:array<string>,context_text:string,"
    "exact_text:string,evidence_text:string,validation_status:string,confidence:string,metadata:struct<page:int,source:string,id:string,segment_id:string,clause_no:string,parent_section_title:string>,"
    "evidences:array<struct<context_text:string,evidence_text:string,exact_text:string,page:int,id:string,segment_id:string,source:string,validation_status:string,confidence:string>>>>"
)


def heading_key(x: Column) -> Column:
    return text.folded(F.regexp_replace(F.regexp_replace(text.strip(x), "[.:;]+$", ""), r"(?U)\s+", " "))


def strip_title(body: Column, title: Column) -> Column:
    """I1"""
    body, title = text.strip(F.coalesce(body, F.lit(""))), text.strip(F.coalesce(title, F.lit("")))
    first, rest = F.substring_index(body, "\n", 1), text.strip(F.substring(body, F.instr(body, "\n") + 1, F.length(body)))
    rest = F.when(F.instr(body, "\n") > 0, rest).otherwise("")
    cut = F.regexp_replace(F.substring(body, F.length(title) + 1, F.length(body)), r"^[ \t\r\n\-:.;]+", "")
    return F.when((body == "") | (title == ""), body).when(heading_key(first) == heading_key(title), rest).when(body.startswith(title), cut).otherwise(body)


def clause_no(x: Column) -> Column:
    """I2"""
    return text.blank_to_null(F.regexp_replace(F.regexp_extract(F.coalesce(x, F.lit("")), CLAUSE, 1), r"\.+$", ""))


def keyword_inputs(segments: DataFrame) -> DataFrame:
    """Segments with the compact text and clause number that the first stage reads."""
    body = strip_title(F.col("text"), F.col("title"))
    return segments.withColumn("_body", body).select("doc_id", "seg_no", "segment_id", "source", "page", "parent_section_title", F.coalesce(clause_no(F.col("title")), clause_no(F.col("_body"))).alias("clause_no"), text.squeeze(F.col("_body")).alias("text"))


def keyword_batches(segments: DataFrame, size: int = 48) -> DataFrame:
    """(doc_id, batch, source, segments): by source in order of appearance, `size` segments each."""
    if size <= 0:
        raise ValueError("batch_size must be greater than 0")
    rows = keyword_inputs(segments)
    rows = rows.withColumn("_first", F.min("seg_no").over(Window.partitionBy("doc_id", "source")))
    rows = rows.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("seg_no")) - 1) / size))
    packed = rows.groupBy("doc_id", "source", "_first", "_part").agg(F.array_sort(F.collect_list(F.struct("seg_no", "segment_id", "page", "parent_section_title", "clause_no", "text"))).alias("segments"))
    order = Window.partitionBy("doc_id").orderBy("_first", "_part")
    return packed.select("doc_id", F.row_number().over(order).alias("batch"), "source", "segments")


def json_prompt(instructions: str, label: str, payload: Column) -> Column:
    """I5"""
    return F.concat(F.lit(f"{instructions}\n\n{label}:\n"), F.to_json(payload))


def with_keyword_prompts(batches: DataFrame) -> DataFrame:
    parts = F.transform("segments", lambda s: F.struct(*[s[c].alias(c) for c in ("segment_id", "page", "parent_section_title", "clause_no", "text")]))
    return batches.withColumn("prompt", json_prompt(KEYWORD_PROMPT, "Contract segment batch JSON", F.struct("source", parts.alias("segments"))))


def call_slots(prompts: DataFrame, calls: int, per_document: int) -> DataFrame:
    """(prompt_hash, prompt, slot): every distinct prompt with the slot, of `calls`, that sends it.

    A document's prompts go round `per_document` slots that its key picks, so no more of them than that run at once,
    and no more than `calls` of all. A prompt of several documents is sent for the first of them.
    """
    if calls < 1 or per_document < 1:
        raise ValueError("at least one call must be allowed at a time")
    own = prompts.groupBy(F.sha2("prompt", 256).alias("prompt_hash")).agg(F.min(F.struct(F.col("doc_id").cast("string").alias("doc"), "batch")).alias("o"), F.first("prompt").alias("prompt"))
    turn = F.col("o.batch") % min(calls, per_document)
    return own.select("prompt_hash", "prompt", F.pmod(F.xxhash64("o.doc") + turn, F.lit(calls)).cast("int").alias("slot"))


def invoke(prompts: DataFrame, model_factory: Callable, calls: int = 8, per_document: int = 3) -> DataFrame:
    """(prompt_hash, response, error) of every distinct prompt; a failed call has `error`.

    A slot is a partition and sends one prompt after the other (see call_slots). A retried task sends its own prompts
    again; write the result before it is used.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for batch in batches:
            answers, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    reply = model.invoke(prompt)
                    content = getattr(reply, "content", reply)
                    answers.append("\n".join(map(str, content)) if isinstance(content, list) else str(content))
                    errors.append(None)
                except Exception as e:  # the document fails, not the corpus
                    answers.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"prompt_hash": batch["prompt_hash"], "response": answers, "error": errors})

    slots = call_slots(prompts, calls, per_document).repartitionById(calls, "slot").drop("slot")
    return slots.mapInPandas(run, "prompt_hash string, response string, error string")


def with_replies(prompts: DataFrame, sent: DataFrame) -> DataFrame:
    """Prompts with the `response` and `error` that invoke() returned for them."""
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256)).join(sent, "prompt_hash").drop("prompt_hash")


def replay(prompts: DataFrame, table: DataFrame) -> DataFrame:
    """Responses by sha256 of the prompt."""
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256)).join(table.select("prompt_hash", "response"), "prompt_hash", "left").drop("prompt_hash").withColumn("error", F.when(F.col("response").isNull(), "no recorded response"))


def parse_reply(x: Column) -> Column:
    """The reply's JSON object, without a code fence, or the outermost braces; null where there is none."""
    body = text.strip(x)
    body = F.when(body.startswith("```"), F.regexp_replace(F.regexp_replace(body, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(body)
    whole = F.when(F.try_parse_json(body).isNotNull(), body)
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.from_json(F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner)), REPLY)


def clean_provision(x: Column) -> Column:
    """I10"""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text.strip(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    for alias, name in fixed.PROVISION_ALIASES.items():
        slug = F.when(slug == alias, name).otherwise(slug)
    return F.when(slug.isin(*fixed.PROVISION_TYPES), slug)


def infer_provision(x: Column) -> Column:
    """I11"""

    def first_hit(low: Column) -> Column:
        found = None
        for name, needles in fixed.PROVISION_NEEDLES:
            hit = low.contains(needles[0])
            for n in needles[1:]:
                hit = hit | low.contains(n)
            found = F.when(hit, name) if found is None else found.when(hit, name)
        return found.otherwise("other")

    return text.given(F.lower(x), first_hit)


def clean_strings(x: Column) -> Column:
    """I8"""
    return F.filter(F.transform(F.coalesce(x, text.no_strings()), text.strip), lambda s: F.coalesce(s, F.lit("")) != "")


def keyword_groups(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Groups of all replies (doc_id, batch, response), in order, tied to their segments."""
    parsed = replies.withColumn("_groups", parse_reply(F.col("response"))["keyword_groups"]).join(batches.select("doc_id", "batch", F.col("source").alias("_source"), "segments"), ["doc_id", "batch"])
    rows = parsed.select("doc_id", "batch", "_source", "segments", F.posexplode("_groups").alias("i", "g"))
    rows = rows.withColumn("name", text.strip(F.coalesce("g.representative_keyword", F.lit("")))).filter("name <> ''")
    wanted = F.coalesce(text.blank_to_null(F.col("g.metadata.id")), F.col("g.metadata.segment_id"))
    rows = rows.withColumn("s", F.get(F.filter("segments", lambda s: s["segment_id"] == wanted), 0)).withColumn("related", clean_strings(F.col("g.related_keywords")))
    m, s, known = F.col("g.metadata"), F.col("s"), F.col("s").isNotNull()
    meta = F.struct(
        F.coalesce(m["page"], s["page"]).alias("page"), F.coalesce(m["source"], text.blank_to_null(F.col("_source"))).alias("source"),
        F.when(known, s["segment_id"]).otherwise(m["id"]).alias("id"), F.coalesce(m["segment_id"], s["segment_id"]).alias("segment_id"),
        F.coalesce(m["clause_no"], s["clause_no"]).alias("clause_no"), F.coalesce(m["parent_section_title"], s["parent_section_title"]).alias("parent_section_title"),
        F.lit(None).cast("string").alias("coverage_source"), F.lit(None).cast("int").alias("token_count"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("int").alias("chunk_total"), F.lit(None).cast("boolean").alias("is_continuation"),
    )
    kind = F.coalesce(clean_provision(F.coalesce(text.blank_to_null(F.col("g.provision_type")), F.col("g.provision"))), infer_provision(F.concat_ws(" ", "name", F.array_join("related", " "))))
    context = F.coalesce(text.blank_to_null(text.strip(F.col("g.context_text"))), text.strip(s["text"]), F.lit(""))
    order = Window.partitionBy("doc_id").orderBy("batch", "i")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), F.col("name").alias("representative_keyword"), kind.alias("provision_type"), F.col("related").alias("related_keywords"), context.alias("context_text"), F.lit(None).cast("string").alias("exact_text"), F.expr(f"cast(array() as array<{EVIDENCE}>)").alias("evidences"), meta.cast(META).alias("meta"))


def first_segments(segments: DataFrame, most: int) -> DataFrame:
    """The first `most` segments of each (document, page, source), (document, page), (document, source) and document.

    has_page and has_source tell a null of the segments from a side that is left open.
    """
    s = segments.select("doc_id", F.struct("seg_no", "segment_id").alias("s"), "page", "source")
    on = lambda page, source: F.struct(F.lit(page).alias("has_page"), F.lit(source).alias("has_source"), (F.col("page") if page else F.lit(None)).alias("page"), (F.col("source") if source else F.lit(None)).alias("source"))
    keyed = s.select("doc_id", "s", F.explode(F.array(*[on(p, q) for p in (True, False) for q in (True, False)])).alias("on")).select("doc_id", "s", "on.*")
    return keyed.groupBy("doc_id", "has_page", "has_source", "page", "source").agg(F.slice(F.array_sort(F.collect_list("s")), 1, most).alias("first"))


def candidate_segments(groups: DataFrame, segments: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, pos, rank, segment_id): the named segment; else the first on the page and source; else the document's first.

    A null page or source of a group leaves that side open. Lookups by equality in the lists of `first_segments`, so a
    group meets one list of at most `most` segments, not the segments of its document.
    """
    wanted = F.coalesce(text.blank_to_null(F.col("meta.id")), F.col("meta.segment_id"))
    g = groups.select("doc_id", "pos", wanted.alias("segment_id"), F.col("meta.page").alias("page"), F.col("meta.source").alias("source"))
    named = g.join(segments.select("doc_id", "segment_id"), ["doc_id", "segment_id"], "left_semi").select("doc_id", "pos", F.lit(1).alias("rank"), "segment_id")
    open_ = g.join(named.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti").drop("segment_id").withColumns({"has_page": F.col("page").isNotNull(), "has_source": F.col("source").isNotNull()})
    lists = first_segments(segments, most)
    both = lists.filter("(not has_page or page is not null) and (not has_source or source is not null)")
    keys = ["doc_id", "has_page", "has_source"]
    known = lambda df: df.withColumns({"page": F.coalesce(F.col("page").cast("string"), F.lit("")), "source": F.coalesce("source", F.lit(""))})
    met = known(open_).join(known(both), [*keys, "page", "source"], "left")
    whole = lists.filter("not has_page and not has_source").select("doc_id", F.col("first").alias("any"))
    found = met.join(whole, "doc_id", "left").select("doc_id", "pos", F.posexplode(F.coalesce("first", "any")).alias("rank", "s"))
    return named.unionByName(found.select("doc_id", "pos", (F.col("rank") + 1).alias("rank"), "s.segment_id"))


def evidence_batches(groups: DataFrame, segments: DataFrame, size: int = 50, most: int = 2) -> DataFrame:
    """(doc_id, batch, keyword_groups, segments): contexts as pseudo-segments first, then the candidates of groups without context."""
    if size <= 0 or most <= 0:
        raise ValueError("batch_size and max_segments_per_group must be greater than 0")
    numbered = groups.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1) / size).cast("int"))
    context = text.strip(F.coalesce("context_text", F.lit("")))
    payload = F.struct("representative_keyword", F.when(F.size("related_keywords") > 0, F.col("related_keywords")).alias("related_keywords"), "provision_type", "context_text", "exact_text", F.col("meta").alias("metadata"))
    named = F.coalesce(text.blank_to_null(F.col("meta.id")), F.col("meta.segment_id"))
    own = F.when(context != "", F.struct(F.lit(0).alias("tier"), F.col("pos").alias("ord"), F.lit(0).alias("rank"), named.alias("id"), F.col("meta.page").alias("page"), F.col("meta.source").alias("source"), context.alias("text")))
    heads = numbered.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", payload.alias("g")))).alias("gs"), F.collect_list(own).alias("own"))
    bare = numbered.filter(context == "")
    wanted = candidate_segments(bare, segments, most).join(numbered.select("doc_id", "pos", "batch"), ["doc_id", "pos"])
    first = wanted.groupBy("doc_id", "batch", "segment_id").agg(F.min(F.struct("pos", "rank")).alias("f"))
    met = first.join(segments.select("doc_id", "segment_id", "page", "source", "text"), ["doc_id", "segment_id"])
    extra = met.groupBy("doc_id", "batch").agg(F.collect_list(F.struct(F.lit(1).alias("tier"), F.col("f.pos").alias("ord"), F.col("f.rank").alias("rank"), F.col("segment_id").alias("id"), "page", "source", "text")).alias("extra"))
    both = F.array_sort(F.concat("own", F.coalesce("extra", F.slice("own", 1, 0))))
    return heads.join(extra, ["doc_id", "batch"], "left").select("doc_id", "batch", F.transform("gs", lambda g: g["g"]).alias("keyword_groups"), F.transform(both, lambda s: F.struct(*[s[c].alias(c) for c in ("id", "page", "source", "text")])).alias("segments"))


def with_evidence_prompts(batches: DataFrame) -> DataFrame:
    return batches.withColumn("prompt", json_prompt(EVIDENCE_PROMPT, "Evidence extraction batch JSON", F.struct("keyword_groups", "segments")))


def confidence(x: Column) -> Column:
    """I13"""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(0.0))))


def normal_evidence(e) -> Column:
    """I12"""
    status = F.coalesce(text.blank_to_null(text.strip(e["validation_status"])), F.lit("passed"))
    some = lambda *names: F.coalesce(*[text.blank_to_null(e[n]) for n in names], F.lit(""))
    return F.struct(
        text.strip(some("context_text", "evidence_text", "exact_text")).alias("context_text"), text.strip(some("exact_text")).alias("exact_text"), e["page"].alias("page"),
        F.coalesce(text.blank_to_null(e["id"]), e["segment_id"]).alias("id"), F.coalesce(text.blank_to_null(e["segment_id"]), e["id"]).alias("segment_id"), e["source"].alias("source"),
        F.when(status.isin("passed", "not_found", "invalid"), status).otherwise("not_found").alias("validation_status"), confidence(e["confidence"]).alias("confidence"),
    ).cast(EVIDENCE)


def merge_replies(groups: DataFrame, replies: DataFrame) -> DataFrame:
    """Groups with the evidences returned under their name in their batch's reply (doc_id, batch, response).

    groups carry `batch`. The last of several entries with a name wins; without one the group is not_found.
    """
    rows = replies.select("doc_id", "batch", F.posexplode(parse_reply(F.col("response"))["keyword_groups"]).alias("i", "r")).withColumn("_name", text.evidence_key(F.col("r.representative_keyword"))).filter("_name <> ''")
    last = rows.groupBy("doc_id", "batch", "_name").agg(F.max_by("r", "i").alias("r"))
    df = groups.withColumn("_name", text.evidence_key(F.col("representative_keyword"))).join(last, ["doc_id", "batch", "_name"], "left")
    top = F.struct(F.col("r.context_text").alias("context_text"), F.lit(None).cast("string").alias("evidence_text"), F.col("r.exact_text").alias("exact_text"), F.col("r.metadata.page").alias("page"), F.coalesce("r.metadata.id", "r.metadata.segment_id").alias("id"), F.coalesce("r.metadata.segment_id", "r.metadata.id").alias("segment_id"), F.col("r.metadata.source").alias("source"), F.col("r.validation_status").alias("validation_status"), F.col("r.confidence").alias("confidence"))
    stated = F.coalesce(text.blank_to_null(F.col("r.context_text")), text.blank_to_null(F.col("r.evidence_text")), text.blank_to_null(F.col("r.exact_text"))).isNotNull()
    either = lambda a, b: F.coalesce(text.blank_to_null(F.col(f"meta.{a}")), F.col(f"meta.{b}"))
    missing = F.struct(F.lit("").alias("context_text"), F.lit("").alias("exact_text"), F.col("meta.page").alias("page"), either("id", "segment_id").alias("id"), either("segment_id", "id").alias("segment_id"), F.col("meta.source").alias("source"), F.lit("not_found").alias("validation_status"), F.lit(0.0).alias("confidence")).cast(EVIDENCE)
    found = F.when(F.size("r.evidences") > 0, F.transform(F.filter("r.evidences", lambda e: e.isNotNull()), normal_evidence)).when(stated, F.array(normal_evidence(top)))
    df = df.withColumn("evidences", F.when(F.size(found) > 0, found).otherwise(F.array(missing))).withColumn("_e", F.get("evidences", 0))
    e, m = F.col("_e"), F.col("meta")
    meta = m.withField("page", F.coalesce(m["page"], e["page"])).withField("source", F.coalesce(m["source"], e["source"])).withField("id", F.coalesce(m["id"], e["id"])).withField("segment_id", F.coalesce(m["segment_id"], e["segment_id"], e["id"]))
    return df.withColumns({"context_text": F.coalesce(text.blank_to_null(e["context_text"]), e["exact_text"], F.lit("")), "exact_text": F.coalesce(e["exact_text"], F.lit("")), "meta": meta}).select(*groups.columns)


def summary(names: Column, shown: int) -> Column:
    """I16: the first names and how many more."""
    more = F.size(names) - shown
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))
