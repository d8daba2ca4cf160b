"""Segmentation of normalised pages into titled clauses (S1 to S14): one row a document, its lines and blocks in arrays.

Arrays are exploded with the outer generators: for the others Spark infers a filter on the array's size and pushes it below
the projections that make the array, where all of them are written into one another and evaluated for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions import fixed, text

MAX_TOKENS, MIN_TOKENS = 500, 40


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, lines array<struct<page, pos, source, text>>): the stripped non-blank lines of every document, in order."""
    split = F.split(F.coalesce("text", F.lit("")), "\r\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    rows = pages.select("doc_id", "page", "source", split.alias("ls"))
    own = F.transform("ls", lambda line, i: F.struct(F.col("page").alias("page"), i.alias("pos"), F.col("source").alias("source"), text.strip(line).alias("text")))
    packed = rows.select("doc_id", "page", F.filter(own, lambda x: x["text"] != "").alias("ls")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "ls"))).alias("ps"))
    single = F.size(F.array_distinct(F.col("ps.page"))) == F.size("ps")  # pages of one number are read line by line
    lines = packed.select("doc_id", single.alias("single"), F.flatten("ps.ls").alias("lines"))
    return lines.select("doc_id", F.when(F.col("single"), F.col("lines")).otherwise(F.sort_array("lines")).alias("lines"))


def numbered_title(line: Column) -> Column:
    """S3: the number and the shortest part of the body that ends in . or : (up to 140 characters, no initials); else the line."""

    def cut(body: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.least(F.greatest(F.length(body), F.lit(1)), F.lit(140))), lambda i: F.substring(body, i, F.lit(1)).isin(".", ":") & ((i == F.length(body)) | F.substring(body, i + 1, F.lit(1)).rlike(r"(?U)^\s")))
        parts = F.filter(F.transform(ends, lambda i: F.substring(body, F.lit(1), i)), lambda p: ~p.rlike(r"(?U)^(?:[A-Z]\.\s*)+$"))
        title = text.given(parts, lambda ps: F.when(F.size(ps) > 0, F.concat(F.regexp_extract(line, fixed.NUMBERED, 1), F.lit(" "), F.get(ps, 0))).otherwise(line))
        return F.when(body.rlike(r"(?U)[.:](?:\s|\z)"), title).otherwise(line)

    return text.given(F.regexp_extract(line, fixed.NUMBERED, 2), cut)


#: Codes of heading_code.
SIGNATURE, STRUCTURE, NUMBERED, BULLET = 1, 2, 3, 4


def heading_code(line: Column) -> Column:
    """The pattern that makes a line a heading, or null. The first character rules most lines out: letters outside ASCII can match one of it."""
    first = F.substring(line, 1, 1)
    beyond = first > "~"
    begins = lambda letters: beyond | first.isin(*letters)
    return (
        F.when(begins("IiSsAa") & line.rlike(fixed.SIGNATURE), SIGNATURE)
        .when(begins("AaSsEe") & line.rlike(fixed.STRUCTURE), STRUCTURE)
        .when(begins("0123456789") & line.rlike(fixed.NUMBERED), NUMBERED)
        .when(((first == "(") | first.between("a", "z")) & line.rlike(fixed.BULLET), BULLET)
    )


def heading_kind(line: Column, code: Column) -> Column:
    word = F.lower(F.regexp_extract(line, r"(?U)^\S+", 0))
    structure = F.when(word.isin("schedule", "exhibit", "appendix", "annex"), word).otherwise("section")
    return F.when(code == SIGNATURE, "signature").when(code == STRUCTURE, structure).when(code == NUMBERED, "section").when(code == BULLET, "bullet")


def heading_title(line: Column, code: Column) -> Column:
    return F.when(code <= STRUCTURE, line).when(code == NUMBERED, numbered_title(line)).when(code == BULLET, F.regexp_extract(line, fixed.BULLET, 1))


def heading_level(line: Column, code: Column) -> Column:
    """S4"""
    depth = F.size(F.split(F.regexp_replace(F.regexp_extract(line, fixed.NUMBERED, 1), r"\.+$", ""), r"\."))
    return F.when(code <= STRUCTURE, 1).when(code == NUMBERED, depth).when(code == BULLET, 99)


def detect_headings(lines: DataFrame) -> DataFrame:
    """h_kind, h_title, h_level of every line, null where it is no heading."""
    t, code = F.col("text"), F.col("_code")
    return lines.withColumn("_code", heading_code(t)).withColumns({"h_kind": heading_kind(t, code), "h_title": heading_title(t, code), "h_level": heading_level(t, code)}).drop("_code")


def looks_like_title(x: Column) -> Column:
    """S9"""
    words = text.split_words(F.regexp_replace(x, r"\.+$", ""))
    capital = text.given(words, lambda w: (F.size(w) > 0) & (F.size(w) <= 8) & (text.is_upper(x) | (F.size(F.filter(w, text.starts_upper)) >= F.size(w) - 1)))
    return ~text.strip(x).rlike("[.;,]$") & capital


def build_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, blocks), from (doc_id, lines array<struct<page, source, text, ...>>); dropped headings are marked.

    A block is a slice of the document's array of lines from a heading to the next, so nothing is sorted or shuffled.
    Columns that are read twice below stay columns of their own: each array is made once.
    """
    marked = docs.select("doc_id", "lines", F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), x["text"].alias("text"), heading_code(x["text"]).alias("code"))).alias("marks"))
    heads = marked.select("doc_id", "lines", F.size("lines").alias("n"), F.filter("marks", lambda m: m["code"].isNotNull() | (m["at"] == 1)).alias("heads"))
    last = lambda i: F.coalesce(F.get("heads", i + 1)["at"], F.col("n") + 1)

    def spanned(h: Column, i: Column) -> Column:
        own, size = h["text"], last(i) - h["at"]
        fields = {"at": h["at"], "n": size, "text": own, "second": F.when(size > 1, F.get("lines", h["at"])["text"]), "kind": heading_kind(own, h["code"]), "title": heading_title(own, h["code"]), "level": heading_level(own, h["code"])}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    spans = heads.select("doc_id", "lines", F.get("heads", 0)["code"].isNull().alias("opens"), (F.size("heads") > 1).alias("many"), F.transform("heads", spanned).alias("spans"))

    def judged(b: Column) -> Column:
        chapter = (b["kind"] == "section") & (b["level"] == 1)
        asked = b["second"].isNotNull() & (chapter | (b["n"] == 2))
        return F.struct(b.alias("b"), chapter.alias("chapter"), F.when(asked, looks_like_title(b["second"])).otherwise(False).alias("titled"))

    known = spans.select("doc_id", "lines", "opens", "many", F.transform("spans", judged).alias("known"))
    opens = F.col("opens")

    def block(x: Column, i: Column) -> Column:
        b, whole = x["b"], F.slice("lines", x["b"]["at"], x["b"]["n"])
        first = F.get("lines", b["at"] - 1)
        joined = F.when(b["n"] == 1, first["text"]).otherwise(F.array_join(F.transform(whole, lambda y: y["text"]), "\n"))
        kind = F.coalesce(b["kind"], F.when(F.col("many"), "opening").otherwise("document"))
        title = F.when(x["chapter"] & x["titled"], F.concat_ws(" ", b["title"], b["second"])).otherwise(b["title"])
        empty = (b["n"] <= 2) & (b["text"] == b["title"]) & ((b["kind"] != "section") | (b["level"] == 1)) & (b["second"].isNull() | x["titled"])
        fields = {"block_no": F.when(opens, i).otherwise(i + 1), "text": joined, "n_lines": b["n"], "page": first["page"], "source": first["source"], "kind": kind, "title": title, "level": F.coalesce(b["level"], F.lit(1)), "dropped": F.coalesce(empty, F.lit(False))}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return known.select("doc_id", F.transform("known", block).alias("blocks"))


def parent_of(open_: Column, level: Column) -> Column:
    """Of a section below the first level, the open section a level above, else the chapter's."""
    at = lambda n: F.get(F.filter(open_, lambda s: s["level"] == n), 0)["title"]
    return F.when(level > 1, F.coalesce(text.blank_to_null(at(level - 1)), at(F.lit(1))))


def with_parents(docs: DataFrame) -> DataFrame:
    """S7 on arrays: (doc_id, blocks) with parent_section_title in every block; dropped headings count as parents.

    The fold of parent_titles runs over the sections alone; what follows a section up to the next has it as parent, if a bullet.
    """
    marked = docs.select("doc_id", "blocks", F.transform("blocks", lambda b, i: F.struct(i.alias("at"), b["kind"].alias("kind"), b["level"].alias("level"), b["title"].alias("title"))).alias("marks"))
    found = marked.select("doc_id", "blocks", F.filter("marks", lambda m: m["kind"] == "section").alias("sections"))
    start = F.struct(F.expr("cast(array() as array<struct<level:int,title:string>>)").alias("open"), text.no_strings().alias("parents"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.filter(acc["open"], lambda x: x["level"] < s["level"])
        return F.struct(F.array_append(kept, F.struct(s["level"].alias("level"), s["title"].alias("title"))).alias("open"), F.array_append(acc["parents"], parent_of(acc["open"], s["level"])).alias("parents"))

    folded = found.select("doc_id", "blocks", "sections", F.aggregate("sections", start, step, lambda acc: acc["parents"]).alias("parents"), F.coalesce(F.get("sections", 0)["at"], F.size("blocks")).alias("first"), F.size("blocks").alias("n"))
    put = lambda b, parent: F.struct(*[b[c].alias(c) for c in ("block_no", "text", "n_lines", "page", "source", "kind", "title", "level", "dropped")], parent.cast("string").alias("parent_section_title"))
    none = F.lit(None).cast("string")

    def section(s: Column, i: Column) -> Column:
        size = F.coalesce(F.get("sections", i + 1)["at"], F.col("n")) - s["at"]
        return F.transform(F.slice("blocks", s["at"] + 1, size), lambda b, j: put(b, F.when(j == 0, F.get("parents", i)).when(b["kind"] == "bullet", s["title"])))

    head = F.transform(F.slice("blocks", F.lit(1), F.col("first")), lambda b: put(b, none))
    return folded.select("doc_id", F.concat(head, F.flatten(F.transform("sections", section))).alias("blocks"))


def parent_titles(blocks: DataFrame) -> DataFrame:
    """parent_section_title, at any depth; dropped headings count as parents.

    A fold over the blocks of a chapter (a section of level 1 and what follows it; nothing from before outlives it),
    whose state is the stack of open sections by level: a section closes those of its own level and below. A bullet's
    parent is the innermost open section, a section's the one a level above, else the chapter's.
    """
    columns, section = blocks.columns, (F.col("kind") == "section")
    before = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    chapters = blocks.withColumn("_chapter", F.count(F.when(section & (F.col("level") == 1), 1)).over(before))
    packed = chapters.groupBy("doc_id", "_chapter").agg(F.array_sort(F.collect_list(F.struct("block_no", *[c for c in columns if c not in ("doc_id", "block_no")]))).alias("_blocks"))
    start = F.struct(F.expr("cast(array() as array<struct<level:int,title:string>>)").alias("open"), text.no_strings().alias("parents"))

    def step(acc: Column, b: Column) -> Column:
        open_, is_section = acc["open"], b["kind"] == "section"
        above = F.when(is_section, parent_of(open_, b["level"]))
        parent = F.when(b["kind"] == "bullet", F.get(open_, F.size(open_) - 1)["title"]).otherwise(above)
        kept = F.filter(open_, lambda s: s["level"] < b["level"])
        own = F.struct(b["level"].cast("int").alias("level"), b["title"].alias("title"))
        return F.struct(F.when(is_section, F.array_append(kept, own)).otherwise(open_).alias("open"), F.array_append(acc["parents"], parent).alias("parents"))

    found = packed.withColumn("_parents", F.aggregate("_blocks", start, step, lambda acc: acc["parents"]))
    return found.select("doc_id", F.inline(F.zip_with("_blocks", "_parents", lambda b, p: F.struct(b.alias("b"), p.alias("parent_section_title"))))).select(*[c if c == "doc_id" else f"b.{c}" for c in columns], "parent_section_title")


def pieces_that_fit(x: Column, most: int) -> Column:
    """Paragraphs; those over the limit as sentences, cut into windows of tokens."""
    paragraphs = F.filter(F.transform(F.split(x, r"\n\s*\n|\n"), text.strip), lambda p: p != "")

    def windows(sentence: Column) -> Column:
        runs = F.regexp_extract_all(sentence, F.lit(r"(?Us)\S+(?:\s+\S+){0," + str(most - 1) + "}"), F.lit(0))
        return F.transform(runs, text.strip)

    def sentences(p: Column) -> Column:
        return F.filter(F.transform(F.split(p, r"""(?U)(?<=[.!?;])\s+(?=[A-Z0-9("])"""), text.strip), lambda s: s != "")

    return F.flatten(F.transform(paragraphs, lambda p: F.when(text.token_count(p) <= most, F.array(p)).otherwise(F.flatten(F.transform(sentences(p), windows)))))


def pack(pieces: Column, most: int) -> Column:
    """Greedy packing of pieces into chunks; the state keeps the open chunk's token count."""
    start = F.struct(text.no_strings().alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, piece: Column) -> Column:
        n = text.token_count(piece)
        full = (acc["open"] != "") & (acc["n"] + n > most)
        first = acc["open"] == ""
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full | first, piece).otherwise(F.concat(acc["open"], F.lit("\n"), piece)).alias("open"),
            F.when(full | first, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def merge_short(chunks: Column, most: int, least: int) -> Column:
    """A chunk under the minimum joins the one before it if both fit."""
    if least <= 0:
        return chunks
    start = F.struct(text.no_strings().alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, chunk: Column) -> Column:
        n = text.token_count(chunk)
        first = acc["open"] == ""
        joins = ~first & (n < least) & (acc["n"] + n <= most)
        return F.struct(
            F.when(first | joins, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
            F.when(joins, F.concat(acc["open"], F.lit("\n"), chunk)).otherwise(chunk).alias("open"),
            F.when(joins, acc["n"] + n).otherwise(n).alias("n"),
        )

    return F.aggregate(chunks, start, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def split_by_tokens(x: Column, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> Column:
    """A text that fits is one chunk. One of under 2 * most characters can't hold more tokens than that."""
    if most <= 0:
        raise ValueError("max_tokens must be greater than 0")

    def chunks(y: Column) -> Column:
        fits = (F.length(y) < 2 * most) | (text.token_count(y) <= most)
        return F.when(fits, F.array(y)).otherwise(merge_short(pack(pieces_that_fit(y, most), most), most, least))

    return text.given(text.strip(x), chunks)


def segments_of(docs: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> DataFrame:
    """Numbered segments of the blocks that are kept, from with_parents."""
    fields = ("block_no", "title", "source", "parent_section_title", "page")
    cut = docs.select("doc_id", F.transform(F.filter("blocks", lambda b: ~b["dropped"]), lambda b: F.struct(*[b[c].alias(c) for c in fields], split_by_tokens(b["text"], most, least).alias("chunks"))).alias("kept"))
    rows = F.flatten(F.transform("kept", lambda b: F.transform(b["chunks"], lambda x, i: F.struct(*[b[c].alias(c) for c in fields], F.size(b["chunks"]).alias("_total"), i.alias("_i"), x.alias("text")))))
    rows = cut.select("doc_id", F.posexplode_outer(rows).alias("_n", "s")).filter("_n is not null").select("doc_id", (F.col("_n") + 1).alias("seg_no"), "s.*")
    family = Window.partitionBy("doc_id", "source", "parent_section_title")
    orphan = F.col("parent_section_title").isNull() | (F.col("parent_section_title") == "")
    index = F.when(orphan, F.col("_i") + 1).otherwise(F.row_number().over(family.orderBy("seg_no")))
    total = F.when(orphan, F.col("_total")).otherwise(F.count("*").over(family).cast("int"))
    return rows.select(
        "doc_id", "seg_no", F.format_string("seg_%03d", "seg_no").alias("segment_id"), "text", "title", "page", "source", "parent_section_title",
        text.token_count(F.col("text")).alias("token_count"), index.alias("chunk_index"), total.alias("chunk_total"), (index < total).alias("is_continuation"),
    )


def segment_pages(pages: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> DataFrame:
    """H4: the whole chain."""
    return segments_of(with_parents(build_blocks(page_lines(pages))), most, least)
