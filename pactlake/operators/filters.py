"""Precision filter of keyword groups (F1, F2): a group is dropped for the first of four reasons that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions import fixed, text


def drop_reason(g) -> Column:
    """signature, opening, anchor, overlap, or null if the group stays."""
    body = F.concat_ws(" ", F.coalesce(g["context_text"], F.lit("")), F.coalesce(g["exact_text"], F.lit("")))
    known = text.given(body, lambda b: F.struct(b.alias("body"), text.keyword_key(g["representative_keyword"]).alias("key"), context_kind(b).alias("kind")))
    return text.given(known, lambda k: first_reason(g, k["body"], k["key"], k["kind"]))


def first_reason(g, body: Column, key: Column, kind: Column) -> Column:
    business = F.coalesce(g["provision_type"].isin(*fixed.BUSINESS_TYPES), F.lit(False))
    allowed = F.coalesce(g["provision_type"].isin("signatures", "parties"), F.lit(False)) | key.isin("signatures", "parties")
    unanchored = F.lit(False)
    for name, patterns in fixed.RISKY_ANCHORS.items():
        unanchored = unanchored | ((key == name) & ~text.any_match(body, patterns))
    labels = F.filter(F.concat(F.array(g["representative_keyword"]), F.coalesce(g["related_keywords"], text.no_strings())), lambda x: F.coalesce(text.strip(x), F.lit("")) != "")
    deterministic = F.coalesce(g["meta"]["coverage_source"] == "deterministic", F.lit(False))
    bare = deterministic & business & (F.size(labels) > 0) & ~label_overlap(labels, body)
    return F.when((kind == "signature") & ~allowed, "signature").when(kind.isin("opening", "recitals") & business & (key != "parties"), "opening").when(unanchored, "anchor").when(bare, "overlap")


def context_kind(body: Column) -> Column:
    """by the first 600 characters; an opening has under 240 words."""


    def kind(start: Column) -> Column:
        opening = (start.contains("exhibit") | start.contains("by and between") | start.contains("made between") | start.contains("entered into")) & (F.size(text.split_words(body)) < 240)
        return (
            F.when(start.contains("signature") | start.startswith("accepted and agreed") | start.contains("print name"), "signature")
            .when(start.contains("recitals") | start.startswith("whereas"), "recitals")
            .when(opening, "opening")
            .otherwise("body")
        )

    return text.given(text.keyword_key(F.substring(body, 1, 600)), kind)


def label_overlap(labels: Column, body: Column) -> Column:
    """F1d: some label shares two of its long tokens (or its only one) with the text."""
    words = text.tokens(body)

    def fits(label: Column) -> Column:
        own = F.filter(text.tokens(label), lambda t: (F.length(t) > 3) & ~t.isin(*fixed.GENERIC_LABEL_TOKENS))
        return (F.size(own) > 0) & (F.size(F.array_intersect(own, words)) >= F.least(F.lit(2), F.size(own)))

    return F.exists(labels, fits)


def filter_groups(groups: DataFrame) -> DataFrame:
    """The groups that stay."""
    return groups.filter(drop_reason({c: F.col(c) for c in groups.columns}).isNull())
