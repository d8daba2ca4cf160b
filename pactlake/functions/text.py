"""Column functions for keys, tokens and sentences. Regexes are Java's; \\w and \\s are ASCII unless (?U) is set."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlake.functions import fixed

NONE = "cast(array() as array<string>)"


def no_strings() -> Column:
    return F.expr(NONE)


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def given(x: Column, f) -> Column:
    """f(x), with x computed once however often f reads it."""
    return F.get(F.transform(F.array(x), f), 0)


def strip(x: Column) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, ends stripped; null to ''. A plain space alone is left as it is."""
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def folded(x: Column) -> Column:
    """Lower case with sharp s as ss, the part of casefolding that matters here."""
    return F.lower(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("ẞ"), F.lit("ss")), F.lit("ß"), F.lit("ss")))


def keyword_key(x: Column) -> Column:
    """Folded, everything but a-z and 0-9 to one space."""
    return F.trim(F.regexp_replace(folded(x), "[^a-z0-9]+", " "))


def evidence_key(x: Column) -> Column:
    """H9: stripped and folded; punctuation stays."""
    return folded(strip(x))


def plain_text(x: Column) -> Column:
    """Stripped, folded, white space collapsed; punctuation stays."""
    return squeeze(folded(x))


def tokens(x: Column) -> Column:
    """Distinct a-z0-9 runs of the folded text."""
    return F.array_distinct(F.regexp_extract_all(folded(x), F.lit("[a-z0-9]+"), F.lit(0)))


def token_count(x: Column) -> Column:
    """Runs of non-space."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"(?U)\S+"))


def split_words(x: Column) -> Column:
    """Python's str.split()."""
    return F.filter(F.split(squeeze(x), " "), lambda w: w != "")


def canonical_token(t: Column) -> Column:
    """Equivalents, then a plural ending."""
    for word, other in fixed.TOKEN_EQUIVALENTS.items():
        t = F.when(t == word, other).otherwise(t)
    return (
        F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3), F.substring(t, F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )


def canonical_tokens(key: Column) -> Column:
    stems = F.transform(F.split(key, " "), canonical_token)
    return F.filter(stems, lambda t: (t != "") & ~t.isin(*fixed.LABEL_STOPWORDS))


def canonical_key(x: Column) -> Column:
    """Stems without stop words."""
    return F.array_join(canonical_tokens(keyword_key(x)), " ")


def aliases(values: Column) -> Column:
    """Keys and canonical keys of all values, distinct and sorted."""
    keys = F.transform(values, keyword_key)
    both = F.concat(keys, F.transform(keys, canonical_key))
    return F.array_sort(F.array_distinct(F.filter(both, lambda k: k != "")))


def keyword_tokens(labels: Column) -> Column:
    """Tokens of all labels longer than two characters that are no stop words."""
    every = F.flatten(F.transform(labels, tokens))
    return F.array_distinct(F.filter(every, lambda t: (F.length(t) > 2) & ~t.isin(*fixed.KEYWORD_STOPWORDS)))


def ratio(a: Column, b: Column) -> Column:
    """A / b, 0 if b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets."""
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(ratio(2.0 * shared, n + m))


def sentences(x: Column) -> Column:
    """Parts after . ! ? and white space, but not after a.m., p.m., Corp., Ltd. and Pte. before Ltd."""
    guarded = r"(?U)(?<=[.!?])(?<!\b?a\.m\.)(?<!p\.m\.)(?<!A\.M\.)(?<!P\.M\.)(?<!Corp\.)(?<!Ltd\.)(?<!Pte\.(?=\sLtd\.))\s+".replace(r"\b?", "")
    parts = F.filter(F.transform(F.split(strip(F.coalesce(x, F.lit(""))), guarded), strip), lambda s: s != "")
    return parts


def distinct_by_key(values: Column) -> Column:
    """A1f / U4: stripped non-blank values, first spelling of each key, order kept."""
    clean = F.filter(F.transform(values, lambda v: strip(F.coalesce(v, F.lit("")))), lambda v: v != "")
    start = F.struct(no_strings().alias("seen"), no_strings().alias("out"))

    def step(acc: Column, v: Column) -> Column:
        key = keyword_key(v)
        new = ~F.array_contains(acc["seen"], key)
        return F.struct(
            F.when(new, F.array_append(acc["seen"], key)).otherwise(acc["seen"]).alias("seen"),
            F.when(new, F.array_append(acc["out"], v)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(clean, start, step, lambda acc: acc["out"])


def quoted(x: Column) -> Column:
    """A literal for a regex that is built from data."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def has_label(labels: Column, text: Column) -> Column:
    """Any label as a whole word, whatever the case."""
    return F.exists(labels, lambda x: F.regexp_like(text, F.concat(F.lit(r"(?iu)\b"), quoted(x), F.lit(r"\b"))))


def needle(pattern: str) -> str:
    """The longest lower-case letters with which every match of the pattern begins a word, whatever their case. No alternatives outside groups."""
    plain = pattern
    while "(" in plain:
        plain = re.sub(r"\([^()]*\)[?*]?", " ", plain)
    runs = re.findall(r"(?:\\b|\\s\+|\])([a-z]+)([?*{]?)", plain)
    return max((run[:-1] if sign else run for run, sign in runs), key=len, default="")


def any_match(text: Column, patterns, flags: str = "(?is)") -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(flags + p)
    return found


def is_upper(x: Column) -> Column:
    """Python's str.isupper(): a cased letter and no lower-case one."""
    return (F.upper(x) == x) & (F.lower(x) != x)


def starts_upper(word: Column) -> Column:
    return is_upper(F.substring(word, 1, 1))
