"""URL filters: host rules first, else a weighted vocabulary matched by Aho-Corasick.

An automaton over all strict and soft terms reads each lower-cased url once. A match counts only at word
boundaries (no ASCII letter or digit on either side). One strict hit, or `soft_limit` distinct soft terms,
reject the url. The vocabulary is a parameter and travels with the task; no data are shuffled.

Null or empty urls, and urls without "://", have empty host and path, no rule, and whatever verdict their
text earns (allow for null). Repeated rows are judged alike; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import ascii_lower

STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "milf", "escorts", "onlyfans")
SOFT = ("adult", "sex", "nude", "casino", "poker", "betting", "gambling", "viagra", "cialis", "torrent", "warez", "payday", "dating", "slots")
#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def term_hits(strict: Sequence[str], soft: Sequence[str]):
    """Pandas UDF url -> (strict hits, distinct soft terms)."""
    terms = {t: 1 for t in soft} | {t: 0 for t in strict}

    @F.pandas_udf("n_strict long, n_soft long")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, kind in terms.items():
            automaton.add_word(term, (term, kind))
        automaton.make_automaton()
        inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in urls:
            found = []
            for url in batch:
                n_strict, seen = 0, set()
                for end, (term, kind) in automaton.iter(url) if url and terms else ():
                    start = end - len(term) + 1
                    if (start and url[start - 1] in inside) or (end + 1 < len(url) and url[end + 1] in inside):
                        continue
                    if kind:
                        seen.add(term)
                    else:
                        n_strict += 1
                found.append((n_strict, len(seen)))
            yield pd.DataFrame(found, columns=["n_strict", "n_soft"])

    return hits


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for every url. A rule fits its host and all subdomains if the path starts with the rule's; the longest wins."""
    host, path = host_and_path(F.col(url_col))
    df = pages.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), host.alias("host"), path.alias("path"))
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith(f".{rule_host}")) & F.col("path").startswith(prefix)
        rule = F.when(fits, rule_host + prefix).otherwise(rule)
        decided = F.when(fits, verdict).otherwise(decided)
    hits = term_hits(strict, soft)(ascii_lower(F.col("_url")))
    df = df.select(id_col, "host", "path", rule.alias("rule"), decided.alias("_rule_verdict"), hits.alias("_hits"))
    rejects = (F.col("_hits.n_strict") > 0) | (F.col("_hits.n_soft") >= soft_limit)
    return df.select(
        id_col, "host", "path", "rule",
        F.coalesce("_rule_verdict", F.when(rejects, "block").otherwise("allow")).alias("verdict"),
        F.col("_hits.n_strict").alias("n_strict"), F.col("_hits.n_soft").alias("n_soft"),
    )


def _bounded(term: str) -> str:
    return f"(^|[^a-z0-9]){term}($|[^a-z0-9])"


def oracle() -> str:
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # matches that share a boundary character: each boundary is doubled before the pattern runs
    spaced = f"regexp_replace({lower}, '([^a-z0-9])', '\\1\\1', 'g')"
    n_strict = " + ".join(f"len(regexp_extract_all(low, '{_bounded(t)}'))" for t in STRICT)
    n_soft = " + ".join(f"regexp_matches(low, '{_bounded(t)}')::INT" for t in SOFT)
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{pick(v, h, p)}'" for v, h, p in longest) + " END"
    return f"""
WITH a AS (SELECT page_id, {spaced} AS low, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, ({n_strict})::BIGINT AS n_strict, ({n_soft})::BIGINT AS n_soft FROM b)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
  coalesce({case(lambda v, h, p: v)}, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM c"""
