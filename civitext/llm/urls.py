"""URL filter: listed hosts and paths, and a weighted vocabulary for all other URLs.

An Aho-Corasick automaton finds all terms of the vocabulary in the lower-cased URL. A
hit counts if it is not inside a longer run of letters and digits. A URL is blocked by
one strict term, or by soft terms, each counted once, whose weights reach SOFT_LIMIT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civitext.llm.common import ascii_lower

# Fixed values: (host, path, verdict) of listed URLs.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# The vocabulary.
STRICT = ["adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "sex", "spam", "viagra", "xxx"]
SOFT = {
    "ads": 1, "bets": 1, "betting": 1, "bonus": 1, "cheap": 1, "click": 1, "crack": 1, "deals": 1, "farm": 1,
    "free": 1, "loan": 1, "lottery": 1, "pills": 1, "poker": 1, "promo": 1, "slots": 1, "torrent": 1, "track": 1,
    "warez": 1, "win": 1,
}
SOFT_LIMIT = 2


def _after_scheme(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-cased (A to Z) part after the first :// up to / ? # or the end; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*(/[^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    out = F.lit(None)
    for name, prefix, verdict in sorted(rules or RULES, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def term_hits(strict: list[str], soft: dict[str, int]) -> Callable[[Column], Column]:
    """Column function: (strict, soft), distinct strict terms and the weight of distinct soft ones."""

    @F.pandas_udf("strict int, soft int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for urls in batches:
            rows = []
            for url in urls:
                low, found = (url or "").lower(), set()
                for end, term in automaton.iter(low):
                    start = end - len(term) + 1
                    before, after = low[start - 1 : start], low[end + 1 : end + 2]
                    if not (before.isalnum() or after.isalnum()):
                        found.add(term)
                rows.append((sum(t in found for t in strict), sum(w for t, w in soft.items() if t in found)))
            yield pd.DataFrame(rows, columns=["strict", "soft"])

    return run


def judge_urls(
    pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] | None = None,
    strict: list[str] | None = None, soft: dict[str, int] | None = None, soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """(key, host, path, rule, verdict, strict_terms, soft_weight) for every row of `pages`.

    A URL that a rule fits has the rule's verdict, any other the vocabulary's. A null
    URL and one without :// have an empty host and path; a null one holds no terms.
    Repeated rows are judged alike.
    """
    read = pages.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias("_url"))
    hits = term_hits(STRICT if strict is None else strict, SOFT if soft is None else soft)
    read = read.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    read = read.withColumn("listed", longest_rule(F.col("host"), F.col("path"), rules))
    read = read.withColumn("hits", hits(F.col("_url")))
    bad = (F.col("hits.strict") > 0) | (F.col("hits.soft") >= soft_limit)
    own = F.when(bad, "block").otherwise("allow")
    return read.select(
        key, "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", own).alias("verdict"),
        F.col("hits.strict").alias("strict_terms"), F.col("hits.soft").alias("soft_weight"),
    )
