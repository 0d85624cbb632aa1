"""Verdicts on page addresses: host and path rules first, a weighted vocabulary for the rest.

The vocabulary is one Aho-Corasick automaton. A term counts if no ASCII letter or digit stands right before or
after it in the lower-cased address. The weights of the different terms found are added; ``LIMIT`` blocks the
address: one strict term, or two or three different soft ones. The vocabulary and the rules are tables of the caller's;
``TERMS`` is a short general list.

Nulls: a null address, or one without ``://``, has empty host and path; a null address is allowed. Any row is judged
alone, so repeats and ties need no rule. An empty vocabulary blocks nothing, an empty table gives an empty result,
an address of any length is one row. Columns other than page_id and the address are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host/path, verdict); the longest rule that fits wins. Fixed values.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: The weight that blocks an address; a term of that weight is strict.
LIMIT = 6
#: Terms by weight: strict ones, soft ones of which two block, soft ones of which three do.
TERMS: dict[str, int] = dict.fromkeys(
    ("porn", "porno", "xxx", "hentai", "escort", "escorts", "camgirls", "nsfw", "viagra", "cialis", "warez", "keygen", "phishing", "malware", "jackpot"), LIMIT
) | dict.fromkeys(
    ("adult", "sex", "sexy", "nude", "casino", "poker", "betting", "bet", "slots", "pills", "pharmacy", "spam", "crack", "cracked", "torrent", "torrents", "dating", "payday"), 3
) | dict.fromkeys(("cheap", "bonus", "free", "win", "winner", "loan", "loans", "deal", "deals", "farm", "hot", "download", "click", "prize"), 2)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule for the host or a parent of it and a prefix of the path; else null."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def vocabulary(terms: dict[str, int]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term in terms:
        automaton.add_word(term, term)
    automaton.make_automaton()
    return automaton


def _free(c: str) -> bool:
    return not (c.isascii() and c.isalnum())


def terms_in(automaton: ahocorasick.Automaton, url: str | None) -> set[str]:
    """Terms with free boundaries in the address."""
    text = (url or "").encode().lower().decode()
    hits: set[str] = set()
    for end, term in automaton.iter(text) if len(automaton) else ():
        start = end + 1 - len(term)
        if (start == 0 or _free(text[start - 1])) and (end + 1 == len(text) or _free(text[end + 1])):
            hits.add(term)
    return hits


def judge(pages: DataFrame, url: str = "url", terms: dict[str, int] = TERMS, limit: int = LIMIT, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_terms, soft_terms, weight): the rule's verdict, else the vocabulary's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = vocabulary(terms)
        for rows in batches:
            found = [sorted(terms_in(automaton, u)) for u in rows.column(1).to_pylist()]
            strict = pa.array([[t for t in f if terms[t] >= limit] for f in found], pa.list_(pa.string()))
            soft = pa.array([[t for t in f if terms[t] < limit] for f in found], pa.list_(pa.string()))
            weight = pa.array([sum(terms[t] for t in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), strict, soft, weight], names=["page_id", "url", "strict_terms", "soft_terms", "weight"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url).alias("url"))
    seen = rows.mapInArrow(count, "page_id long, url string, strict_terms array<string>, soft_terms array<string>, weight long")
    own = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    seen = seen.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    return seen.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "strict_terms", "soft_terms", "weight")
