"""URL filter: host rules first, then a weighted vocabulary counted by one automaton."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import ascii_lower, c, whole_text


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, on paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: One of these is enough to reject.
STRICT = ("adult-x", "cheap-pills", "free-bets", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
#: Harmless alone; several different ones reject.
SOFT = (
    "adult", "bet", "bets", "bonus", "casino", "cheap", "escort", "farm", "free", "jackpot", "keygen", "loan",
    "nude", "pharmacy", "pills", "poker", "replica", "sex", "spam", "torrent",
)
#: Distinct soft terms that reject.
SOFT_HITS = 2
#: Terms of a vocabulary read from a table, at most.
MOST_TERMS = 1_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    own = (host == rule.host) | host.endswith("." + rule.host)
    return own & path.startswith(rule.path)


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """The automaton of a vocabulary, which a worker builds once; None without terms."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, terms in ((0, soft), (1, strict)):
        for term in terms:
            automaton.add_word(term, (kind, term))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _counter(strict: tuple[str, ...], soft: tuple[str, ...]):
    """A function from lowered URLs to their numbers of distinct strict and soft terms.

    The automaton reports every occurrence in one pass over the URL, overlapping ones too; an
    occurrence counts only if no letter or digit of ASCII touches either end.
    """

    def count(urls: pa.Array) -> pa.Array:
        automaton = _automaton(strict, soft)
        found: tuple[list[int], list[int]] = ([], [])
        for url in urls.to_pylist():
            hits: tuple[set[str], set[str]] = (set(), set())
            for end, (kind, term) in automaton.iter(url) if automaton else ():
                start = end + 1 - len(term)
                if url[start - 1 : start] not in _INSIDE and url[end + 1 : end + 2] not in _INSIDE:
                    hits[kind].add(term)
            for kind in (0, 1):
                found[kind].append(len(hits[kind]))
        counts = [pa.array(x, pa.int32()) for x in (found[1], found[0])]
        return pa.StructArray.from_arrays(counts, ["n_strict", "n_soft"])

    return F.arrow_udf(count, "n_strict int, n_soft int")


def vocabulary(terms: DataFrame, term: str = "term", weight: str = "weight") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """``(strict, soft)`` terms of a table, for ``judge_urls``.

    A weight of 1 or more makes a term strict, a lesser one over 0 soft; a term with several weights
    has the greatest.  Terms are stripped of spaces and A-Z is lowered.  Null and empty terms, and those
    whose weight is null, NaN or not over 0, take no part.  Every worker holds the whole vocabulary, so one
    of over ``MOST_TERMS`` terms is refused.
    """
    word, heavy = ascii_lower(F.trim(c(term).cast("string"))), c(weight).cast("double")
    sound = heavy.isNotNull() & ~F.isnan(heavy) & (heavy > 0)
    own = terms.filter(sound).select(word.alias("term"), heavy.alias("weight")).filter("term <> ''")
    found = own.groupBy("term").agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"the vocabulary has more than {MOST_TERMS} terms")
    strict = tuple(sorted(r.term for r in found if r.weight >= 1))
    return strict, tuple(sorted(r.term for r in found if r.weight < 1))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_hits: int = SOFT_HITS,
    url: str = "url",
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``n_strict`` and ``n_soft``.

    The rule with the longest name among those that fit decides (the longer host if two are as
    long); where none fits, the verdict is ``block`` for one strict term or ``soft_hits`` different
    soft ones anywhere in the URL, and ``allow`` otherwise.

    Only the URL is read by the terms' pass, one row at a time: no shuffle, and memory as large as
    one batch.  A null URL, an empty one and one without ``://`` have an empty host and path; the
    first two hold no term.  Columns of ``pages`` with the names of the new ones are replaced;
    repeated rows are judged alike, and an empty table gives an empty one.
    """
    if any(t != t.lower() or not t for t in (*strict, *soft)):
        raise ValueError("terms must be lower case and not empty")
    text = whole_text(url)
    host, path = host_of(text), path_of(text)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one to be wrapped around is looked at first.
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = _fits(r, host, path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    terms = _counter(tuple(strict), tuple(soft))(ascii_lower(text))
    by_terms = F.when((F.col("_t.n_strict") > 0) | (F.col("_t.n_soft") >= soft_hits), "block").otherwise("allow")
    new = ("host", "path", "rule", "verdict", "n_strict", "n_soft")
    kept = [n for n in pages.columns if n.lower() not in new]
    judged = pages.select(
        F.struct(*[c(n) for n in kept]).alias("_page") if kept else F.lit(None).alias("_page"),
        terms.alias("_t"),
        host.alias("_h"),
        path.alias("_p"),
        rule.alias("_r"),
        verdict.alias("_v"),
    )
    return judged.select(
        *[F.col("_page")[n].alias(n) for n in kept],
        F.col("_h").alias("host"),
        F.col("_p").alias("path"),
        F.col("_r").alias("rule"),
        F.coalesce("_v", by_terms).alias("verdict"),
        F.col("_t.n_strict").alias("n_strict"),
        F.col("_t.n_soft").alias("n_soft"),
    )
