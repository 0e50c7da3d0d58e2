"""URL filter: rules by host and path, then a weighted vocabulary found by an Aho-Corasick automaton.

A strict term rejects alone; soft terms reject when enough different ones are present. A term counts only where it
stands by itself: the characters on both sides of it in the lower-cased url are no letters or digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices

#: Terms that reject a url alone, and terms that reject it by their number.
STRICT_TERMS = "porn xxx hentai xvideos escort casino blackjack roulette warez keygen malware phishing".split()
SOFT_TERMS = "sex adult nude cam dating bet betting poker slots gambling loan pills viagra torrent crack free cheap bonus win hot".split()


@dataclass(frozen=True)
class UrlRules:
    """(action, host, path) rules, of which the longest that fits decides, and the vocabulary for the other urls."""

    rules: tuple[tuple[str, str, str], ...] = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
    strict: tuple[str, ...] = field(default_factory=lambda: tuple(STRICT_TERMS))
    soft: tuple[str, ...] = field(default_factory=lambda: tuple(SOFT_TERMS))
    least_soft: int = 2


def split_url(url: str) -> tuple[str, str]:
    """Host, with A-Z in lower case, and path; both empty without `://`."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return _lower(host), rest[:cut]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    return text.translate(_LOWER)


class UrlJudge:
    def __init__(self, rules: UrlRules):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, host, path in sorted(rules.rules, key=lambda r: (-len(r[1] + r[2]), r)):
            self.by_host.setdefault(host, []).append((path, host + path, action))
        self.least_soft = rules.least_soft
        self.terms = ahocorasick.Automaton()
        for weight, terms in ((1, rules.soft), (2, rules.strict)):
            for term in terms:
                self.terms.add_word(_lower(term), (_lower(term), weight))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule whose host is this one or a parent of it and whose path begins this one, and its action."""
        found, at = [], host
        while host:
            found += [(len(rule), rule, action) for start, rule, action in self.by_host.get(at, ()) if path.startswith(start)]
            _, dot, at = at.partition(".")
            if not dot:
                break
        return max(found)[1:] if found else None

    def hits(self, url: str) -> tuple[int, int]:
        """Different strict and soft terms that stand by themselves in the url."""
        text, found = _lower(url), {1: set(), 2: set()}
        if len(self.terms):
            for end, (term, weight) in self.terms.iter(text):
                start = end - len(term) + 1
                if not (start and text[start - 1].isalnum()) and not text[end + 1 : end + 2].isalnum():
                    found[weight].add(term)
        return len(found[2]), len(found[1])

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        url = url or ""
        host, path = split_url(url)
        rule, (strict, soft) = self.rule(host, path), self.hits(url)
        verdict = rule[1] if rule else "block" if strict or soft >= self.least_soft else "allow"
        return host, path, rule[0] if rule else None, verdict, strict, soft


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: UrlRules = UrlRules()) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_strict and n_soft (different terms found).

    A null url, or one without `://`, has an empty host and path and fits no rule; its terms still count. Repeated rows
    are judged alike; an empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(rules).judge
        for batch in slices(batches):
            done = zip(*map(judge, batch.column(1).to_pylist()), strict=True)
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(done, kinds, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    id_type = pages.select(F.col(id_col)).schema[0].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col)).mapInArrow(kernel, f"page_id {id_type}, host string, path string, rule string, verdict string, n_strict bigint, n_soft bigint")


def oracle_sql(rules: UrlRules = UrlRules()) -> str:
    """The same rows from the pages table, in DuckDB's SQL."""
    quote = "'{}'".format
    ascii_lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    values = ", ".join(f"({quote(h)}, {quote(p)}, {quote(a)})" for a, h, p in rules.rules)
    count = lambda terms: " + ".join(f"CAST(regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') AS BIGINT)" for t in terms) or "0"
    return f"""
    WITH base AS (
      SELECT row_number() OVER () AS k, page_id, coalesce(url, '') AS u, {ascii_lower("coalesce(url, '')")} AS low,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT *, {ascii_lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM base),
    fits AS (
      SELECT k, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.a, length(r.h || r.p)) AS action
      FROM parts JOIN (VALUES {values}) r(h, p, a) ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY k),
    counted AS (SELECT *, {count(rules.strict)} AS n_strict, {count(rules.soft)} AS n_soft FROM parts LEFT JOIN fits USING (k))
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN n_strict > 0 OR n_soft >= {rules.least_soft} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
    FROM counted"""


