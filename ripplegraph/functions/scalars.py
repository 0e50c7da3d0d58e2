"""Scalar functions as column expressions; ids in docstrings are those of the operator inventory."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segments(path: Column | str) -> Column:
    """The parts of a path or url between slashes."""
    return F.split(_col(path), "/")


def last_segments(path: Column | str, n: int = 1) -> Column:
    """The last n parts, joined again."""
    parts = segments(path)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), n), "/")


def basename(path: Column | str) -> Column:
    return F.element_at(segments(path), -1)


def ends_with_any(path: Column | str, endings: Iterable[str]) -> Column:
    """Whether a name has one of the endings."""
    out = F.lit(False)
    for e in endings:
        out = out | _col(path).endswith(e)
    return out


def strip_punctuation(name: Column | str) -> Column:
    """A variable's name without quotes, brackets and commas."""
    return F.translate(_col(name), "\"'[],{}", "")


def strip_query(url: Column | str) -> Column:
    """A url up to its question mark."""
    return F.split_part(_col(url), F.lit("?"), F.lit(1))


def slash_count(text: Column | str) -> Column:
    """X7."""
    return F.length(_col(text)) - F.length(F.translate(_col(text), "/", ""))


def as_array(value: Column | str) -> Column:
    """A scalar as an array of one; null as an empty one."""
    c = _col(value)
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def safe_name(path: Column | str) -> Column:
    """A path as a file name."""
    return F.translate(_col(path), "/", "_")


def run_id() -> Column:
    """X20."""
    return F.expr("uuid()")


def local_time(epoch: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since the epoch as text in the session's time zone."""
    return F.date_format(F.timestamp_seconds(_col(epoch)), pattern)


def url_match(call: Column | str, definition: Column | str) -> Column:
    """struct(primary, secondary) of a called and a defined url.

    Primary: the last two segments of the shorter url (of equal ones, the definition), the last one not empty, stand
    somewhere in the longer. Secondary: both end in the same segment, not empty.
    """
    call, definition = _col(call), _col(definition)
    call_is_shorter = F.length(call) < F.length(definition)
    shorter = F.when(call_is_shorter, call).otherwise(definition)
    longer = F.when(call_is_shorter, definition).otherwise(call)
    primary = (F.size(segments(shorter)) >= 2) & (basename(shorter) != "") & longer.contains(last_segments(shorter, 2))
    secondary = (basename(call) == basename(definition)) & (basename(call) != "")
    return F.struct(F.coalesce(primary, F.lit(False)).alias("primary"), F.coalesce(secondary, F.lit(False)).alias("secondary"))


def criticality(report: Column | str, label: str = "Criticality", digits: str = "[0-5]") -> Column:
    """The first digit on the rest of the line behind the first label; null if there is none."""
    c = _col(report)
    at = F.locate(label, c)
    rest = F.split_part(F.substring(c, at + len(label), F.length(c)), F.lit("\n"), F.lit(1))
    return F.when(at > 0, F.nullif(F.regexp_extract(rest, digits, 0), F.lit(""))).cast("int")


def sections(report: Column | str, phrase: str) -> Column:
    """Number -> paragraph of what follows a phrase (upper and lower case alike); null without the phrase."""
    c = _col(report)
    at = F.locate(phrase.lower(), F.lower(c))
    parts = F.split(F.trim(F.substring(c, at + len(phrase), F.length(c))), "\n\n")
    return F.when(at > 0, F.map_from_arrays(F.sequence(F.lit(1), F.size(parts)), parts))


def impact_prompt(context: Column, new_code: Column, old_code: Column, method: Column | None = None, downstream: Column | None = None) -> Column:
    """X11: what a scorer is asked about a change, and about a method that uses the changed one."""
    text = F.concat(F.lit("Method:\n"), context, F.lit("\n\nBefore the change:\n"), F.array_join(old_code, ""), F.lit("\nAfter the change:\n"), F.array_join(new_code, ""))
    if method is None or downstream is None:
        return text
    return F.concat(text, F.lit("\n\nA user of it, "), method, F.lit(":\n"), downstream)


def line_of_offset(text: Column | str, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(_col(text), F.lit(1), offset), "\n", -1))


def nth_line(text: Column | str, n: Column | int) -> Column:
    """The trimmed nth line, 'NA' beyond the end."""
    n = F.lit(n) if isinstance(n, int) else n
    lines = F.split(_col(text), "\n", -1)
    return F.coalesce(F.trim(F.try_element_at(lines, n)), F.lit("NA"))


def argument_count(call: Column | str) -> Column:
    """How many arguments stand between the first pair of parentheses."""
    inside = F.trim(F.regexp_extract(_col(call), r"\(([^)]*)\)", 1))
    return F.when(inside == "", 0).otherwise(F.size(F.split(inside, ",")))


def token_estimate(text: Column | str, per_word: float = 1.4) -> Column:
    """Tokens that a text may take, by its words."""
    words = F.filter(F.split(_col(text), r"\s+"), lambda w: w != "")
    return F.size(words) * F.lit(per_word)


def json_list(reply: Column | str) -> Column:
    """The list that a reply contains from its first bracket on, its texts in quotes of either kind; null if it does
    not parse."""
    c = _col(reply)
    at = F.locate("[", c)
    return F.when(at > 0, F.from_json(F.substring(c, at, F.length(c)), "array<string>", {"allowSingleQuotes": "true"}))


@F.pandas_udf(T.IntegerType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Percent 2 * LCS / (len a + len b) of two texts, rounded; null if one is null."""

    def ratio(x, y):
        if x is None or y is None:
            return None
        if not x and not y:
            return 100
        # bit-parallel longest common subsequence: bit k of v is cleared where the length grows at y[k]
        where: dict[str, int] = {}
        for k, c in enumerate(y):
            where[c] = where.get(c, 0) | 1 << k
        full = (1 << len(y)) - 1
        v = full
        for c in x:
            u = v & where.get(c, 0)
            v = (v + u | v - u) & full
        return round(200 * (len(y) - v.bit_count()) / (len(x) + len(y)))

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="object").astype("Int32")
