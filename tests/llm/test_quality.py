"""The quality verdict against a plain version of references and distances."""

import math
import re
from collections import Counter

import duckdb
import pytest

pytest.importorskip("ripplegraph.llm")

from ripplegraph.llm import quality  # noqa: E402

SMALL = "/root/testdata/sf0.001"
RULES = quality.Rules(min_reference_words=2000)


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(words), len(inside)


def plain_histograms(text):
    kinds, common = Counter(), Counter()
    for c in text or "":
        if c in "#*$%&|<>":
            kinds[7] += 1
        elif ord(c) >= 128:
            kinds[6] += 1
        elif c.islower():
            kinds[0] += 1
        elif c.isupper():
            kinds[1] += 1
        elif c.isdigit():
            kinds[2] += 1
        elif c in " \t\n\v\f\r":
            kinds[3] += 1
        elif c in ".,;:'\"!?()-":
            kinds[4] += 1
        else:
            kinds[5] += 1
    cut = re.sub(r"[!-/:-@\[-`{-~\x00-\x1f]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    for w in re.findall(r"[^ ]+", cut):
        common[w if w in quality.WORDS else None] += 1
    return kinds, common


def plain_distance(counts, reference):
    total, out = max(sum(counts.values()), 1), 0.0
    for key in set(counts) | set(reference):
        p, q = counts.get(key, 0) / total, reference.get(key, 0.0)
        m = (p + q) / 2
        out += sum(x * math.log2(x / m) / 2 for x in (p, q) if x > 0)
    return math.sqrt(max(out, 0))


def plain_verdicts(rows):
    sums = {}
    for _, text, lang in rows:
        n, repeated = plain_base(text)
        if lang is None or n < RULES.min_words or 100 * repeated > RULES.max_repeat_percent * n:
            continue
        kinds, common = plain_histograms(text)
        if 50 * kinds[7] > sum(kinds.values()) or kinds[1] > kinds[0] + kinds[6]:
            continue
        a, b = sums.setdefault(lang, (Counter(), Counter()))
        a.update(kinds)
        b.update(common)
    sums = {k: v for k, v in sums.items() if sum(v[1].values()) >= RULES.min_reference_words}
    known = [tuple({k: x / sum(c.values()) for k, x in c.items()} for c in v) for v in sums.values()]
    out = {}
    for doc, text, lang in rows:
        n, repeated = plain_base(text)
        failed, near = n < RULES.min_words or 100 * repeated > RULES.max_repeat_percent * n, (None, None)
        kept = not failed
        if not failed and lang in sums:
            kinds, common = plain_histograms(text)
            limits = RULES.max_char_distance + RULES.char_leeway / max(sum(kinds.values()), 1), RULES.max_word_distance
            guards = sum(kinds.values()) >= RULES.guard_chars, sum(common.values()) >= RULES.guard_words
            pairs = [tuple(plain_distance(c, r) if g else None for c, r, g in zip((kinds, common), ref, guards, strict=True)) for ref in known]
            near = min(pairs, key=lambda d: sum(x / limit for x, limit in zip(d, limits, strict=True) if x is not None))
            kept = all(x is None or x <= limit for x, limit in zip(near, limits, strict=True))
        out[doc] = failed, kept, *near
    return out


def test_verdicts_are_those_of_the_plain_version(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    want, got = plain_verdicts(rows), quality.judge_quality(df, rules=RULES).collect()
    assert len(got) == len(rows) and any(not r.kept and not r.base_failed for r in got)
    for r in got:
        failed, kept, chars, words = want[r.doc_id]
        assert (r.base_failed, r.kept) == (failed, kept), r.doc_id
        for x, y in ((r.char_distance, chars), (r.word_distance, words)):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), r.doc_id


def test_languages_without_a_reference_and_wrong_tags(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    english = "The weather in the valley was mild for most of the year, and the people who lived there were used to long walks by the river. "
    italian = "Il tempo nella valle era mite per gran parte dell'anno e la gente che viveva lì amava le lunghe passeggiate lungo il fiume. "
    dutch = "Het weer in het dal was het grootste deel van het jaar zacht en de mensen die er woonden hielden van lange wandelingen. "
    chinese = "山谷 里 的 天气 一年 中 大部分 时间 都 很 温和 ， 住在 那里 的 人们 喜欢 沿着 河边 散步 。 "
    more = [(10001, italian, "it"), (10002, dutch, "nl"), (10003, chinese, "zh"), (10004, english, None), (10005, english, "de")]
    texts = [(k, " ".join(t.replace("valley", f"v{j}").replace("valle", f"v{j}").replace("dal", f"d{j}").replace("山谷", f"山{j}") for j in range(6)), lang) for k, t, lang in more]
    df = spark.createDataFrame(rows + texts, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality.judge_quality(df, rules=quality.Rules(min_reference_words=2000, max_repeat_percent=101)).collect()}
    assert all(got[k].kept for k, *_ in more)
    assert all(got[k].char_distance is None and got[k].word_distance is None for k in (10001, 10002, 10003, 10004))
    assert got[10005].word_distance is not None  # tagged wrongly, and near the reference of its own language


def test_repeated_windows_are_compared_whole(monkeypatch):
    words = [b"w%d" % k for k in range(40)]
    monkeypatch.setattr(quality, "_STEP", quality._STEP * 0)  # every window has the same hash
    assert quality.repeat_words(words) == 0
    assert quality.repeat_words(words + words[3:11]) == 16
