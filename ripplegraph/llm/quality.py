"""Quality rules: base measures of a text, and its distance from the histograms of its language.

Two histograms are taken of each text: classes of characters, and common words (the fixed lists below, everything else
in one last bin). A language's reference is the sum of the histograms of all its documents that pass the base rules and
are plain prose. A text is kept if it passes them and, where it is long enough for a histogram to say something, lies within the limit of
Jensen-Shannon distance of a reference in both histograms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import cut_lineage
from .rows import as_bytes, slices

#: Common function words of the languages that are told apart.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not are this or from at an which".split(),
    "de": "der die das und in zu den von ist mit des auf für im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "le la les de des du et un une en est que qui dans pour pas sur par au avec il elle ce plus".split(),
    "es": "el la los las de del y en un una que es por con para no se su al lo como más o pero".split(),
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
_WORD_AT = {w.encode(): k for k, w in enumerate(WORDS)}
OTHER = len(WORDS)

#: Classes of bytes: lower, upper, digit, white space, sentence marks, other ASCII, letters beyond ASCII, symbols; the
#: next one is counted nowhere.
CLASSES = 8


def _byte_classes() -> np.ndarray:
    out = np.full(256, 5, np.int64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[[32, 9, 10, 11, 12, 13]] = 3
    out[list(b".,;:'\"!?()-")] = 4
    out[0xC0:], out[0x80:0xC0] = 6, CLASSES
    out[list(_SYMBOLS)] = 7
    return out


_BLANK, _CONTINUES, _SYMBOLS = b" \t\n\v\f\r", bytes(range(0x80, 0xC0)), b"#*$%&|<>"
_CLASS = _byte_classes()
_TO_WORDS = bytes(32 if c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or c < 32 else c for c in range(256))
WINDOW = 8
_STEP = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


@dataclass(frozen=True)
class Rules:
    """Limits. The guards are the least lengths at which a histogram is judged."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_char_distance: float = 0.165
    #: A short text's histogram strays further: this, over the number of characters, is added to the limit.
    char_leeway: float = 35.0
    max_word_distance: float = 0.38
    guard_chars: int = 250
    guard_words: int = 60
    #: A language with fewer words than these has no reference; with so many a histogram is near its limit.
    min_reference_words: int = 5000


def repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that stand twice or more in the text, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _STEP[k]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    maybe = np.flatnonzero(np.isin(key, twice)).tolist()
    windows = [tuple(words[k : k + WINDOW]) for k in maybe]  # hashes only say where to look
    count = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.array([k for k, w in zip(maybe, windows, strict=True) if count[w] > 1], np.int64)
    np.add.at(marks, at, 1)
    np.subtract.at(marks, at + WINDOW, 1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def base_measures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or b""
    words = text.split()
    seen, twice = set(), 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                twice += bool(line.strip())
            seen.add(line)
    return len(words), len(text.translate(None, _BLANK + _CONTINUES)), len(text) - len(text.translate(None, _SYMBOLS)), twice, repeat_words(words)


def base_fails(n_words: int, n_repeat: int, rules: Rules) -> bool:
    return n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words


def is_plain_prose(chars: np.ndarray) -> bool:
    """Whether a text may speak for its language: few symbols, and not mostly in capitals."""
    return 50 * chars[7] <= chars.sum() and chars[1] <= chars[0] + chars[6]


def histograms(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words, the other words in the last bin."""
    text = text or b""
    chars = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
    words = text.lower().translate(_TO_WORDS).split()
    hits = [k for k in map(_WORD_AT.get, words) if k is not None]
    common = np.bincount(np.array(hits, np.int64), minlength=OTHER + 1)
    common[OTHER] = len(words) - len(hits)
    return chars, common


def js_distance(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root, base 2) of counts from each row of references (probabilities)."""
    p = counts / max(counts.sum(), 1)
    m = (references + p) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(references > 0, references * np.log2(references / m), 0).sum(axis=1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def fit_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> dict[str, tuple[list[float], list[float]]]:
    """Histograms of each language over all documents that pass the base rules and are plain prose, as probabilities.

    Each task adds up its own documents; what is shuffled is one row a task and language. Languages of
    fewer than `rules.min_reference_words` words get none, whatever else the corpus holds. A null language has none.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = (text or b"").split()
                if lang is not None and not base_fails(len(words), repeat_words(words), rules):
                    chars, common = histograms(text)
                    if not is_plain_prose(chars):
                        continue
                    new = np.concatenate((chars, common))
                    sums[lang] = sums[lang] + new if lang in sums else new
            if len(sums) > 4096:
                yield _sums(sums)
                sums = {}
        yield _sums(sums)

    found = docs.select(F.col(lang_col), F.col(text_col)).mapInArrow(kernel, "lang string, counts array<bigint>")
    flat = found.select("lang", F.posexplode("counts").alias("k", "n")).groupBy("lang", "k").agg(F.sum("n").alias("n"))
    rows = cut_lineage(flat.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("bins"), F.sum(F.when(F.col("k") >= CLASSES, F.col("n"))).alias("words")))
    out = {}
    for row in rows.where(F.col("words") >= rules.min_reference_words).collect():
        counts = np.array([b.n for b in row.bins], float)
        chars, words = counts[:CLASSES], counts[CLASSES:]
        out[row.lang] = (list(chars / max(chars.sum(), 1)), list(words / max(words.sum(), 1)))
    return out


def _sums(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))})


RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules(), references: dict | None = None) -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, kept, char_distance and word_distance.

    A null or empty text has no words and fails. The distances are null where a guard applies or the text's language has no
    reference, and a null distance rejects nothing. A text whose language has a reference is held against the nearest of
    all references, so that a wrong tag of such a language alone is no fault. Repeated rows are judged alike; an empty
    table gives an empty result; other columns are ignored. Texts are read twice and never shuffled; the references are
    fitted while the result is being declared.
    """
    known = fit_references(docs, text_col, lang_col, rules) if references is None else references
    char_refs, word_refs = (np.array([v[k] for v in known.values()]) for k in (0, 1))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, lang in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                base = base_measures(text)
                failed, near, limits = base_fails(base[0], base[4], rules), (None, None), (0.0, 0.0)
                if not failed and lang in known:
                    chars, words = histograms(text)
                    d = [js_distance(chars, char_refs) if chars.sum() >= rules.guard_chars else None, js_distance(words, word_refs) if words.sum() >= rules.guard_words else None]
                    limits = rules.max_char_distance + rules.char_leeway / max(chars.sum(), 1), rules.max_word_distance
                    over = sum((x / limit for x, limit in zip(d, limits, strict=True) if x is not None), np.zeros(len(known)))
                    best = int(np.argmin(over))
                    near = [None if x is None else float(x[best]) for x in d]
                kept = not failed and all(x is None or x <= limit for x, limit in zip(near, limits, strict=True))
                rows.append((*base, failed, kept, *near))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col), F.col(lang_col)).mapInArrow(kernel, f"doc_id {id_type}, {RESULT}")
