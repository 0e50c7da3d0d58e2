"""Toxicity by a classifier chain.

The categories are predicted one after another by linear models; each later model also sees the probabilities of the
earlier categories. While a model is trained, what it sees of the earlier ones are out-of-fold predictions, so that it
learns to trust them no more than they deserve on new texts.

Features are the different words of a text and the beginnings of the longer ones, hashed to a fixed number of columns, of which those stay that enough
training texts contain and that, by a chi-squared test, go with some category. A word is weighted by how many texts contain it, not by how often a text repeats it, so that one
slur in a long text weighs what it weighs in a short one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices

#: Words that a category's training label is derived from, within the texts labelled toxic.
CATEGORIES = {
    "insult": "idiot moron stupid clown loser fool dumb imbecile".split(),
    "contempt": "worthless pathetic scum trash disgusting vermin filth garbage".split(),
}
FINAL = "toxic"
BITS = 20
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of longer words that are features too.
PREFIXES = (4, 6)


@dataclass(frozen=True)
class Settings:
    #: The most labelled rows that training takes, by the order of their ids' hashes.
    sample: int = 6000
    folds: int = 5
    least_texts: int = 5
    #: The least chi-squared statistic of a column with some category.
    least_chi2: float = 20.0
    steps: int = 300
    penalty: float = 0.005
    #: A text is rejected from this probability of the last category on.
    threshold: float = 0.4


def column(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def text_columns(text: str | None) -> list[int]:
    """Hashed columns of the different lower-cased words of a whole text, and of their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    starts = {f"{w[:n]}-" for n in PREFIXES for w in words if len(w) > n}
    return sorted({column(w) for w in words | starts})


def _telling(texts: list[np.ndarray], labels: dict[str, np.ndarray], s: Settings) -> np.ndarray:
    """Columns in s.least_texts texts or more that go with some category."""
    if not texts:
        return np.zeros(0, np.int64)
    columns, there = np.unique(np.concatenate(texts), return_counts=True)
    often = there >= s.least_texts
    columns, there = columns[often], there[often].astype(float)
    n, best = len(texts), np.zeros(len(columns))
    for y in labels.values():
        a = np.zeros(len(columns))
        for t in (t for t, is_in in zip(texts, y, strict=True) if is_in):
            a[np.searchsorted(columns, t[np.isin(t, columns)])] += 1
        b, c = there - a, y.sum() - a
        d = n - a - b - c
        best = np.maximum(best, n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1))
    return columns[best >= s.least_chi2].astype(np.int64)


class _Rows:
    """Sparse 0/1 rows over selected columns."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.size)

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(rows: _Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, s: Settings) -> np.ndarray:
    """Logistic regression with an L2 penalty by Adam: weights of n columns, of the extra ones, and the intercept."""
    w = np.zeros(n + extra.shape[1] + 1)
    if not len(y):  # nothing speaks for the category
        w[-1] = -30
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = max(weight.sum(), 1e-9)
    for t in range(1, s.steps + 1):
        z = rows.dot(w[:n]) + extra @ w[n:-1] + w[-1]
        g = (_sigmoid(z) - y) * weight / total
        grad = np.concatenate((rows.back(g, n), extra.T @ g, [g.sum()]))
        grad[:-1] += s.penalty * w[:-1] / len(y) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class ToxicityChain:
    """The chain's links in order: name and weights; `columns` maps hashed columns to weights' places."""

    def __init__(self, names: list[str], columns: np.ndarray, weights: list[np.ndarray]):
        self.names, self.columns, self.weights = names, columns, weights

    @classmethod
    def train(cls, texts: list[np.ndarray], labels: dict[str, np.ndarray], s: Settings = Settings()) -> ToxicityChain:
        """texts: hashed columns of each training text; labels: 0/1 for each category, in the chain's order."""
        once = list({sha256(t).digest(): k for k, t in reversed(list(enumerate(texts)))}.values())  # copies of a text count once
        texts, labels = [texts[k] for k in sorted(once)], {name: y[sorted(once)] for name, y in labels.items()}
        columns = _telling(texts, labels, s)
        rows = [np.searchsorted(columns, t[np.isin(t, columns)]) for t in texts]
        n, size, fold = len(columns), len(rows), np.arange(len(rows)) % s.folds
        extra, weights = np.zeros((size, 0)), []
        data = _Rows(rows)
        parts = [(np.flatnonzero(fold != f), np.flatnonzero(fold == f)) for f in range(s.folds)]
        for k, y in enumerate(labels.values()):
            y = y.astype(float)
            weights.append(_fit(data, extra, y, np.ones(size), n, s))
            if k + 1 < len(labels):
                out = np.zeros(size)
                for a, b in parts:
                    if len(a) and len(b):
                        held = _Rows([rows[i] for i in b])
                        w = _fit(_Rows([rows[i] for i in a]), extra[a], y[a], np.ones(len(a)), n, s)
                        out[b] = _sigmoid(held.dot(w[:n]) + extra[b] @ w[n:-1] + w[-1])
                extra = np.column_stack((extra, out))
        return cls(list(labels), columns, weights)

    def predict(self, texts: list[list[int]]) -> np.ndarray:
        """A row of probabilities, one a category, for each text's hashed columns."""
        n, rows = len(self.columns), []
        for t in texts:
            t = np.array(t, np.int64)
            at = np.searchsorted(self.columns, t)
            at = np.minimum(at, max(n - 1, 0))
            rows.append(at[self.columns[at] == t] if n else np.zeros(0, np.int64))
        data, out = _Rows(rows), np.zeros((len(texts), 0))
        for w in self.weights:
            out = np.column_stack((out, _sigmoid(data.dot(w[:n]) + out @ w[n:-1] + w[-1])))
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Settings = Settings()) -> ToxicityChain:
    """Fit the chain on at most s.sample labelled rows.

    Rows whose label or id is null are no labels; of several labels of one id the largest holds. The sample is drawn
    from all labels by a hash of the id; only hashed columns reach the driver, and only the sample's.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    sample = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(s.sample))  # bounded by the setting
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id").select("_id", "_text", "_y")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = pa.array([text_columns(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), cols], names=["_id", "_y", "cols"])

    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = chosen.mapInArrow(kernel, f"_id {id_type}, _y int, cols array<int>").orderBy(F.xxhash64("_id"), "_id").limit(s.sample).toArrow()
    flat = rows.column("cols").combine_chunks()
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    texts = [np.ascontiguousarray(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    toxic = rows.column("_y").to_numpy().astype(bool)
    label = {}
    for name, words in CATEGORIES.items():
        seeds = np.unique([column(w) for w in words])
        label[name] = toxic & np.array([bool(np.isin(seeds, t).any()) for t in texts], bool)
    label[FINAL] = toxic
    return ToxicityChain.train(texts, label, s)


def _scores(chain, texts: list[str | None], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    p = chain.predict([text_columns(t) for t in texts])
    blank = np.array([not t for t in texts], bool)
    p[blank] = 0
    return p, p[:, -1] >= threshold


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Settings = Settings(), chain: ToxicityChain | None = None) -> DataFrame:
    """One row per document: doc_id, a probability p_<category> for each link of the chain, rejected.

    A null or empty text scores zero and is not rejected. Without labels nothing is rejected. Repeated rows score alike; an empty table gives an empty result; other columns are ignored. Documents
    are read once to find the labelled ones and once to score all; only the labels are shuffled.
    """
    chain = chain or train(docs, labels, id_col, text_col, label_col, s)
    shared, threshold = docs.sparkSession.sparkContext.broadcast(chain), s.threshold
    names = [f"p_{n}" for n in chain.names]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p, rejected = _scores(shared.value, batch.column(1).to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in p.T), pa.array(rejected, pa.bool_())], names=["doc_id", *names, "rejected"])

    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(kernel, f"doc_id {id_type}, {', '.join(f'{n} double' for n in names)}, rejected boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The documents, with all their columns, that the chain does not reject."""
    shared, at = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, s=s)), docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(~_scores(shared.value, batch.column(at).to_pylist(), s.threshold)[1], pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)
