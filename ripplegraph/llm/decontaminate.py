"""Benchmark decontamination by winnowing.

Documents and benchmark items are sequences of words. Of every 10 words in a row, five-word grams are hashed and the
smallest hash (the rightmost of equals) is kept as a fingerprint, on both sides alike: two texts that share 10 words
share the fingerprint that those words keep. Fingerprints of the documents are looked up among those of the items, and
each hit is extended word by word; runs of 10 words or more are contaminated. Items of fewer than 10 words keep all
their words as one gram, looked for at every position.

The benchmark goes to the executors in blocks of a bounded size. The texts are read once for each block and never
shuffled or written: what further blocks find are rows of documents with hits, which are joined to those of the first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import as_bytes, free_name, slices

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text in a block; its index takes about six times as much.
BLOCK_BYTES = 32 << 20
FILTER_BITS = 22
SLICE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_MIX = _U(0xFF51AFD7ED558CCD)
_PLACES = np.cumprod(np.full(WINDOW, 0xC2B2AE3D27D4EB4F, np.uint64), dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, 2 * len(cls.up), 1 << 18)
            cls.up, cls.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


class Words:
    """Words of several texts: where they stand in one lower-cased buffer, whose they are, and their hashes."""

    def __init__(self, texts: list[bytes | None]):
        self.buffer = b"\0".join(t or b"" for t in texts) + b"\0"
        raw = _LOWER[np.frombuffer(self.buffer, np.uint8)]
        self.buffer = raw.tobytes()
        inside = np.concatenate(([False], _IN_WORD[raw], [False])).view(np.int8)
        step = np.flatnonzero(np.diff(inside))
        self.start, self.end = step[::2], step[1::2]
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        self.last = np.searchsorted(self.start, ends)  # of each text: the number of words up to its end
        self.first = np.concatenate(([0], self.last[:-1]))
        self.count = self.last - self.first
        self.stop = np.repeat(self.last, self.count)  # of each word: where its text's words end
        up, down = Powers.get(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = (h ^ (h >> _U(32))) * _MIX

    def grams(self) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hash of the n words from each position on), for n from 1 to WINDOW."""
        n_words, total = len(self.hash), np.zeros(len(self.hash), np.uint64)
        for n in range(1, min(WINDOW, n_words) + 1):
            total = total[: n_words - n + 1] + self.hash[n - 1 :] * _PLACES[n - 1]
            mixed = (total ^ (total >> _U(29))) * _MIX
            yield n, mixed ^ (mixed >> _U(32))

    def starts(self, n: int) -> np.ndarray:
        """Whether n words of one text begin at each position."""
        at = np.arange(max(0, len(self.hash) - n + 1))
        return at + n <= self.stop[: len(at)]

    def winnowed(self, gram: np.ndarray) -> np.ndarray:
        """Positions of the grams that are the smallest, the rightmost of equals, in some window of WINDOW words."""
        n = len(self.hash) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        least, at = gram[:n], np.zeros(n, np.int8)
        for k in range(1, WINDOW - GRAM + 1):
            new = gram[k : k + n]
            smaller = new <= least
            least = np.minimum(least, new)
            at[smaller] = k
        found = (np.arange(n) + at)[self.starts(WINDOW)]
        return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found

    def text(self, a: int, b: int) -> list[bytes]:
        return [self.buffer[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


class _Table:
    """Hashes with their places, behind a filter of FILTER_BITS bits."""

    def __init__(self, keys: np.ndarray, places: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self.keys >> _U(64 - FILTER_BITS)] = True

    def hits(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(index of a key that is in the table, its places)."""
        maybe = np.flatnonzero(self.seen[keys >> _U(64 - FILTER_BITS)])
        lo, hi = (np.searchsorted(self.keys, keys[maybe], side) for side in ("left", "right"))
        for k in np.flatnonzero(hi > lo):
            yield int(maybe[k]), self.places[lo[k] : hi[k]]


class BenchmarkIndex:
    """Fingerprints of a block of items. Items of the same words share one entry."""

    def __init__(self, items: Iterable[tuple[object, str | None]]):
        rows = [(i, (t or "").encode()) for i, t in items]
        alone, self.ids = {}, []
        for (item, _), words in zip(rows, _word_lists([t for _, t in rows]), strict=True):
            if words:
                k = alone.setdefault(tuple(words), len(alone))
                if k == len(self.ids):
                    self.ids.append(set())
                self.ids[k].add(str(item))
        self.words = Words([b" ".join(w) for w in alone])
        grams = dict(self.words.grams())
        whole = self.words.count
        self.short: dict[int, _Table] = {}
        for n in sorted({int(n) for n in whole if n < WINDOW}):
            at = self.words.first[whole == n]
            self.short[n] = _Table(grams[n][at], at)
        at = self.words.winnowed(grams[GRAM]) if GRAM in grams else np.zeros(0, np.int64)
        self.long = _Table(grams[GRAM][at], at) if len(at) else None
        self.entry = np.repeat(np.arange(len(self.ids)), whole)  # of each word: its item's entry

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """Of each text: its number of words, which of them are hit, and the ids of the items that hit them."""
        doc, index = Words(texts), self.words
        owner = np.repeat(np.arange(len(texts)), doc.count)
        marks, items = np.zeros(len(doc.hash) + 1, np.int64), [set() for _ in texts]

        def hit(a: int, b: int, at: int) -> None:
            if doc.text(a, b) == index.text(at, at + b - a):
                marks[a] += 1
                marks[b] -= 1
                items[owner[a]].update(self.ids[self.entry[at]])

        long_grams = None
        for n, gram in doc.grams():
            if n == GRAM:
                long_grams = gram
            if n in self.short:
                at = np.flatnonzero(doc.starts(n))
                for k, places in self.short[n].hits(gram[at]):
                    for q in places.tolist():
                        hit(int(at[k]), int(at[k]) + n, q)
            if n >= GRAM and n >= max(self.short, default=0):
                break
        if self.long is not None and long_grams is not None:
            done: dict[tuple[int, int], int] = {}
            at = doc.winnowed(long_grams)
            for k, places in self.long.hits(long_grams[at]):
                p = int(at[k])
                for q in places.tolist():
                    if done.get((p - q, int(owner[p])), -1) > p:
                        continue
                    a, b = self._extend(doc, p, q, int(doc.first[owner[p]]), int(doc.stop[p]))
                    done[p - q, int(owner[p])] = b
                    if b - a >= WINDOW:
                        hit(a, b, q - (p - a))
        covered = np.cumsum(marks)[:-1] > 0
        return [(int(n), covered[f : f + n], i) for n, f, i in zip(doc.count, doc.first, items, strict=True)]

    def _extend(self, doc: Words, p: int, q: int, first: int, stop: int) -> tuple[int, int]:
        """The longest run around doc's word p of words that equal those around the index's word q."""
        own = self.entry[q]
        left = min(p - first, q - int(self.words.first[own]))
        right = min(stop - p, int(self.words.last[own]) - q)
        same = doc.hash[p - left : p][::-1] == self.words.hash[q - left : q][::-1]
        a = p - (left if same.all() else int(np.argmin(same)))
        same = doc.hash[p : p + right] == self.words.hash[q : q + right]
        return a, p + (right if same.all() else int(np.argmin(same)))


def _word_lists(texts: list[bytes]) -> list[list[bytes]]:
    if not texts:
        return []
    words = Words(texts)
    return [words.text(a, b) for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


HITS, ITEMS = "array<struct<first:int,last:int>>", "array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits array<struct<first,last>>, items array<string>): runs of words that are hit, and by which items.

    A null or empty text has no words and no hits; a null or wordless item hits nothing. Repeated documents are judged
    alike, two texts of one id each by itself, and repeated items are one. An empty benchmark hits nothing, an empty table
    gives an empty result. Other columns are ignored. The benchmark is read while the result is being declared.
    """
    share, id_type = docs.sparkSession.sparkContext.broadcast, docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    schema = f"doc_id {id_type}, text_key bigint, n_words bigint, hits {HITS}, items {ITEMS}"
    first, *others = [share(BenchmarkIndex(block)) for block in _blocks(benchmark, item_col, item_text)] or [share(BenchmarkIndex([]))]
    out = rows.mapInArrow(_scanning(first, False), schema)
    if others:
        parts = [rows.mapInArrow(_scanning(index, True), schema) for index in others]
        more = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_key")
        more = more.agg(F.flatten(F.collect_set("hits")).alias("more_hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("more_items"))
        out = out.alias("o").join(more.alias("m"), F.expr("o.doc_id <=> m.doc_id AND o.text_key = m.text_key"), "left")
        none = lambda c, kind: f"coalesce({c}, cast(array() as {kind}))"
        joined = f"""aggregate(array_sort(concat(hits, {none("more_hits", HITS)})), cast(array() as {HITS}), (done, s) ->
            IF(size(done) = 0 OR s.first > element_at(done, -1).last + 1, concat(done, array(s)),
               concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last))))))"""
        out = out.select("o.doc_id", "n_words", F.expr(joined).alias("hits"), F.expr(f"array_sort(array_union(items, {none('more_items', ITEMS)}))").alias("items"))
    return out.select("doc_id", "n_words", "hits", "items")


def _scanning(index, hits_only: bool):
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            hits, items, counts = [], [], []
            for n, hit, found in index.value.scan(as_bytes(batch.column(1))):
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                hits.append([{"first": a, "last": b - 1} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                items.append(sorted(found))
                counts.append(n)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(hits, span), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text_key", "n_words", "hits", "items"])
            yield out.filter(pa.array(list(map(bool, hits)), pa.bool_())) if hits_only else out

    return kernel


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document; see contamination()."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which no word is hit.

    Null and empty texts stay; repeated rows go or stay together, two texts of one id each by itself. An empty benchmark
    keeps all, an empty table gives an empty result. The benchmark is read while the result is being declared.
    """
    share, at = docs.sparkSession.sparkContext.broadcast, docs.columns.index(text_col)

    def keeping(index):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at, SLICE):
                yield batch.filter(pa.array([not hit.any() for _, hit, _ in index.value.scan(as_bytes(batch.column(at)))], pa.bool_()))

        return kernel

    indices = [share(BenchmarkIndex(block)) for block in _blocks(benchmark, "item_id", "text")]
    kept = docs.mapInArrow(keeping(indices[0]), docs.schema) if indices else docs
    if indices[1:]:
        texts = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
        schema = f"doc_id int, text_key bigint, n_words bigint, hits {HITS}, items {ITEMS}"
        found = reduce(DataFrame.unionByName, [texts.mapInArrow(_scanning(index, True), schema) for index in indices[1:]])
        found = found.select(F.struct("text_key").alias(name := free_name(docs, "found"))).distinct()
        kept = kept.join(found, F.xxhash64(text_col) == F.col(f"{name}.text_key"), "left_anti")
    return kept


def oracle_sql() -> str:
    """contamination_digest() in DuckDB's SQL."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents),
    b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE len({words}) > 0),
    item_windows AS (
      SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[s : s + least({WINDOW}, len(w)) - 1], ' ') AS g
      FROM b, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) r(s)),
    sizes AS (SELECT DISTINCT n FROM item_windows),
    doc_windows AS (
      SELECT k, s, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) r(s)),
    found AS (SELECT k, s, n, item_id FROM doc_windows JOIN item_windows USING (n, g)),
    items AS (
      SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY k),
    hits AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, s, n FROM found), unnest(range(s, s + n)) r(p) GROUP BY k)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN items USING (k) LEFT JOIN hits USING (k)"""
