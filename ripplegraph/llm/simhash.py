"""SimHash near-duplicates, found with keys from a Golay code.

A fingerprint of 64 bits falls into three segments. The perfect binary Golay code of 23 bits puts every word within three
errors of exactly one of its 4,096 codewords, so a segment (filled up with zeros) names a codeword by 12 bits. Its indices
are the codewords named by the segment and by each segment one bit away, six at most: two segments that differ in up to
two bits have such a neighbour in common, hence an index.

Up to four differing bits fall to the segments in one of two ways. Either one segment has none: then the smaller number of
the other two is two at most, and a key of the whole segment and an index of another one is common (33 bits or more). Or
each segment has one at least: then two have exactly one, so that one half of either is whole, and the third has two at
most; a key of two such halves and an index of the third is common (32 bits or more). No link within four bits is lost,
and keys are long enough for few fingerprints to share one by chance.

Most keys stand in one fingerprint only. One pass over the shuffled keys, without a sort, finds those that two have, and
only these are joined to count the differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, cut_lineage
from .rows import as_bytes, slices

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_GENERATOR, _CHECK_BITS, _LENGTH = 0b101011100011, 11, 23


def fingerprint(text: bytes | None) -> int:
    """SimHash of the XXH64 of the word shingles; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1))
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error of each remainder."""

    def remainder(w: int) -> int:
        for k in range(_LENGTH - 1, _CHECK_BITS - 1, -1):
            if w >> k & 1:
                w ^= _GENERATOR << (k - _CHECK_BITS)
        return w

    one = [remainder(1 << k) for k in range(_LENGTH)]
    xor = lambda bits, at: int(np.bitwise_xor.reduce([one[k + at] for k in range(12) if bits >> k & 1] or [0]))
    error = np.zeros(1 << _CHECK_BITS, np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(_LENGTH), n):
            error[int(np.bitwise_xor.reduce([one[k] for k in bits]))] = sum(1 << k for k in bits)
    return np.array([xor(b, 0) for b in range(1 << 12)]), np.array([xor(b, 12) for b in range(1 << 11)]), error


class Golay:
    _tables = None

    @classmethod
    def indices(cls, words: np.ndarray) -> np.ndarray:
        """The index of the codeword nearest to each word."""
        if cls._tables is None:
            cls._tables = _golay()
        low, high, error = cls._tables
        return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> _CHECK_BITS

    @classmethod
    def keys(cls, words: np.ndarray) -> np.ndarray:
        """Six columns for each word: the indices named by it and by the words one bit away, filled up with -1."""
        near = words[:, None] ^ np.array([0, *(1 << k for k in range(_LENGTH))], np.int64)
        out = np.sort(cls.indices(near), axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        return -np.sort(-out, axis=1)[:, :6]


#: The kinds of keys: a whole segment and the segment of the index; two segments' halves (low or high) and the third one.
WHOLE = tuple(permutations(range(len(SEGMENTS)), 2))
HALVES = tuple(product([(0, 1, 2), (0, 2, 1), (1, 2, 0)], (0, 1), (0, 1)))


def band_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number, key, own) of every fingerprint's keys; a key holds its kind, the whole bits and an index, and own says
    whether the index is the segment's own."""
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    low = [width // 2 for _, width in SEGMENTS]
    halves = [(p & ((1 << n) - 1), p >> n) for p, n in zip(parts, low, strict=True)]
    index = [(found := Golay.keys(p), found == Golay.indices(p)[:, None]) for p in parts]
    kinds = [(parts[a], index[b]) for a, b in WHOLE] + [(halves[a][x] << 11 | halves[b][y], index[c]) for (a, b, c), x, y in HALVES]
    rows, keys, own = [], [], []
    for k, (whole, (indices, is_own)) in enumerate(kinds):
        there = indices >= 0
        rows.append(np.nonzero(there)[0])
        keys.append((k << 36 | whole[:, None] << 12 | indices)[there])
        own.append(is_own[there])
    return tuple(map(np.concatenate, (rows, keys, own)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every whole text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(kernel, f"doc_id {id_type}, fp bigint")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            fp = part.column(0).to_numpy()
            row, key, own = band_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(own)], names=["key", "fp", "own"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _is_link(x: str, y: str) -> str:
    """SQL for: the rows' fingerprints differ in 1 to MAX_BITS bits, and this key is the one to say so.

    Of a pair's kinds of keys it is the one of the first whole segment and the better of the others; without one, that of
    the segment with two errors, or the last, and of the halves that are whole. Of a kind's common keys it is the own index
    of the smaller segment where the segments differ in one bit or none; where they differ in two, few keys are common.
    """
    e = f"({x}.fp ^ {y}.fp)"
    bits = lambda at, width: f"({_signed(((1 << width) - 1) << at)}L)"
    errors = [f"bit_count({e} & {bits(*segment)})" for segment in SEGMENTS]
    said = []
    for k, (a, b) in enumerate(WHOLE):
        c = 3 - a - b
        said.append((k, b, [f"{errors[a]} = 0", *(f"{errors[s]} > 0" for s in range(a)), f"{errors[b]} {'<=' if b < c else '<'} {errors[c]}"]))
    for k, ((a, b, c), *sides) in enumerate(HALVES, len(WHOLE)):
        whole = [f"({e} & {bits(at + side * (width // 2), width - width // 2 if side else width // 2)}) = 0" for (at, width), side in zip((SEGMENTS[a], SEGMENTS[b]), sides, strict=True)]
        said.append((k, c, [f"{errors[a]} = 1", f"{errors[b]} = 1", f"{errors[c]} = 2" if c < 2 else f"{errors[c]} > 0", *whole]))
    tests = []
    for k, s, test in said:
        smaller = f"IF(({x}.fp & {bits(*SEGMENTS[s])}) <= ({y}.fp & {bits(*SEGMENTS[s])}), {x}.own, {y}.own)"
        tests.append(f"({x}.key >> 36 = {k} AND {' AND '.join(test)} AND ({errors[s]} = 2 OR {smaller}))")
    return f"{x}.fp < {y}.fp AND bit_count({e}) <= {MAX_BITS} AND ({' OR '.join(tests)})"


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): every two fingerprints of distinct(fp) that differ in 1 to MAX_BITS bits, smaller first."""
    keyed = distinct.select("fp").mapInArrow(_keyed, "key bigint, fp bigint, own boolean").repartition("key")
    # all columns are asked for on both sides, so that they read one shuffle
    several = keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max("own").alias("own")).where("lo <> hi AND own IS NOT NULL").select("key")
    kept = cut_lineage(keyed.join(several.hint("shuffle_hash"), "key", "left_semi"))
    found = kept.alias("x").join(kept.alias("y"), F.expr(f"x.key = y.key AND {_is_link('x', 'y')}"))
    return found.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Documents link if their fingerprints differ in MAX_BITS bits or fewer; component_id is the smallest doc_id that can
    be reached. Null, empty and wordless texts all have the fingerprint zero and link like any other. Copies share a
    fingerprint, and only different fingerprints are joined. Repeated rows are repeated in the result; an empty table
    gives an empty result; a null doc_id is no smallest one. Other columns are ignored. Spark jobs run while the result
    is being declared.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col))
    first = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    ids = first.where("first IS NOT NULL")
    edges = links(ids).join(ids.select(F.col("fp").alias("a"), F.col("first").alias("src")), "a").join(ids.select(F.col("fp").alias("b"), F.col("first").alias("dst")), "b")
    found = connected_components(edges.select("src", "dst"))
    named = first.join(found, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are the smallest doc_id of their component.

    Rows of one doc_id are one document: they stay together, or go together where some text of theirs has a near-duplicate
    with a smaller id. A null doc_id stays; an empty table gives an empty result.
    """
    more = near_duplicates(docs, "doc_id", text_col).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(more, "doc_id", "left_anti").select(*docs.columns)
