"""Nearest vectors by blocks of queries: products of matrices choose, sums in the order of the elements decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Queries that are sent to the executors at once, at most about; and those of them whose products are held at once.
BLOCK, CHUNK = 1 << 15, 1 << 9


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of one size, without nulls, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up from the first element on as relational.dot() does, to the last bit."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _unit(m: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (m / norm[:, None]).astype(np.float32)


def _best(k: int, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each row, in order of row, score and id."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    order = order[nth < k]
    return row[nth < k], score[order], ids[order]


class Search:
    """The k vectors nearest to each of a block of queries, over batches of vectors.

    A product in single precision is off by less than `slack`, so that whatever is among the k nearest lies within it of
    the k-th of them; all that does is scored anew in double precision.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.norm = np.sqrt(_dot(queries, queries))
        self.unit = _unit(queries, self.norm)
        self.slack = np.float32((queries.shape[1] + 8) * 2.0**-22)
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norm = np.sqrt(_dot(vectors, vectors))
        unit = np.ascontiguousarray(_unit(vectors, norm).T)
        for at in range(0, len(self.q), CHUNK):
            near = self.unit[at : at + CHUNK] @ unit
            least = np.full(len(near), -np.inf, np.float32)
            old = self.found.get(at)
            if near.shape[1] >= self.k:
                if old is None:
                    least = np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
            if old is not None:
                last = np.flatnonzero(np.append(old[0][1:] != old[0][:-1], True))
                full = np.bincount(old[0], minlength=len(near))[old[0][last]] >= self.k
                least[old[0][last[full]]] = old[1][last[full]]
            row, col = np.nonzero(near >= (least - 2 * self.slack)[:, None])
            for some in range(0, len(row), 1 << 17):
                r, c = row[some : some + (1 << 17)], col[some : some + (1 << 17)]
                score = _dot(vectors[c], self.q[at + r]) / (norm[c] * self.norm[at + r])
                old = self.found.get(at)
                new = (r, score, ids[c])
                self.found[at] = _best(self.k, *(new if old is None else map(np.concatenate, zip(old, new, strict=True))))

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, score, id) of what is found."""
        for at, (row, score, ids) in self.found.items():
            yield at + row, score, ids


def nearest_block(vectors: DataFrame, queries: DataFrame, k: int, size: int) -> DataFrame:
    """(query_id, vec_id, score): for each of queries(query_id, _q), at most some BLOCK of them, at least its k nearest of
    vectors(vec_id, _v). All are finite, longer than nothing and have `size` elements; a task sends k rows a query."""
    block = queries.select("query_id", "_q").toArrow().combine_chunks()
    names = block.column("query_id").combine_chunks()
    lists = block.column("_q").combine_chunks()
    shared = vectors.sparkSession.sparkContext.broadcast((names, _matrix(lists, size)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, search, kind = shared.value[0], None, None
        for batch in batches:
            if batch.num_rows:
                search, kind = search or Search(shared.value[1], k), batch.schema.field(0).type
                search.add(np.array(batch.column(0).to_pylist()), _matrix(batch.column(1), size))
        for row, score, ids in search.rows() if search else ():
            yield pa.RecordBatch.from_arrays([of.take(pa.array(row)), pa.array(ids.tolist(), kind), pa.array(score)], names=["query_id", "vec_id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}
    return vectors.select("vec_id", "_v").mapInArrow(kernel, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double")
