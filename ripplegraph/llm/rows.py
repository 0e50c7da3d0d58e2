"""Arrow batches as Python rows in bounded slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A slice ends at this many rows or, roughly, bytes; a single longer text makes a slice of its own.
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts in column number `text` of a slice stay near `size` bytes."""
    for batch in batches:
        n, at = batch.num_rows, 0
        per_row = max(1, batch.column(text).nbytes // max(n, 1))
        step = max(1, min(SLICE_ROWS, size // per_row))
        while at < n:
            yield batch.slice(at, step)
            at += step


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def release() -> None:
    """Give the memory that nothing uses any more back to the system; allocators keep it otherwise, in every idle worker."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidied(kernel: Callable) -> Callable:
    """kernel(batches) -> batches, whose worker keeps no memory of it when it has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_texts(docs: DataFrame, id_col: str, text_col: str, kernel: Callable, schema: str, *more: str) -> DataFrame:
    """Run kernel(batches) -> batches over (id, text, *more) alone; other columns never reach Python."""
    return docs.select(F.col(id_col), F.col(text_col), *map(F.col, more)).mapInArrow(kernel, schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
