"""Token counts by a map-side lookup in two tiers.

Tier one is a compact hash table, broadcast, of frequent pre-tokens and their numbers of tokens: those that the
vocabulary holds whole, which are the frequent ones of the text that it was made from. What it lacks is encoded on its
first sight and kept in a cache of each Python worker. No pass over the corpus is needed to fill the table, and neither
pre-tokens nor texts are shuffled; the counts do not depend on what the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PreTokenizer
from .rows import map_texts, slices

#: Entries of the broadcast table, and of a worker's cache beyond them before it starts anew.
TABLE, CACHE = 1 << 16, 1 << 18
#: Longer pre-tokens are encoded each time anew, so that neither the table (16 MB at most) nor a cache grows by long ones.
LONGEST = 64


def frequent_lengths(path: str | None = None, table: int = TABLE) -> dict[str, int]:
    """Numbers of tokens of the first `table` pre-tokens that the vocabulary holds whole."""
    pre = PreTokenizer.shared(path)
    return {p: pre.length(p) for p in [p for p in pre.whole_words() if len(p) <= LONGEST][:table]}


class Lengths(dict):
    """Pre-tokens' numbers of tokens: tier one, and what was encoded since the cache last started anew."""

    _shared: dict = {}

    @classmethod
    def shared(cls, path: str | None, first: dict[str, int]) -> Lengths:
        """One per Python process and file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path, first)
        return cls._shared[path]

    def __init__(self, path: str | None, first: dict[str, int]):
        super().__init__(first)
        self.first, self.encode = first, PreTokenizer.shared(path).length

    def __missing__(self, piece: str) -> int:
        n = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.first) + CACHE:
                self.clear()
                self.update(self.first)
            self[piece] = n
        return n


def _counting(table, path: str | None, limit: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, length = PreTokenizer.shared(path), Lengths.shared(path, table.value).__getitem__
        for batch in slices(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            n_bytes = [len(text.encode()) for text in texts]
            # a special token is one
            n_tokens = [sum(1 if isinstance(span, int) else sum(map(length, span)) for span in pre.spans(text)) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return kernel


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    A null or empty text has no bytes and no tokens; special tokens' strings in a text count one token each. Repeated
    rows give repeated results; an empty table gives none; other columns are ignored. Texts are read once and never
    shuffled.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return map_texts(docs, id_col, text_col, _counting(table, path, limit), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
