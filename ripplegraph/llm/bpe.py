"""BPE encoding and decoding with forced boundaries.

A merge joins two neighbouring symbols into a token of the vocabulary, so two byte characters that stand side by side in
no token are never joined: between them is a certain cut. A pre-token falls into fragments at its certain cuts; each
fragment is encoded by itself and the ids are put together again. Workers keep a cache of pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PreTokenizer
from .rows import map_texts, slices

#: Entries of a worker's cache of pre-tokens before it starts anew, and the longest pre-token that it takes.
CACHE, LONGEST = 1 << 18, 64


class _Cache(dict):
    """For each pre-token: its ids as decimal text and what they decode to, both with a space in front of each, and
    their number."""

    def __init__(self, encode, tokens: dict[int, str]):
        super().__init__()
        self.encode, self.tokens = encode, tokens

    def __missing__(self, piece: str) -> tuple[str, str, int]:
        ids = self.encode(piece)
        found = "".join(f" {i}" for i in ids), "".join(f" {self.tokens[i]}" for i in ids), len(ids)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = found
        return found


class ForcedBoundaryBpe:
    """Encoder and decoder of one vocabulary file; one per Python process and file."""

    _shared: dict = {}

    @classmethod
    def shared(cls, path: str | None) -> ForcedBoundaryBpe:
        if path not in cls._shared:
            cls._shared[path] = cls(PreTokenizer.shared(path))
        return cls._shared[path]

    def __init__(self, pre: PreTokenizer):
        from tokenizers.models import BPE

        model = pre.file["model"]
        self.pre, self.ids = pre, model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in pre.special.items()}
        self.inner, self.final = self._side_by_side(self.ids)
        #: Models of fragments inside a pre-token and of its last one, which carries the word's end.
        self._inside = BPE(self.ids, merges)
        self._last = BPE(self.ids, merges, end_of_word_suffix=self.suffix) if self.suffix else self._inside
        self._known = _Cache(self.encode_piece, self.tokens)

    def _side_by_side(self, vocabulary) -> tuple[set[str], set[str]]:
        """Pairs of byte characters next to each other in some token: before the word's end, and at it."""
        inner, final = set(), set()
        for token in vocabulary:
            ends = self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            pairs = list(map(add, body, body[1:]))
            final.update(pairs[-1:] if ends else ())
            inner.update(pairs[:-1] if ends else pairs)
        return inner, final if self.suffix else inner

    def fragments(self, piece: str) -> list[str]:
        """Byte characters of a pre-token, parted at its certain cuts."""
        chars = self.pre.byte_level(piece)
        pairs, inner = list(map(add, chars, chars[1:])), self.inner
        if not pairs or pairs[-1] in self.final and inner.issuperset(pairs[:-1]):
            return [chars]
        cuts = [k for k, pair in enumerate(pairs[:-1], 1) if pair not in inner]
        if pairs and pairs[-1] not in self.final:
            cuts.append(len(pairs))
        return [chars[a:b] for a, b in zip([0, *cuts], [*cuts, len(chars)])]  # noqa: B905

    def encode_piece(self, piece: str) -> list[int]:
        *inside, last = self.fragments(piece)
        return [t.id for f in inside for t in self._inside.tokenize(f)] + [t.id for t in self._last.tokenize(last)]

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.digest(text)[1].split()))

    def decode(self, ids) -> str:
        """Tokens put together with one space, as a vocabulary without a decoder has it; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimal text, and the text that they decode to."""
        ids, back, total, known = [], [], 0, self._known.__getitem__
        for span in self.pre.spans(text):
            if isinstance(span, int):
                ids.append(f" {span}")
                back.append(f" {self.tokens[span]}")
                total += 1
            elif span:
                some, tokens, counts = zip(*map(known, span), strict=True)
                ids += some
                back += tokens
                total += sum(counts)
        return total, "".join(ids)[1:], "".join(back)[1:]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text; a null text has no ids."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBpe.shared(path)
        for batch in slices(batches):
            done = [bpe.digest(t or "") for t in batch.column(1).to_pylist()]
            ids = pa.array([list(map(int, s.split())) for _, s, _ in done], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([d for *_, d in done], pa.string())], names=["doc_id", "ids", "decoded"])

    return map_texts(docs, id_col, text_col, kernel, f"doc_id {_type(docs, id_col)}, ids array<int>, decoded string")


def decode_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, decoded string) of rows of ids; a null array decodes to the empty text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBpe.shared(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return map_texts(rows, id_col, ids_col, kernel, f"doc_id {_type(rows, id_col)}, decoded string")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    A null or empty text has no ids, and both digests are those of nothing. Special tokens' strings in a text become
    their ids. Repeated rows give repeated results; an empty table gives none; other columns are ignored. Nothing is
    shuffled.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBpe.shared(path)
        for batch in slices(batches):
            done = [bpe.digest(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, *_ in done], pa.int64()), *(pa.array([sha256(d[k].encode()).hexdigest() for d in done], pa.string()) for k in (1, 2))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_texts(docs, id_col, text_col, kernel, f"doc_id {_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _type(df: DataFrame, col: str) -> str:
    return df.select(F.col(col)).schema[0].dataType.simpleString()
