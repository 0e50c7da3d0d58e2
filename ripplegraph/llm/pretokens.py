"""Normalising and pre-tokenising for a tokenizer file whose model is a BPE with word ends."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: In texts below this code point, but for the odd characters, Python's rules for case, letters and white space are the
#: library's and NFC changes nothing, so that the quick pattern holds. Odd are control characters, blanks that Python
#: takes for white space or does not, and letters whose lower case lies beyond.
PLAIN_END = 0x250
ODD = "".join(map(chr, [*range(9), *range(14, 32), *range(127, 161)])) + "".join(c for c in map(chr, range(PLAIN_END)) if max(c.lower()) >= chr(PLAIN_END))


def _class(name: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(PLAIN_END)) if regex.fullmatch(rf"\p{{{name}}}", c))


def quick(pattern: str) -> re.Pattern:
    r"""The pattern with \p{L} and \p{N} spelt out for plain texts."""
    return re.compile(re.sub(r"\\p\{(\w)\}", lambda m: _class(m[1]), pattern))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class PreTokenizer:
    """Pieces of a text, as the tokenizers library cuts them; one per Python process and file."""

    _shared: dict = {}

    @classmethod
    def shared(cls, path: str | None) -> PreTokenizer:
        if path not in cls._shared:
            cls._shared[path] = cls(path or default_path())
        return cls._shared[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in self.file["added_tokens"]}
        self._special_cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        splits = [p["pattern"]["Regex"] for p in self.file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._pieces = quick(splits[0]).findall
        self._odd = re.compile(f"[{re.escape(ODD)}]|[^\0-{chr(PLAIN_END - 1)}]").search
        self.byte_chars = _byte_chars()
        self.char_bytes = {c: b for b, c in enumerate(self.byte_chars)}

    def spans(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pre-tokens, and the ids of the special tokens that stand between them."""
        if not any(map(text.__contains__, self.special)):
            yield self.pieces(text)
            return
        at = 0
        for m in self._special_cut.finditer(text):
            yield self.pieces(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield self.pieces(text[at:])

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens, normalised.

        A plain text needs no more than lower case and the pattern; others go through the library's own normaliser and
        pre-tokeniser.
        """
        if self._odd(text) is None:
            return self._pieces(text.lower())
        library = self.library
        cut = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        return [bytes(map(self.char_bytes.__getitem__, p)).decode("utf-8") for p, _ in cut]

    def byte_level(self, piece: str) -> str:
        return "".join(map(self.byte_chars.__getitem__, piece.encode()))

    def length(self, piece: str) -> int:
        """Number of tokens of a pre-token, by the library's model."""
        return len(self.library.model.tokenize(self.byte_level(piece)))

    def whole_words(self) -> list[str]:
        """Pre-tokens that the vocabulary holds whole, in the order of their ids: a vocabulary takes the pre-tokens that are
        frequent, the more frequent ones first."""
        suffix, found = self.file["model"].get("end_of_word_suffix") or "", []
        for token in sorted(self.file["model"]["vocab"], key=self.file["model"]["vocab"].get):
            body = token.removesuffix(suffix)
            if body and token.endswith(suffix) and all(c in self.char_bytes for c in body):
                try:
                    piece = bytes(map(self.char_bytes.__getitem__, body)).decode("utf-8")
                except UnicodeDecodeError:  # part of a character
                    continue
                if self.pieces(piece) == [piece]:
                    found.append(piece)
        return found


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]
