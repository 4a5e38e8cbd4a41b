"""Exact ids of the public byte-level BPE with 50,257 entries, as little-endian 16-bit strings."""

from __future__ import annotations

import base64
import re

import numpy as np

from ._common import enter, store

# fixed values: the vocabulary's one added token
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_TWO = re.compile(r"\s\s")


class Encoder(dict):
    """Ids of a text by its space-separated units.

    The vocabulary's splitting pattern always breaks before a single space that stands between two
    non-space characters, so such units can be encoded apart and kept. Texts with any two white
    space characters in a row, or at an end, are encoded whole. The added token is one id wherever its string stands in
    a text, as in the tokenizers file. The rank file holds the same vocabulary and merges; tests hold their ids against each other.
    The store empties when its units pass `limit` in number.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k.tiktoken", limit: int = 100_000):
        super().__init__()
        import public_tokenizers as P
        import tiktoken

        with open(P.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(vocabulary, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.limit = limit

    def _ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u2").tobytes()

    def _whole(self, text: str) -> bytes:
        if not text:
            return b""
        if _TWO.search(text) or text[0].isspace() or text[-1].isspace():
            return self._ids(text)
        first, *rest = text.split(" ")
        return self._ids(first) + b"".join(map(self.__getitem__, rest))

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self._ids(" " + unit)
        if len(unit) <= 64:
            self[unit] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text, two bytes each; empty for null and ''."""
        if not text:
            return b""
        if SPECIAL not in text:
            return self._whole(text)
        return np.array([SPECIAL_ID], "<u2").tobytes().join(map(self._whole, text.split(SPECIAL)))


_encoders: dict[str, Encoder] = {}
store(_encoders.clear)


def encoder(vocabulary: str = "byte_bpe_50k.tiktoken") -> Encoder:
    """One encoder a worker process."""
    enter("tokens")
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
