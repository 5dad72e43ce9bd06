"""Byte-level BPE ids through a bounded cache of words."""

from __future__ import annotations

import array
import base64
import functools
import sys

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
CACHED_WORDS = 600_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoding(path: str):
    """The tiktoken encoding of a rank file; the special string stands for itself, as the JSON form has it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def chunks(text: str) -> list[str] | None:
    """The text cut before each single blank between two visible characters, where tokens always end.

    None if it has a special string, or a blank that touches other white space: such a text is encoded whole.
    """
    if SPECIAL in text:
        return None
    parts = text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def _little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    numbers = array.array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.encoding = encoding(path)
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return _little(self.encoding.encode(text, allowed_special="all"))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = chunks(text)
        if parts is None:
            return self._ids(text)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for p in set(parts).difference(known):
            word = p[1:] if p[:1] == " " else p
            if not word or word[0].isspace() or word[-1].isspace():
                return self._ids(text)
            known[p] = _little(self.encoding.encode_ordinary(p))
        return b"".join([known[p] for p in parts])


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker."""
    return Encoder(path)
