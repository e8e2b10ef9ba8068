"""Byte-level BPE ids of whole texts, as little-endian unsigned 32-bit integers.

The ids are those of the `tokenizers` library with the given vocabulary file; the same vocabulary
as ranks gives the same ids several times faster (tests compare the two). Where all white space of
a text is single spaces and line ends between words, the vocabulary's pattern needs no look-ahead,
and a plain one, a third faster, cuts alike.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers

NAME = "byte_bpe_50k"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
LOOK_AHEAD = r"|\s+(?!\S)|\s+"


class Bpe:
    """encode(text) gives an array of ids. specials: whether the special token's string is one id."""

    def __init__(self, path: str | None = None, specials: bool = True):
        import tiktoken

        with open(path or public_tokenizers.path(f"{NAME}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        made = functools.partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.whole = made("whole", pat_str=pattern)
        self.plain = made("plain", pat_str=pattern.replace(LOOK_AHEAD, r"|\s")) if pattern.endswith(LOOK_AHEAD) else self.whole
        self.allowed = {SPECIAL} if specials else set()

    def encode(self, text: str) -> np.ndarray:
        # the words lie between single spaces and line ends: each gap is one of these, and none is at either end
        plain = text.split() == text.replace("\n", " ").split(" ")
        encoding = self.plain if plain else self.whole
        return encoding.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())

    def decode(self, ids) -> str:
        return self.whole.decode_bytes([int(x) for x in ids]).decode("utf-8")


@functools.lru_cache(maxsize=4)
def shared(path: str | None = None, specials: bool = True) -> Bpe:
    """One encoder for all tasks of a worker."""
    return Bpe(path, specials)
