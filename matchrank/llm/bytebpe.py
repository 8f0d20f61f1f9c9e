"""Byte-level BPE ids, exactly those of the tokenizers library, by its vocabulary on a faster engine.

The vocabulary is read through the library; its tokens in order of id are the merge ranks that the
tiktoken engine wants, and that engine merges the same pairs in a third of the time. The two follow
different Unicode versions, so a text with a character that newer versions assign, and a text that
holds a special token, is given to the library itself.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import regex

# fixed value: the pattern of the byte-level pre-tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable ones for themselves, the
    rest in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def unsure(char: str) -> bool:
    """Unassigned in this Python's tables, or outside the first plane and no pictograph."""
    return unicodedata.category(char) == "Cn" or (char > "￿" and not "\U0001f000" <= char <= "\U0001faff")


class ByteBpe:
    """Encodes texts to id bytes; ``dtype`` is the narrowest little-endian type for the vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._lib.get_vocab_size() <= 1 << 16 else "<u4")
        specials = {t.content for t in self._lib.get_added_tokens_decoder().values()}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in self._lib.get_vocab().items() if token not in specials}
        self._fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._special = regex.compile("|".join(map(regex.escape, specials))).search if specials else lambda s: None
        self._known: set[str] = set()

    def _sure(self, text: str) -> bool:
        if text.isascii():
            return True
        new = set(text) - self._known
        if any(map(unsure, new)):
            return False
        self._known |= new
        return True

    def encode(self, text: str) -> bytes:
        """The ids of a text, exactly the library's, as bytes of ``dtype``."""
        if self._special(text) or not self._sure(text):
            ids = self._lib.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast(text)
        return np.array(ids, self.dtype).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    return ByteBpe(path)
