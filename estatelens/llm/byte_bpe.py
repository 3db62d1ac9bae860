"""Byte-level BPE: the vocabulary of a tokenizer file and ids of whole texts.

Ordinary text goes through the ``tiktoken`` encoder, loaded with the vocabulary of the tokenizer file:
the same pieces, merges and ids as the ``tokenizers`` library, some four times as fast. A text that holds
one of the file's special strings goes whole through the ``tokenizers`` library, which gives those
strings their own ids. Tests hold the ids to those of the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import cached_property

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: How the vocabulary cuts a text into pieces (fixed value of byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """The byte each printable stand-in of a byte-level vocabulary means.

    Printable Latin-1 characters stand for themselves; the other bytes get the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, special strings and encoders of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = byte_of_character()
        self.ids = {
            bytes(to_byte[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.typecode = "H" if self.size <= 1 << 16 else "I"
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.path = path
        self.plain = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=self.ids, special_tokens={}
        ).encode_ordinary

    @cached_property
    def library(self) -> Tokenizer:
        """The tokenizer itself, loaded where a text needs it: it takes much memory."""
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def whole(self, text: str) -> list[int]:
        """Ids as the library gives them, special strings included."""
        return self.library.encode(text, add_special_tokens=False).ids


class Encoder:
    """Ids of texts as little-endian unsigned integers of the vocabulary's width."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.typecode = self.vocabulary.typecode
        self.width = array(self.typecode).itemsize

    def ids(self, text: str) -> list[int]:
        if self.vocabulary.special_pattern.search(text):
            return self.vocabulary.whole(text)
        return self.vocabulary.plain(text)

    def packed(self, text: str) -> bytes:
        return array(self.typecode, self.ids(text)).tobytes()


def crc32_of(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
