"""Token counts of whole texts, huge ones by overlapping chunks.

The tokenizer's vocabulary has word ends, and its pre-tokenizer drops white space: no token reaches over
a white-space character, and what stands left of one never changes the tokens right of it. Two things
follow. In a batch, a word costs the library one encoding however often it occurs. And a huge text can
be encoded in overlapping chunks: at an ASCII white-space character inside the overlap both chunks have
a boundary, the left chunk is complete up to it and the right one from it on. Chunks are spliced at the
first such character, after the tokens and offsets of both sides have been found equal up to the last
one in the overlap. Where there are not two, or the sides differ, the overlap is widened; a chunk
without any is extended to the next two at once, at worst to the end of the text, so counts are always
exact. Where blanks stand is known before anything is encoded, so a text without any is encoded once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estatelens.llm.workers import kept, strings

BLANK = re.compile("[\x20\x09-\x0d]")
#: Words encoded by one call of the library.
BLOCK = 4096


@dataclass
class Chunk:
    """Tokens of ``text[start:end]`` with offsets in the whole text."""

    start: int
    end: int
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def between(self, left: int, right: int):
        """Ids and offsets of the tokens that start in ``left`` … ``right``."""
        a, b = np.searchsorted(self.begins, (left, right))
        return self.ids[a:b], self.begins[a:b], self.ends[a:b]


class Counter:
    """Counts tokens with one tokenizer."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def encode(self, text: str):
        return self.library.encode(text, add_special_tokens=False)

    def of_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; words hold no ASCII white space."""
        out = []
        for start in range(0, len(words), BLOCK):
            block = words[start : start + BLOCK]
            edges = np.cumsum([0] + [len(w) + 1 for w in block])
            begins = np.array([o[0] for o in self.encode(" ".join(block)).offsets], dtype=np.int64)
            out.append(np.diff(np.searchsorted(begins, edges)))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, each distinct word of the batch encoded once."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        counts = self.of_words(words.dictionary.to_pylist())
        each = counts[words.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.int64)
        total = np.concatenate(([0], np.cumsum(each)))
        edges = lists.offsets.to_numpy()
        edges = edges - edges[0]
        return total[edges[1:]] - total[edges[:-1]]

    def chunk(self, text: str, start: int, end: int) -> Chunk:
        found = self.encode(text[start:end])
        offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2) + start
        return Chunk(start, end, np.array(found.ids), offsets[:, 0], offsets[:, 1])

    def splice(self, text: str, left: Chunk, right: Chunk) -> int | None:
        """Where ``right`` takes over from ``left``, or None if that can't be shown."""
        marks = [m.start() for m in BLANK.finditer(text, right.start, left.end)]
        if len(marks) < 2:
            return None
        first, last = marks[0], marks[-1]
        same = zip(left.between(first, last), right.between(first, last))
        return first if all(np.array_equal(a, b) for a, b in same) else None

    def reach(self, text: str, start: int, end: int, overlap: int) -> tuple[int, int]:
        """(end, overlap) of a chunk from ``start``, so that two blanks after its first character are in
        the overlap: it is widened for them, and the chunk made longer if it has not two."""
        width = overlap
        while end < len(text):
            marks = BLANK.finditer(text, max(start + 1, end - width), end)
            if next(marks, None) and next(marks, None):
                return end, width
            if end - width > start + 1:
                width *= 2
                continue
            marks = [m.start() for _, m in zip(range(2), BLANK.finditer(text, start + 1))]
            end = min(marks[1] + 1 + overlap, len(text)) if len(marks) == 2 else len(text)
            width = end - start - 1
        return end, width

    def of_huge(self, text: str, size: int, overlap: int) -> tuple[int, int, int]:
        """Tokens, chunks and widened overlaps of one text."""
        total, chunks, widened = 0, 1, 0
        done = 0  # everything before is counted
        end, width = self.reach(text, 0, min(size, len(text)), overlap)
        widened += width > overlap
        left = self.chunk(text, 0, end)
        while left.end < len(text):
            start, at, right = max(left.end - width, left.start + 1, done), None, None
            stop, wide = self.reach(text, start, max(min(start + size, len(text)), left.end + 1), overlap)
            right = self.chunk(text, start, stop)
            at = self.splice(text, left, right)
            if at is None or at < done:  # the sides differ: a wider overlap, or all of it in one chunk
                widened += 1
                if start > max(left.start + 1, done):
                    width *= 2
                else:
                    left = self.chunk(text, left.start, min(2 * left.end - left.start, len(text)))
                continue
            total += len(left.between(done, at)[0])
            done, left, width = at, right, wide
            widened += wide > overlap
            chunks += 1
        return total + len(left.between(done, len(text) + 1)[0]), chunks, widened


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    chunk_chars: int = 65_536,
    overlap_chars: int = 1_024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, and for huge texts n_chunks and n_widened.

    Texts of more than ``chunk_chars`` characters go by chunks, of any length beyond. A null text is an empty one: no bytes, no
    tokens, not over the limit. Every row gives one row, also if it repeats another; an empty table gives
    none; a null id stays null; other columns are not read.
    """

    def count(batches):
        counter = kept(("counter", tokenizer), lambda: Counter(tokenizer))
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sizes = pc.utf8_length(texts).to_numpy()
            huge = np.flatnonzero(sizes > chunk_chars)
            plain = texts if not len(huge) else pc.if_else(pa.array(sizes > chunk_chars), "", texts)
            tokens = counter.of_texts(plain)
            chunks, widened = np.ones(len(tokens), np.int32), np.zeros(len(tokens), np.int32)
            for at, text in zip(huge, strings(texts.take(pa.array(huge)))):
                tokens[at], chunks[at], widened[at] = counter.of_huge(
                    text, chunk_chars, overlap_chars
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(tokens, type=pa.int64()),
                    pa.array(tokens > limit),
                    pa.array(chunks),
                    pa.array(widened),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    types = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(count, types)
