"""BPE encoding of words by a walk over their trie, and decoding.

For every prefix of a word there is exactly one token that can be the last of its encoding: the token
that ends the prefix, is itself left whole by the merges, and does not merge across its left edge with
the last token of what stands before it. So the encoding of a word is a chain of last-token states, and
words with a common prefix share the states of that prefix.

The distinct words of a batch, sorted, are their trie laid out depth first: a word differs from its
neighbour only below the node where their paths part. Walking the list keeps the states of the current
path alone, works out each trie node once, and needs no memory for the trie itself.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.byte_bpe import PATTERN, Vocabulary
from estatelens.llm.workers import kept, slices

#: Pairs of tokens whose boundary is remembered; beyond that the memory starts anew.
REMEMBERED = 400_000
#: Words whose ids one process remembers from earlier batches; beyond that it starts anew.
WORDS = 500_000


class Merges:
    """Which two tokens may stand side by side.

    Ids follow the order of the merges. Taking a token apart along the merge that made it gives, from the
    last merge back to the first, the states next to the boundary; the pair stands unless at some moment
    the two neighbours would have merged earlier than the neighbours did with their own other sides.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.ids = vocabulary.ids
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        for token, number in sorted(self.ids.items(), key=lambda item: item[1]):
            if len(token) > 1:
                left, right = self.last_merge(token, number)
                self.halves[number] = (left, right)
                self.joined[left, right] = number

    def last_merge(self, token: bytes, number: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``: merge bytes by rank until two are left."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                range(len(parts) - 1),
                key=lambda i: self.ids.get(parts[i] + parts[i + 1], number),
            )
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def stand(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            known = self.known[key] = self.stand_apart(left, right)
        return known

    def stand_apart(self, left: int, right: int) -> bool:
        limit = 1 << 62  # the pair may not merge before this merge
        joined, halves = self.joined, self.halves
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            # undo the later of the two merges that made the neighbours
            parts = halves.get(left) if left > right else None
            if parts is None and right in halves and (left <= right or left not in halves):
                limit, right = right + 1, halves[right][0]
            elif left in halves:
                limit, left = left, halves[left][1]
            else:
                return True


class TrieEncoder:
    """Encodes the distinct words of a batch by their trie; decodes ids."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.merges = Merges(self.vocabulary)
        self.words_of = regex.compile(PATTERN).findall
        self.split_special = partial(
            re.split, "(" + self.vocabulary.special_pattern.pattern + ")"
        )
        # longest token by its last three bytes: where to start looking for the last token of a prefix
        self.longest: dict[bytes, int] = {}
        for token in self.vocabulary.ids:
            if len(token) > 2:
                self.longest[token[-3:]] = max(len(token), self.longest.get(token[-3:], 0))
        names = {i: token for token, i in self.vocabulary.ids.items()}
        names |= {i: text.encode() for text, i in self.vocabulary.special.items()}
        self.token = names.__getitem__
        self.known: dict[str, list[int]] = {}

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of each word."""
        ids, stand, longest = self.vocabulary.ids.get, self.merges.stand, self.longest.get
        known = self.merges.known.get
        out = {}
        last = [-1]  # last token of the prefix of each length of the current path
        size = [0]  # and its length
        path = b""
        for word in sorted(word.encode() for word in words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - longest(word[end - 3 : end], 2) if end > 2 else 0
                if start < 0:
                    start = 0
                while True:
                    token = ids(word[start:end])
                    if token is not None:
                        before = last[start]
                        if before < 0:
                            break
                        fits = known(before << 32 | token)
                        if fits or fits is None and stand(before, token):
                            break
                    start += 1
                last.append(token)
                size.append(end - start)
            path = word
            chain, at = [], len(word)
            while at:
                chain.append(last[at])
                at -= size[at]
            out[word.decode()] = chain[::-1]
        return out

    def encode_batch(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text between and including special strings."""
        special = self.vocabulary.special_pattern.search
        pieces = []
        for text in texts:
            if special(text):
                found = []
                for part in self.split_special(text):
                    found += [part] if part in self.vocabulary.special else self.words_of(part)
                pieces.append(found)
            else:
                pieces.append(self.words_of(text))
        return pieces

    def encode(self, texts: list[str]):
        """Ids of each text, one after the other; a new word of the batch is encoded once."""
        pieces = self.encode_batch(texts)
        if len(self.known) > WORDS:
            self.known = {}
        known = self.known
        known |= {text: [i] for text, i in self.vocabulary.special.items()}
        known |= self.encode_words({w for found in pieces for w in found if w not in known})
        for found in pieces:
            ids: list[int] = []
            for word in found:
                ids += known[word]
            yield ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token, ids)).decode("utf-8", errors="replace")


def encode_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded text if wanted.

    The digests are of the decimal ids joined by commas and of the text decoded from the ids. A null text
    is an empty one. Every row gives one row, also if it repeats another; an empty table gives none; a
    null id stays null; other columns are not read.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def encode(batches):
        encoder = kept(("trie_bpe", tokenizer), lambda: TrieEncoder(tokenizer))
        numbers = [str(i) for i in range(encoder.vocabulary.size)].__getitem__
        for batch in slices(batches, 1):
            rows = []
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                decoded = encoder.decode(ids)
                row = (
                    doc,
                    len(ids),
                    hashlib.sha256(",".join(map(numbers, ids)).encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                )
                rows.append((*row, ids, decoded) if with_ids else row)
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names
            )

    types = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(encode, types + ", ids array<long>, decoded string" * with_ids)
