"""Words and word shingles of a batch of texts as 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINAL = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * _FINAL[0]
    h = (h ^ (h >> np.uint64(27))) * _FINAL[1]
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Hashes of all words of a batch, text after text; text i has ``edges[i]:edges[i + 1]``."""

    hashes: np.ndarray
    edges: np.ndarray

    def windows(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each place on; the last k-1 of a text reach beyond it."""
        out = np.zeros(max(len(self.hashes) - k + 1, 0), dtype=np.uint64)
        for i in range(k):
            out = mixed(out + self.hashes[i : i + len(out)] * _MIX + np.uint64(k))
        return out


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts without nulls; ``lower``: with A-Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    digest = xxhash.xxh3_64_intdigest
    by_code = np.array([digest(w) if w else 0 for w in known], dtype=np.uint64)
    codes = coded.indices.to_numpy()
    edges = lists.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    if "" in known:  # what stands before or after white space at the ends of a text
        real = codes != known.index("")
        edges = np.concatenate(([0], np.cumsum(real)))[edges]
        codes = codes[real]
    return Words(by_code[codes] if len(codes) else np.zeros(0, np.uint64), edges)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles, letters A-Z in lower case.

    A text of fewer words has its whole sequence as its only one, a text without words none.
    """
    words = words_of(texts, lower=True)
    windows = words.windows(k)
    out = []
    for start, end in zip(words.edges[:-1].tolist(), words.edges[1:].tolist()):
        if end - start >= k:
            out.append(np.unique(windows[start : end - k + 1]))
        elif end > start:
            short = Words(words.hashes[start:end], np.array([0, end - start]))
            out.append(short.windows(end - start))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
