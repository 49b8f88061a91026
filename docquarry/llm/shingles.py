"""Multisets of word shingles of a batch of texts, vectorised over the batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import xxhash

from docquarry.llm.memos import only, register

#: Characters of text that are held as words at once.
CHUNK_CHARS = 1_000_000
MEMO_WORDS = 100_000
MASK48 = np.uint64((1 << 48) - 1)
PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (UTF-8) -> 64-bit hash, remembered for up to MEMO_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value


HASHES = WordHashes()
register("shingles", HASHES.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of these sizes with about CHUNK_CHARS characters; a longer text stands alone, and at most 65,536 go together."""
    start, chars, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > start and (chars + n > CHUNK_CHARS or i - start >= 1 << 16):
            yield start, i
            start, chars = i, 0
        chars += n
    if start <= i:
        yield start, i + 1


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    return spans(len(t) if t is not None else 0 for t in texts)


def multisets(texts: Sequence[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the texts, sorted by document and shingle.

    A shingle is a run of `words` words; a text of fewer words, but at least one, has all of them as its only shingle;
    an empty or null text has none. Shingles are 48-bit hashes (within two texts of 20,000 words a chance of 1e-6 that
    any two collide). Words are split at ASCII white space.
    """
    only("shingles")
    split = [text.encode("utf-8", "surrogatepass").split() if text else [] for text in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    h = np.empty(int(sizes.sum()), np.uint64)
    at = 0
    for w in split:
        h[at : at + len(w)] = np.fromiter(map(HASHES.__getitem__, w), np.uint64, len(w))
        at += len(w)
    ends = np.cumsum(sizes)
    keys = []
    if len(h) >= words:
        s = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            s = mix(s * PRIME + h[k : len(h) - words + 1 + k])
        doc = np.repeat(np.arange(len(sizes)), sizes)[: len(s)]
        fits = np.arange(len(s)) + words <= ends[doc]
        keys.append((doc[fits].astype(np.uint64) << np.uint64(48)) | (s[fits] >> np.uint64(16)))
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):
        own = np.array([xxhash.xxh64_intdigest(b" ".join(split[d])) for d in short], np.uint64)
        keys.append((short.astype(np.uint64) << np.uint64(48)) | (own >> np.uint64(16)))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & MASK48, count
