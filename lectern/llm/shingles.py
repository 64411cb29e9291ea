"""Words and word shingles of many texts at once, as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(count: int) -> np.ndarray:
    out = np.full(count, MULTIPLIER, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the lower-cased texts in order, and the index at which each text's words begin."""
    lowered = [t.lower() for t in texts]
    codes = code_points("\n".join(lowered) + "\n")
    inside = word_characters()[codes]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[0::2], edge[1::2]
    text_begin = np.cumsum([0] + [len(t) + 1 for t in lowered])
    first_word = np.searchsorted(begin, text_begin)
    if not len(begin):
        return np.zeros(0, np.uint64), first_word
    size = end - begin
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(size.sum()) - np.repeat(at, size)
    values = (codes[inside].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[place]
    return scramble(np.add.reduceat(values, at) + size.astype(np.uint64)), first_word


def shingle_sets(texts: list[str], words: int, least_words: int) -> list[np.ndarray | None]:
    """For each text, its distinct sequences of ``words`` consecutive words as sorted hashes; None below ``least_words``."""
    hashes, first = word_hashes(texts)
    if len(hashes) >= words:
        mixed = np.zeros(len(hashes) - words + 1, dtype=np.uint64)
        for k in range(words):
            mixed = scramble(mixed * MULTIPLIER + hashes[k : len(hashes) - words + 1 + k])
    out: list[np.ndarray | None] = []
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist()):
        if end - begin < max(least_words, words):
            out.append(None)
            continue
        own = np.sort(mixed[begin : end - words + 1])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return out
