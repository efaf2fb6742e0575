"""Sets of word shingles as sorted 64-bit hashes, and MinHash signatures of them.

Words are runs of anything but ASCII white space, with A-Z in lower case. A word's hash adds up a
random number per byte times a power for its place; a shingle's hash chains those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from kinweave.llm.common import slices

CHUNK = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_OF_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C13)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_OF_BYTE[_IS_SPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in the bytes."""
    codes = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[codes]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    ends = np.append(starts[1:], len(codes))
    place = np.arange(starts[0], len(codes)) - np.repeat(starts, ends - starts)
    powers = np.full(int(place.max()) + 1, _STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return starts, mix(np.add.reduceat(_OF_BYTE[codes[starts[0]:]] * powers[place], starts - starts[0]))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many words each text has.

    A very long text is read piece by piece, cut at white space.
    """
    raw = [t.encode().lower() for t in texts]
    if sum(map(len, raw)) <= 4 * CHUNK:
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        starts, hashes = byte_words(b" ".join(raw))
        return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    found, counts = [], []
    for one in raw:
        parts, begin = [], 0
        while begin < len(one):
            end = begin + CHUNK
            while end < len(one) and not _IS_SPACE[one[end]]:
                end += 1
            parts.append(byte_words(one[begin:end])[1])
            begin = end
        found += parts
        counts.append(sum(map(len, parts)))
    return np.concatenate([np.empty(0, np.uint64), *found]), np.array(counts, np.int64)


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than ``width``, its words
    as one; without words, none."""
    for first, last in slices(texts, CHUNK):
        words, counts = word_hashes(texts[first:last])
        size = max(0, len(words) - width + 1)
        chained = np.zeros(size, np.uint64)
        for k in range(width if size else 0):
            chained = mix(chained * _STEP + words[k:k + size])
        place = 0
        for n in counts:
            if n >= width:
                yield np.unique(chained[place:place + n - width + 1])
            elif n:
                one = np.zeros(1, np.uint64)
                for k in range(n):
                    one = mix(one * _STEP + words[place + k:place + k + 1])
                yield mix(one + np.uint64(n))
            else:
                yield np.empty(0, np.uint64)
            place += n


def factors(length: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(seed))
    return (random.integers(0, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            random.integers(0, 1 << 63, length, dtype=np.uint64))


def signature(values: np.ndarray, scale: np.ndarray, shift: np.ndarray, bits: int = 16) -> np.ndarray:
    """For each hash function, ``bits`` bits of the smallest hash of the set."""
    least = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(values), 1 << 14):
        part = values[begin:begin + (1 << 14)]
        np.minimum(least, (part[None, :] * scale[:, None] + shift[:, None]).min(axis=1), out=least)
    return (mix(least) >> np.uint64(64 - bits)).astype(np.uint16)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
