"""Hashes of many substrings, words and word shingles at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONE, _TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Rolling:
    """Hashes of any substring of a byte array: sums of letter values times powers, modulo 2**64."""

    def __init__(self, size: int) -> None:
        letters = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, (2, 256), dtype=np.uint64)
        self.letters = letters * _U(2) + _U(1)
        self.powers, self.inverses = [], []
        for base in (_ONE, _TWO):
            self.powers.append(self._powers(base, size))
            self.inverses.append(self._powers(pow(base, -1, 1 << 64), size))

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        powers = np.full(size + 1, _U(base))
        powers[0] = 1
        return np.cumprod(powers, dtype=np.uint64)

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(data.size + 1, dtype=np.uint64)
        np.cumsum(self.letters[which][data] * self.powers[which][: data.size], out=out[1:])
        return out

    def between(self, sums: np.ndarray, which: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (sums[last] - sums[first]) * self.inverses[which][first]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each run of bytes that are not white space."""
    inside = np.empty(data.size + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    hashes = rolling.between(rolling.sums(data, 0), 0, first, end)
    return first, mix(hashes + (end - first).astype(np.uint64))


def shingles(texts: list[bytes], size: int, chunk: int = 1 << 18):
    """Lists of texts in turn: (number of the first text, shingle hashes, count for each text).

    A shingle is `size` words in a row; a text of fewer words, if any, is one shingle by itself.
    """
    rolling = Rolling(max([2 * chunk, *(len(t) + 2 for t in texts)]))
    first = 0
    while first < len(texts):
        last, total = first + 1, len(texts[first]) + 1
        while last < len(texts) and total + len(texts[last]) + 1 <= 2 * chunk:
            total += len(texts[last]) + 1
            last += 1
        part = texts[first:last]
        data = np.frombuffer(b"\n".join(part), dtype=np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in part)])
        at, hashed = words(data, rolling)
        bounds = np.searchsorted(at, begins)
        n_words = np.diff(bounds)
        padded = np.concatenate((hashed, np.zeros(size, dtype=np.uint64)))
        grams = np.zeros(hashed.size, dtype=np.uint64)
        for i in range(size):
            grams = grams * _U(_ONE) + padded[i : i + hashed.size]
        counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
        for i in np.flatnonzero((n_words > 0) & (n_words < size)):
            value = np.full(1, n_words[i], dtype=np.uint64)
            for at_word in range(bounds[i], bounds[i + 1]):
                value = mix(value * _U(_TWO) + hashed[at_word : at_word + 1])
            grams[bounds[i]] = value[0]
        starts = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        yield first, mix(grams[starts + np.arange(counts.sum())]), counts
        first = last
