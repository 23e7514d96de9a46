"""Least hashes of the windows of a byte string: a sparse index for substrings of any length.

A window of `size` bytes is named by the least hash of its grams of half that size. Two strings that
share a window share its name, and neighbouring windows mostly have the same one, so a text has
about four different names for each `size` bytes. Strings of less than eight bytes are named by
themselves, and then a text has the names of all strings of exactly that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Lengths of windows.
EXACT = range(1, 8)
SIZES = [*EXACT, 8, 16, 32, 64]
#: Bytes of text that are looked at together.
SLICE = 1 << 18
#: Bits of a `Sieve`.
BITS = 1 << 24

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def size_for(length: int) -> int:
    """The longest window that a string of `length` bytes has."""
    return max(s for s in SIZES if s <= length)


def window_names(data: np.ndarray, size: int) -> np.ndarray:
    """The name of the window of `size` bytes at each place of `data` that has one."""
    if data.size < size:
        return np.zeros(0, dtype=np.uint64)
    if size in EXACT:
        value = np.zeros(data.size - size + 1, dtype=np.uint64)
        for i in range(size):
            value = (value << np.uint64(8)) | data[i : i + value.size]
        return _mixed(value | np.uint64(size << 56))
    grams, step = _BYTES[data], 1
    while 2 * step <= size // 2:
        grams = _mixed(grams[:-step] * _FACTOR + grams[step:])
        step *= 2
    least, step = grams, 1
    while 2 * step <= size // 2:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return _mixed(np.minimum(least[:-1], least[1:]) + np.uint64(size))


class Sieve:
    """A set of names that may hold some others too, in a fixed number of bits."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def word_of(name: np.ndarray) -> np.ndarray:
        return (name >> np.uint64(6)) & np.uint64(BITS // 64 - 1)

    def holds(self, names: np.ndarray) -> np.ndarray:
        return (self.words[self.word_of(names)] >> (names & np.uint64(63))) & np.uint64(1) == 1


def names_of(data: bytes, size: int) -> np.ndarray:
    """The different names of all windows of `size` bytes."""
    return np.unique(window_names(np.frombuffer(data, dtype=np.uint8), size))


def names_in(texts: list[bytes], sizes: list[int], sieve: Sieve) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of a text, name): the names of all windows of the texts that the sieve holds.

    Windows across the border of two texts count for the first one. A pair may come again in a
    later part of a text longer than a slice.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for low in range(0, data.size, SLICE):
        for size in sizes:
            names = window_names(data[low : low + SLICE + size - 1], size)
            fresh = np.ones(names.size, dtype=bool)
            fresh[1:] = names[1:] != names[:-1]
            # The first window of a text counts, whatever the text before it ends with.
            begins = ends[np.searchsorted(ends, low) : np.searchsorted(ends, low + names.size)] - low
            fresh[begins[begins < names.size]] = True
            at = np.flatnonzero(fresh)
            at = at[sieve.holds(names[at])]
            if at.size:
                text = np.searchsorted(ends, at + low, side="right")
                order = np.lexsort((names[at], text))
                text, own = text[order], names[at][order]
                new = np.ones(own.size, dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (own[1:] != own[:-1])
                yield text[new], own[new]
