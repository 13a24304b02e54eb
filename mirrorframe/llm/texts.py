"""Words of many texts at once: boundaries and 64-bit hashes over whole UTF-8 buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_SPACES = [0x20, *range(0x09, 0x0E)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = _powers(self.base, 1 << 16), _powers(self.inverse, 1 << 16)

    def upto(self, n: int):
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(BYTE_BASE), Powers(WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over the word (the finaliser of SplitMix64); changes ``h``."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of ``values[start:end]`` for many spans, from one running sum."""
    return sums_hash(running_sums(values, powers), starts, ends, powers)


def running_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """What ``sums_hash`` needs of the values, whatever the spans."""
    up, _ = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums


def sums_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """``spans_hash`` from the running sums of the values."""
    _, down = powers.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


class Alphabet:
    """Which bytes belong to words, and what they count as in comparisons."""

    def __init__(self, separators, lower: bool):
        self.member = np.ones(256, bool)
        self.member[list(separators)] = False
        self.value = np.arange(1, 257, dtype=U64)
        if lower:
            self.value[65:91] += U64(32)


#: ``[^\x20\x09-\x0D]+`` as they are, the same with A-Z lower-cased, and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
SPACED = Alphabet(_SPACES, lower=False)
SPACED_LOWER = Alphabet(_SPACES, lower=True)
ALNUM_LOWER = Alphabet([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of the first byte of each word and of the one after its last; no word passes the end of its row."""
    inside = alphabet.member[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[heads], end[tails] = inside[heads], inside[tails]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class Words:
    """The words of a block of texts.

    ``starts``/``ends`` are byte positions, ``first[i]:first[i + 1]`` the words of
    row ``i``, ``hashes`` one 64-bit value for each word.
    """

    def __init__(self, column: pa.Array, alphabet: Alphabet):
        self.data, self.offsets = buffers(column)
        self.starts, self.ends = word_spans(self.data, self.offsets, alphabet)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = spans_hash(alphabet.value[self.data], self.starts, self.ends, BYTE_POWERS)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """How many words of its row follow each word, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive words from each word on; those that run over the end are cut there."""
    n = len(hashes)
    at = np.arange(n)
    return spans_hash(hashes, at, np.minimum(at + size, n), WORD_POWERS)
