"""Elias-Fano sequences and the levels of an n-gram trie over them, queried for many keys at once."""

from __future__ import annotations

import tempfile

import numpy as np

_ONE = np.uint64(1)
_PIECE = 1 << 14


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` (from 0) in each 64-bit word."""
    words, rank = words.copy(), rank.astype(np.int64)
    place = np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.int64)
        right = rank >= low
        rank -= np.where(right, low, 0)
        place += np.where(right, width, 0)
        words = np.where(right, words >> np.uint64(width), words)
    return place


class EliasFano:
    """A non-decreasing sequence: the low bits of each value packed, the high bits as gaps in a bit vector.

    ``arrays()`` are all there is to it, so a sequence can be read from mapped memory as it lies.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        if bits:
            # In pieces: a piece's flags take a byte a bit, and shifts eight.
            places = np.arange(bits, dtype=np.uint64)
            bits_of = lambda part: np.packbits(((part[:, None] >> places) & _ONE).astype(np.uint8).ravel(), bitorder="little")
            packed = np.concatenate([bits_of(values[i : i + _PIECE]) for i in range(0, n, _PIECE)])
            low = np.zeros(len(packed) // 8 + 2, np.uint64)
            low.view(np.uint8)[: len(packed)] = packed
        else:
            low = np.zeros(2, np.uint64)
        marks = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (top >> bits) + n + 1
        flags = np.zeros((size // 64 + 1) * 64, np.uint8)
        flags[marks] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(n, bits, low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values number ``i``."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _below(self, part: np.ndarray) -> np.ndarray:
        """How many values have a high part under ``part``: the ones before zero number part - 1."""
        out = np.zeros(len(part), np.int64)
        some = np.flatnonzero(part > 0)
        k = part[some] - 1
        word = np.minimum(np.searchsorted(self.zeros, k, "right") - 1, len(self.high) - 1)
        out[some] = word * 64 + _select_in_word(~self.high[word], k - self.zeros[word]) - k
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Number of the first value >= x, n if there is none."""
        x = np.asarray(x, np.uint64)
        last = np.int64(self.zeros[-1]) - 1
        part = np.minimum((x >> np.uint64(self.low_bits)).astype(np.int64), last)
        begin, end = self._below(part), np.minimum(self._below(np.minimum(part + 1, last)), self.n)
        end = np.maximum(begin, np.where(part >= last, self.n, end))
        want = x & np.uint64((1 << self.low_bits) - 1)
        while (open_ := begin < end).any():
            middle = (begin + end) >> 1
            less = open_ & (self._low(np.minimum(middle, max(0, self.n - 1))) < want)
            begin, end = np.where(less, middle + 1, begin), np.where(open_ & ~less, middle, end)
        return begin


class Level:
    """One level of an n-gram trie: the n-grams that lie under each context, each with a code.

    ``pointers`` says where each context's n-grams begin. ``keys`` holds the keys of all contexts in a
    row: sorted within a context, and made monotone by adding the last value before the context's range,
    so an n-gram is found from its context by a successor search.
    """

    def __init__(self, pointers: EliasFano, keys: EliasFano, codes: np.ndarray):
        self.pointers, self.keys, self.codes = pointers, keys, codes

    @classmethod
    def build(cls, contexts: np.ndarray, keys: np.ndarray, n_contexts: int, codes: np.ndarray) -> Level:
        """``contexts``, ``keys``: those of each n-gram, sorted by both, no two the same."""
        begin = np.searchsorted(contexts, np.arange(n_contexts + 1))
        ends = np.zeros(n_contexts + 1, np.uint64)
        has = begin[1:] > begin[:-1]
        # Each range adds its last key to what came before; + 1 keeps equal neighbours of two ranges apart.
        ends[1:][has] = keys[begin[1:][has] - 1].astype(np.uint64) + _ONE
        return cls(EliasFano.of(begin), EliasFano.of(keys.astype(np.uint64) + np.cumsum(ends)[:-1][contexts]), codes)

    def places(self, contexts: np.ndarray, keys: np.ndarray, chunk: int = 1 << 17) -> np.ndarray:
        """Place of each n-gram in the level, -1 where it isn't there."""
        if len(keys) > chunk:
            return np.concatenate([self.places(contexts[i : i + chunk], keys[i : i + chunk]) for i in range(0, len(keys), chunk)])
        distinct, number = np.unique(contexts, return_inverse=True)
        begin = self.pointers.access(distinct).astype(np.int64)
        end = self.pointers.access(distinct + 1).astype(np.int64)
        base = np.zeros(len(distinct), np.uint64)
        some = begin > 0
        base[some] = self.keys.access(begin[some] - 1) + _ONE
        want = base[number] + keys.astype(np.uint64)
        place = self.keys.successor(want)
        found = np.flatnonzero((place >= begin[number]) & (place < end[number]))
        hit = found[self.keys.access(place[found]) == want[found]]
        out = np.full(len(keys), -1, np.int64)
        out[hit] = place[hit]
        return out

    def look_up(self, contexts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Code of each n-gram, 0 where it isn't there."""
        if not len(self.codes):
            return np.zeros(len(keys), np.uint16)
        place = self.places(contexts, keys)
        return np.where(place >= 0, self.codes[np.maximum(place, 0)], 0).astype(self.codes.dtype)

    def pack(self) -> bytes:
        """As it lies in a file: a head of 64-bit numbers, then the arrays, each from a multiple of 8 bytes."""
        parts = [*self.pointers.arrays(), *self.keys.arrays(), self.codes]
        head = np.array([self.pointers.n, self.pointers.low_bits, self.keys.n, self.keys.low_bits, self.codes.itemsize, *[len(p) for p in parts]], np.int64)
        return b"".join(p.tobytes().ljust(-(-p.nbytes // 8) * 8, b"\0") for p in (head, *parts))

    @classmethod
    def mapped(cls, packed: bytes) -> Level:
        """A packed level read from a memory-mapped scratch file, which goes with the last reference to it."""
        with tempfile.TemporaryFile() as file:
            file.write(packed)
            file.flush()
            memory = np.memmap(file, np.uint8, "r")
        head = memory[: 12 * 8].view(np.int64)
        kinds, parts, at = [np.uint64, np.uint64, np.int64] * 2 + [np.dtype(f"u{head[4]}")], [], 12 * 8
        for kind, n in zip(kinds, head[5:].tolist()):
            size = n * np.dtype(kind).itemsize
            parts.append(memory[at : at + size].view(kind))
            at += -(-size // 8) * 8
        return cls(EliasFano(int(head[0]), int(head[1]), *parts[:3]), EliasFano(int(head[2]), int(head[3]), *parts[3:6]), parts[6])
