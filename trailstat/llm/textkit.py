"""Words, hashes and windows of many texts at once, as numpy arrays over UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply, as in MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        codes = codes[_LOWER]
    codes[_SPACE] = 0
    return codes


_CODES = {lower: _byte_codes(lower) for lower in (False, True)}
#: For segments that hold spaces.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        n = max(n, 2 * _WINDOW)
        table = np.ones(n, np.uint64)
        table[1:] = np.uint64(base)
        table = np.multiply.accumulate(table)
        _powers[base] = table
    return table


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = _BYTES) -> np.ndarray:
    """64-bit hash of each segment; bytes between segments must have code 0."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(start, low + _WINDOW)))
        high = int(end[to - 1])
        values = codes[data[low:high]] * _power_table(_BASE, high - low)[: high - low]
        local = start[at:to] - low
        out[at:to] = np.add.reduceat(values, local) * _power_table(_INVERSE, high - low)[local]
        at = to
    return mix(out ^ ((end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB)))


class Words:
    """The words (runs of bytes other than the six spaces) of a batch of texts.

    start, end: byte places of each word in ``data``; first: for each text, the number of the first of
    its words (one more entry than texts).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~_SPACE[data]
        cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = solid
        opens = solid & ~before[:-1]
        opens[cuts] = solid[cuts]
        after = np.empty(len(data) + 1, bool)
        after[-1] = False
        after[:-1] = solid
        ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes = solid & ~after[1:]
        closes[ends] = solid[ends]
        self.data = data
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hash of each word's bytes (A-Z as a-z where ``lower``).

        A polynomial over random byte codes modulo 2**64, then mixed with the length. Unlike words of
        fewer than 1,024 bytes meet with a chance of about 2**-64 a pair.
        """
        return segment_hashes(self.data, self.start, self.end, _CODES[lower])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows of each text, and where each text's begin; a shorter text is one window."""
    n = len(hashes)
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    weights = mix(np.arange(11, 11 + k, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if n >= k else 0):
        rolled += hashes[j : n - k + 1 + j] * weights[j]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places = np.flatnonzero(counts[owner] >= k)
    out = np.empty(begin[-1], np.uint64)
    out[places] = rolled[(first[:-1] - begin[:-1])[owner[places]] + places]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[first[i] : first[i + 1]]
        out[begin[i]] = (own * weights[: len(own)]).sum(dtype=np.uint64) ^ np.uint64(0xE7037ED1A0B428DB * len(own) & (1 << 64) - 1)
    return mix(out), begin


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``max_bytes`` of text (or one row), each with its UTF-8 bytes and offsets; null as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
