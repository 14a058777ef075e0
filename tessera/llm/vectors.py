"""Words of Arrow text batches as numpy arrays: positions and 64-bit hashes.

A word is ``[^\\x20\\x09-\\x0D]+`` in UTF-8. Its hash sums a random 64-bit value
of each byte times a power of an odd constant (so that any stretch's hash comes
from two prefix sums), and is then mixed. Tables come from a fixed seed: every
task and run hashes alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text worked on at a time; one longer text is a slice by itself.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on the input's."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inverse = pow(BASE, -1, 1 << 64)
        tables = []
        for base in (BASE, inverse):
            t = np.full(size, base, U)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a slice of texts: ``start``/``end`` byte positions within
    ``data``, ``hash`` and, for text i, the words first[i] to first[i + 1].
    ``breaks`` marks the bytes between words."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashed: bool = True, breaks: np.ndarray = _SPACE):
        if texts.null_count:
            texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        n = len(texts)
        kind, buffers = (np.int64 if wide else np.int32), texts.buffers()
        at = np.frombuffer(buffers[1], kind, n + 1, texts.offset * kind().itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        raw = buffers[2]
        self.data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.text_at = at - at[0]
        word = ~breaks[self.data]
        size = len(self.data)
        edge = np.zeros(size + 1, bool)
        edge[self.text_at] = True
        before = np.empty(size, bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:size]))
        after = np.empty(size, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.text_at)
        if hashed:
            body = _LOWER[self.data] if lower else self.data
            power, inverse = _power_tables(size + 1)
            sums = np.zeros(size + 1, U)
            np.cumsum(_RANDOM[body] * power[:size], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of the text in ``column``."""
    for b in batches:
        if not b.num_rows:
            continue
        text = b.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
        upto = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            base = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, base + size, "right")))
            yield b.slice(at, to - at)
            at = to


def rolling_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, from running sums: a few steps whatever k."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    power, inverse = _power_tables(len(word_hash))
    sums = np.zeros(len(word_hash) + 1, U)
    np.cumsum(mix(word_hash) * power, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def window_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (len - k + 1 values)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(BASE) + word_hash[j:j + n]
    return mix(out)


def shingles(words: Words, i: int, k: int = 5) -> np.ndarray:
    """Distinct k-word shingle hashes of text i, ascending; a text with fewer words is one shingle."""
    h = words.hash[words.first[i]:words.first[i + 1]]
    if not len(h):
        return h
    if len(h) < k:
        return window_hashes(h, len(h)) ^ U(len(h))
    return np.unique(window_hashes(h, k))
