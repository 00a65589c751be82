"""Hashes of byte ranges in batches of texts, by prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = np.random.default_rng(20240611)
BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: The separators of words as bytes.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hash of any byte range of ``data`` in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * _power("up", BASE, n), out=self.sums[1:])
        self.down = _power("down", _INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of at most ``max_bytes`` of text (one longer text alone), their bytes and offsets."""
    texts = batch.column(column)
    lengths = np.array(pc.binary_length(texts), np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        part = batch.slice(start, stop - start)
        yield part, _bytes(part.column(column)), np.concatenate([[0], ends[start:stop] - base])
        start = stop


def _bytes(texts: pa.Array) -> np.ndarray:
    """The bytes of a text column without nulls, joined."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]]
