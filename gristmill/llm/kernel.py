"""Numpy kernels over Arrow strings: words and shingles of a batch of texts as flat arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that a slice of a batch holds, unless one text has more.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts as bytes and offsets. Null texts are empty."""
    text = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_string())
    if not len(text):
        return
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(n, b, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more entry than texts)."""
    n = len(data)
    full = np.ones(n + 1, bool)
    if n:
        np.logical_not(BLANK[data], out=full[:n])
    full[n] = False
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, full[:-1]
    starts = np.flatnonzero(full & (~before | edge))
    stops = np.flatnonzero(before & (~full | edge))
    return starts, stops, np.searchsorted(starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    n = len(data)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_KEYS[data] * up[:n], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64))


def words(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and each text's first word."""
    data = LOWER[data] if lower else data
    starts, stops, first = word_spans(data, ends)
    return span_hashes(data, starts, stops), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles and their bounds; a text of fewer words is one shingle, one of none has none."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
    stop = np.repeat(first[1:], count)
    total = np.zeros(len(at), U64)
    last = max(len(hashes) - 1, 0)
    for j in range(k):
        x = hashes[np.minimum(at + j, last)] if len(hashes) else total
        total = total * U64(0xD6E8FEB86659FD93) + np.where(at + j < stop, x, U64(0))
    return mix(total), bounds
