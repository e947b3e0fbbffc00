"""Array kernels over Arrow text columns, shared by the operators that run Python.

A batch is cut into runs of whole rows of about a megabyte, so that the per-byte arrays
of a task stay small however many rows a batch holds; only a single longer text makes a
longer run. Texts are handled as UTF-8 bytes; a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: ASCII white space: the separators of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {1: np.ones(1, U64), 2: np.ones(1, U64)}
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def runs(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of at most limit bytes or one row."""
    column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of the words of [^\\x20\\x09-\\x0D]+; no word crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(n: int, inverse: bool) -> np.ndarray:
    key, base = (2, _INVERSE) if inverse else (1, _BASE)
    have = _powers[key]
    if len(have) < n:
        steps = np.full(max(n, 1 << 20), base, U64)
        steps[0] = 1
        _powers[key] = have = np.multiply.accumulate(steps)
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64, from 0: spans then hash in constant time."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _power(len(values), False), out=out[1:])
    return out


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_BYTE[data])


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values between starts and ends, the same wherever they stand."""
    return mix((pre[ends] - pre[starts]) * _power(len(pre), True)[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(byte_prefix(data), starts, ends)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if have < w else out


def as_i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
