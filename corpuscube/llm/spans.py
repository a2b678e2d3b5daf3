"""Byte-level text primitives on Arrow batches, vectorised with numpy.

A chunk is a run of whole documents laid end to end: `data` (uint8) and `off` (int64,
one more than there are documents).  Chunks are bounded by bytes, so that working memory
does not depend on how many rows Arrow puts into a batch; one document longer than the
bound is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None


def release() -> None:
    """Give freed memory back to the system: Python workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

U = np.uint64
_rng = np.random.default_rng(20240607)
#: Of two hashes that have nothing in common: each byte's random 64-bit value, an odd base, and
#: the powers of the base and of its inverse modulo 2**64.
_BYTES = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
_BASES = [x for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F) for x in (base, pow(base, -1, 1 << 64))]
_powers = [np.ones(1, np.uint64) for _ in _BASES]


def _power(which: int, n: int) -> np.ndarray:
    got = _powers[which]
    while len(got) < n:
        step = U(pow(_BASES[which], len(got), 1 << 64))
        got = np.concatenate([got, got * step])
    _powers[which] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Prefix:
    """Hashes of arbitrary spans of one buffer, each by one subtraction and one product."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which, self.sums = which, np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * _power(2 * which, len(data)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _power(2 * self.which + 1, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * back[starts])

    def all(self, n: int) -> np.ndarray:
        """Of every span of n bytes, a product that `mix` would make a hash."""
        return (self.sums[n:] - self.sums[:-n]) * _power(2 * self.which + 1, len(self.sums) - n)


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[i] bytes of a from at_a[i] on are those of b from at_b[i] on, 8 at a time.
    Both buffers have 8 bytes to spare at their ends."""
    lanes = [np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)) for x in (a, b)]
    out, left, done = np.ones(len(size), bool), np.flatnonzero(size > 0), 0
    while len(left):
        rest = size[left] - done
        unused = (U(8) * (U(8) - np.minimum(rest, 8).astype(np.uint64))).astype(np.uint64)
        differ = (lanes[0][at_a[left] + done] ^ lanes[1][at_b[left] + done]) << unused
        out[left[differ != 0]] = False
        done += 8
        left = left[(rest > 8) & (differ == 0)]
    return out


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as its bytes and offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.binary()) if pa.types.is_string(col.type) else col
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    _, at, body = col.buffers()
    off = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(col: pa.Array, limit: int = CHUNK, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, data, off) of each chunk of a column: at most
    `limit` bytes and `most` rows, but a row at least."""
    data, off = flat(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(lo + most, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that no document's edge crosses: starts, ends, and where each
    document's runs begin in them (one more than there are documents)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    edges = off[(off > 0) & (off < n)]
    first[edges] = True
    last[edges - 1] = True
    starts = np.flatnonzero(inside & first)
    return starts, np.flatnonzero(inside & last) + 1, np.searchsorted(starts, off)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of each item, from where each document's items begin."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds, each by itself, so that equal segments have
    equal sums wherever they stand; empty segments sum to zero."""
    out = np.zeros(len(bounds) - 1)
    some = np.diff(bounds) > 0
    if some.any():
        out[some] = np.add.reduceat(np.asarray(values, np.float64)[: bounds[-1]], bounds[:-1][some])
    return out
