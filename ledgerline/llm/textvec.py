"""Vectorised word and byte handling over the buffers of Arrow string columns.

Everything works on slices of at most about ``SLICE`` bytes (one longer document makes one longer
slice), so memory is bounded by the slice and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 20
SLICE_DOCS = 4096

_U = np.uint64


def _mixer(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) | _U(1)


#: A-Z become a-z, every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: the space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes that separate words of letters and digits: 0-2F, 3A-60 and 7B-7F.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_BYTE = _mixer(11, 256)
_LENGTH = int(_mixer(12, 1)[0])
_LONG = 64  # bytes of a word from which on it is hashed by itself
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE, docs: int = SLICE_DOCS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes and ``docs`` rows together, one row at least."""
    n, at = len(bounds) - 1, 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(max(to, at + 1), at + docs, n)
        yield at, to
        at = to


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the last."""
    return np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


class Words:
    """The words of some documents: their byte ranges, hashes and the range of words of each document."""

    __slots__ = ("data", "starts", "ends", "first", "hashes")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, lower: bool, hashed: bool = True):
        data = LOWER[data] if lower else data
        n = len(data)
        out = separators[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = out[:-1]
        inside = ~out
        begin = inside & (before | edge[:-1])
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            after[:-1] = out[1:]
        self.data = data
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = self._hashes() if hashed else None

    def _hashes(self) -> np.ndarray:
        """Eight bytes at a time, each step a bijection of what went before; long words by themselves."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.uint64)
        eights = _eights(self.data)
        size = self.ends - self.starts
        out = mix((eights[self.starts] & _HEAD[np.minimum(size, 8)]) ^ size.astype(np.uint64) * _U(_LENGTH))
        live = np.flatnonzero((size > 8) & (size <= _LONG))
        for at in range(8, _LONG, 8):
            if not len(live):
                break
            left = size[live] - at
            out[live] = mix(out[live] ^ (eights[self.starts[live] + at] & _HEAD[np.minimum(left, 8)]))
            live = live[left > 8]
        whole = memoryview(self.data)
        for k in np.flatnonzero(size > _LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(whole[self.starts[k] : self.ends[k]], _LENGTH)
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


_LEFT, _RIGHT = (int(x) for x in _mixer(13, 2))


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs; what is folded between the products keeps it from being a polynomial in the values."""
    out = right >> _U(29)
    out ^= right
    out *= _U(_RIGHT)
    out += left * _U(_LEFT)
    out ^= out >> _U(32)
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive values (64-bit codes or bytes), by doubling; the caller masks those that cross documents."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    span, now = 1, hashes
    if hashes.dtype == np.uint8:
        span, now = (8, mix(_eights(hashes)[: len(hashes) - 7].copy())) if k >= 8 else (1, _BYTE[hashes])
    while span * 2 <= k:
        now = _paired(now[:-span], now[span:])
        span *= 2
    if span < k:
        now = _paired(now[: len(hashes) - k + 1], now[k - span :])
    return mix(now ^ _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def range_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of some ranges of contiguous units, over their bytes."""
    width, raw = units.itemsize, memoryview(np.ascontiguousarray(units).view(np.uint8))
    digest = xxhash.xxh3_64_intdigest
    found = (digest(raw[a:b], _LENGTH) for a, b in zip((starts * width).tolist(), (ends * width).tolist(), strict=True))
    return np.fromiter(found, np.uint64, len(starts))


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of ``n`` items, where row r holds items first[r] to first[r + 1]."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
