"""Vectorised word columns: numpy views over Arrow string buffers.

Every operator that walks words uses this module inside its Arrow tasks. A batch
of texts is cut into slices of bounded bytes; within a slice, word borders, word
hashes and the owning row come from whole-array numpy operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (_BASE, 0xC2B2AE3D27D4EB4F)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that end a word of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes that end a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True


class Words(NamedTuple):
    """Words of one slice: row borders, byte spans and 64-bit hashes."""

    bounds: np.ndarray  # rows + 1: the first word of each row
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray  # the slice's bytes, lower-cased if asked for

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _byte_codes(lane: int = 0) -> np.ndarray:
    raw = b"".join(hashlib.sha256(b"byte %d" % i).digest()[8 * lane : 8 * lane + 8] for i in range(256))
    return np.frombuffer(raw, "<u8").copy()


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept for slices of the usual size only."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        out = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > 2 * SLICE_BYTES:
            return out
        _powers[base] = have = out
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes): runs of rows of at most ``limit`` bytes, one row at least."""
    at, raw = buffers(column)
    for first, end in _runs(at, limit):
        yield first, end, at[first : end + 1] - at[first], raw[at[first] : at[end]]


def byte_runs(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows of at most ``limit`` bytes, one row at least."""
    return _runs(buffers(column)[0], limit)


def _runs(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    first, rows = 0, len(at) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end
        first = end


class Spans:
    """Prefix sums over a row of 64-bit codes: ``of`` gives a hash of each span of it, equal for equal spans.

    Hashes of two lanes are independent: together they are a 128-bit digest.
    """

    def __init__(self, codes: np.ndarray, lane: int = 0):
        base, self._inverse = _BASES[lane]
        self._total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _power(base, len(codes))[: len(codes)], out=self._total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self._total[end] - self._total[start]) * _power(self._inverse, len(self._total) - 1)[start]
        value += (end - start).astype(np.uint64) * _M1
        return mix(value)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes; spans may overlap."""
    return Spans(_byte_codes(lane)[data], lane).of(start, end)


def words(at: np.ndarray, data: np.ndarray, stops: np.ndarray = SPACE, lower: bool = True) -> Words:
    """All words of a slice. ``stops``: the 256 flags of bytes that no word holds."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)  # one stop on each side
    np.logical_not(stops[data], out=inside[1:-1])
    cut = at[1:-1]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    inner = cut[(cut > 0) & (cut < n)]
    opens[inner] = inside[inner + 1]
    closes[inner - 1] = inside[inner]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(np.searchsorted(start, at), start, end, span_hashes(data, start, end), data)


def hash_words(texts: list[str], stops: np.ndarray = SPACE, lower: bool = True) -> list[np.ndarray]:
    """Word hashes of each text."""
    out: list[np.ndarray] = []
    for _, _, at, data in slices(pa.array(texts, pa.large_string())):
        w = words(at, data, stops, lower)
        out += [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return out


def crc_mod(ids, m: int):
    """crc32 of the decimal text of each id, modulo m."""
    import zlib

    return np.fromiter((zlib.crc32(str(i).encode()) % m for i in ids), np.int64, len(ids))
