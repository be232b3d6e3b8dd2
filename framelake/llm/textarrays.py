"""Small numpy helpers over the UTF-8 bytes of many texts at once.

A block of texts is one uint8 array and the offsets at which each text begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _POWER)
_tables: dict[str, np.ndarray] = {"power": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["power"]) < n:
        for name, base in (("power", _POWER), ("inverse", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["power"], _tables["inverse"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column's values one after another, and len + 1 offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows with about `size` bytes (one row at least): first row, end, bytes, offsets."""
    data, at = utf8(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def owner(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text in which each byte position lies."""
    return np.searchsorted(offsets, positions, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every run of bytes other than ASCII space, tab, LF, VT, FF, CR."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    ends[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, owner(offsets, starts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def counts_before(flags: np.ndarray) -> np.ndarray:
    """Running count of set flags, with a leading zero."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def shingle_hashes(hashes: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of `size` words; a text with fewer words has one, of all its words."""
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n = first[1:] - first[:-1]
    end = np.repeat(first[1:], n)
    at = np.arange(len(doc))
    keep = (at + size <= end) | ((at == first[:-1][doc]) & (n[doc] < size))
    at, end = at[keep], end[keep]
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        here = at + j < end
        part = hashes[np.minimum(at + j, len(hashes) - 1)] if len(hashes) else out
        out = out * _POWER + np.where(here, part, np.uint64(0))
    return mix(out), doc[at]
