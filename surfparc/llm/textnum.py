"""Byte-level text arithmetic in numpy, for use inside tasks.

Texts of a batch lie one after another in one byte buffer; ``offsets`` marks them.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words so that every bit depends on all."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, which serves many tasks."""
    module = sys.modules.setdefault("_surfparc_worker_cache", types.ModuleType("_surfparc_worker_cache"))
    return module.__dict__.setdefault(name, {})


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 .. n - 1, modulo 2**64."""
    out = np.full(n, BASE)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def token_runs(group: np.ndarray, offsets: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero group within a text: starts, ends, groups, 64-bit hashes."""
    n = len(group)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(group.dtype), none.astype(np.uint64)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(group[1:], group[:-1], out=change[1:])
    change[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(change)
    ends = np.append(at[1:], n)
    length = ends - at
    place = np.arange(n, dtype=np.int64) - np.repeat(at, length)
    h = np.add.reduceat(BYTE[lower] * powers(int(length.max()))[place], at)
    keep = group[at] != 0
    return at[keep], ends[keep], group[at[keep]], mix(h[keep] + length[keep].astype(np.uint64))


def owner(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row of the text in which each position lies."""
    return np.searchsorted(offsets, starts, side="right") - 1
