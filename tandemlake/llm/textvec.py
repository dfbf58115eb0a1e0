"""Vectorised views of Arrow string columns: lines, words, hashes, shingles.

Every function works on the UTF-8 bytes of many texts at once, so that Python
runs once per batch and not once per word. Texts are taken whole. A null text
counts as an empty one.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# White space that ends a word: blank and the control codes 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_MULT = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one at a time.
LONG = 64

#: Bytes of text that one vectorised step holds; longer texts are a step of their own.
STEP_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def steps(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds within them) of runs of rows of about STEP_BYTES."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        if len(chunk):
            if chunk.null_count:
                chunk = chunk.fill_null("")
            wide = pa.types.is_large_string(chunk.type)
            _, at, data = chunk.buffers()
            at = np.frombuffer(at, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
            data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            i = 0
            while i < len(chunk):
                j = int(np.searchsorted(at, at[i] + STEP_BYTES, "right")) - 1
                j = min(max(j, i + 1), len(chunk))
                yield base + i, base + j, data[at[i] : at[j]], at[i : j + 1] - at[i]
                i = j
        base += len(chunk)


def segments(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `inside` that don't cross a row bound."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (with the end as last)."""
    start, end = segments(~IS_SPACE[data], bounds)
    return start, end, np.searchsorted(start, bounds)


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (parted by newlines; a row has one at least), and each row's first."""
    cut = np.flatnonzero(data == 10)
    row = np.searchsorted(bounds, cut, "right") - 1
    n = np.bincount(row, minlength=len(bounds) - 1)[: len(bounds) - 1] + 1
    first = np.concatenate([[0], np.cumsum(n)])
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    start[first[:-1]], start[inner] = bounds[:-1], cut + 1
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    end[first[1:] - 1], end[inner] = bounds[1:], cut
    return start, end, first


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans (A-Z as a-z if `lower`).

    Eight bytes a step, each step mixed through all bits before the next, so no
    pair of texts made for a polynomial collides; spans of over LONG bytes go
    through a cryptographic hash.
    """
    size = (end - start).astype(np.int64)
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", held, 0, (1,))  # the eight bytes from each place on
    out = mix64(mix64(size.astype(np.uint64) + U64(0x9E3779B97F4A7C15)) ^ (eight[start] & _KEEP[np.minimum(size, 8)]))
    live = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, LONG, 8):
        if not len(live):
            break
        out[live] = mix64(out[live] + _MULT[k // 8] ^ (eight[start[live] + k] & _KEEP[np.minimum(size[live] - k, 8)]))
        live = live[size[live] > k + 8]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(held[start[k] : end[k]].data, digest_size=8).digest(), "little")
    return out


def shingles(word: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `width`-word shingles of each row, and each row's first.

    A row with fewer words has its whole sequence as one; a row without words none.
    """
    n = np.diff(first)
    many = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(n)), many)
    i = np.arange(at[-1]) - at[row] + first[:-1][row]
    out = np.zeros(len(i), np.uint64)
    full = n[row] >= width
    if full.all():
        for k in range(width):
            out += word[i + k] * _MULT[k]
        out += U64(width)
    else:
        for k in range(width):
            has = k < n[row]
            out[has] += word[i[has] + k] * _MULT[k]
        out += np.minimum(n[row], width).astype(np.uint64)
    return mix64(out), at


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, and each row's first."""
    if not len(values):
        return values, np.zeros(len(first), np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(first) - 1))])


def row_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each row's values (wrapping for unsigned ones)."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def release() -> None:
    """Give freed memory back: a Python worker is kept for later tasks, and its idle memory counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def releasing(run):
    """run(table), then release()."""

    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    return whole
