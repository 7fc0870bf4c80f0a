"""Word spans and 64-bit word hashes of whole Arrow batches, in numpy.

Texts stay the UTF-8 buffer Arrow delivers; no Python string is made for a
word. A hash is a polynomial over random byte values modulo 2^64, taken from
one running sum per slice, then mixed. Separators are ASCII, so splitting bytes
equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
LOWER = _low
#: Words are runs of anything but the ASCII white space 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply) on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BYTE_EXACT, BYTE_LOWER = _BYTE, _BYTE[LOWER]
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept up to the slice size."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES)
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, dtype=U)
                p[0] = 1
                made.append(np.cumprod(p, dtype=U))
        if size > SLICE_BYTES:
            return made[0], made[1]
        _powers["up"], _powers["down"] = made
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at, raw


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; ``at`` are offsets into ``data`` from 0. No word spans two rows."""
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    m = is_word[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = m[edges]
    last[edges - 1] = m[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, byte: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """64-bit hash of each span's bytes, with A-Z lowered unless ``byte`` is BYTE_EXACT."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(byte[data] * up[: len(data)], dtype=U, out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ ((end - start).astype(U) * U(0x9E3779B97F4A7C15)))


def word_hashes(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of a slice, in order."""
    s, e, row = spans(data, at, is_word)
    return hashes(data, s, e), row


def walk(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each slice of a string column."""
    at, raw = buffers(column)
    for i, j in slices(at):
        yield i, j, raw[at[i]: at[j]], at[i: j + 1] - at[i]


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (hash, row) of the ``width``-word shingles of each row; a row with
    fewer words, but some, gives its whole sequence as one."""
    step = mix(np.arange(1, width + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)
    n = len(h)
    if n >= width:
        v = h[: n - width + 1] * step[0]
        for i in range(1, width):
            v = v + h[i: n - width + 1 + i] * step[i]
        inside = row[: n - width + 1] == row[width - 1:]
        v, r = mix(v[inside]), row[: n - width + 1][inside]
    else:
        v, r = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    count = np.bincount(row, minlength=n_rows) if n else np.zeros(n_rows, dtype=np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(row, short)
        whole = [mix(np.array([sum(int(h[a + i]) * int(step[i]) for i in range(count[s])) + 977 * int(count[s]) & (1 << 64) - 1], dtype=U))[0]
                 for s, a in zip(short, first)]
        v, r = np.concatenate([v, np.array(whole, dtype=U)]), np.concatenate([r, short])
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    if len(v):
        keep = np.ones(len(v), dtype=bool)
        keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        v, r = v[keep], r[keep]
    return v, r
