"""Vectorised word spans and hashes over a batch of texts (numpy, inside tasks).

A batch of texts is one byte buffer plus offsets, as Arrow hands it over. A
word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, the same class
as the regular expression ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text (every byte of
a multi-byte character is 0x80 or more). Nothing here loops over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - loads pa.compute

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
_POW = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 1 << 16), MULT, dtype=np.uint64)
        p[0] = 1
        _POW = np.multiply.accumulate(p)
    return _POW[:n]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.cast(pa.large_binary()).fill_null(b"")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    n = len(col)
    offs = np.frombuffer(off, dtype=np.int64)[col.offset: col.offset + n + 1] if off is not None and n else np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(offs[0]), int(offs[-1])) if n else (0, 0)
    return buf[lo:hi], offs - lo


def is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return buf + (((buf >= 65) & (buf <= 90)).view(np.uint8) << 5)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(buf, offs, ~is_space(buf))


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes with ``inside``; none crosses rows."""
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    first = np.zeros(n + 1, dtype=bool)
    first[offs[:-1]] = True  # a text starts here
    prev = np.empty(n, dtype=bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | first[:n]))
    nxt = np.empty(n, dtype=bool)
    nxt[-1] = False
    nxt[:-1] = inside[1:] & ~first[1:n]
    ends = np.flatnonzero(inside & ~nxt) + 1
    rows = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, equal spans alike wherever they stand.

    Works window by window so that the 8-byte-per-byte temporaries stay small.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    step = 1 << 20
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + step, side="left"))
        j = max(j, i + 1)
        hi = int(ends[j - 1])
        p = powers(hi - lo + 1)
        acc = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * p[:-1], out=acc[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        # multiply up to a common power instead of dividing: exact modulo 2**64
        out[i:j] = (acc[e] - acc[s]) * p[hi - lo - s]
        out[i:j] = mix(out[i:j] * inverse_power(hi - lo))
        i = j
    return out


def inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(pow(int(MULT), -1, 1 << 64), n, 1 << 64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every k consecutive entries (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for d in range(k):
        h = mix(h * MULT + words[d: d + n] + np.uint64(d + 1))
    return h


def slices(batches, column: str, limit: int = 4 << 20):
    """Cut record batches so that a slice holds about ``limit`` bytes of ``column``.

    Every row stays whole; a text longer than ``limit`` is a slice of its own.
    The temporaries of a slice are some 20 times its bytes, so they stay small
    whatever the batch size of the session.
    """
    for b in batches:
        col = b.column(column)
        size = pa.compute.binary_length(col.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False) if len(col) else np.zeros(0)
        end = np.cumsum(size)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + limit, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
