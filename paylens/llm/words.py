"""Words of whole texts as NumPy arrays, for use inside Arrow tasks.

A word is a run of bytes outside space and ``\\x09-\\x0D``; in UTF-8 no other
character contains these bytes, so byte runs are the regex's words.  Hashes
are 64 bits: a table-mapped polynomial over the word's bytes, computed for all
words of a block with one prefix sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_CAP = 1 << 21  # bytes per prefix sum; longer words are hashed in parts

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _pows:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _pows[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _pows[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True,
                upto: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which do not overlap and ascend.

    With ``upto``, one row for the whole spans and one for each length in it:
    the hashes of the spans' first so many bytes (whole shorter spans).
    """
    table = _BYTE_LOWER if lower else _BYTE
    stops = [ends, *(np.minimum(ends, starts + n) for n in upto)]
    out = np.zeros((len(stops), len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + _CAP, "right"))
        if j <= i:  # one span longer than the cap: sum its parts
            for k, stop in enumerate(stops):
                lo, total, shift = int(starts[i]), 0, 1
                while lo < stop[i]:
                    hi = min(lo + _CAP, int(stop[i]))
                    up, _ = _powers(hi - lo)
                    part = int((table[buf[lo:hi]] * up[: hi - lo]).sum(dtype=np.uint64))
                    total = (total + part * shift) & 0xFFFFFFFFFFFFFFFF
                    shift, lo = shift * pow(_BASE, _CAP, 1 << 64) & 0xFFFFFFFFFFFFFFFF, hi
                out[k, i] = total
            i += 1
            continue
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[buf[lo:hi]] * up[: hi - lo], dtype=np.uint64, out=sums[1:])
        s = starts[i:j] - lo
        for k, stop in enumerate(stops):
            out[k, i:j] = (sums[stop[i:j] - lo] - sums[s]) * down[s]
        i = j
    for k, stop in enumerate(stops):
        out[k] = mix(out[k] + (stop - starts).astype(np.uint64))
    return out if upto else out[0]


@dataclass
class Block:
    """Some consecutive rows: ``buf`` their bytes, row r at offs[r]:offs[r + 1]; words by row."""
    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray  # words of row r: first[r]:first[r + 1]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """Number of True bytes in each row."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as empty."""
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of a column; null reads as empty, invalid bytes as U+FFFD."""
    data, offs = text_bytes(column)
    raw = memoryview(data)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield str(raw[a:b], "utf-8", "replace")


def blocks(column: pa.Array, size: int = BLOCK_BYTES, between: np.ndarray = SPACE) -> Iterator[Block]:
    """Rows of ``column`` in blocks of about ``size`` bytes (a longer text is a block of its own).

    ``between``: which bytes separate words.
    """
    data, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n)
        buf, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        in_word = ~between[buf]
        start, end = in_word.copy(), in_word.copy()
        start[1:] &= ~in_word[:-1]
        end[:-1] &= ~in_word[1:]
        full = np.flatnonzero(np.diff(o))
        start[o[full]] = in_word[o[full]]
        end[o[full + 1] - 1] = in_word[o[full + 1] - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        first = np.searchsorted(starts, o, "left")
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        yield Block(lo, hi, buf, o, starts, ends, row, first)
        lo = hi


_SHINGLE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word index of every window of ``n`` words inside one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1:])
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += hashes[k:k + m] * _SHINGLE[k]
    return mix(total[at]), at


def row_shingles(block: Block, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in row order (with repeats) and their row starts.

    A row with 1 to n - 1 words has one shingle, the whole sequence; a row
    without words has none.
    """
    win, at = windows(hashes, block.row, n)
    counts = block.n_words
    short = np.flatnonzero((counts > 0) & (counts < n))
    rows, vals = block.row[at], win
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            h = hashes[block.first[r]:block.first[r + 1]]
            total = (h * _SHINGLE[:len(h)]).sum(dtype=np.uint64, keepdims=True)
            extra[i] = mix(total + np.full(1, len(h), np.uint64) * _SHINGLE[15])[0]
        rows, vals = np.concatenate([rows, short]), np.concatenate([vals, extra])
        order = np.argsort(rows, kind="stable")
        rows, vals = rows[order], vals[order]
    return vals, np.searchsorted(rows, np.arange(len(counts) + 1), "left")
