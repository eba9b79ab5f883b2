"""Words of whole Arrow columns as 64-bit hashes, and runs of words: array code for use inside tasks.

A word is a run of characters other than ASCII blanks. Texts are read from the column's own buffer, so no Python
object is made per word; working memory stays near ``CHUNK`` bytes times a small factor plus 24 bytes a word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_draw = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _draw.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class Words(NamedTuple):
    """``hash``, ``row`` and place (``start``, ``end`` in ``data``) of every word; ``first``: index of each row's first word."""
    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _UP or len(_UP[0]) < n:
        most = max(n, 2 * CHUNK)
        made = [_powers(_BASE, most), _powers(pow(_BASE, -1, 1 << 64), most)]
        if n > 2 * CHUNK:  # one word of megabytes: not kept
            return made[0], made[1]
        _UP[:] = made
    return _UP[0], _UP[1]


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        part = data[start[i]:end[j - 1]]
        up, down = _tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:len(part)], out=sums[1:])
        a, b = start[i:j] - start[i], end[i:j] - start[i]
        out[i:j] = mix((sums[b] - sums[a]) * down[a])
        i = j
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 bounds of its rows in them; the column must hold no null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def words_of(column: pa.Array) -> Words:
    data, bounds = text_bytes(column)
    inside = _INSIDE[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[bounds] = True  # a row's first byte
    start = np.flatnonzero(inside & (opens[:-1] | ~np.concatenate([[False], inside[:-1]]))) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (opens[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 if len(data) else np.zeros(0, np.int64)
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(first))
    return Words(_hash_spans(data, start, end), row, start, end, data, first)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values, in order: doubled runs are joined, so the work grows with log k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    whole, size, have, done = h, 1, None, 0
    while True:
        if k & size:
            if have is None:
                have, done = whole, size
            else:
                n = len(h) - done - size + 1
                have, done = mix(have[:n] * np.uint64(0xD6E8FEB86659FD93) + whole[done:done + n]), done + size
        if size * 2 > k:
            return have[:len(h) - k + 1]
        n = len(whole) - size
        whole, size = mix(whole[:n] * np.uint64(0xA0761D6478BD642F) + whole[size:size + n]), size * 2


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:len(x) - size], x[size:]), size * 2
    if size < width:
        x = np.minimum(x[:len(x) - (width - size)], x[width - size:])
    return x
