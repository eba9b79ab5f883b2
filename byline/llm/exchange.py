"""Sorted key arrays sent from blocks of rows to ranges of keys and back.

A block (some megabytes of text) sends each range one row: the sorted 64-bit keys it has there with their values as
packed arrays. Keys are hashes, so ranges are equally full; the number of ranges grows with the input. A key that
every document holds reaches its range once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key; ascending keys have ascending ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def pack(block: int, keys: np.ndarray, ranges: int, where: np.ndarray | None = None, **values: np.ndarray) -> pa.Table:
    """One row per range that ascending ``keys`` touch: range, block, keys and the values, as bytes.

    ``where`` gives the ranges (ascending) of keys that are no hashes."""
    where = range_of(keys, ranges) if where is None else where
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    columns = {"range": pa.array([int(where[a]) for a, _ in spans], pa.int32()), "block": pa.array([block] * len(spans), pa.int32())}
    for name, x in {"keys": keys, **values}.items():
        columns[name] = pa.array([put(x[a:b]) for a, b in spans], pa.binary())
    return pa.table(columns)


def put(x: np.ndarray) -> bytes:
    """An array's bytes, all first bytes before all second ones: ascending keys and small numbers then compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpack(table: pa.Table, **types) -> list[np.ndarray]:
    """The packed columns of all rows, one after the other; ``types`` maps column names to array types."""
    out = []
    for name, kind in types.items():
        width = np.dtype(kind).itemsize
        parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column(name)]
        whole, at = np.empty((sum(map(len, parts)) // width, width), np.uint8), 0
        for part in parts:
            n = len(part) // width
            whole[at:at + n] = part.reshape(width, n).T
            at += n
        out.append(whole.view(kind).ravel())
    return out


def origins(table: pa.Table, column: str = "keys", width: int = 8) -> np.ndarray:
    """For every packed key the number of the row it came in."""
    sizes = [len(x.as_buffer()) // width for x in table.column(column)]
    return np.repeat(np.arange(len(sizes)), sizes)


def by_row(chosen: np.ndarray, origin: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, chosen positions of that row): positions ascend within a row."""
    cuts = np.searchsorted(origin[chosen], np.arange(rows + 1))
    for i in range(rows):
        if cuts[i] < cuts[i + 1]:
            yield i, chosen[cuts[i]:cuts[i + 1]]


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among ascending keys, -1 where it is absent."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)


def same_runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts in an ordered array."""
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]) if len(ordered) else np.zeros(0, np.int64)
