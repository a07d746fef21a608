"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them, without a copy; a null is empty."""
    column = flat(column)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def sliced(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of the column; a longer text is a part of its own."""
    _, off = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A string column of the given byte spans."""
    n = len(start)
    length = np.maximum(end - start, 0)
    if null is not None:
        length = np.where(null, 0, length)
    off = np.zeros(n + 1, np.int64)
    np.cumsum(length, out=off[1:])
    at = np.repeat(start - off[:-1], length) + np.arange(off[-1])
    body = data[at] if len(at) else np.zeros(0, np.uint8)
    validity = None
    if null is not None and null.any():
        validity = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    out = pa.Array.from_buffers(
        pa.large_string(), n, [validity, pa.py_buffer(off.tobytes()), pa.py_buffer(body.tobytes())]
    )
    return out.cast(pa.string()) if off[-1] < 2**31 - 1 else out


def changes(columns: list[pa.Array]) -> np.ndarray:
    """For sorted rows: where a row's key differs from that of the row before (the first row always does)."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for column in columns:
        column = flat(column)
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def by_group(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups from batches whose rows are sorted by the keys: one table for each run of equal keys."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        if kept:
            head = pa.concat_tables([kept[-1].slice(kept[-1].num_rows - 1, 1), part.slice(0, 1)]).select(keys)
            if changes([flat(head.column(k)) for k in keys])[1]:
                yield pa.concat_tables(kept)
                kept = []
        cuts = np.flatnonzero(changes([flat(part.column(k)) for k in keys]))
        for a, b in zip(cuts, [*cuts[1:], None]):
            piece = part.slice(a, None if b is None else b - a)
            if b is None:
                kept.append(piece)
            elif kept:
                yield pa.concat_tables([*kept, piece])
                kept = []
            else:
                yield piece
    if kept:
        yield pa.concat_tables(kept)


def held_back(
    batches: Iterable[pa.RecordBatch], keys: list[str], shrink: Callable[[pa.Table], pa.Table]
) -> Iterator[pa.Table]:
    """Tables of whole groups, many groups at a time; the group a batch ends in waits, shrunk, for the next one."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        if rest is not None:
            part = pa.concat_tables([rest, part])
        last = int(np.flatnonzero(changes([flat(part.column(k)) for k in keys]))[-1])
        if last:
            yield part.slice(0, last)
        rest = shrink(part.slice(last))
    if rest is not None:
        yield rest
