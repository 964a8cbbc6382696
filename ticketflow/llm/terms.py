"""Runs of letters in many texts at once, as Arrow arrays of terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are counted together before rows leave a task.
HELD_BYTES = 8 << 20

_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True


def any_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and of all characters above ASCII."""
    return _ASCII[data] | (data >= 0x80)


def latin_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and of the characters U+00C0 to U+00FF, which UTF-8 writes as 0xC3 and one more byte."""
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of set bytes."""
    step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def term_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """Slices of a byte array, in order and apart from each other, as one Arrow array."""
    offset = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offset[1:])
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[start] += 1
    step[end] -= 1
    kept = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offset), pa.py_buffer(kept)])


def held(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts have `most` bytes."""
    kept, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.column(text).nbytes
        if size >= most:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
