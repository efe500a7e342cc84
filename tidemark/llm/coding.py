"""Words of whole Arrow columns of text as local codes: blocks of documents, each with a dictionary of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(*parts: int | tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes are among ``parts``: bytes, or (first, last)."""
    out = np.zeros(256, bool)
    for p in parts:
        a, b = (p, p) if isinstance(p, int) else p
        out[a : b + 1] = True
    return out


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased.
LETTERS_AND_DIGITS = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def row_blocks(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.Table]:
    """Consecutive rows with about ``size`` bytes in column number ``text``; a longer text ends the block it is in."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = done = 0
        while at < batch.num_rows:
            to = min(int(np.searchsorted(ends, done + size - n)) + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            n += int(ends[to - 1]) - done
            at, done = to, int(ends[to - 1])
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, bounds of the rows' bytes); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # a column without chunks stays one
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return _LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]


def word_spans(data: np.ndarray, bounds: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of ``solid`` bytes; words end where a row ends."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_word = solid[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = of_word[:-1], of_word[1:]
    return np.flatnonzero(of_word & (~before | first[:n])), np.flatnonzero(of_word & (~after | first[1:])) + 1


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, solid: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(dictionary of distinct words, code of each word)."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid[data]])])
    out = words.dictionary_encode()
    return out.dictionary, out.indices.to_numpy(zero_copy_only=False).astype(np.int64)
