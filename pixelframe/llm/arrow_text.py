"""Text columns of Arrow batches as bytes, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and each text's start with the end of the last. Nulls: empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def coded_runs(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Runs of the bytes that `solid` marks, within texts end to end: the distinct runs, each run's number among them,
    and where each begins. Runs are told apart by all their bytes."""
    mask = solid[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = mask[edges]
    start = np.flatnonzero(begins)
    kept = np.ascontiguousarray(data[mask])
    bounds = np.append(np.cumsum(mask, dtype=np.int64 if len(mask) >> 31 else np.int32)[start] - 1, len(kept)).astype(np.int64)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
    return runs.dictionary, runs.indices.to_numpy(), start


def pieces(batches: Iterable[pa.RecordBatch], text_col: str, most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in pieces of about most_bytes of text at most (a longer text is a piece of its own)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
            end = min(max(end, at + 1), at + most_rows, n)
            yield batch.slice(at, end - at)
            at = end
