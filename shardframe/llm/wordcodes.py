"""Words of a run of texts as codes of a dictionary: equal words have equal codes, by their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Code of every word and the words by code. Words are runs of bytes of a kind, cut at the edges of texts."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    body = data[kind[data]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def strings(column: pa.Array, missing: str) -> tuple[np.ndarray, pa.Array]:
    """Code of every row of a text column, and the values by code."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    found = column.cast(pa.large_string()).fill_null(missing).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
