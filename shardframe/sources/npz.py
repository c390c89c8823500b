"""Samples stored as npz archives inside larger files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shardframe.sources.files import read_ranges, small_batches

# Array and scalar fields of the two sample kinds.
KINDS = {
    "gpt": (("text",), ()),
    "bert": (("text", "types", "labels", "loss_mask", "padding_mask"), ("is_random", "truncated")),
}


def read_npz_samples(ranges: DataFrame, kind: str) -> DataFrame:
    """Add the fields of ``kind`` (``gpt`` or ``bert``) to ``(path, begin, end, …)``."""
    arrays, scalars = KINDS[kind]
    keep = ranges.columns
    fields = [*[f"`{c}` {t}" for c, t in ranges.dtypes], *[f"{a} array<bigint>" for a in arrays], *[f"{s} int" for s in scalars]]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            samples = [np.load(io.BytesIO(p), allow_pickle=False) for p in batch["payload"].to_pylist()]
            columns = [batch[c] for c in keep]
            columns += [pa.array([s[a].astype(np.int64).ravel() for s in samples], pa.list_(pa.int64())) for a in arrays]
            columns += [pa.array([int(s[x]) for s in samples], pa.int32()) for x in scalars]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *arrays, *scalars])

    return read_ranges(ranges).mapInArrow(load, ", ".join(fields))
