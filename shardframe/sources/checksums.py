"""MD5 of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shardframe.sources.files import io_parts, list_files, open_file

READ_BYTES = 8 << 20


def md5_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, md5)`` of every file, read as a stream."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for path in batch["path"].to_pylist():
                digest = hashlib.md5()
                with open_file(path) as handle:
                    while block := handle.read(READ_BYTES):
                        digest.update(block)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(sums, pa.string())], names=["path", "md5"])

    files = list_files(spark, paths).select("path").repartition(io_parts(spark), "path")
    return files.mapInArrow(stream, "path string, md5 string")
