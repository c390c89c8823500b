"""Shards as files: the bytes of each rank's samples, one after the other, with their new offsets."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.operators.sharding import RANK_DIR, SHARD_FILE
from shardframe.session import qualify
from shardframe.sources.files import AsideFile, read_ranges, write_file


def write_shards(ranges: DataFrame, index: DataFrame, directory: str) -> DataFrame:
    """Write every packed file and return ``(dp_rank, file_id, path, n_samples, bytes)``.

    ``ranges(sample_id, path, begin, end)`` are the sources, ``index`` comes from
    :func:`shardframe.operators.sharding.shard_index`. A file is a bounded group: it closes at its minimum
    of samples, and its bytes go to the open file one sample at a time. Beside each file are its index
    (``.idx``) and its sample ids (``.meta``). The result is lazy; its rows are the files written when it runs.
    """
    directory = qualify(ranges.sparkSession, directory)
    wanted = index.select("dp_rank", "file_id", "ord", "sample_id")
    loaded = read_ranges(ranges.select("sample_id", "path", "begin", "end").join(wanted, "sample_id"))
    name = F.concat(
        F.lit(directory.rstrip("/") + "/"), F.format_string(RANK_DIR, "dp_rank"), F.lit("/"), F.format_string(SHARD_FILE, "file_id")
    )
    rows = loaded.select("dp_rank", "file_id", name.alias("path"), "ord", "sample_id", "payload")
    placed = rows.repartition("dp_rank", "file_id").sortWithinPartitions("dp_rank", "file_id", "ord")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, out, ends, ids = [], None, None, [], []

        def close():
            if key is None:
                return
            size = out.close()
            # Published layout: the number of files, a line for the file with its count, a line of begin and end per sample.
            name = key[2].rpartition("/")[2]
            head = f"1\n./{name} {len(ends)}\n"
            lines = (f"{begin} {end}\n".encode() for begin, end in zip([0, *ends], ends))
            write_file(key[2] + ".idx", itertools.chain([head.encode()], lines))
            write_file(key[2] + ".meta", (f"{i}\n".encode() for i in ids))
            done.append((*key, len(ends), size))

        for batch in batches:
            # Payloads are taken one by one, so a file is never held.
            for at, (rank, file_id, path, sample) in enumerate(zip(*(batch[c].to_pylist() for c in ("dp_rank", "file_id", "path", "sample_id")))):
                if key != (rank, file_id, path):
                    close()
                    key, out, ends, ids = (rank, file_id, path), AsideFile(path), [], []
                out.write(batch["payload"][at].as_py())
                ends.append(out.size)
                ids.append(sample)
        close()
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*done)) or [[]] * 5
        names = ["dp_rank", "file_id", "path", "n_samples", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return placed.mapInArrow(write, "dp_rank bigint, file_id bigint, path string, n_samples bigint, bytes bigint")
