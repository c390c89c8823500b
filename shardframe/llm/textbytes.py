"""UTF-8 texts of an Arrow batch as one flat byte array, and the words in it as arrays of positions."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTES = np.arange(256)
#: Words of everything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Words of ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = (
    ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
)

_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


class _Kept(dict):
    """Arrays made once per process; they are made anew where this module's code is sent to."""

    def __reduce__(self):
        return _Kept, ()


_powers = _Kept()


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept between tasks, and so is what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts take about ``most`` bytes; a longer single text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 offsets of the texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 word offsets of the texts. Words never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edge] = inside[edge]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Longer ranges are hashed by a digest: sums of powers agree for some pairs of long periodic ranges, of 1,024 bytes at least.
LONG = 320


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte range: equal ranges get equal values in every batch."""
    out = _short_hashes(data, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def same_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the ranges ``left`` and ``right`` (indices) hold the same bytes, for each pair."""
    same = ends[left] - starts[left] == ends[right] - starts[right]
    for k in np.flatnonzero(same).tolist():
        a, b, n = starts[left[k]], starts[right[k]], ends[left[k]] - starts[left[k]]
        same[k] = data[a : a + n].tobytes() == data[b : b + n].tobytes()
    return same


def _short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges by sums of powers."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _power("base", _BASE, len(data)), out=sums[1:])
    values = (sums[ends] - sums[starts]) * _power("inverse", _INVERSE, len(data) + 1)[starts]
    return mixed(values + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes at every place that has so many."""
    n = len(data) - width + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _power("base", _BASE, len(data)), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _power("inverse", _INVERSE, n))


def windows(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` values inside a text: the values' index of its start, and the hash."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + values[k : k + n]
    starts = np.arange(n)
    owner = np.searchsorted(bounds, starts, "right") - 1
    starts = starts[starts + width <= bounds[owner + 1]]
    return starts, mixed(out[starts])


def ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones that Spark's long holds."""
    return values.view(np.int64)
