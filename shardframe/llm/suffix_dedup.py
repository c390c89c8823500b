"""Removal of repeated byte strings: deep-shallow suffix sorting over the places where documents can agree.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a document with a smaller doc_id. Which strings
to sort is decided without sorting all of them: every string of ``WIDTH`` bytes has one anchor, its ``GRAM``-byte part
of smallest hash, and equal strings have equal anchors at the same offset. Only strings whose anchor occurs in two
documents can repeat. The strings of one anchor make up one region of text, so one region stands for up to
``WIDTH - GRAM + 1`` suffixes.

1. Every chunk of documents sends its distinct anchors with the number of documents that have them. Anchors of two
   documents or more come back (a table of the shared anchors of each chunk).
2. Each chunk cuts out the regions of its shared anchors. Equal regions within a chunk go out once, for the smallest
   doc_id. An anchor of more than ``HOT`` documents is not gathered at one place: its suffixes go out one by one, dealt by a
   hash of their own bytes, so that only suffixes that are equal meet, once per chunk.
3. The regions of a range of anchors are sorted: equal regions first; then the suffixes of the remaining ones by
   multikey quicksort on eight-byte words to a shallow depth, and groups that still agree by blind tries, which look
   only at the bytes where a group branches. Each run of equal suffixes has a smallest doc_id, and each region learns
   which of its suffixes start in a smaller document.
4. The marks go back to their chunks, where the covered bytes are removed.

The texts move twice, compressed, next to what belongs to their chunk; the strings that move are those that can repeat.
Chunks are runs of rows within an input partition, found again by their first row's number; a chunk whose texts are not
those of step 1 fails the job rather than giving a wrong result, so ``docs`` must read the same rows every time (a
stored table does).

Defined results: a null text is empty; a text under ``WIDTH`` bytes loses nothing. Copies of a string within one
document, or in rows of the same doc_id, remove nothing. Rows of null doc_id count as after all others, and not
before each other. Strings are judged on the input. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm import textbytes
from shardframe.llm.shared import text_of, written

WIDTH = 50
GRAM = 20
SPAN = WIDTH - GRAM + 1
#: Bytes that the quicksort looks at before the tries take over.
SHALLOW = 16
#: Text bytes of a chunk, about, and its documents, at most.
CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 50_000
#: Text bytes per range of anchors, about, and the fewest ranges.
RANGE_BYTES = 16 << 20
LEAST_RANGES = 48
#: Bytes of text that a chunk's anchors are sought in at a time, and regions of a range that are sorted at a time.
SLICE_BYTES = 1 << 20
BATCH_REGIONS = 25_000
#: Documents that an anchor may have for its regions to be gathered at one place.
HOT = 20_000
LAST = np.iinfo(np.int64).max

PACKED = "part int, base long, kind int, data binary"
TEXTS, KEYS, LOCAL, REGIONS, MASKS = range(5)


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 64):
        part, base, kind, data = zip(*rows[at : at + 64])
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(base, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())],
            names=["part", "base", "kind", "data"],
        )


# Chunks and anchors


class Chunk:
    """Documents of a chunk: bytes one after the other, offsets, and ids (null as LAST)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> None:
        self.data, self.offsets, self.ids, self.has_id = data, offsets, ids, has_id
        self.order = np.where(has_id, ids, LAST)

    @classmethod
    def of(cls, parts: list[pa.RecordBatch]) -> Chunk:
        data, sizes = zip(*((d, np.diff(o)) for d, o in (textbytes.flat(p.column("text")) for p in parts)))
        ids = np.concatenate([p.column("doc_id").fill_null(0).to_numpy() for p in parts])
        has = np.concatenate([p.column("doc_id").is_valid().to_numpy(False) for p in parts])
        return cls(np.concatenate(data), np.r_[0, np.cumsum(np.concatenate(sizes))], ids, has)

    def pack(self) -> bytes:
        n = len(self.ids)
        return n.to_bytes(8, "little") + self.offsets.tobytes() + self.ids.tobytes() + self.has_id.tobytes() + _zip(self.data.tobytes())

    @classmethod
    def unpack(cls, raw: bytes) -> Chunk:
        n = int.from_bytes(raw[:8], "little")
        offsets = np.frombuffer(raw, np.int64, n + 1, 8)
        ids = np.frombuffer(raw, np.int64, n, 16 + 8 * n)
        has = np.frombuffer(raw, bool, n, 16 + 16 * n)
        return cls(np.frombuffer(_unzip(raw[16 + 17 * n :]), np.uint8), offsets, ids, has)

    def digest(self) -> bytes:
        """Tells chunks of other rows apart."""
        return hashlib.blake2b(self.order.tobytes() + self.offsets.tobytes() + self.data.tobytes(), digest_size=16).digest()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    """The chunks of an input partition, and the number of the first row of each."""
    held, size, docs = [], 0, 0
    for batch in batches:
        for part in textbytes.slices(batch):
            for cut in range(0, part.num_rows, CHUNK_DOCS // 2):
                piece = part.slice(cut, CHUNK_DOCS // 2)
                if held and (size > CHUNK_BYTES or docs + piece.num_rows > CHUNK_DOCS):
                    yield held[0].column("uid")[0].as_py(), Chunk.of(held)
                    held, size, docs = [], 0, 0
                held.append(piece)
                docs += piece.num_rows
                size += textbytes.flat(piece.column("text"))[0].size
    if held:
        yield held[0].column("uid")[0].as_py(), Chunk.of(held)


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of strings with one anchor: the anchor's key and place, the document, the first string's start, their number."""
    n = len(data) - WIDTH + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty, empty, empty, empty
    keys = textbytes.grams(data, GRAM)
    grams = len(keys)
    # The smallest hash of a string's grams; the first of equal ones, as the place fills the low bits.
    bits = np.uint64(len(data).bit_length())
    low = keys >> bits << bits | np.arange(grams, dtype=np.uint64)
    width = 1
    while 2 * width < SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Strings lie within their document.
    whole = np.ones(n, bool)
    for end in offsets[1:-1].tolist():
        whole[max(end - WIDTH + 1, 0) : min(end, n)] = False
    starts = np.flatnonzero(whole)
    if not len(starts):
        return empty.astype(np.uint64), empty, empty, empty, empty
    place = place[starts]
    new = np.r_[True, (place[1:] != place[:-1]) | (np.diff(starts) != 1)]
    first = np.flatnonzero(new)
    counts = np.diff(np.r_[first, len(starts)])
    begin = starts[first]
    owner = np.searchsorted(offsets, begin, "right") - 1
    # Smallest hashes lie close to zero: they are mixed once more, so that ranges of keys are even.
    return textbytes.mixed(keys[place[first]] + np.uint64(1)), place[first], owner, begin, counts


def anchors(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Anchors of a whole chunk; see :func:`_anchors`."""
    out, start, n = [], 0, len(chunk.ids)
    while start < n:
        end = int(np.searchsorted(chunk.offsets, chunk.offsets[start] + SLICE_BYTES, "right")) - 1
        end = min(max(end, start + 1), n)
        base = chunk.offsets[start]
        keys, place, owner, begin, counts = _anchors(chunk.data[base : chunk.offsets[end]], chunk.offsets[start : end + 1] - base)
        out.append((keys, place + base, owner + start, begin + base, counts))
        start = end
    return tuple(np.concatenate(x) for x in zip(*out)) if out else _anchors(np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _own(base: int) -> int:
    """A part below 0 for rows that only wait for others of their chunk."""
    return -1 - (base ^ base >> 33) % (2**31 - 1)


# 1. Shared anchors


def _send_keys(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, chunk in chunks(batches):
            keys, _, owner, _, _ = anchors(chunk)
            order = np.lexsort((chunk.order[owner], keys))
            keys, ids = keys[order], chunk.order[owner][order]
            rows = [(_own(base), base, TEXTS, chunk.digest())]
            if len(keys):
                other = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]
                keys, counts = np.unique(keys[other], return_counts=True)
                cuts = np.searchsorted(_part_of(keys, parts), np.arange(parts + 1))
                counts = np.minimum(counts, 65535).astype(np.uint16)
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    run = slice(cuts[p], cuts[p + 1])
                    rows.append((p, base, KEYS, keys[run].tobytes() + counts[run].tobytes()))
            yield from _rows(rows)
        textbytes.give_back()

    return run


def _shared_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the anchors of one range, those of several documents, back to each chunk with the number of documents."""
    if int(pdf["part"].iloc[0]) < 0:
        return pdf
    sent = [(np.frombuffer(d, np.uint64, len(d) // 10), np.frombuffer(d, np.uint16, len(d) // 10, len(d) // 10 * 8)) for d in pdf["data"]]
    keys, counts = np.concatenate([k for k, _ in sent]), np.concatenate([c for _, c in sent]).astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    opens = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    total = np.add.reduceat(counts[order], opens)
    keys, total = keys[opens][total > 1], total[total > 1]
    out = []
    for base, (mine, _) in zip(pdf["base"], sent):
        if len(keys):
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            known = keys[at] == mine
            if known.any():
                out.append((-1, base, KEYS, mine[known].tobytes() + (total[at[known]] > HOT).astype(np.uint8).tobytes()))
    return pd.DataFrame(out, columns=["part", "base", "kind", "data"])


# 2. Regions of shared anchors


def _send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for base, chunk in chunks(batches):
        yield from _rows([(0, base, TEXTS, chunk.digest() + chunk.pack())])
    textbytes.give_back()


def _chunk_of(texts: pd.DataFrame, known: pd.DataFrame) -> Chunk:
    raw = texts["data"].iloc[0]
    digest = known.loc[known["kind"] == TEXTS, "data"]
    if not len(digest) or digest.iloc[0] != raw[:16]:
        raise ValueError("the documents were not read in the same order twice; write them to a table first")
    return Chunk.unpack(raw[16:])


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    total = int(sizes.sum())
    if not total:
        return data[:0]
    ends = np.cumsum(sizes)
    return data[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def _regions(chunk: Chunk, shared: np.ndarray, hot: np.ndarray, parts: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """What the chunk keeps (places of its regions and which sent region stands for each), and the packed regions by part."""
    keys, _, owner, begin, counts = anchors(chunk)
    at = np.minimum(np.searchsorted(shared, keys), max(len(shared) - 1, 0))
    known = shared[at] == keys if len(shared) else np.zeros(len(keys), bool)
    keys, owner, begin, counts, hot_here = keys[known], owner[known], begin[known], counts[known], hot[at[known]]
    doc = chunk.order[owner]
    own = np.zeros(len(keys), np.uint64)
    cut = 0
    # Hashes of the regions, over runs of documents so that arrays stay small.
    while cut < len(keys):
        end = max(int(np.searchsorted(begin, begin[cut] + SLICE_BYTES)), cut + 1)
        base = begin[cut]
        stop = int((begin[cut:end] + counts[cut:end]).max()) + WIDTH - 1
        own[cut:end] = textbytes.hashes(chunk.data[base:stop], begin[cut:end] - base, begin[cut:end] - base + counts[cut:end] + WIDTH - 1)
        cut = end
    # The first of equal regions by doc_id is sent and stands for the others.
    order = np.lexsort((begin, doc, own, keys))
    same = np.r_[False, (keys[order][1:] == keys[order][:-1]) & (own[order][1:] == own[order][:-1])][: len(keys)]
    group = np.cumsum(~same) - 1
    sent = order[~same]
    stands = np.zeros(len(keys), np.int64)
    stands[order] = group
    later = doc > doc[sent][stands] if len(keys) else np.zeros(0, bool)
    local = len(keys).to_bytes(8, "little") + begin.astype(np.uint32).tobytes() + stands.astype(np.uint32).tobytes() + counts.astype(np.uint8).tobytes() + later.astype(np.uint8).tobytes()
    number = np.arange(len(sent))
    s_key, s_doc, s_begin, s_count, s_hot = keys[sent], doc[sent], begin[sent], counts[sent], hot_here[sent]
    step = np.zeros(len(sent), np.int64)
    if s_hot.any():
        # Single strings under the hash of their own bytes.
        h = np.flatnonzero(s_hot)
        times = s_count[h]
        which = np.repeat(h, times)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        lone = s_begin[which] + offset
        text = gathered(chunk.data, lone, np.full(len(lone), WIDTH))
        ends = np.arange(1, len(lone) + 1) * WIDTH
        lone_key = textbytes.hashes(text, ends - WIDTH, ends) if len(lone) else np.zeros(0, np.uint64)
        cold = ~s_hot
        number = np.r_[number[cold], which]
        s_key, s_doc = np.r_[s_key[cold], lone_key], np.r_[s_doc[cold], s_doc[which]]
        s_begin, s_count = np.r_[s_begin[cold], lone], np.r_[s_count[cold], np.ones(len(which), np.int64)]
        step = np.r_[step[cold], offset]
    part = _part_of(s_key, parts)
    order = np.lexsort((s_key, part))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        k = order[cuts[p] : cuts[p + 1]]
        text = gathered(chunk.data, s_begin[k], s_count[k] + WIDTH - 1)
        fixed = s_key[k].tobytes() + s_doc[k].tobytes() + number[k].astype(np.uint32).tobytes() + step[k].astype(np.uint8).tobytes() + s_count[k].astype(np.uint8).tobytes()
        out.append((p, len(k).to_bytes(8, "little") + _zip(fixed + text.tobytes())))
    return local, out


def _cut_regions(parts: int):
    def run(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            raise ValueError("the documents were not read in the same order twice; write them to a table first")
        base = int(texts["base"].iloc[0])
        chunk = _chunk_of(texts, known)
        sent = [(np.frombuffer(d, np.uint64, len(d) // 9), np.frombuffer(d, np.uint8, len(d) // 9, len(d) // 9 * 8)) for d in known.loc[known["kind"] == KEYS, "data"]]
        shared = np.concatenate([k for k, _ in sent]) if sent else np.zeros(0, np.uint64)
        hot = np.concatenate([h for _, h in sent]).astype(bool) if sent else np.zeros(0, bool)
        order = np.argsort(shared)
        local, regions = _regions(chunk, shared[order], hot[order], parts)
        rows = [(_own(base), base, TEXTS, texts["data"].iloc[0][:16]), (_own(base), base, LOCAL, _zip(local))]
        del chunk, local
        textbytes.give_back()
        return pd.DataFrame([*rows, *((p, base, REGIONS, d) for p, d in regions)], columns=["part", "base", "kind", "data"])

    return run


# 3. Sorting


def word_at(data: np.ndarray, starts: np.ndarray, depth: int, size: int = 8) -> np.ndarray:
    """``size`` bytes of each suffix from ``depth`` on, as a number that sorts as they do."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        out = out << np.uint64(8) | data[starts + (depth + k)]
    return out


def sort_suffixes(data: np.ndarray, starts: np.ndarray, width: int = WIDTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``width`` bytes, and the number of each one's run of equal suffixes.

    Shallow: within every group of suffixes that agree so far, the next eight bytes are one key; groups of one are
    done. Deep: a group that agrees to the shallow depth is a blind trie. Its node is the first place where any member
    leaves the first one; the members are dealt by the byte there alone, and the bytes before it are never sorted.
    """
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)
    active = np.arange(n)
    depth = 0
    while depth < shallow and len(active):
        size = min(8, width - depth)
        word = word_at(data, starts[order[active]], depth, size)
        active = _split(order, group, active, word)
        depth += size
    reach = np.full(n, depth)  # how far the members of a position's group are known to agree
    while len(active) and depth < width:
        opens, sizes = _groups(group, active)
        head = np.repeat(starts[order[active[opens]]], sizes)
        mine = starts[order[active]]
        leave = np.full(len(active), width)
        from_ = reach[active]
        at = from_.copy()
        open_ = np.arange(len(active))
        while len(open_):
            differs = data[mine[open_] + at[open_]] != data[head[open_] + at[open_]]
            leave[open_[differs]] = at[open_[differs]]
            open_ = open_[~differs]
            at[open_] += 1
            open_ = open_[at[open_] < width]
        branch = np.repeat(np.minimum.reduceat(leave, opens), sizes)
        live = branch < width
        active, branch = active[live], branch[live]
        if not len(active):
            break
        byte = data[starts[order[active]] + branch].astype(np.uint64)
        reach[active] = branch + 1
        active = _split(order, group, active, byte)
        active = active[reach[active] < width]
    return order, np.cumsum(np.r_[False, group[1:] != group[:-1]]) if n else group


def _groups(group: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    opens = np.flatnonzero(np.r_[True, group[active][1:] != group[active][:-1]])
    return opens, np.diff(np.r_[opens, len(active)])


def _split(order: np.ndarray, group: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sort the active positions by key within their groups, name the new groups, and return positions in groups of several."""
    mine = group[active]
    by = np.lexsort((key, mine))
    order[active] = order[active][by]
    key = key[by]
    new = np.r_[True, (mine[1:] != mine[:-1]) | (key[1:] != key[:-1])]
    opens = np.flatnonzero(new)
    sizes = np.diff(np.r_[opens, len(active)])
    # A group is named by its first position, which keeps names unique and in order.
    group[active] = np.repeat(active[opens], sizes)
    return active[np.repeat(sizes > 1, sizes)]


def marks(keys: np.ndarray, docs: np.ndarray, counts: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Of each region, as bits: which of its suffixes also start in a region of the same key with a smaller document.

    ``data`` holds the regions' bytes, ``counts + WIDTH - 1`` each.
    """
    n = len(keys)
    sizes = counts + WIDTH - 1
    begin = np.cumsum(sizes) - sizes
    full = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
    out = np.zeros(n, np.uint64)
    # Equal regions: only the one of the smallest document is left to compare.
    own = np.zeros(n, np.uint64)
    cut = 0
    while cut < n:
        end = max(int(np.searchsorted(begin, begin[cut] + SLICE_BYTES)), cut + 1)
        base, stop = begin[cut], begin[end - 1] + sizes[end - 1]
        own[cut:end] = textbytes.hashes(data[base:stop], begin[cut:end] - base, begin[cut:end] - base + sizes[cut:end])
        cut = end
    order = np.lexsort((docs, own, keys))
    same = np.r_[False, (keys[order][1:] == keys[order][:-1]) & (own[order][1:] == own[order][:-1])] if n else np.zeros(0, bool)
    group = np.cumsum(~same) - 1
    first = order[~same]
    of = np.zeros(n, np.int64)
    of[order] = first[group]
    # Keys of one region have nothing to compare.
    lone = np.ones(len(first), bool)
    k = keys[first]
    lone[1:] &= k[1:] != k[:-1]
    lone[:-1] &= k[1:] != k[:-1]
    rest = first[~lone]
    if len(rest):
        times = counts[rest]
        which = np.repeat(rest, times)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        order, run = sort_suffixes(data, begin[which] + offset)
        least = np.minimum.reduceat(docs[which[order]], np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))[run]
        smaller = np.flatnonzero(least < docs[which[order]])
        np.bitwise_or.at(out, which[order[smaller]], np.uint64(1) << offset[order[smaller]].astype(np.uint64))
    return np.where(docs > docs[of], full, out[of]) if n else out


def _sort_regions(pdf: pd.DataFrame) -> pd.DataFrame:
    """Marks of the regions of one range, back to their chunks."""
    if int(pdf["part"].iloc[0]) < 0:
        return pdf
    fields = []
    for raw in pdf["data"]:
        n = int.from_bytes(raw[:8], "little")
        body = _unzip(raw[8:])
        fields.append(
            (
                np.frombuffer(body, np.uint64, n),
                np.frombuffer(body, np.int64, n, 8 * n),
                np.frombuffer(body, np.uint32, n, 16 * n),
                np.frombuffer(body, np.uint8, n, 20 * n).astype(np.uint64),
                np.frombuffer(body, np.uint8, n, 21 * n).astype(np.int64),
                np.frombuffer(body, np.uint8, -1, 22 * n),
            )
        )
    masks = [np.zeros(len(f[0]), np.uint64) for f in fields]
    # Regions of one key meet in one batch of keys; each chunk's are sorted by key.
    sample = np.sort(np.concatenate([f[0] for f in fields]))
    cuts = np.unique(sample[BATCH_REGIONS::BATCH_REGIONS])
    edges = [np.r_[0, np.searchsorted(f[0], cuts, "left"), len(f[0])] for f in fields]
    starts = [np.r_[0, np.cumsum(f[4] + WIDTH - 1)] for f in fields]
    for k in range(len(cuts) + 1):
        some = [i for i, e in enumerate(edges) if e[k] < e[k + 1]]
        if not some:
            continue
        runs = [slice(edges[i][k], edges[i][k + 1]) for i in some]
        keys, docs, counts = (np.concatenate([fields[i][c][r] for i, r in zip(some, runs)]) for c in (0, 1, 4))
        data = np.concatenate([fields[i][5][starts[i][r.start] : starts[i][r.stop]] for i, r in zip(some, runs)])
        found, at = marks(keys, docs, counts, data), 0
        for i, r in zip(some, runs):
            masks[i][r] = found[at : at + r.stop - r.start]
            at += r.stop - r.start
    out = []
    for base, f, mask in zip(pdf["base"], fields, masks):
        mask = mask << f[3]
        hit = mask > 0
        if hit.any():
            out.append((-1, base, MASKS, f[2][hit].tobytes() + mask[hit].astype(np.uint32).tobytes()))
    del fields, masks, starts
    textbytes.give_back()
    return pd.DataFrame(out, columns=["part", "base", "kind", "data"])


# 4. Removal

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"


def _remove(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The documents of one chunk without the covered bytes."""
    if not len(texts):
        raise ValueError("the documents were not read in the same order twice; write them to a table first")
    chunk = _chunk_of(texts, known)
    raw = _unzip(known.loc[known["kind"] == LOCAL, "data"].iloc[0])
    n = int.from_bytes(raw[:8], "little")
    begin = np.frombuffer(raw, np.uint32, n, 8).astype(np.int64)
    stands = np.frombuffer(raw, np.uint32, n, 8 + 4 * n).astype(np.int64)
    counts = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64)
    later = np.frombuffer(raw, np.uint8, n, 8 + 9 * n).astype(bool)
    mask = np.zeros(int(stands.max()) + 1 if n else 0, np.uint64)
    for d in known.loc[known["kind"] == MASKS, "data"]:
        m = len(d) // 8
        np.bitwise_or.at(mask, np.frombuffer(d, np.uint32, m), np.frombuffer(d, np.uint32, m, 4 * m).astype(np.uint64))
    full = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
    bits = np.where(later, full, mask[stands] if n else full)
    change = np.zeros(len(chunk.data) + 1, np.int32)
    for k in range(SPAN):
        at = begin[(bits >> np.uint64(k) & np.uint64(1)) > 0] + k
        np.add.at(change, at, 1)
        np.add.at(change, at + WIDTH, -1)
    covered = np.cumsum(change[:-1], dtype=np.int32) > 0
    edge = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
    inside = covered.copy()
    inside[1:] &= covered[:-1]
    inside[edge] = False
    opens = np.flatnonzero(covered & ~inside)
    inside = covered.copy()
    inside[:-1] &= covered[1:]
    inside[np.r_[edge[1:], len(covered)][: len(edge)] - 1] = False
    closes = np.flatnonzero(covered & ~inside) + 1
    owner = np.searchsorted(chunk.offsets, opens, "right") - 1
    per = np.bincount(owner, minlength=len(chunk.ids))
    removed = np.bincount(owner, closes - opens, len(chunk.ids)).astype(np.int64)
    cuts = np.r_[0, np.cumsum(per)]
    shas, spans = [], []
    for k in range(len(chunk.ids)):
        a, b = chunk.offsets[k], chunk.offsets[k + 1]
        part = chunk.data[a:b]
        shas.append(hashlib.sha256(part[~covered[a:b]].tobytes() if removed[k] else part.tobytes()).hexdigest())
        spans.append([{"start": int(x - a), "stop": int(y - a)} for x, y in zip(opens[cuts[k] : cuts[k + 1]], closes[cuts[k] : cuts[k + 1]])])
    textbytes.give_back()
    return pd.DataFrame(
        {
            "doc_id": pd.arrays.IntegerArray(chunk.ids.copy(), ~chunk.has_id),
            "n_bytes": np.diff(chunk.offsets),
            "n_removed": removed,
            "n_spans": per,
            "kept_sha256": shas,
            "spans": spans,
        }
    )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (removed byte ranges) of every row."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    parts = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    sent = rows.mapInArrow(_send_keys(parts), PACKED)
    shared = written(sent.groupBy("part").applyInPandas(_shared_keys, PACKED), "anchors")
    texts = rows.mapInArrow(_send_texts, PACKED)
    regions = texts.groupBy("base").cogroup(shared.groupBy("base")).applyInPandas(_cut_regions(parts), PACKED)
    found = written(regions.groupBy("part").applyInPandas(_sort_regions, PACKED), "marks")
    return texts.groupBy("base").cogroup(found.groupBy("base")).applyInPandas(_remove, RESULT)
