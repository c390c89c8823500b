"""Exact deduplication against a minimal perfect hash index of historical digests.

A history of digests is cut into shards by a hash of the digest. Each shard holds a minimal perfect hash over its
distinct digests: levels of bit arrays, in each of which a key owns a bit if no other key of that level falls on it;
the rank of the bit is the key's slot. A slot holds the full digest, the locator of the winner (its doc_id and row)
and how many historical rows have it. A probe finds at most one slot and compares all bytes of the digest, so a
digest that was never indexed can't be taken for a member. Members are repeats of a historical text; nonmembers are
grouped among themselves.

Digests are counted (with map-side sums) before they meet the index, so a text that a third of all rows share is one
probe. The only table with a row per document is the last join, whose other side has one row per text: Spark splits
its hot keys (adaptive skew join).

Defined results: a null text is the empty text; texts are compared after every run of white space (space, tab, line
feed, vertical tab, form feed, carriage return) has become one space, without trimming. Rows whose doc_id is null
are rows like any other but win only if no row of their group has an id. Of rows that repeat both id and text,
exactly one stays. Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardframe.llm.shared import semi, text_of, written

DIGEST_BYTES = 32
#: Digests of a shard, on average; a shard is built and probed in one task's memory (about 50 bytes each).
SHARD_DIGESTS = 32_768
#: Fewest shards, so that small inputs use all cores.
LEAST_SHARDS = 48
#: Bits of a level for each key that reaches it.
BITS_PER_KEY = 1.6
LEVELS = 64

INDEX_SCHEMA = "shard int, levels array<long>, bits binary, digests binary, ids binary, has_id binary, rows binary, counts binary"
CLASS_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long, member boolean"


def normalized(text: Column) -> Column:
    """Text with every run of white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` (unique) and the SHA-256 of the normalized text, once per row of ``docs``."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(normalized(text_of()), 256)).alias("digest"),
    )


def counted(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: the winner's locator and the number of rows."""
    return (
        rows.groupBy("digest")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("w"), F.count(F.lit(1)).alias("n"))
        .select("digest", F.col("w.doc_id").alias("id"), F.col("w.row").alias("row"), "n")
    )


def _keys(digest_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = digest_bytes.view(">u8").reshape(len(digest_bytes), 4).astype(np.uint64)
    return pairs[:, 0] ^ pairs[:, 2], (pairs[:, 1] ^ pairs[:, 3]) | np.uint64(1)


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    h = a + b * np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def perfect_hash(digest_bytes: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the bits of all levels, and the slot of each of the distinct digests (n x 32 bytes)."""
    a, b = _keys(digest_bytes)
    left, levels, bits, slots, base, taken = np.arange(len(a)), [], [], np.zeros(len(a), np.int64), 0, 0
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError(f"{len(left)} digests still collide after {LEVELS} levels")
        size = int(len(left) * BITS_PER_KEY) + 1
        at = _places(a[left], b[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        good = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[good]] = taken + rank[at[good]]
        taken += int(alone.sum())
        levels.append(size)
        bits.append(alone)
        base += size
        left = left[~good]
    return levels, np.concatenate(bits) if bits else np.zeros(0, bool), slots


def slots_of(digest_bytes: np.ndarray, levels: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest, or -1 where no level has a bit for it. A slot proves nothing before its bytes are checked."""
    out = np.full(len(digest_bytes), -1, np.int64)
    if not len(digest_bytes) or not len(bits):
        return out
    a, b = _keys(digest_bytes)
    rank, base, left = np.cumsum(bits) - 1, 0, np.arange(len(a))
    for level, size in enumerate(levels):
        at = base + _places(a[left], b[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left = left[~hit]
        base += size
    return out


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), DIGEST_BYTES)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _matrix(pdf["digest"])
    levels, bits, slots = perfect_hash(keys)
    order = np.argsort(slots)
    ids = pdf["id"]
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])],
            "levels": [levels],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [keys[order].tobytes()],
            "ids": [ids.fillna(0).to_numpy(np.int64)[order].tobytes()],
            "has_id": [ids.notna().to_numpy(bool)[order].tobytes()],
            "rows": [pdf["row"].to_numpy(np.int64)[order].tobytes()],
            "counts": [pdf["n"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def _winner(id_a, has_a, row_a, id_b, has_b, row_b):
    """The earlier of two locators: those with an id first, then by id, then by row."""
    first = np.where(has_a != has_b, has_a, np.where(has_a & (id_a != id_b), id_a < id_b, row_a <= row_b))
    return np.where(first, id_a, id_b), has_a | has_b, np.where(first, row_a, row_b)


def _classes(digest_bytes, ids, has, rows, counts, member) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "digest": [d.tobytes() for d in digest_bytes],
            "keep_id": pd.arrays.IntegerArray(np.asarray(ids, np.int64), ~has),
            "keep_row": rows,
            "group_size": counts,
            "member": member,
        }
    )


def _probe(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    parts = []
    keys = _matrix(new["digest"]) if len(new) else np.zeros((0, DIGEST_BYTES), np.uint8)
    has = new["id"].notna().to_numpy(bool)
    ids, rows, counts = new["id"].fillna(0).to_numpy(np.int64), new["row"].to_numpy(np.int64), new["n"].to_numpy(np.int64)
    member = np.zeros(len(new), bool)
    if len(index):
        s = index.iloc[0]
        levels = [int(x) for x in s["levels"]]
        bits = np.unpackbits(np.frombuffer(s["bits"], np.uint8), count=sum(levels)).astype(bool)
        held = np.frombuffer(s["digests"], np.uint8).reshape(-1, DIGEST_BYTES)
        h_ids, h_has = np.frombuffer(s["ids"], np.int64).copy(), np.frombuffer(s["has_id"], bool).copy()
        h_rows, h_counts = np.frombuffer(s["rows"], np.int64).copy(), np.frombuffer(s["counts"], np.int64).copy()
        slot = slots_of(keys, levels, bits)
        found = np.flatnonzero(slot >= 0)
        found = found[(held[slot[found]] == keys[found]).all(axis=1)]
        member[found] = True
        at = slot[found]
        h_ids[at], h_has[at], h_rows[at] = _winner(h_ids[at], h_has[at], h_rows[at], ids[found], has[found], rows[found])
        h_counts[at] += counts[found]
        parts.append(_classes(held, h_ids, h_has, h_rows, h_counts, np.ones(len(held), bool)))
    rest = ~member
    parts.append(_classes(keys[rest], ids[rest], has[rest], rows[rest], counts[rest], np.zeros(int(rest.sum()), bool)))
    return pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index over ``history`` (``digest, id, row, n``; digests distinct), one row per shard."""
    return history.select(_shard(shards), "digest", "id", "row", "n").groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def probe(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """Classes of the history and of ``new`` together; ``member`` tells whether the text is in the history."""
    dealt = new.select(_shard(shards), "digest", "id", "row", "n")
    return dealt.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe, CLASS_SCHEMA)


def exact_dedup(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, in_history, row`` for every row of ``docs``.

    The rows up to the id at ``history_share`` of the id range are the history; the later ones probe its index. The
    result does not depend on that share.
    """
    rows = written(digests(docs), "digests")
    span = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    shards = max(LEAST_SHARDS, -(-span.n // SHARD_DIGESTS))
    cut = (span.lo or 0) + int(((span.hi or 0) - (span.lo or 0)) * history_share)
    old = F.coalesce(F.col("doc_id") <= cut, F.lit(False))
    index = build_index(counted(rows.filter(old)), shards)
    classes = probe(index, counted(rows.filter(~old)), shards)
    return rows.join(classes, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
        "row",
    )


def keep_first(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` (of :func:`exact_dedup`) keeps, with the columns of ``docs``.

    Where all rows of an id stay, which is the rule, the id decides. Only where an id is repeated and some of its
    rows go, the text is read again to tell them apart.
    """
    by_id = written(
        verdicts.groupBy("doc_id").agg(F.sum(F.col("kept").cast("long")).alias("stay"), F.count(F.lit(1)).alias("n")), "kept"
    ).filter("stay > 0")
    whole = semi(docs, by_id.filter("stay = n").select(F.col("doc_id").alias("_id")))
    mixed = by_id.filter("stay < n").select(F.col("doc_id").alias("_id"))
    if mixed.isEmpty():
        return whole
    sha = F.sha2(normalized(text_of()), 256)
    again = semi(docs, mixed).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_id"), sha.alias("_sha"))
    wins = verdicts.filter("kept").select(F.col("doc_id").alias("_win"), F.col("text_sha256").alias("_win_sha")).distinct()
    some = again.join(wins, F.col("_id").eqNullSafe(F.col("_win")) & (F.col("_sha") == F.col("_win_sha")), "left_semi")
    return whole.unionByName(some.dropDuplicates(["_id", "_sha"]).select("_doc.*"))
