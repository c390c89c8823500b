"""Near-duplicate classes: documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

Method: token-combination prefixes. All shingles (tokens) are counted over all documents, and every document orders
its tokens from the rarest to the most frequent. Two sets that are similar enough share a token among the first
``n - ceil(0.8 n) + 1`` of each (the prefix), and ``1 + e`` tokens if both prefixes are extended by ``e``. Tokens that
only one document has can't be shared, so a document with that many of them is done. Rare tokens of the prefix are
indexed singly. If no rare token is shared, all shared ones are frequent: then the prefix is extended by as many tokens
as there are slots, so two of the shared ones fall into one slot (pigeonhole), and the pairs of frequent tokens in a
slot are indexed. Entries with the same key are candidates. Candidates are grouped transitively, each group is
verified by exact overlap counts in blocks, and the verified links make up the components.

Steps and what moves:

1. Texts become chunks of documents: their tokens (64-bit hashes of the shingles), dealt by token range and packed,
   eight bytes for each token and document. A token that many documents of a chunk have is sent once with a number. So
   a token of a third of all documents costs one entry per chunk.
2. The counts of tokens found more than once return to their chunk, and the documents that can have a link are
   written with these tokens in order. Identical sets are collapsed to one (with map-side minimums).
3. Index entries meet by key: only the smallest and another document of a key are aggregated, so a hot key is no
   group, and the edges from each document to the smallest one make up the candidate groups.
4. A candidate group is cut into blocks of at most ``BLOCK`` documents; each pair of blocks is one task's unit. It gives
   a spanning forest of the links it finds, never the pairs. No candidate is dropped, whatever the size of a group.

Sets are compared by 56 bits of their hashes: chance makes one of 10^11 pairs of sets off by one.

Defined results: a null text, an empty one, and one of white space only have no set and are linked with nothing; rows
that repeat an id are rows of their own; rows of null id take part, and a component's id is the smallest id that is not
null in it. Ties need no rule. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardframe.llm import textbytes
from shardframe.llm.graph import components
from shardframe.llm.shared import semi, text_of, written

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Tokens of a chunk, about, and its documents, at most (an index of 16 bits).
CHUNK_TOKENS = 2_000_000
CHUNK_DOCS = 60_000
#: A token of more documents of a chunk than this is sent as one entry with their number.
HEAVY = 16
#: Bytes of text per token range, about, and the fewest ranges.
RANGE_BYTES = 12_000_000
LEAST_RANGES = 48
#: Tokens of more documents than this are indexed in pairs.
FREQUENT = 64
#: Documents of a block of a candidate group.
BLOCK = 256

LOW = np.uint64((1 << 48) - 1)

PACKED_SCHEMA = "part int, base long, kind int, data binary"
SET_SCHEMA = "uid long, doc_id long, n long, digest binary, tokens binary, counts binary"


# 1. Chunks


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct tokens of each text, sorted, one after the other; the text of each; sizes; and a digest of each set."""
    raw, offsets = textbytes.flat(texts)
    data = textbytes.LOWER[raw]
    starts, ends, bounds = textbytes.words(data, offsets, textbytes.SPACED)
    hashes = textbytes.hashes(data, starts, ends)
    at, keys = textbytes.windows(hashes, bounds, SHINGLE)
    owner = np.searchsorted(bounds, at, "right") - 1
    # The whole sequence of a text of fewer words is its one token.
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        inside = counts[short] > k
        word = hashes[np.where(inside, bounds[:-1][short] + k, 0)]
        whole = np.where(inside, whole * np.uint64(0xC2B2AE3D27D4EB4F) + word, whole)
    whole = textbytes.mixed(whole + counts[short].astype(np.uint64))
    owner, keys = np.concatenate([owner, short]), np.concatenate([keys, whole]) >> np.uint64(8)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])] if len(keys) else np.zeros(0, bool)
    owner, keys = owner[new], keys[new]
    sizes = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(sizes)
    raw = keys.tobytes()
    digests = [hashlib.blake2b(raw[8 * (e - s) : 8 * e], digest_size=16).digest() for e, s in zip(ends.tolist(), sizes.tolist())]
    return keys, owner, sizes, digests


def _chunk(base: int, ids: bytes, keys: np.ndarray, owner: np.ndarray, sizes: np.ndarray, digests: list[bytes], ranges: int) -> Iterator[tuple]:
    """Packed rows of one chunk: (part, base, kind, data). Kind 0: members; 1: heavy tokens and their documents;
    2: a token range's light tokens and documents; 3: a token range's heavy tokens and their numbers."""
    own = -1 - (base ^ base >> 33) % (2**31 - 1)
    yield own, base, 0, sizes.astype(np.int64).tobytes() + b"".join(digests) + ids
    # Documents that repeat a set of the chunk send nothing: the first one stands for them.
    first: dict[bytes, int] = {}
    stands = np.array([first.setdefault(d, k) for k, d in enumerate(digests)], np.int64)
    weight = np.bincount(stands, minlength=len(digests))
    sent = stands[owner] == owner
    keys, owner = keys[sent], owner[sent]
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    if not len(keys):
        return
    opens = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    number = np.add.reduceat(weight[owner], opens)
    many = np.diff(np.r_[opens, len(keys)])
    # Copies within the chunk count as documents, too.
    heavy = (many > HEAVY) | (number > many)
    heavy_here = np.repeat(heavy, many)
    packed = (keys & LOW) << np.uint64(16) | owner.astype(np.uint64)
    part = ((keys >> np.uint64(24)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    if heavy_here.any():
        yield own, base, 1, keys[heavy_here].tobytes() + owner[heavy_here].astype(np.uint16).tobytes()
    light = ~heavy_here
    # Keys are sorted, so a range of tokens is a run.
    cuts = np.searchsorted(part[light], np.arange(ranges + 1))
    data, marks = packed[light], (keys[light] >> np.uint64(48)).astype(np.uint8)
    for p in range(ranges):
        if cuts[p] < cuts[p + 1]:
            run = slice(cuts[p], cuts[p + 1])
            yield p, base, 2, data[run].tobytes() + marks[run].tobytes()
    where, total = opens[heavy], number[heavy]
    cuts = np.searchsorted(part[where], np.arange(ranges + 1))
    for p in range(ranges):
        if cuts[p] < cuts[p + 1]:
            run = slice(cuts[p], cuts[p + 1])
            yield p, base, 3, keys[where[run]].tobytes() + total[run].astype(np.int64).tobytes()


def _pack(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, docs, base, ids = [], 0, 0, None, []

        def flush():
            nonlocal held, tokens, docs, base, ids
            if held:
                sizes = np.concatenate([h[2] for h in held])
                shifts = np.r_[0, np.cumsum([len(h[2]) for h in held])]
                rows = list(
                    _chunk(
                        base,
                        b"".join([a for a, _ in ids]) + b"".join([b for _, b in ids]),
                        np.concatenate([h[0] for h in held]),
                        np.concatenate([h[1] + s for h, s in zip(held, shifts)]),
                        sizes,
                        [d for h in held for d in h[3]],
                        ranges,
                    )
                )
                held, tokens, docs, base, ids = [], 0, 0, None, []
                for at in range(0, len(rows), 64):
                    part, bases, kinds, data = zip(*rows[at : at + 64])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int32()), pa.array(bases, pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())],
                        names=["part", "base", "kind", "data"],
                    )

        for batch in batches:
            for part in textbytes.slices(batch):
                for cut in range(0, part.num_rows, CHUNK_DOCS // 2):
                    piece = part.slice(cut, CHUNK_DOCS // 2)
                    if docs + piece.num_rows > CHUNK_DOCS or tokens > CHUNK_TOKENS:
                        yield from flush()
                    if base is None:
                        base = piece.column("uid")[0].as_py()
                    sets = shingle_sets(piece.column("text"))
                    held.append(sets)
                    id_column = piece.column("doc_id")
                    ids.append((id_column.fill_null(0).to_numpy().tobytes(), id_column.is_valid().to_numpy(False).tobytes()))
                    tokens += len(sets[0])
                    docs += piece.num_rows
        yield from flush()
        textbytes.give_back()

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers of documents of the tokens of one range, back to the chunks that have them; members pass through."""
    if int(pdf["part"].iloc[0]) < 0:
        return pdf
    kind = pdf["kind"].to_numpy()
    light, heavy = [], []
    for k, data in zip(kind, pdf["data"]):
        if k == 2:
            n = len(data) // 9
            low = np.frombuffer(data, np.uint64, n) >> np.uint64(16)
            light.append(np.frombuffer(data, np.uint8, n, 8 * n).astype(np.uint64) << np.uint64(48) | low)
        else:
            n = len(data) // 16
            heavy.append((np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.int64, n, 8 * n)))
    keys = np.concatenate([*light, *(h[0] for h in heavy)])
    numbers = np.concatenate([*(np.ones(len(x), np.int64) for x in light), *(h[1] for h in heavy)])
    order = np.argsort(keys)
    keys = keys[order]
    opens = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    total = np.add.reduceat(numbers[order], opens)
    shared = total > 1
    keys, total = keys[opens][shared], total[shared]
    out, lights, heavies = [], iter(light), iter(heavy)
    for k, base, data in zip(kind, pdf["base"], pdf["data"]):
        if not len(keys):
            break
        mine = next(lights) if k == 2 else next(heavies)[0]
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        known = keys[at] == mine
        if known.any():
            found = mine[known].tobytes() + total[at[known]].tobytes()
            if k == 2:
                n = len(mine)
                found += (np.frombuffer(data, np.uint64, n)[known] & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
            out.append((-1, base, k, found))
    textbytes.give_back()
    return pd.DataFrame(out, columns=["part", "base", "kind", "data"])


# 2. Documents with their shared tokens, rarest first


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n that must hold one of the tokens it shares with a similar set."""
    return n - (n * PERCENT + 99) // 100 + 1


def _assemble(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members of one chunk; those that can have a link with their shared tokens and the numbers of these."""
    base = int(pdf["base"].iloc[0])
    kinds = dict.fromkeys(range(4), ())
    kinds |= {k: list(g["data"]) for k, g in pdf.groupby("kind")}
    members = kinds[0][0]
    m = len(members) // 33
    sizes = np.frombuffer(members, np.int64, m)
    ids, has_id = np.frombuffer(members, np.int64, m, 24 * m), np.frombuffer(members, bool, m, 32 * m)
    digests = [members[8 * m + 16 * k : 8 * m + 16 * k + 16] for k in range(m)]
    keys, total, owner = [], [], []
    for data in kinds[2]:
        n = len(data) // 18
        keys.append(np.frombuffer(data, np.uint64, n))
        total.append(np.frombuffer(data, np.int64, n, 8 * n))
        owner.append(np.frombuffer(data, np.uint16, n, 16 * n).astype(np.int64))
    known = [(np.frombuffer(d, np.uint64, len(d) // 16), np.frombuffer(d, np.int64, len(d) // 16, len(d) // 2)) for d in kinds[3]]
    if known:
        heavy, number = np.concatenate([k[0] for k in known]), np.concatenate([k[1] for k in known])
        order = np.argsort(heavy)
        heavy, number = heavy[order], number[order]
        for data in kinds[1]:
            n = len(data) // 10
            mine = np.frombuffer(data, np.uint64, n)
            at = np.minimum(np.searchsorted(heavy, mine), len(heavy) - 1)
            keys.append(mine)
            total.append(number[at])
            owner.append(np.frombuffer(data, np.uint16, n, 8 * n).astype(np.int64))
    if keys:
        keys, total, owner = np.concatenate(keys), np.concatenate(total), np.concatenate(owner)
        order = np.lexsort((keys, total, owner))
        keys, total, owner = keys[order], total[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(m + 1))
    else:
        cuts = np.zeros(m + 1, np.int64)
    shared = np.diff(cuts)
    may = np.flatnonzero((shared > 0) & (sizes - shared < prefix_length(sizes)))
    able = np.zeros(m, bool)
    able[may] = True
    textbytes.give_back()
    return pd.DataFrame(
        {
            "uid": base + np.arange(m),
            "doc_id": pd.arrays.IntegerArray(ids.copy(), ~has_id),
            "n": sizes,
            "digest": [d if n else None for d, n in zip(digests, sizes)],
            "tokens": [keys[cuts[k] : cuts[k + 1]].tobytes() if able[k] else None for k in range(m)],
            "counts": [np.minimum(total[cuts[k] : cuts[k + 1]], 2**31 - 1).astype(np.int32).tobytes() if able[k] else None for k in range(m)],
        }
    )


# 3. Index


def index_keys(n: int, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys under which a set is indexed. ``tokens`` are the shared ones, rarest first; the other ``n - len`` come before."""
    alone = n - len(tokens)
    prefix = int(prefix_length(np.int64(n)))
    rare = int(np.searchsorted(counts, FREQUENT, "right"))
    single = textbytes.mixed(tokens[: max(min(rare, prefix - alone), 0)])
    if alone + rare >= prefix:
        return single
    keys = [single]
    # The larger set of a pair has the pair's class of sizes; the smaller one is at least 0.8 of it.
    for band in range(n.bit_length(), (n * 100 // PERCENT).bit_length() + 1):
        slots = max(1, (1 << band - 1) // 8)
        some = tokens[rare : max(prefix + slots - alone, 0)]
        slot = (some % np.uint64(slots)).astype(np.int64)
        order = np.lexsort((some, slot))
        some, slot = some[order], slot[order]
        for step in range(1, len(some)):
            same = slot[step:] == slot[:-step]
            if not same.any():
                break
            a, b = some[:-step][same], some[step:][same]
            keys.append(textbytes.mixed(textbytes.mixed(a + np.uint64(band)) * np.uint64(3) + b))
    return np.unique(np.concatenate(keys))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            keys, uids = [], []
            for uid, n, tokens, counts in zip(*(part.column(c).to_pylist() for c in ("uid", "n", "tokens", "counts"))):
                k = index_keys(n, np.frombuffer(tokens, np.uint64), np.frombuffer(counts, np.int32))
                keys.append(textbytes.ordered(k))
                uids.append(np.full(len(k), uid))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(uids))], names=["key", "uid"])


# 4. Verification


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges make up a spanning forest."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    used = np.zeros(len(left), bool)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[b], used[k] = a, True
    return used


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    wanted = many[column] > 1
    owner, column = owner[wanted], (np.cumsum(many > 1) - 1)[column[wanted]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int((many > 1).sum()), 4096):
        run = slice(np.searchsorted(column, at), np.searchsorted(column, at + 4096))
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[run], column[run] - at] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links among the sets of two blocks (or of one)."""
    pdf = pdf.sort_values("uid")
    uids, n = pdf["uid"].to_numpy(), pdf["n"].to_numpy()
    if len(uids) < 2:
        return pd.DataFrame({"a": uids[:0], "b": uids[:0]})
    both = overlaps([np.frombuffer(t, np.uint64) for t in pdf["tokens"]])
    linked = 100 * both >= PERCENT * (n[:, None] + n[None, :] - both)
    left, right = np.nonzero(np.triu(linked, 1))
    used = _forest(left, right, len(uids))
    del both, linked
    if len(uids) > BLOCK // 2:
        textbytes.give_back()
    return pd.DataFrame({"a": uids[left[used]], "b": uids[right[used]]})


def sets_of(docs: DataFrame) -> DataFrame:
    """``uid, doc_id, n, digest, tokens, counts`` per row of ``docs`` (``uid, doc_id, text``; ``uid`` counts up within a
    partition); tokens only where a link is possible."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    packed = docs.select("uid", "doc_id", "text").mapInArrow(_pack(ranges), PACKED_SCHEMA)
    counted = packed.groupBy("part").applyInPandas(_count, PACKED_SCHEMA)
    return counted.groupBy("base").applyInPandas(_assemble, SET_SCHEMA)


def links(sets: DataFrame) -> DataFrame:
    """Edges ``a, b`` of a spanning forest of the links among different sets, one row of ``sets`` for each."""
    entries = written(sets.select("uid", "n", "tokens", "counts").mapInArrow(_index, "key long, uid long"), "entries")
    # Written, as are the other small tables below: then both sides of a join are dealt anew, and hot keys can be split.
    keys = written(
        entries.groupBy("key").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).filter("first < last").select("key", "first"), "keys"
    )
    candidates = (
        entries.join(keys, "key").filter("uid <> first").select(F.col("first").alias("a"), F.col("uid").alias("b"))
    )
    groups = components(candidates.distinct())
    sizes = written(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = (
        sets.select("uid", "n", "tokens")
        .join(groups.select(F.col("node").alias("uid"), "root"), "uid")
        .join(sizes.select("root", blocks.alias("blocks")), "root")
        .withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "uid", "n", "tokens")
    )
    return placed.groupBy("root", "i", "j").applyInPandas(_verify, "a long, b long")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, uid, digest, first`` for every row; ``first`` marks one row of each component."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")
    )
    sets = written(sets_of(rows), "sets")
    # One row per distinct set; a set that repeats keeps the row of the smallest uid.
    wanted = sets.filter("tokens IS NOT NULL")
    least = wanted.groupBy("digest").agg(F.min("uid").alias("uid"))
    found = links(wanted.join(least.select("uid"), "uid", "left_semi"))
    classes = written(sets.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("uid").alias("rep")), "reps")
    roots = components(found)
    named = sets.select("uid", "doc_id", "n", "digest").join(classes, "digest", "left").withColumn("rep", F.coalesce("rep", "uid"))
    named = named.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = written(named.select("uid", "doc_id", "n", "digest", F.coalesce("root", "rep").alias("root")), "classes")
    ids = written(
        named.groupBy("root").agg(
            F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("w")
        ),
        "components",
    )
    return named.join(ids, "root").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "uid", "digest", (F.col("uid") == F.col("w.uid")).alias("first")
    )


@F.arrow_udf(T.BinaryType())
def set_digest(texts: pa.Array) -> pa.Array:
    """Digest of the text's set; null without words."""
    _, _, sizes, digests = shingle_sets(texts)
    return pa.array([d if n else None for d, n in zip(digests, sizes)], pa.binary())


def keep_first(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with the columns of ``docs``.

    Where all rows of an id stay, which is the rule, the id decides. Only where an id is repeated and some of its
    rows go, the text is read again to tell them apart.
    """
    by_id = written(
        verdicts.groupBy("doc_id").agg(F.sum(F.col("first").cast("long")).alias("stay"), F.count(F.lit(1)).alias("n")), "first"
    ).filter("stay > 0")
    whole = semi(docs, by_id.filter("stay = n").select(F.col("doc_id").alias("_id")))
    mixed = by_id.filter("stay < n").select(F.col("doc_id").alias("_id"))
    if mixed.isEmpty():
        return whole
    again = semi(docs, mixed).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_id"), set_digest(text_of()).alias("_set")
    )
    wins = verdicts.filter("first").select(F.col("doc_id").alias("_win"), F.col("digest").alias("_win_set")).distinct()
    some = again.join(wins, F.col("_id").eqNullSafe(F.col("_win")) & F.col("_set").eqNullSafe(F.col("_win_set")), "left_semi")
    one = some.filter("_set IS NOT NULL").dropDuplicates(["_id", "_set"]).select("_doc.*")
    return whole.unionByName(one).unionByName(some.filter("_set IS NULL").select("_doc.*"))
