"""Exact top-k search by inner product: buckets of vectors of like length, pruned by local cosine thresholds.

Method: norm-bucketed retrieval. Components become the integers ``floor(256 * x)``. All vectors are range-partitioned by
falling length, and each partition (a cell) is cut into buckets of at most ``BUCKET`` vectors whose shortest has at least
``RATIO`` of the length of the longest. Every query first meets the few buckets of the longest vectors; its k-th best score there
is its threshold. A bucket whose longest vector is ``l`` can only matter to a query ``q`` if the local cosine threshold
``threshold / (|q| * l)`` is at most 1. Where it is, the bucket is searched by one of two prunings:

- length, for low thresholds: only vectors of length ``threshold / |q|`` at least, a prefix of the bucket, in one product
  of matrices;
- coordinates, for thresholds from ``COORD_LEAST``: in the query's largest coordinates the unit vectors that can reach the
  threshold lie in an interval around the query's own, found by binary search in the bucket's sorted column. Queries whose
  interval holds over ``COORD_SHARE`` of the bucket go by length after all.

What is left is verified by exact products, and the threshold rises to the k-th best found. Pruning allows for rounding, so
which way a bucket is searched never changes the result.

What moves: queries are packed in groups of ``GROUP`` of like threshold per length, and a group meets the cells that hold a
vector long enough for one of its queries, no others. Group and cell are the unit of a task, bounded on both sides; a vector that
repeats any number of times is spread over cells by its row. Each unit returns at most k rows a query, ranked in one window of a query's rows.

Exactness: products below 2^53 are exact in double precision (lengths decide by Cauchy-Schwarz); longer vectors are
multiplied as Python integers, and a score that no long can hold counts as the nearest long.

Defined results: a vector that is null, or holds a null, a NaN, an infinity, or a component whose 256-fold is infinite, takes no part. A shorter
vector counts as filled up with zeros, so an empty one has score 0 with all. Rows that repeat are rows of their own: a query's candidates are all
rows but its own, others of the same id included. Rows of null id are candidates (last among ties), never queries.
Without queries or candidates there are no rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardframe.llm import textbytes
from shardframe.llm.shared import written

K = 5
#: Queries are rows whose id this divides.
QUERY_EVERY = 50
SCALE = 256.0
#: Vectors of a bucket, and its shortest as a share of its longest.
BUCKET = 2048
RATIO = 0.9
#: Vectors of a cell, about, and queries of a group.
GROUP = 65_536
#: Buckets of the longest vectors that give the first thresholds.
SEEDS = 4
#: Local cosine threshold from which coordinates prune; the share of a bucket up to which they do; coordinates looked at.
COORD_LEAST = 0.6
COORD_SHARE = 0.125
FOCUS = 3
#: Queries multiplied at once.
BLOCK = 512
SLACK = 1e-9
LEAST, MOST = -(2**63), 2**63 - 1

VECTOR_SCHEMA = "row long, vec_id long, norm double, width int, kind int, data binary"
BUCKET_SCHEMA = "cell int, longest double, n int, data binary"
GROUP_SCHEMA = "reach double, n int, data binary"
HIT_SCHEMA = "query_row long, query_id long, row long, vec_id long, score long"
SEEDED_SCHEMA = VECTOR_SCHEMA + ", least long, reach double"


# 1. Vectors of integers


def quantised(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors that take part, and their integers (as doubles), for each width."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    widths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths >= 0]):
        at = np.flatnonzero(widths == width)
        values = vectors.take(pa.array(at)).flatten()
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(SCALE * values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width))
        # A null is NaN by now.
        good = np.isfinite(whole).all(axis=1)
        yield at[good], whole[good]


def _kind(whole: np.ndarray) -> int:
    """Bytes of an integer; 8 stands for a double."""
    most = np.abs(whole).max() if whole.size else 0
    return 2 if most < 2**15 else 4 if most < 2**31 else 8


TYPES = {2: np.int16, 4: np.int32, 8: np.float64}


def lengths(whole: np.ndarray) -> np.ndarray:
    """Euclidean lengths."""
    with np.errstate(over="ignore"):
        return np.sqrt((whole * whole).sum(axis=1))


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids = batch.column("row"), batch.column("vec_id")
        for at, whole in quantised(batch.column("embedding")):
            if not len(at):
                continue
            kind, n, width = _kind(whole), len(at), whole.shape[1]
            raw = whole.astype(TYPES[kind]).tobytes()
            offsets = pa.array(np.arange(n + 1) * width * kind, pa.int32())
            data = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(raw)])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [rows.take(take), ids.take(take), pa.array(lengths(whole)), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, kind, np.int32)), data],
                names=["row", "vec_id", "norm", "width", "kind", "data"],
            )


class Vectors:
    """Vectors of a bucket or a group: rows, ids (and which are null), lengths, integers as doubles."""

    def __init__(self, row, ids, no_id, norm, whole, least=None):
        self.row, self.ids, self.no_id, self.norm, self.whole = row, ids, no_id, norm, whole
        self.least = np.full(len(row), LEAST, np.int64) if least is None else least

    def __len__(self) -> int:
        return len(self.row)

    @classmethod
    def of(cls, frame: pd.DataFrame) -> Vectors:
        """From rows of the vectors' table."""
        width = int(frame["width"].max()) if len(frame) else 0
        whole = np.zeros((len(frame), width))
        for k, (w, kind, data) in enumerate(zip(frame["width"], frame["kind"], frame["data"])):
            whole[k, :w] = np.frombuffer(data, TYPES[kind])
        no_id = frame["vec_id"].isna().to_numpy()
        ids = frame["vec_id"].array if no_id.any() else frame["vec_id"].to_numpy(np.int64)
        if no_id.any():
            ids = np.array([0 if gone else int(i) for i, gone in zip(ids, no_id)], np.int64)
        least = frame["least"].to_numpy(np.int64) if "least" in frame else None
        return cls(frame["row"].to_numpy(np.int64), ids, no_id, frame["norm"].to_numpy(float), whole, least)

    def pack(self) -> bytes:
        """One cell of bytes."""
        kind = _kind(self.whole)
        head = np.array([len(self), self.whole.shape[1], kind], np.int64).tobytes()
        parts = [self.row, self.ids, self.least, self.norm, self.no_id, self.whole.astype(TYPES[kind])]
        return head + b"".join(x.tobytes() for x in parts)

    @classmethod
    def unpack(cls, data: bytes) -> Vectors:
        """The vectors that were packed."""
        n, width, kind = np.frombuffer(data, np.int64, 3).tolist()
        row, ids, least = (np.frombuffer(data, np.int64, n, 24 + 8 * n * k) for k in range(3))
        norm = np.frombuffer(data, float, n, 24 + 24 * n)
        no_id = np.frombuffer(data, bool, n, 24 + 32 * n)
        whole = np.frombuffer(data, TYPES[kind], n * width, 24 + 33 * n).reshape(n, width).astype(float)
        return cls(row, ids, no_id, norm, whole, least)


# 2. Buckets


def bucket_cuts(norms: np.ndarray) -> list[int]:
    """Where buckets of falling lengths begin, and the end."""
    cuts, at = [0], 0
    while at < len(norms):
        like = int(np.searchsorted(-norms, -RATIO * norms[at], "right"))
        at = max(at + 1, min(at + BUCKET, like))
        cuts.append(at)
    return cuts


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = pd.DataFrame()

    def packed(frame: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, list[tuple]]:
        norms = frame["norm"].to_numpy(float)
        cuts = bucket_cuts(norms)
        if not last:
            cuts.pop()  # the last one may go on in the next batch
        out = []
        for a, b in zip(cuts, cuts[1:]):
            part = frame.iloc[a:b]
            out.append((int(part["cell"].iloc[0]), float(norms[a]), b - a, Vectors.of(part).pack()))
        return frame.iloc[cuts[-1] :], out

    for batch in batches:
        frame = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        held = pd.concat([held, frame], ignore_index=True) if len(held) else frame
        while len(held) > 2 * BUCKET:
            cut = held.iloc[: 2 * BUCKET]
            rest, out = packed(cut, False)
            held = pd.concat([rest, held.iloc[2 * BUCKET :]], ignore_index=True)
            yield _bucket_batch(out)
    if len(held):
        yield _bucket_batch(packed(held, True)[1])


def _bucket_batch(rows: list[tuple]) -> pa.RecordBatch:
    cell, longest, n, data = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(cell, pa.int32()), pa.array(longest, pa.float64()), pa.array(n, pa.int32()), pa.array(data, pa.binary())],
        names=["cell", "longest", "n", "data"],
    )


# 3. The search of some buckets for some queries


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def products(queries: np.ndarray, vectors: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Inner products of all queries with all vectors, as doubles or, where these aren't exact, as longs."""
    if exact_in_double:
        return queries @ vectors.T
    if not queries.shape[1]:
        return np.zeros((len(queries), len(vectors)), np.int64)
    integers = np.frompyfunc(int, 1, 1)
    scores = integers(queries).dot(integers(vectors).T)
    return np.frompyfunc(lambda s: min(max(s, LEAST), MOST), 1, 1)(scores).astype(np.int64)


class Bests:
    """The k best of every query so far; the k-th is its threshold."""

    def __init__(self, queries: Vectors, k: int):
        self.k, self.least = k, queries.least.copy()
        self.found = tuple(np.zeros(0, np.int64) for _ in range(5))  # query, score, no id, id, row
        self.extra: list[tuple] = []
        self.held = 0

    def add(self, query, score, vectors: Vectors, at) -> None:
        """Scores of vectors ``at``, none below its query's threshold."""
        self.extra.append((query, score.astype(np.int64), vectors.no_id[at].astype(np.int64), vectors.ids[at], vectors.row[at]))
        self.held += len(query)

    def settle(self) -> None:
        """Keep the k best and raise the thresholds."""
        if not self.held:
            return
        query, score, no_id, ids, row = every = [np.concatenate(x) for x in zip(self.found, *self.extra)]
        # ~score falls as score rises and can't overflow.
        order = np.lexsort((row, ids, no_id, ~score, query))
        sorted_query = query[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query, "left")
        self.found = tuple(x[order[rank < self.k]] for x in every)
        kth = order[rank == self.k - 1]
        self.least[query[kth]] = np.maximum(self.least[query[kth]], score[kth])
        self.extra, self.held = [], 0


def _by_length(bests: Bests, queries: Vectors, vectors: Vectors, chosen: np.ndarray) -> None:
    """All products of the chosen queries with the vectors long enough."""
    with np.errstate(divide="ignore", invalid="ignore"):
        wanted = np.where(bests.least[chosen] > 0, bests.least[chosen] / queries.norm[chosen] * (1 - SLACK), 0.0)
    reach = np.searchsorted(-vectors.norm, -wanted, "right")
    chosen = chosen[np.argsort(-reach, kind="stable")]
    reach = np.sort(reach)[::-1]
    row_at = np.argsort(vectors.row, kind="stable")
    sorted_rows = vectors.row[row_at]
    for a in range(0, len(chosen), BLOCK):
        part, n = chosen[a : a + BLOCK], int(reach[a])
        if not n:
            return
        longest = float(queries.norm[part].max()) * float(vectors.norm[0])
        scores = products(queries.whole[part], vectors.whole[:n], longest < 2**53)
        own = np.minimum(np.searchsorted(sorted_rows, queries.row[part]), len(sorted_rows) - 1)
        is_own = sorted_rows[own] == queries.row[part]
        own = row_at[own]
        hits = scores >= bests.least[part][:, None]
        mine = np.flatnonzero(is_own & (own < n))
        hits[mine, own[mine]] = False
        if n > 4 * bests.k and np.count_nonzero(hits) > 4 * bests.k * len(part):
            # Many scores reach the thresholds: what doesn't reach the k-th best in here, the query's own row put last, is out.
            kept = scores[mine, own[mine]]
            scores[mine, own[mine]] = LEAST
            hits &= scores >= np.partition(scores, n - bests.k, axis=1)[:, n - bests.k][:, None]
            scores[mine, own[mine]] = kept
        q, v = np.nonzero(hits)
        bests.add(part[q], scores[q, v], vectors, v)
        if bests.held > 500_000:
            bests.settle()


class Columns:
    """Sorted coordinates of a bucket's unit vectors, each made when it is first looked at."""

    def __init__(self, vectors: Vectors):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            self.unit = np.nan_to_num(vectors.whole / vectors.norm[:, None])
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the vectors by a coordinate, and the coordinate in that order."""
        if f not in self.known:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.known[f] = order, self.unit[order, f]
        return self.known[f]


def interval(coordinate: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a coordinate of unit vectors can lie that have at least this cosine to one with the given coordinate."""
    own, turn = np.arccos(np.clip(coordinate, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(np.pi, own + turn)) - SLACK, np.cos(np.maximum(0.0, own - turn)) + SLACK


def _by_coordinates(bests: Bests, queries: Vectors, vectors: Vectors, columns: Columns, chosen: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Search by coordinate intervals; the queries whose interval holds too much are returned."""
    left = []
    for a in range(0, len(chosen), BLOCK):
        part, angle = chosen[a : a + BLOCK], cosine[a : a + BLOCK]
        unit = queries.whole[part] / queries.norm[part][:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        first, last = np.zeros(len(part), np.int64), np.full(len(part), len(vectors))
        best = np.zeros(len(part), np.int64)
        for k in range(focus.shape[1]):
            coordinate = focus[:, k]
            low, high = interval(unit[np.arange(len(part)), coordinate], angle)
            for f in np.unique(coordinate):
                here = np.flatnonzero(coordinate == f)
                _, values = columns.get(int(f))
                x, y = np.searchsorted(values, low[here], "left"), np.searchsorted(values, high[here], "right")
                y = np.maximum(x, y)
                less = y - x < last[here] - first[here]
                first[here[less]], last[here[less]], best[here[less]] = x[less], y[less], f
        size = last - first
        fits = size <= COORD_SHARE * len(vectors)
        left.append(part[~fits])
        size = np.where(fits, size, 0)
        q = np.repeat(np.arange(len(part)), size)
        if not len(q):
            continue
        place = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + first[q]
        orders = {int(f): columns.get(int(f))[0] for f in np.unique(best[fits])}
        v = np.empty(len(q), np.int64)
        for f, order in orders.items():
            here = best[q] == f
            v[here] = order[place[here]]
        for k in range(focus.shape[1]):
            low, high = interval(unit[np.arange(len(part)), focus[:, k]], angle)
            value = columns.unit[v, focus[q, k]]
            inside = (value >= low[q]) & (value <= high[q])
            q, v = q[inside], v[inside]
        scores = np.einsum("ij,ij->i", queries.whole[part[q]], vectors.whole[v]).astype(np.int64)
        good = (scores >= bests.least[part[q]]) & (vectors.row[v] != queries.row[part[q]])
        bests.add(part[q[good]], scores[good], vectors, v[good])
    return np.concatenate(left) if left else chosen[:0]


def search(queries: Vectors, buckets: list[Vectors], k: int) -> Bests:
    """The k best of each query in some buckets, above the threshold that the query comes with."""
    bests = Bests(queries, k)
    for vectors in sorted(buckets, key=lambda b: -b.norm[0]):
        width = max(queries.whole.shape[1], vectors.whole.shape[1])
        queries.whole, vectors.whole = _padded(queries.whole, width), _padded(vectors.whole, width)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            local = np.where(bests.least > 0, bests.least / (queries.norm * vectors.norm[0]), -1.0)
        alive = ~(local > 1 + SLACK)
        # Coordinates need doubles that hold every product.
        exact = queries.norm * vectors.norm[0] < 2**53
        turned = np.flatnonzero(alive & exact & (local >= COORD_LEAST))
        rest = np.flatnonzero(alive & ~(exact & (local >= COORD_LEAST)))
        if len(turned):
            left = _by_coordinates(bests, queries, vectors, Columns(vectors), turned, np.minimum(local[turned] * (1 - SLACK), 1.0))
            rest = np.sort(np.concatenate([rest, left]))
        for part in (rest[exact[rest]], rest[~exact[rest]]):
            _by_length(bests, queries, vectors, part)
        bests.settle()
    return bests


# 4. Groups of queries against cells


def _seeded(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The queries of one share with their first thresholds."""
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in SEEDED_SCHEMA.split(", ")])
        queries = Vectors.of(left)
        bests = search(queries, [Vectors.unpack(d) for d in right["data"]], k)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(bests.least > 0, bests.least / queries.norm * (1 - 4 * SLACK), 0.0)
        textbytes.give_back()
        return left.drop(columns="share").assign(least=bests.least, reach=np.nan_to_num(reach))

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def packed() -> pa.RecordBatch:
        frame = pa.Table.from_batches(held).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        return pa.RecordBatch.from_arrays(
            [pa.array([float(frame["reach"].min())]), pa.array([len(frame)], pa.int32()), pa.array([Vectors.of(frame).pack()], pa.binary())],
            names=["reach", "n", "data"],
        )

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GROUP:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def _cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best of one cell for one group of queries."""
        if not len(left) or not len(right):
            return pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in HIT_SCHEMA.split(", ")})
        queries = Vectors.unpack(left["data"].iloc[0])
        query, score, no_id, ids, row = search(queries, [Vectors.unpack(d) for d in right["data"]], k).found
        textbytes.give_back()
        return pd.DataFrame(
            {
                "query_row": queries.row[query],
                "query_id": queries.ids[query],
                "row": row,
                "vec_id": pd.array(ids, "Int64") if not no_id.any() else pd.array([None if gone else i for i, gone in zip(ids.tolist(), no_id)], "Int64"),
                "score": score,
            }
        )

    return run


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score, query_row, row``: the k best rows of every query."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    table = written(rows.filter("embedding IS NOT NULL").mapInArrow(_quantise, VECTOR_SCHEMA), "vectors")
    n = table.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # Partitions of falling length are the cells; a vector's row parts those of one length.
    ranged = table.repartitionByRange(max(tasks, -(-n // GROUP)), F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    buckets = written(ranged.withColumn("cell", F.spark_partition_id()).mapInArrow(_buckets, BUCKET_SCHEMA), "buckets")

    queries = table.filter(f"vec_id % {query_every} = 0")
    shares = max(tasks, -(-n // (query_every * GROUP)))
    seeds = written(buckets.orderBy(F.desc("longest"), "cell").limit(SEEDS), "seeds")
    seeded = (
        queries.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int"))
        .groupBy("share")
        .cogroup(seeds.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "data").groupBy("share"))
        .applyInPandas(_seeded(k), SEEDED_SCHEMA)
    )
    # Queries that need vectors of like length make up a group.
    ordered = written(seeded, "queries").repartitionByRange(max(1, -(-n // (query_every * GROUP))), "reach", "row")
    groups = written(ordered.mapInArrow(_groups, GROUP_SCHEMA).withColumn("grp", F.monotonically_increasing_id()), "groups")

    # One row for each group and each cell with a vector that is long enough: numbers only, from the cells' list repeated for a group.
    cells = written(buckets.groupBy("cell").agg(F.max("longest").alias("longest")), "cells")
    most = cells.agg(F.max("cell")).first()[0]
    if most is None:
        most = -1
    plan = (
        groups.select("grp", "reach", F.explode(F.sequence(F.lit(0), F.lit(max(most, 0)))).alias("cell"))
        .join(cells, "cell")
        .filter("longest >= reach")
        .select("grp", "reach", "cell")
    )
    plan = written(plan, "plan")
    left = groups.select("grp", "data").join(plan.select("grp", "cell"), "grp")
    right = buckets.join(plan, "cell").filter("longest >= reach").select("cell", "grp", "data")
    hits = left.groupBy("grp", "cell").cogroup(right.groupBy("grp", "cell")).applyInPandas(_cell(k), HIT_SCHEMA)

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row", "row")
