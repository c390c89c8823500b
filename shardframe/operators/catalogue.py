"""A catalogue of paths ``(path, is_dir, size, version)``: upsert, listing, delete, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardframe.functions.paths import ancestors, base_name, parent_path, parts_to_path, path_parts
from shardframe.session import store


def normal_path(path) -> Column:
    """Absolute path without empty components."""
    return parts_to_path(path_parts(path))


def under(path: Column, prefix: str) -> Column:
    """True for the prefix itself and everything below it."""
    root = "/" + "/".join(p for p in prefix.split("/") if p)
    if root == "/":
        return F.lit(True)
    return (path == root) | path.startswith(root + "/")


def with_parents(paths: DataFrame) -> DataFrame:
    """Add the directories that the paths imply (size 0, version 0); listed paths win."""
    # Duplicates meet before the shuffle: the ancestor sets of neighbours are nearly the same.
    implied = paths.select(F.explode(ancestors("path")).alias("path")).distinct()
    rows = paths.select("path", "is_dir", "size", "version", F.lit(1).alias("_listed")).unionByName(
        implied.select(
            "path",
            F.lit(True).alias("is_dir"),
            F.lit(0).cast("bigint").alias("size"),
            F.lit(0).cast("bigint").alias("version"),
            F.lit(0).alias("_listed"),
        )
    )
    picked = rows.groupBy("path").agg(F.max_by(F.struct("is_dir", "size", "version"), "_listed").alias("r"))
    return picked.select("path", "r.is_dir", "r.size", "r.version")


def path_upsert(paths: DataFrame, updates: DataFrame, replace: bool) -> tuple[DataFrame, DataFrame]:
    """Apply updates, latest version first, with implied parents; returns the catalogue and the violations.

    Without ``replace`` a path that exists, or comes twice, is kept as it was first and reported. A path
    below a file is reported and left out.
    """
    cols = ["path", "is_dir", "size", "version"]
    old = paths.select(normal_path("path").alias("path"), *cols[1:])
    new = updates.select(normal_path("path").alias("path"), *cols[1:])
    body = F.struct("is_dir", "size", "version")
    if replace:
        rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        merged = rows.groupBy("path").agg(F.max_by(body, F.struct("_new", "version")).alias("r"))
        rejected = None
    else:
        counted = new.groupBy("path").agg(F.min_by(body, "version").alias("r"), F.count(F.lit(1)).alias("_n"))
        known = old.select("path").withColumn("_known", F.lit(1))
        checked = counted.join(known, "path", "left")
        added = checked.filter(F.col("_known").isNull()).select("path", "r")
        merged = old.select("path", body.alias("r")).unionByName(added)
        extra = F.col("_n") - F.when(F.col("_known").isNull(), 1).otherwise(0)
        rejected = checked.select("path", extra.cast("bigint").alias("n"), F.lit("path exists").alias("reason")).filter("n > 0")
    flat = merged.select("path", "r.is_dir", "r.size", "r.version")
    files = flat.filter(~F.col("is_dir")).select(F.col("path").alias("_file"))
    below = (
        flat.select("path", F.explode(ancestors("path")).alias("_file"))
        .join(files, "_file", "left_semi")
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("reason", F.lit("parent is a file"))
    )
    kept = with_parents(flat.join(below.select("path"), "path", "left_anti"))
    return kept, below if rejected is None else rejected.unionByName(below)


def path_list(paths: DataFrame, prefix: str) -> DataFrame:
    """A subtree, its root included."""
    return paths.filter(under(F.col("path"), prefix))


def path_find(paths: DataFrame, directory: str, stem: str) -> DataFrame:
    """Direct children of a directory whose name up to the first dot is ``stem``."""
    root = "/" + "/".join(p for p in directory.split("/") if p)
    name = F.substring_index(base_name("path"), ".", 1)
    return paths.filter(parent_path("path") == root).filter(name == stem)


def path_delete(paths: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The catalogue without a subtree, and one row with the deleted files and directories."""
    gone = under(F.col("path"), prefix)
    counts = paths.filter(gone).agg(
        F.count(F.when(~F.col("is_dir"), 1)).alias("files"), F.count(F.when(F.col("is_dir"), 1)).alias("dirs")
    )
    return paths.filter(~gone), counts


NESTED = "_kind int, _part int, at bigint, until bigint, depth int, _closed boolean, children bigint, files bigint, dirs bigint, bytes bigint"
COUNTS = ("children", "files", "dirs", "bytes")


class _Walk:
    """Subtrees of one range of paths in pre-order: a row closes the open paths that it doesn't lie under.

    Paths that are still open at the end of the range, and what lies here of paths that were opened in earlier ranges, are told apart by
    their depth: of each depth at most one path is open.
    """

    def __init__(self):
        self.n = self.files = self.dirs = self.bytes = 0
        # Open paths of this range: depth, place, totals before what lies under it, children, its row.
        self.open: list[list] = []
        # Least depth so far, rows of that depth, and (depth, least depth before, place, totals, children) where it fell.
        self.least, self.at_least, self.falls = None, 0, []

    def add(self, depth: int, is_dir: bool, size: int, row) -> list[tuple]:
        """The next path; the paths that it closes, each with its numbers."""
        done = []
        while self.open and self.open[-1][0] >= depth:
            done.append(self._numbers(self.open.pop(), self.n))
        if self.open and self.open[-1][0] == depth - 1:
            self.open[-1][5] += 1
        if self.least is None or depth < self.least:
            self.falls.append((depth, self.least, self.n, self.files, self.dirs, self.bytes, self.at_least))
            self.least, self.at_least = depth, 0
        self.at_least += depth == self.least
        self.n += 1
        self.files += not is_dir
        self.dirs += is_dir
        self.bytes += size
        self.open.append([depth, self.n - 1, self.files, self.dirs, self.bytes, 0, row])
        return done

    def _numbers(self, entry: list, until: int | None) -> tuple:
        depth, at, files, dirs, size, children, row = entry
        return row, at, until, depth, children, self.files - files, self.dirs - dirs, self.bytes - size

    def left(self) -> list[tuple]:
        """The paths that are open at the end."""
        return [self._numbers(entry, None) for entry in self.open]

    def by_depth(self, most: int) -> list[tuple]:
        """For a path of each depth that was open before this range: whether it ends here, where, and what lies under it here."""
        out = []
        for depth in range(most + 1):
            fall = next((f for f in self.falls if f[0] <= depth), None)
            if fall is None:
                out.append((depth, False, self.n, self.at_least if depth == self.least - 1 else 0, self.files, self.dirs, self.bytes))
            else:
                _, before, at, files, dirs, size, rows = fall
                out.append((depth, True, at, rows if before is not None and depth == before - 1 else 0, files, dirs, size))
        return out


def nested_order(paths: DataFrame) -> DataFrame:
    """``paths`` in pre-order: adds ``at``, ``until``, ``depth``, and ``children, files, dirs, bytes`` below each path.

    ``at`` is the place of a path when all are sorted by their components, and ``[at, until)`` are the places of its subtree, itself included. One
    range-partitioned sort gives them: each task walks its range with a stack of open paths, and what crosses ranges is one row for each range and
    depth. Paths must be distinct; directories need not be listed, but only listed paths get numbers.
    """
    kept = [c for c in paths.columns if c not in {f.split()[0] for f in NESTED.split(", ")}]
    held = store(paths.select(*kept, path_parts("path").alias("_parts")), "paths")
    most = held.agg(F.coalesce(F.max(F.size("_parts")), F.lit(0)).alias("d")).first()["d"]
    fields = StructType([held.schema[c] for c in kept])
    schema = StructType([*fields.fields, *StructType.fromDDL(NESTED).fields])
    names = [f.name for f in schema.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), _Walk()

        def give(rows: pa.RecordBatch | None, kind: int, at, until, depth, closed, numbers) -> pa.RecordBatch:
            n = len(at)
            own = rows.columns if rows is not None else [pa.nulls(n, t) for t in own_types]
            cells = [[kind] * n, [part] * n, at, until, depth, closed, *numbers]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cells, types))], names=names)

        def nodes(found: list[tuple], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            # Rows of this batch are taken together; a path opened in an earlier one brings its own.
            here = [f for f in found if isinstance(f[0], int)]
            if here:
                _, at, until, depth, *numbers = zip(*here)
                yield give(batch.select(kept).take(pa.array([f[0] for f in here], pa.int64())), 0, at, until, depth, [True] * len(here), numbers)
            for row, at, until, depth, *numbers in (f for f in found if not isinstance(f[0], int)):
                yield give(row, 0, [at], [until], [depth], [True], [[x] for x in numbers])

        own_types = None
        for batch in batches:
            own_types = own_types or [batch.schema.field(c).type for c in kept]
            found = []
            for k, (depth, is_dir, size) in enumerate(zip(*(batch[c].to_pylist() for c in ("_depth", "is_dir", "size")))):
                found += state.add(depth, is_dir, size or 0, k)
            yield from nodes(found, batch)
            for entry in state.open:
                if isinstance(entry[6], int):
                    entry[6] = batch.select(kept).slice(entry[6], 1)
        if not state.n:
            return
        for row, at, until, depth, *numbers in state.left():
            yield give(row, 0, [at], [until], [depth], [False], [[x] for x in numbers])
        depth, closed, at, *numbers = zip(*state.by_depth(most))
        yield give(None, 1, at, [None] * len(at), depth, closed, numbers)
        yield give(None, 2, [state.n], [None], [-1], [False], [[0]] * 4)

    ranged = held.repartitionByRange("_parts").sortWithinPartitions("_parts")
    walked = store(ranged.select(*kept, F.size("_parts").alias("_depth")).mapInArrow(walk, schema), "nested")
    # One row for each range, then one for each range and depth: numbers of ranges, not of paths.
    all_before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = walked.filter("_kind = 2").select("_part", F.coalesce(F.sum("at").over(all_before), F.lit(0)).alias("_base"), F.sum("at").over(every).alias("_all"))
    bases = store(bases, "bases")
    of_depth = Window.partitionBy("depth").orderBy("_part")
    sums = [F.sum(c).over(of_depth.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_{c}") for c in COUNTS]
    along = walked.filter("_kind = 1").join(bases, "_part").select("_part", "depth", "_closed", (F.col("_base") + F.col("at")).alias("_at"), "_all", *sums)
    ending = F.struct(F.col("_at").alias("until"), *[F.col(f"_{c}").alias(c) for c in COUNTS])
    later = of_depth.rowsBetween(1, Window.unboundedFollowing)
    closing = F.coalesce(F.first(F.when(F.col("_closed"), ending), ignorenulls=True).over(later), F.last(ending.withField("until", F.col("_all"))).over(later))
    rest = along.select("_part", "depth", closing.alias("_end"), *[F.col(f"_{c}") for c in COUNTS], "_all")
    rest = store(rest, "crossing")

    nodes = walked.filter("_kind = 0").drop("_kind").join(bases.drop("_all"), "_part").withColumn("at", F.col("at") + F.col("_base"))
    inner = nodes.filter("_closed").withColumn("until", F.col("until") + F.col("_base"))
    crossing = nodes.filter("NOT _closed").drop("until").join(rest, ["_part", "depth"]).withColumn("until", F.coalesce("_end.until", "_all"))
    more = {c: F.col(c) + F.coalesce(F.col("_end")[c] - F.col(f"_{c}"), F.lit(0)) for c in COUNTS}
    columns = [*kept, "at", "until", "depth", *COUNTS]
    return inner.select(*columns).unionByName(crossing.withColumns(more).select(*columns))


def subtree(nested: DataFrame, prefix: str) -> DataFrame:
    """The rows of :func:`nested_order` at and under a listed path, by the range of their places."""
    root = "/" + "/".join(p for p in prefix.split("/") if p)
    found = nested.filter(F.col("path") == root).select("at", "until").first()
    return nested.filter(F.lit(False)) if found is None else nested.filter((F.col("at") >= found["at"]) & (F.col("at") < found["until"]))


def path_stats(paths: DataFrame) -> DataFrame:
    """Per directory: direct children, files and directories below, bytes below."""
    return nested_order(paths).filter("is_dir").select("path", *COUNTS)
