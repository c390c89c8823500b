"""How far the sources of a language diverge in their words: smoothed integer chi-square terms, exact.

A language keeps the terms found in at least ``LEAST_DOCS`` of its documents (V of them). A group (language and source) gives
a kept term ``p = 1 + floor(10^9 * (count + 1) / (N + V))``, N its occurrences of all kept terms; the whole language likewise.
``f(p, q) = floor((p - q)^2 / q)``. Pairs: the sum of ``f`` over all kept terms, for each ordered pair of sources of a language.
Terms: ``f`` of a group against its language, where the group has the term and more of it; the ``TOP_TERMS`` largest.

Method: a frequent-pattern tree of term rows. A term's row lists its nonzero counts in the order of the sources (those with
the most terms first). Written out, a pair's sum is

    V * f(zero, zero)                                                  both sources without the term
    + for each term of one source: f(own, zero) - f(zero, zero)        single corrections, for either side
    + for each term of both:  f(a, b) - f(a, zero) - f(zero, b) + f(zero, zero)

so zero counts cost nothing. Rows go into prefix trees with their multiplicities: equal rows are one row, and rows that begin alike share
nodes (source, count). A node that ``m`` terms pass through adds ``m`` times the pair correction with each of its ancestors, once for the
node and the ancestor, and ``m`` to the number of its source's terms of that count, from which the single corrections follow.

Steps and what moves: 1. words are counted in runs of texts, then by language, source and term (map-side sums). 2. One row for each
language and term: its counts by source, no more than the language has sources. 3. Equal rows are counted, and the rows are
dealt by ranges of their first items (``KEY_ITEMS``), so that those that begin alike meet; a language of any size is many ranges. 4. Each task makes trees of runs of at most
``RUN_ITEMS`` items and returns sums for pairs of sources. The output has a row for each pair of sources of a language, and so has the
last join; nothing else grows with their square. Sources are never collected: their table is joined, and broadcast only if Spark finds it small.

Arithmetic: shares are divided as 38-digit decimals, ``f`` fits a long as ``p`` and ``q`` are at most 10^9 + 1, and sums are 38-digit decimals.

Defined results: null text, language and source are the empty string. A group without terms has p of count 0 everywhere. A language without kept terms
has pair values of 0 and no terms. Rows that repeat are documents of their own. A language of one source has no pairs. Ties are
ranked by the item's UTF-8 bytes. Without documents there are no rows. Only ``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardframe.llm import textbytes, wordcodes
from shardframe.llm.shared import text_of, written

LEAST_DOCS = 3
TOP_TERMS = 200
#: Bytes of text counted at once, about, and items of the rows of one tree, at most (but for a single longer row).
RUN_BYTES = 4 << 20
RUN_ITEMS = 500_000
#: Items of a row by which rows are dealt; those that are alike so far are dealt by their hash.
KEY_ITEMS = 4

_BYTES = np.arange(256)
#: Terms of ASCII letters and every byte of a non-ASCII character.
LETTERS = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

COUNT_SCHEMA = "lang string, source string, term string, n long, docs long"
#: Pair corrections (other >= 0: value) and numbers of terms of a count (other = -1: p of the count, value).
TREE_SCHEMA = "lang string, own int, other int, p long, value long"


# 1. Counts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textbytes.slices(batch, most=RUN_BYTES):
            raw, offsets = textbytes.flat(part.column("text"))
            data = textbytes.LOWER[raw]
            starts, ends, bounds = textbytes.words(data, offsets, LETTERS)
            if not len(starts):
                continue
            codes, terms = wordcodes.coded(data, starts, ends, LETTERS)
            lang, langs = wordcodes.strings(part.column("lang"), "")
            source, sources = wordcodes.strings(part.column("source"), "")
            size = len(terms)
            # Distinct (document, term) with the number of occurrences, then the same by group.
            doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            held, times = np.unique(doc * size + codes, return_counts=True)
            group = (lang * len(sources) + source)[held // size] * size + held % size
            order = np.argsort(group, kind="stable")
            group, times = group[order], times[order]
            opens = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            key = group[opens]
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(key // size // len(sources))).cast(pa.string()),
                    sources.take(pa.array(key // size % len(sources))).cast(pa.string()),
                    terms.take(pa.array(key % size)).cast(pa.string()),
                    pa.array(np.add.reduceat(times, opens)),
                    pa.array(np.diff(np.r_[opens, len(group)])),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
            textbytes.give_back()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group."""
    texts = docs.select(text_of().alias("text"), text_of("lang").alias("lang"), text_of("source").alias("source"))
    return texts.mapInArrow(_counts, COUNT_SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """``p`` of a count, exact: 10^9 * (n + 1) needs more than a long."""
    return F.expr(f"1L + (CAST({n} + 1 AS DECIMAL(20, 0)) * CAST(1000000000 AS DECIMAL(10, 0))) div CAST({total} + {kept} AS DECIMAL(20, 0))")


def gap(p: str, q: str) -> Column:
    """``f`` of two shares; a square is at most 10^18."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


# 2. Trees


class Tree:
    """A prefix tree of sorted rows: for every node its item (an index into the rows' items), parent and number of terms."""

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, weight: np.ndarray):
        """``keys``: items of all rows one after the other; equal keys are equal items. Rows that begin alike are neighbours."""
        item, parent, through = [], [], []
        size = np.diff(offsets)
        rows, depth, made = np.flatnonzero(size > 0), 0, 0
        same = np.zeros(len(size), bool)  # row begins like the one before, as deep as seen
        same[1:] = True
        node = np.full(len(size), -1, np.int64)
        while len(rows):
            at = offsets[rows] + depth
            before = rows - 1
            like = same[rows] & (before >= 0)
            like &= size[before] > depth
            like[like] = keys[at[like]] == keys[offsets[before[like]] + depth]
            same[rows] = like
            fresh = ~like
            own = made + np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            item.append(at[first])
            parent.append(node[rows[first]])
            through.append(np.add.reduceat(weight[rows], first))
            node[rows] = own
            made += len(first)
            depth += 1
            rows = rows[size[rows] > depth]
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.item, self.parent, self.through = whole(item), whole(parent), whole(through)

    def ancestors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair of a node and one of its ancestors, once, by their distance."""
        node, above = np.arange(len(self.parent)), self.parent
        while True:
            has = above >= 0
            node, above = node[has], above[has]
            if not len(node):
                return
            yield node, above
            above = self.parent[above]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values, in longs."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    opens = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[opens], np.add.reduceat(values, opens) if len(keys) else values


def corrections(source: np.ndarray, p: np.ndarray, zero: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own and other source, and the sum of the pair corrections of the tree's terms."""
    f = lambda a, b: (a - b) * (a - b) // b
    most = int(source.max()) + 1 if len(source) else 1
    keys, values = [], []
    for node, above in tree.ancestors():
        a, b, m = tree.item[node], tree.item[above], tree.through[node]
        for x, y in ((a, b), (b, a)):
            value = f(p[x], p[y]) - f(p[x], zero[y]) - f(zero[x], p[y]) + f(zero[x], zero[y])
            key, total = summed(source[x] * most + source[y], m * value)
            keys.append(key)
            values.append(total)
    key, total = summed(np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(0, np.int64),) * 2
    return key // most, key % most, total


def _runs(items: np.ndarray, lang: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of one language with at most ``RUN_ITEMS`` items together, or a single row."""
    start, n = 0, len(lang)
    ends = np.cumsum(items)
    change = np.flatnonzero(lang[1:] != lang[:-1]) + 1
    while start < n:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + RUN_ITEMS, "right")))
        cut = change[np.searchsorted(change, start, "right") :]
        end = min(end, int(cut[0]) if len(cut) else n)
        yield start, end
        start = end


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, langs = wordcodes.strings(batch.column("lang"), "")
        column = batch.column("items")
        size = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        source, n, p, zero = (flat.field(k).to_numpy().astype(np.int64) for k in ("idx", "n", "p", "zero"))
        weight = batch.column("terms").to_numpy()
        offsets = np.r_[0, np.cumsum(size)]
        for a, b in _runs(size, lang):
            cut = slice(offsets[a], offsets[b])
            # Items by their rank, as pairs of numbers make no single key.
            _, keys = np.unique(np.stack([source[cut], n[cut]], axis=1), axis=0, return_inverse=True)
            tree = Tree(keys.reshape(-1), offsets[a : b + 1] - offsets[a], weight[a:b])
            own, other, total = corrections(source[cut], p[cut], zero[cut], tree)
            rank = keys.reshape(-1)[tree.item]
            numbered, terms = summed(rank, tree.through)
            sample = np.zeros(int(rank.max()) + 1 if len(rank) else 0, np.int64)
            sample[rank] = tree.item
            single = sample[numbered]
            name = langs[int(lang[a])].as_py()
            m = len(own) + len(single)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * m, pa.string()),
                    pa.array(np.r_[own, source[cut][single]].astype(np.int32)),
                    pa.array(np.r_[other, np.full(len(single), -1)].astype(np.int32)),
                    pa.array(np.r_[np.zeros(len(own), np.int64), p[cut][single]]),
                    pa.array(np.r_[total, terms]),
                ],
                names=["lang", "own", "other", "p", "value"],
            )
    textbytes.give_back()


# 3. The audit


def big(column: str) -> Column:
    """A number as a decimal that holds every sum."""
    return F.col(column).cast("decimal(38,0)")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources, and the leading terms of every group."""
    spark = docs.sparkSession
    rows = written(
        term_counts(docs)
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("items"))
        .filter(F.col("docs") >= least_docs)
        .select("lang", "term", "total", "items"),
        "terms",
    )
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    used = (
        rows.select("lang", F.explode("items").alias("x"))
        .groupBy("lang", F.col("x.source").alias("source"))
        .agg(F.count(F.lit(1)).alias("terms"), F.sum("x.n").alias("total"))
    )
    named = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    numbered = Window.partitionBy("lang").orderBy(F.desc("terms"), "source")
    groups = named.join(used, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["terms", "total", "kept", "lang_total"])
    groups = groups.withColumn("idx", F.row_number().over(numbered) - 1).withColumn("zero", F.when(F.col("kept") > 0, share("0", "total", "greatest(kept, 1)")))
    groups = written(groups, "groups")

    # Counts of the kept terms, each with its share and its group's share of count 0.
    cells = (
        rows.select("lang", "term", F.col("total").alias("term_total"), F.explode("items").alias("x"))
        .select("lang", "term", "term_total", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
        .join(groups, ["lang", "source"])
        .withColumn("p", share("n", "total", "kept"))
    )
    ahead = cells.withColumn("q", share("term_total", "lang_total", "kept")).filter("p > q")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        ahead.select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= top_terms)
    )

    # Rows of terms in the order of the sources, equal ones counted, dealt by ranges of what they begin with.
    patterns = (
        cells.groupBy("lang", "term")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "n", "p", "zero"))).alias("items"))
        .groupBy("lang", "items")
        .agg(F.count(F.lit(1)).alias("terms"))
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    begin = F.transform(F.slice("items", 1, KEY_ITEMS), lambda x: F.struct(x["idx"], x["n"]))
    ranged = written(patterns, "patterns").repartitionByRange(tasks, "lang", begin, F.xxhash64("items")).sortWithinPartitions("lang", "items")
    found = written(
        ranged.mapInArrow(_trees, TREE_SCHEMA).groupBy("lang", "own", "other", "p").agg(F.sum(big("value")).alias("value")), "corrections"
    )

    one = groups.select("lang", F.col("idx").alias("own"), F.col("zero").alias("own_zero"))
    two = groups.select("lang", F.col("idx").alias("other"), F.col("zero").alias("other_zero"))
    single = found.filter("other = -1").select("lang", "own", "p", "value").join(one, ["lang", "own"]).join(two, "lang").filter("own <> other")
    # A term of one source only weighs for the source against others, and for others against it.
    sides = single.select(
        "lang",
        F.explode(
            F.array(
                F.struct("own", "other", (big("value") * (gap("p", "other_zero") - gap("own_zero", "other_zero"))).cast("decimal(38,0)").alias("value")),
                F.struct(
                    F.col("other").alias("own"), F.col("own").alias("other"), (big("value") * (gap("other_zero", "p") - gap("other_zero", "own_zero"))).cast("decimal(38,0)").alias("value")
                ),
            )
        ).alias("x"),
    ).select("lang", "x.own", "x.other", "x.value")
    moved = (
        sides.unionByName(found.filter("other >= 0").select("lang", "own", "other", "value"))
        .groupBy("lang", "own", "other")
        .agg(F.sum("value").alias("moved"))
    )
    pairs = (
        groups.select("lang", "source", F.col("idx").alias("own"), F.col("zero").alias("own_zero"), "kept")
        .join(groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("other"), F.col("zero").alias("other_zero")), "lang")
        .filter("own <> other")
        .join(moved, ["lang", "own", "other"], "left")
    )
    base = F.coalesce(big("kept") * gap("own_zero", "other_zero"), F.lit(0))
    pairs = pairs.select("lang", "source", "item", (base + F.coalesce("moved", F.lit(0))).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(first))
    columns = ("lang", "source", "item", "value", "rank")
    both = pairs.select(*columns, F.lit("pair").alias("part")).unionByName(terms.select(*columns, F.lit("term").alias("part")))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
