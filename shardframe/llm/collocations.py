"""Phrases whose words stand together more often than their parts suggest, from a weighted de Bruijn graph.

Texts are lower-cased (A-Z), split at ``[.,;:!?`` and line ends into pieces, and pieces at spaces and tabs into words. Per language, candidates are
phrases of ``least_words`` to ``most_words`` words found ``LEAST_COUNT`` times or more. A candidate of count ``a`` cut into parts of counts
``l`` and ``r`` scores ``floor(10^6 * a * a / (l * r))``; its lowest cut counts. A candidate inside a longer one that is at least half as frequent is dropped.

Method: only the longest grams are counted. A gram of m words (``most_words``) is an edge from the node of its first m - 1
words to that of its last; where a piece ends early, what is left of it is kept as an end of its node. So each place of a text
is one row, and every shorter count follows: a phrase occurs as often as edges leave the nodes that begin with it (their flow), plus the ends
in them. Counts of one to m - 1 words are sums over nodes, not over the text.

Frequent edges make up the graph. A node with one frequent edge in and one out is inner to a path; paths are found by pointer doubling
(``ROUNDS`` rounds; one node in ``CUT`` is no inner node, by its hash, so paths stay short, and a node that no round resolves begins a path
of its own), and every path is one row, with the chain of its words and its edges' counts. Candidates of m words are the paths' edges; whether a candidate of m - 1 words lies
inside a longer one is decided at the places of the paths. It suffices to look one word further: a phrase of that length between
the two is as frequent as the longer one. How paths are cut changes no result.

Steps and what moves: 1. grams of runs of texts (``RUN_BYTES``) are counted by codes of their words, and so are the flows of their nodes. Both are packed for
each part that a hash of their words names: the part's words once, then codes. So a word or node that a third of all places have costs one entry for a
run and different gram, and edges of one node spread over all parts. 2. A part of edges keeps the frequent ones; a part of nodes keeps frequent nodes and sums
of the flows by shorter prefixes. That table is written, and the steps after it read only it. 3. Prefix sums meet by phrase. 4. Paths, parts and ranks join
frequent phrases only. A language's first ``TOP`` are the first of the first of ``shuffle.partitions`` shares.

Arithmetic: ``10^6 * a * a`` and ``l * r`` are 38-digit decimals (exact to 10^15 occurrences).

Defined results: a null text is empty, a null language is ``und``, apart from no other language named so. Texts without words give nothing. Rows that repeat are counted
each. Ties of cuts go to the shortest first part, ties of rank to count and then to the phrase's UTF-8 bytes. Without documents there are no rows. Only ``text`` and
``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardframe.llm import textbytes, wordcodes
from shardframe.llm.shared import text_of, written

LEAST_WORDS, MOST_WORDS = 2, 3
LEAST_COUNT = 10
#: A longer candidate of at least this share (percent) of a candidate's count replaces it.
PERCENT = 50
TOP = 2000
#: Bytes of text whose grams are counted at once, about, and places, at most.
RUN_BYTES = 4 << 20
RUN_PLACES = 1_000_000
#: Bytes of text for each part, about.
PART_BYTES = 12 << 20
#: Parts that one task takes, one after the other, at most.
TASK_PARTS = 16
#: Doubling rounds (paths of up to 2^ROUNDS inner nodes), and the share of nodes that always end a path.
ROUNDS = 5
CUT = 8

_BYTES = np.arange(256)
SEPARATOR = np.isin(_BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
WORD = ~(SEPARATOR | (_BYTES == 32) | (_BYTES == 9))

PACKED_SCHEMA = "part int, size long, data binary"
#: Frequent edges have ``next``; without it ``n`` is (a part of) the count of a phrase, or of all places for no words.
GRAPH_SCHEMA = "lang string, node string, words int, next string, n long"


# 1. Longest grams


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the number of words from each to the end of its piece, and its text."""
    starts, ends, bounds = textbytes.words(data, offsets, WORD)
    if not len(starts):
        return starts, ends, starts, starts
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pieces = np.cumsum(SEPARATOR[data], dtype=np.int32)[starts]  # equal or not is all that counts
    last = np.ones(len(starts), bool)
    last[:-1] = (pieces[1:] != pieces[:-1]) | (text[1:] != text[:-1])
    final = np.flatnonzero(last)
    return starts, ends, final[np.searchsorted(final, np.arange(len(starts)))] - np.arange(len(starts)) + 1, text


def combined(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One number for each row: equal for equal rows, and ordered as they are."""
    key, bound = columns[0].astype(np.int64), sizes[0]
    for column, size in zip(columns[1:], sizes[1:]):
        if bound > 2**62 // size:
            _, key = np.unique(key, return_inverse=True)
            bound = len(key)
        key, bound = key * size + column, bound * size
    return key


def totals(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each different key, and its sum of ``n``."""
    order = np.argsort(key)
    key = key[order]
    opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return order[opens], np.add.reduceat(n[order], opens) if len(key) else n


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as one plane for each byte, which compresses well, after the number of bytes."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return bytes([kind.itemsize]) + values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T.tobytes()


def pack(columns: list[np.ndarray], lang: np.ndarray, n: np.ndarray, words: pa.Array, langs: pa.Array) -> tuple[int, bytes]:
    """Grams in bytes (and their number before compression): codes of their words (0 for none, else from 1) by a list of the words they use, with languages and counts.

    Rows come in the order of their languages and codes, so the first words are written as differences.
    """
    used = np.zeros(len(words) + 1, bool)
    for column in columns:
        used[column] = True
    used[0] = False
    local = np.cumsum(used) * used
    spoken = np.unique(lang)
    names = pa.concat_arrays([words.take(pa.array(np.flatnonzero(used[1:]))), langs.take(pa.array(spoken))])
    data, offsets = textbytes.flat(names)
    first = local[columns[0]]
    step = np.diff(first, prepend=0) % (len(local) + 1)
    numbers = [np.diff(offsets), n, np.searchsorted(spoken, lang), step, *(local[column] for column in columns[1:])]
    head = np.array([len(n), len(columns), used.sum(), len(spoken), len(local) + 1], np.int64)
    plain = head.tobytes() + b"".join(map(_planes, numbers)) + data.tobytes()
    return len(plain), pa.compress(plain, "zstd", asbytes=True)


def unpack(data: bytes, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, pa.Array, int]:
    """Columns of codes, languages, counts, the names and how many of them are words."""
    data = pa.decompress(data, size, "zstd", asbytes=True)
    rows, width, words, langs, circle = np.frombuffer(data, np.int64, 5).tolist()
    at = 40

    def take(count: int) -> np.ndarray:
        nonlocal at
        item = data[at]
        planes = np.frombuffer(data, np.uint8, count * item, at + 1).reshape(item, count)
        at += 1 + count * item
        return np.ascontiguousarray(planes.T).view(f"u{item}").reshape(count).astype(np.int64)

    lengths, n, lang, step = take(words + langs), take(rows), take(rows), take(rows)
    columns = [np.cumsum(step) % circle, *(take(rows) for _ in range(width - 1))]
    offsets = np.zeros(words + langs + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    names = pa.Array.from_buffers(pa.large_string(), words + langs, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data).slice(at)])
    return columns, lang, n, names, words


def _run(most: int, parts: int, lang: np.ndarray, codes: np.ndarray, left: np.ndarray, words: pa.Array, langs: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """Packed edges (parts from 0) and nodes (parts from ``parts``) of the places that ``lang`` covers."""
    n, size = len(lang), len(words) + 1
    columns = []
    for k in range(most):
        column = np.zeros(n, np.int64)
        more = np.flatnonzero(left[:n] > k)
        column[more] = codes[more + k] + 1
        columns.append(column)
    data, offsets = textbytes.flat(words)
    mark = np.r_[np.uint64(0), textbytes.hashes(data, offsets[:-1], offsets[1:])]
    at, times = totals(combined([lang, *columns], [len(langs)] + [size] * most), np.ones(n, np.int64))
    lang, columns = lang[at], [c[at] for c in columns]
    # The flow of a node: its edges, and the ends of pieces in it.
    node_at, flow = totals(combined([lang, *columns[:-1]], [len(langs)] + [size] * (most - 1)), times)
    whole = np.flatnonzero(columns[-1])
    for first, kept, count, rows in ((0, columns, times[whole], whole), (parts, columns[:-1], flow, node_at)):
        spread = np.zeros(len(rows), np.uint64)
        for column in kept:
            spread = textbytes.mixed(spread + mark[column[rows]])
        part = (spread % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            if cuts[p] < cuts[p + 1]:
                mine = order[cuts[p] : cuts[p + 1]]
                yield first + p, *pack([c[rows[mine]] for c in kept], lang[rows[mine]], count[mine], words, langs)


def _grams(most: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textbytes.slices(batch, most=RUN_BYTES):
                raw, offsets = textbytes.flat(piece.column("text"))
                data = textbytes.LOWER[raw]
                starts, ends, left, text = places(data, offsets)
                if not len(starts):
                    continue
                codes, words = wordcodes.coded(data, starts, ends, WORD)
                lang, langs = wordcodes.strings(piece.column("lang"), "und")
                for a in range(0, len(codes), RUN_PLACES):
                    b = min(a + RUN_PLACES, len(codes))
                    for part, plain, packed in _run(most, parts, lang[text[a:b]], codes[a:], left[a:], words, langs):
                        cells = [pa.array([part], pa.int32()), pa.array([plain], pa.int64()), pa.array([packed], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cells, names=["part", "size", "data"])
                textbytes.give_back()

    return run


def _joined(names: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """Words of codes from 1, with a space between; code 0 is no word."""
    word = lambda c: names.take(pa.array(np.maximum(c - 1, 0), mask=c == 0))
    out = word(columns[0])
    for column in columns[1:]:
        out = pc.binary_join_element_wise(out, word(column), pa.scalar(" ", out.type), null_handling="skip")
    return out


def _merged(most: int, parts: int, least_count: int):
    def run(table: pa.Table) -> pa.Table:
        """Rows of the graph from all packed grams of one part."""
        is_edges = table.column("part")[0].as_py() < parts
        blobs = [unpack(data.as_py(), size.as_py()) for data, size in zip(table.column("data"), table.column("size"))]
        found = pa.concat_arrays([b[3] for b in blobs]).dictionary_encode()
        codes, names = found.indices.to_numpy().astype(np.int64), found.dictionary
        shifts = np.cumsum([0] + [len(b[3]) for b in blobs])
        width = len(blobs[0][0])
        columns = [np.concatenate([np.where(b[0][k] > 0, codes[s + np.maximum(b[0][k] - 1, 0)] + 1, 0) for b, s in zip(blobs, shifts)]) for k in range(width)]
        lang = np.concatenate([codes[s + b[4] + b[1]] for b, s in zip(blobs, shifts)])
        n = np.concatenate([b[2] for b in blobs])
        at, n = totals(combined([lang, *columns], [len(names)] + [len(names) + 1] * width), n)
        lang, columns = lang[at], [c[at] for c in columns]
        out = []

        def give(rows: np.ndarray, count: np.ndarray, words: int) -> None:
            node = _joined(names, [c[rows] for c in columns[:words]]) if words else pa.nulls(len(rows), pa.string())
            last = names.take(pa.array(columns[-1][rows] - 1)) if is_edges else pa.nulls(len(rows), pa.string())
            cells = [names.take(pa.array(lang[rows])), node, pa.array(np.full(len(rows), words, np.int32)), last, pa.array(count)]
            out.append(pa.Table.from_arrays([c.cast(pa.string()) if k in (0, 1, 3) else c for k, c in enumerate(cells)], names=["lang", "node", "words", "next", "n"]))

        frequent = np.flatnonzero(n >= least_count)
        if is_edges:
            give(frequent, n[frequent], most - 1)
        else:
            full = frequent[columns[-1][frequent] > 0]
            give(full, n[full], most - 1)
            for words in range(most - 1):
                begun = np.flatnonzero(columns[words - 1]) if words else np.arange(len(n))
                first, total = totals(combined([lang[begun], *(c[begun] for c in columns[:words])], [len(names)] + [len(names) + 1] * words), n[begun])
                give(begun[first], total, words)
        textbytes.give_back()
        return pa.concat_tables(out)

    return run


def graph(docs: DataFrame, most: int, least_count: int) -> DataFrame:
    """``lang, node, words, next, n``: the frequent edges, the frequent nodes, and sums of flows by their first words, as a table."""
    texts = docs.select(text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-size // PART_BYTES))
    packed = texts.mapInArrow(_grams(most, parts), PACKED_SCHEMA).repartition(max(tasks, -(-2 * parts // TASK_PARTS)), "part")
    return written(packed.groupBy("part").applyInArrow(_merged(most, parts, least_count), GRAPH_SCHEMA), "graph")


# 2. Counts of phrases


def prefix(phrase: str, words: int | str) -> Column:
    """The first words of a phrase."""
    return F.expr(f"substring_index({phrase}, ' ', {words})")


def suffix(phrase: str, words: int | str) -> Column:
    """The last words of a phrase."""
    return F.expr(f"substring_index({phrase}, ' ', -({words}))")


def phrases(rows: DataFrame, least_count: int) -> DataFrame:
    """``lang, phrase, words, f`` of the frequent phrases shorter than the edges, from the flows of the nodes that begin with them."""
    met = rows.filter("next IS NULL AND words > 0").groupBy("lang", F.col("node").alias("phrase"), "words").agg(F.sum("n").alias("f"))
    return written(met.filter(F.col("f") >= least_count), "phrases")


# 3. Paths


def unary_paths(edges: DataFrame, most: int, rounds: int = ROUNDS) -> DataFrame:
    """``lang, chain, edges``: the frequent edges (``lang, node, next, n``) as paths, ``edges`` in order with ``place, gram, n``.

    ``chain`` is the text of the path: its first gram and the last word of each further one.
    """
    after = F.col("next") if most == 2 else F.concat_ws(" ", suffix("node", most - 2), "next")
    arcs = written(edges.select("lang", "node", after.alias("to"), F.concat_ws(" ", "node", "next").alias("gram"), "n"), "arcs")
    degrees = arcs.groupBy("lang", F.col("node").alias("at")).agg(F.count(F.lit(1)).alias("n_out")).join(
        arcs.groupBy("lang", F.col("to").alias("at")).agg(F.count(F.lit(1)).alias("n_in"), F.min("node").alias("before")), ["lang", "at"]
    )
    inner = degrees.filter(f"n_out = 1 AND n_in = 1 AND pmod(xxhash64(lang, at), {CUT}) <> 0").select("lang", "at", "before")
    inner = written(inner, "inner")
    above = inner.select("lang", F.col("at").alias("before"), F.lit(True).alias("known"))
    # Every inner node points to the inner node before it, the first of a path to itself.
    up = inner.join(above, ["lang", "before"], "left").select(
        "lang", "at", F.when(F.col("known"), F.col("before")).otherwise(F.col("at")).alias("up"), F.coalesce(F.col("known").cast("int"), F.lit(0)).alias("place")
    )
    up = written(up, "pointers")
    for _ in range(rounds):
        further = up.select("lang", F.col("at").alias("up"), F.col("up").alias("jump"), F.col("place").alias("more"))
        up = written(up.join(further, ["lang", "up"]).select("lang", "at", F.col("jump").alias("up"), (F.col("place") + F.col("more")).alias("place")), "pointers")
    tops = up.filter("up = at").select("lang", F.col("at").alias("up"), F.lit(True).alias("top"))
    # A node whose pointer has met no first node (a longer path, or a circle) begins a path of its own.
    up = up.join(tops, ["lang", "up"], "left").select(
        "lang", "at", F.when(F.col("top"), F.col("up")).otherwise(F.col("at")).alias("path"), F.when(F.col("top"), F.col("place")).otherwise(0).alias("place")
    )
    up = written(up, "places")
    at_end = up.select("lang", F.col("at").alias("to"), F.col("path").alias("end_path"), F.col("place").alias("end_place"))
    at_start = up.select("lang", F.col("at").alias("node"), F.col("path").alias("start_path"), (F.col("place") + 1).alias("start_place"))
    placed = arcs.join(at_end, ["lang", "to"], "left").join(at_start, ["lang", "node"], "left").select(
        "lang",
        # A gram has one word more than a node, so the two kinds of names are apart.
        F.coalesce("end_path", "start_path", "gram").alias("path"),
        F.coalesce("end_place", "start_place", F.lit(0)).alias("place"),
        "gram",
        "n",
    )
    rows = placed.groupBy("lang", "path").agg(F.sort_array(F.collect_list(F.struct("place", "gram", "n"))).alias("edges"))
    tail = F.transform(F.slice("edges", F.lit(2), F.size("edges")), lambda e: F.substring_index(e["gram"], " ", -1))
    return rows.select("lang", F.concat_ws(" ", F.array(F.col("edges")[0]["gram"]), tail).alias("chain"), "edges")


def longest_at_nodes(paths: DataFrame, most: int) -> DataFrame:
    """``lang, phrase, longest``: for each node on a path the count of the most frequent edge it is part of."""
    counts, size = F.col("edges.n"), F.size("edges")
    at = F.sequence(F.lit(0), size)
    node = lambda k: F.when(k < size, F.substring_index(F.get(F.col("edges.gram"), k), " ", most - 1)).otherwise(
        F.substring_index(F.get(F.col("edges.gram"), size - 1), " ", 1 - most)
    )
    near = F.transform(at, lambda k: F.struct(node(k).alias("phrase"), F.greatest(F.get(counts, k - 1), F.get(counts, k)).alias("longest")))
    return paths.select("lang", F.explode(near).alias("x")).groupBy("lang", "x.phrase").agg(F.max("x.longest").alias("longest"))


# 4. Candidates


def cut_score(a: str, left: str, right: str) -> Column:
    """``floor(10^6 * a * a / (l * r))``, exact."""
    up = f"CAST({a} AS DECIMAL(15, 0)) * CAST({a} AS DECIMAL(15, 0)) * CAST(1000000 AS DECIMAL(7, 0))"
    return F.expr(f"({up}) div (CAST({left} AS DECIMAL(18, 0)) * CAST({right} AS DECIMAL(18, 0)))")


def collocations(
    docs: DataFrame, least_words: int = LEAST_WORDS, most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT, percent: int = PERCENT, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, cut`` of each language's first ``top`` phrases; the cut is after so many words."""
    if not 2 <= least_words <= most_words:
        raise ValueError("phrases have two words or more")
    spark = docs.sparkSession
    nodes = graph(docs, most_words, least_count)
    short = phrases(nodes, least_count)
    paths = written(unary_paths(nodes.filter("next IS NOT NULL").select("lang", "node", "next", "n"), most_words), "paths")

    found = paths.select("lang", F.explode("edges").alias("e")).select("lang", F.col("e.gram").alias("phrase"), F.lit(most_words).alias("words"), F.col("e.n").alias("a"))
    for words in range(least_words, most_words):
        mine = short.filter(F.col("words") == words)
        if words == most_words - 1:
            longer = longest_at_nodes(paths, most_words)
        else:
            ends = F.array(prefix("phrase", words), suffix("phrase", words))
            longer = short.filter(F.col("words") == words + 1).select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
        mine = mine.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longest IS NULL OR 100 * longest < {percent} * f"))
        found = found.unionByName(mine.select("lang", "phrase", "words", F.col("f").alias("a")))
    found = written(found, "candidates")

    part = short.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", prefix("phrase", "cut")).withColumn("right", suffix("phrase", "words - cut"))
    cuts = cuts.join(part.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(part.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    least = F.min(F.struct(cut_score("a", "l", "r").alias("score"), "cut", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(least.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score", "x.cut")

    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    near = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    sums = nodes.filter("next IS NULL AND words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
