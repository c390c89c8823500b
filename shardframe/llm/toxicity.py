"""Toxic spans and document scores from a linear-chain conditional random field.

Labels exist per document only. A bounded, hashed sample of labelled documents (``PER_CLASS`` of each class, fewer if
there are fewer) is brought to the driver. There, words and word beginnings that occur almost only in toxic documents
become features, and the words that carry one in a toxic document are the labelled toxic tokens. A field of two
states (clean, toxic) is trained on these sequences by gradient ascent; a logistic curve from its marginals to the
document label is fitted on the same sample. The model is small and of a bounded size (at most ``FEATURES``), so it
is broadcast; every document is then scored on its own, without a shuffle.

Scoring runs forward-backward over the whole text. Words without a feature all have the same potentials, so a run of
them is a power of one 2 x 2 matrix, taken in closed form; the marginals are those of the full recursion. A document's
score depends on the largest marginal and the sum of marginals; words with a marginal of at least one half make up the
offending spans, given as character offsets into the text.

Defined results: a null text is empty; a text without words has the score of a document without toxic words. Labels
are those of ``labels`` rows with a non-null doc_id and label (1 if any row of the id says 1). A null doc_id is never held
out. Repeated rows are scored each. Without labelled documents of both classes every score is 0. Only the named
columns of either table are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardframe.llm import textbytes
from shardframe.llm.shared import received, shipped, text_of

#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 1500
#: Features of the model, at most (those of the most toxic documents).
FEATURES = 5000
#: A feature follows so many different words in the toxic sample at least, plus this share of the number of toxic documents.
LEAST_CONTEXTS = 3
LEAST_SHARE = 0.01
#: It does so, for each document, so many times as often as in the clean sample (with half a time added to both).
LEAST_RATIO = 25.0
#: Lengths in bytes of the word beginnings; 0 is the whole word.
PREFIXES = (0, 4, 5, 6, 7, 8)
#: Words of a training sequence.
SEQUENCE = 32
THRESHOLD = 0.3
FLOOR = 1e-9

SCHEMA = "doc_id long, score double, n_toxic long, spans array<struct<start: long, stop: long, marginal: double>>"


@dataclass(frozen=True)
class Model:
    """Sorted feature keys and weights; potentials of the field; the curve to the document score."""

    keys: np.ndarray
    weights: np.ndarray
    roots: np.ndarray
    bias: float
    start: np.ndarray
    moves: np.ndarray
    curve: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _first_eight(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number, the first byte highest, zero beyond the word."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        at = starts + k
        inside = at < ends
        byte = data[np.where(inside, at, 0)]
        out |= np.where(inside, byte, 0).astype(np.uint64) << np.uint64(8 * (7 - k))
    return out


def _feature_keys(data, starts, ends) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the words that have one, and its key."""
    head = _first_eight(data, starts, ends)
    for length in PREFIXES:
        yield _keys_of_kind(length, data, starts, ends, head)


def _keys_of_kind(length: int, data, starts, ends, head) -> tuple[np.ndarray, np.ndarray]:
    if not length:
        return np.arange(len(starts)), textbytes.hashes(data, starts, ends)
    which = np.flatnonzero(ends - starts >= length)
    kept = head[which] >> np.uint64(64 - 8 * length)
    return which, textbytes.mixed(kept * np.uint64(16) + np.uint64(length))


class Tokens:
    """The words of a run of texts in lower case (A to Z)."""

    def __init__(self, texts: pa.Array) -> None:
        raw, self.offsets = textbytes.flat(texts)
        self.data = textbytes.LOWER[raw]
        self.starts, self.ends, self.bounds = textbytes.words(self.data, self.offsets, textbytes.ALNUM)


def _active(tokens: Tokens, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Words that have features of the model, in order, and the sum of their weights."""
    # A feature is at least two bytes long in all words that have it, or a whole word: its first two bytes tell.
    if not len(tokens.starts):
        return np.zeros(0, np.int64), np.zeros(0)
    second = np.where(tokens.starts + 1 < tokens.ends, tokens.data[np.minimum(tokens.starts + 1, len(tokens.data) - 1)], 0)
    maybe = np.flatnonzero(model.roots[tokens.data[tokens.starts].astype(np.int64) << 8 | second])
    if not len(maybe):
        return maybe, np.zeros(0)
    total, hit = np.zeros(len(maybe)), np.zeros(len(maybe), bool)
    for which, keys in _feature_keys(tokens.data, tokens.starts[maybe], tokens.ends[maybe]):
        at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
        known = model.keys[at] == keys
        total[which[known]] += model.weights[at[known]]
        hit[which[known]] = True
    return maybe[hit], total[hit]


def _powers(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Parts of a positive 2 x 2 matrix: m^g is in proportion to first + ratio^g second."""
    half, det = np.trace(m) / 2, m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
    root = np.sqrt(max(half * half - det, 1e-300))
    large, small = half + root, half - root
    return (m - small * np.eye(2)) / (large - small), (large * np.eye(2) - m) / (large - small), small / large


def marginals(model: Model, lengths: np.ndarray, owner: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at the given words, by forward-backward over whole texts.

    ``owner`` (ascending) is the text, ``place`` the word's position in it, ``lengths`` the texts' numbers of words;
    all other words have the default potentials.
    """
    count = len(owner)
    if not count:
        return np.zeros(0)
    move, plain = np.exp(model.moves), np.exp(np.array([0.0, model.bias]))
    step = move * plain
    one, two, ratio = _powers(step)
    emit = np.exp(np.stack([np.zeros(count), np.clip(model.bias + weight, -50, 50)], axis=1))
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[first, count])
    gap = np.r_[0, np.diff(place) - 1]
    gap[first] = place[first] - 1
    last = first + sizes - 1
    ahead, back = np.zeros((count, 2)), np.ones((count, 2))
    start = np.exp(model.start)
    through = lambda v, g, left: (v @ one + (ratio ** g)[:, None] * (v @ two)) if left else (v @ one.T + (ratio ** g)[:, None] * (v @ two.T))
    by_size = np.argsort(-sizes, kind="stable")
    first, sizes, last = first[by_size], sizes[by_size], last[by_size]
    for k in range(int(sizes[0])):
        at = first[: np.searchsorted(-sizes, -k, "left")] + k
        if k:
            v = through(ahead[at - 1], gap[at], True) @ move
        else:
            begin = np.broadcast_to(start * plain, (len(at), 2))
            v = through(begin, np.maximum(gap[at], 0), True) @ move
            v = np.where((gap[at] < 0)[:, None], start, v)
        v = v * emit[at]
        ahead[at] = v / v.sum(axis=1, keepdims=True)
    for k in range(int(sizes[0])):
        at = last[: np.searchsorted(-sizes, -k, "left")] - k
        if k:
            v = (emit[at + 1] * back[at + 1]) @ move.T
            v = through(v, gap[at + 1], False)
        else:
            v = through(np.ones((len(at), 2)), lengths[owner[at]] - 1 - place[at], False)
        back[at] = v / v.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1)


def _document_features(n: int, owner: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Columns: 1, log odds of the largest marginal, log of 1 + the sum of marginals."""
    most, total = np.full(n, FLOOR), np.zeros(n)
    np.maximum.at(most, owner, np.clip(m, FLOOR, 1 - FLOOR))
    np.add.at(total, owner, m)
    return np.stack([np.ones(n), np.log(most / (1 - most)) / 10, np.log1p(total)], axis=1)


def _score_texts(model: Model, texts: pa.Array):
    """Per text: score; per offending word: text, start, stop (bytes in the run of texts) and marginal."""
    tokens = Tokens(texts)
    words, weights = _active(tokens, model)
    owner = np.searchsorted(tokens.bounds, words, "right") - 1
    m = marginals(model, np.diff(tokens.bounds), owner, words - tokens.bounds[owner], weights)
    x = _document_features(len(texts), owner, m)
    score = 1 / (1 + np.exp(-np.clip(x @ model.curve, -60, 60)))
    return tokens, score, owner, words, m


# Fitting, on the driver, over the bounded sample


def choose_features(toxic: list[str], clean: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the features, and the roots (first two bytes) of the words that have them."""

    def runs(texts: list[str]) -> list[Tokens]:
        return [Tokens(pa.array(texts[at : at + 200], pa.large_string())) for at in range(0, len(texts), 200)]

    def contexts(tokens: list[Tokens], length: int, among: np.ndarray):
        """Of some features, after how many different words they stand (so copies of a text count once), and their roots."""
        found = []
        for t in tokens:
            if not len(t.starts):
                continue
            head = _first_eight(t.data, t.starts, t.ends)
            which, keys = _keys_of_kind(length, t.data, t.starts, t.ends, head)
            known = among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys
            which, keys = which[known], keys[known]
            before = np.zeros(len(which), np.uint64)
            inner = np.flatnonzero(~np.isin(which, t.bounds))
            before[inner] = textbytes.hashes(t.data, t.starts[which[inner] - 1], t.ends[which[inner] - 1])
            found.append(np.stack([keys, before, head[which] >> np.uint64(48)], axis=1))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.uint64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        if len(rows):
            rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]
        keys, first, n = np.unique(rows[:, 0], return_index=True, return_counts=True)
        return keys, n, rows[first, 2].astype(np.int64)

    least = LEAST_CONTEXTS + LEAST_SHARE * len(toxic)
    bad, good_texts = runs(toxic), runs(clean)
    parts = []
    for length in PREFIXES:
        # Features that occur often at all come first: few are left whose contexts are worth looking at.
        sent = [_keys_of_kind(length, t.data, t.starts, t.ends, _first_eight(t.data, t.starts, t.ends))[1] for t in bad]
        keys, n = np.unique(np.concatenate(sent), return_counts=True)
        keys = keys[n >= least]
        if not len(keys):
            continue
        keys, n, roots = contexts(bad, length, keys)
        often = n >= least
        keys, n, roots = keys[often], n[often], roots[often]
        if not len(keys):
            continue
        other, n_other, _ = contexts(good_texts, length, keys)
        against = np.zeros(len(keys))
        against[np.searchsorted(keys, other)] = n_other
        parts.append((keys, n, roots, against))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, n, roots, against = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, n, roots, against = keys[order], n[order], roots[order], against[order]
    ratio = (n + 0.5) / (len(toxic) + 1) / ((against + 0.5) / (len(clean) + 1))
    good = np.flatnonzero(ratio >= LEAST_RATIO)
    good = np.sort(good[np.argsort(-n[good], kind="stable")[:FEATURES]])
    return keys[good], roots[good]


def _sequences(tokens: Tokens, keys: np.ndarray):
    """Feature occurrences as pairs (word, feature)."""
    pairs = []
    for which, found in _feature_keys(tokens.data, tokens.starts, tokens.ends):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        known = keys[at] == found
        pairs.append(np.stack([which[known], at[known]], axis=1))
    return np.concatenate(pairs)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 60, rate: float = 0.35, ridge: float = 0.02) -> Model:
    """The model from labelled texts."""
    none = Model(np.zeros(1, np.uint64), np.zeros(1), np.zeros(65536, bool), -9.0, np.zeros(2), np.zeros((2, 2)), np.array([-60.0, 0, 0]))
    if not toxic.any() or toxic.all():
        return none
    keys, roots = choose_features([t for t, y in zip(texts, toxic) if y], [t for t, y in zip(texts, toxic) if not y])
    if not len(keys):
        return none
    pairs, per_text, n = [], [], 0
    for at in range(0, len(texts), 200):
        tokens = Tokens(pa.array(texts[at : at + 200], pa.large_string()))
        pairs.append(_sequences(tokens, keys) + [n, 0])
        per_text.append(np.diff(tokens.bounds))
        n += len(tokens.starts)
    pairs, per_text = np.concatenate(pairs), np.concatenate(per_text)
    bounds = np.r_[0, np.cumsum(per_text)]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), per_text)
    label = np.zeros(n, np.int8)
    label[pairs[:, 0]] = 1
    label &= toxic[doc].astype(np.int8)
    # Sequences of up to SEQUENCE words; those without any feature differ in length only and get a weight.
    opens = np.concatenate([np.arange(a, b, SEQUENCE) for a, b in zip(bounds, bounds[1:])])
    sizes = np.diff(np.r_[opens, n])
    sequence = np.repeat(np.arange(len(opens), dtype=np.int32), sizes)
    has = np.zeros(len(opens), bool)
    has[sequence[pairs[:, 0]]] = True
    plain_sizes, plain_weights = np.unique(sizes[~has], return_counts=True)
    rows = np.cumsum(has) - 1
    shape = (int(has.sum()) + len(plain_sizes), SEQUENCE)
    size = np.r_[sizes[has], plain_sizes]
    share = np.r_[np.ones(int(has.sum())), plain_weights]
    y = np.zeros(shape, np.int8)
    at = np.flatnonzero(label)
    y[rows[sequence[at]], at - opens[sequence[at]]] = 1
    row, column, feature = rows[sequence[pairs[:, 0]]], (pairs[:, 0] - opens[sequence[pairs[:, 0]]]), pairs[:, 1]
    live = np.arange(SEQUENCE) < size[:, None]

    w = len(keys)
    flat = np.concatenate([np.zeros(w), [-4.0], [0.0, -2.0], [0.0, -2.0, 0.0, 0.0]])
    square = np.zeros_like(flat)
    seen = np.zeros((2, 2))
    for t in range(1, SEQUENCE):
        np.add.at(seen, (y[:, t - 1], y[:, t]), live[:, t] * share)
    for _ in range(rounds):
        weights, bias, start, moves = flat[:w], flat[w], flat[w + 1 : w + 3], flat[w + 3 :].reshape(2, 2)
        energy = np.full(shape, bias)
        np.add.at(energy, (row, column), weights[feature])
        toxic_e, move = np.exp(np.clip(energy, -50, 50)), np.exp(moves)
        e = lambda t: np.stack([np.ones(shape[0]), toxic_e[:, t]], axis=1)  # noqa: E731, B023
        ahead = np.zeros((SEQUENCE, shape[0], 2))
        v = np.exp(start) * e(0)
        ahead[0] = v / v.sum(axis=1, keepdims=True)
        for t in range(1, SEQUENCE):
            v = (ahead[t - 1] @ move) * e(t)
            ahead[t] = np.where(live[:, t, None], v / v.sum(axis=1, keepdims=True), ahead[t - 1])
        back, p, edges = np.ones((shape[0], 2)), np.zeros(shape), np.zeros((2, 2))
        for t in range(SEQUENCE - 1, -1, -1):
            both = ahead[t] * back
            p[:, t] = both[:, 1] / both.sum(axis=1)
            if t:
                to = e(t) * back
                edge = ahead[t - 1][:, :, None] * move * to[:, None, :]
                edge /= edge.sum(axis=(1, 2), keepdims=True)
                edges += (edge * (live[:, t] * share)[:, None, None]).sum(axis=0)
                v = to @ move.T
                back = np.where(live[:, t, None], v / v.sum(axis=1, keepdims=True), 1.0)
        miss = (y - p) * live * share[:, None]
        grad = np.concatenate(
            [
                np.bincount(feature, miss[row, column], minlength=w),
                [miss.sum()],
                [-miss[:, 0].sum(), miss[:, 0].sum()],
                (seen - edges).ravel(),
            ]
        ) - ridge * flat
        square += grad**2
        flat = flat + rate * grad / np.sqrt(square + 1e-9)
    root = np.zeros(65536, bool)
    root[roots] = True
    model = Model(keys, flat[:w].copy(), root, float(flat[w]), flat[w + 1 : w + 3].copy(), flat[w + 3 :].reshape(2, 2).copy(), np.zeros(3))
    return _fit_curve(model, texts, toxic)


def _fit_curve(model: Model, texts: list[str], toxic: np.ndarray) -> Model:
    x = []
    for at in range(0, len(texts), 200):
        part = pa.array(texts[at : at + 200], pa.large_string())
        tokens, _, owner, _, m = _score_texts(model, part)
        x.append(_document_features(len(part), owner, m))
    x, curve = np.concatenate(x), np.zeros(3)
    for _ in range(25):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -60, 60)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        curve = curve + np.linalg.solve(h, x.T @ (toxic - p) - 0.1 * curve)
    # More of either may not lower the score.
    curve[1:] = np.maximum(curve[1:], 0)
    return Model(model.keys, model.weights, model.roots, model.bias, model.start, model.moves, curve)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a hashed sample of the labelled documents that aren't held out."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    )
    order = F.xxhash64("_id", F.lit(7))
    # A document may lack its text: every label counts, whether or not it has a document.
    chosen = [known.filter(F.col("_toxic") == c).orderBy(order, "_id").limit(per_class) for c in (1, 0)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text")).join(ids, "_id").groupBy("_id", "_toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["_id"])
    return [r["text"] for r in rows], np.array([r["_toxic"] for r in rows], np.int64)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model from the labelled documents that aren't held out."""
    return fit(*sample(docs, labels, per_class))


def _spans(tokens: Tokens, n: int, owner, words, m) -> tuple[np.ndarray, pa.Array]:
    """Number of offending words, and their character ranges, for each text."""
    bad = m >= 0.5
    owner, words, m = owner[bad], words[bad], m[bad]
    letters = np.r_[0, np.cumsum((tokens.data & 0xC0) != 0x80)]
    base = letters[tokens.offsets[owner]] if len(owner) else np.zeros(0, np.int64)
    per = np.bincount(owner, minlength=n)
    parts = pa.StructArray.from_arrays(
        [
            pa.array(letters[tokens.starts[words]] - base, pa.int64()),
            pa.array(letters[tokens.ends[words]] - base, pa.int64()),
            pa.array(m, pa.float64()),
        ],
        names=["start", "stop", "marginal"],
    )
    return per, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)], pa.int32()), parts)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(shared)
        for batch in batches:
            for part in textbytes.slices(batch):
                tokens, score, owner, words, m = _score_texts(model, part.column("text"))
                per, spans = _spans(tokens, part.num_rows, owner, words, m)
                rest = [part.column(k) for k in range(part.num_columns - 1)]
                names = [f"c{k}" for k in range(len(rest))]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(score), pa.array(per, pa.int64()), spans], names=[*names, "score", "n_toxic", "spans"]
                )
        textbytes.give_back()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, n_toxic, spans`` of every row."""
    shared = shipped(docs.sparkSession, model)
    chosen = docs.select(F.col("doc_id").cast("long").alias("c0"), text_of().alias("text"))
    return chosen.mapInArrow(_scorer(shared), SCHEMA.replace("doc_id", "c0", 1)).withColumnRenamed("c0", "doc_id")


def score_of(docs: DataFrame, model: Model) -> Column:
    """The score as a column, so that a filter keeps every other column as it is."""
    shared = shipped(docs.sparkSession, model)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = received(shared)
        for texts in parts:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            out = [_score_texts(model, part.column("text"))[1] for part in textbytes.slices(batch)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))
        textbytes.give_back()

    return scored(text_of())


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Train on the labelled documents that aren't held out, then score every document."""
    scored = score(docs, train(docs, labels, per_class))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_toxic",
        "spans",
    )
