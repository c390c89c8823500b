"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample.

Every rule is a test on signals of a text that are computed for many texts at once in numpy. A hashed sample of the
documents is run through every rule first: each task reports, per rule, how many documents it rejects and how long it
took (a rule's own signal included). The rules are then sorted by rejections per second, so that documents leave
early and dear rules see few of them. The order changes only what the verdict costs, never the verdict: a document is
kept if no rule rejects it. Each document is judged on its own, without a shuffle.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. The base
signals are exact: words are compared by codes of a dictionary of their bytes, 8-word windows by their codes, and lines of equal hashes
by their bytes.

Defined results: a null or empty text has no words and fails the base rule. Repeated rows are judged each; rows of
null doc_id are kept in the output. An empty sample leaves the rules in the order they are listed. The output has
only the columns named below.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm import textbytes, wordcodes
from shardframe.llm.shared import text_of

#: One in so many documents, by a hash of the id, is in the sample for costs and rejections. The sample only orders
#: the rules.
SAMPLE_ONE_IN = 50
WINDOW = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BYTES = np.arange(256)
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LETTER = UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 192)
TAIL = (_BYTES & 0xC0) == 0x80

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, text_chars long"
)


class Signals:
    """Signals of a run of texts, each computed when first asked for."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, self.offsets = textbytes.flat(texts)
        self.n = len(texts)
        self.starts, self.ends, self.bounds = textbytes.words(self.data, self.offsets, textbytes.SPACED)
        self._made: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        made = self.__dict__["_made"]
        if name not in made:
            made[name] = getattr(type(self), f"make_{name}")(self)
        return made[name]

    def only(self, rows: np.ndarray) -> Signals:
        """The signals of some of the texts, from their bytes."""
        part = object.__new__(Signals)
        sizes = np.diff(self.offsets)[rows]
        part.offsets, part.n, part._made = np.r_[0, np.cumsum(sizes)], len(rows), {}
        part.data = np.concatenate([self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows]) if len(rows) else self.data[:0]
        part.starts, part.ends, part.bounds = textbytes.words(part.data, part.offsets, textbytes.SPACED)
        return part

    def _count(self, marked: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(marked)]
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def _per_text(self, where: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        owner = np.searchsorted(self.bounds, where, "right") - 1
        return np.bincount(owner, weights, self.n).astype(np.int64)

    def make_n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    def make_text_chars(self) -> np.ndarray:
        return self._count(~TAIL[self.data])

    def make_word_chars(self) -> np.ndarray:
        return self._count(textbytes.SPACED[self.data] & ~TAIL[self.data])

    def make_n_symbols(self) -> np.ndarray:
        return self._count(SYMBOLS[self.data])

    def make_n_letters(self) -> np.ndarray:
        return self._count(LETTER[self.data])

    def make_n_upper(self) -> np.ndarray:
        return self._count(UPPER[self.data])

    def make_n_lower(self) -> np.ndarray:
        return self._count(LETTER[self.data] & ~UPPER[self.data] & (self.data < 128))

    def make_codes(self) -> np.ndarray:
        """Equal words have equal codes."""
        return wordcodes.coded(self.data, self.starts, self.ends, textbytes.SPACED)[0]

    def make_lines(self) -> np.ndarray:
        """Per line with a word: its text and whether an earlier line of the text is equal."""
        opens = np.unique(np.r_[self.offsets[:-1][np.diff(self.offsets) > 0], np.flatnonzero(self.data[:-1] == 10) + 1])
        if not len(opens):
            return np.zeros((0, 2), np.int64)
        owner = np.searchsorted(self.offsets, opens, "right") - 1
        closes = np.r_[opens[1:], len(self.data)]
        closes = np.where((closes > opens) & (self.data[closes - 1] == 10), closes - 1, closes)
        has = np.searchsorted(self.starts, closes) > np.searchsorted(self.starts, opens)
        opens, closes, owner = opens[has], closes[has], owner[has]
        keys = textbytes.hashes(self.data, opens, closes)
        order = np.lexsort((opens, keys, owner))
        alike = np.flatnonzero((keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1]))
        again = np.zeros(len(order), bool)
        again[alike + 1] = textbytes.same_ranges(self.data, opens, closes, order[alike], order[alike + 1])
        for k in (alike + 1)[~again[alike + 1]].tolist():
            # Different lines of one hash: any earlier line of that hash may be the equal one.
            earlier = [j for j in range(k) if keys[order[j]] == keys[order[k]] and owner[order[j]] == owner[order[k]]]
            again[k] = textbytes.same_ranges(self.data, opens, closes, order[earlier], np.full(len(earlier), order[k])).any()
        return np.stack([owner[order], again], axis=1)

    def make_n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[:, 0], minlength=self.n)

    def make_n_dup_lines(self) -> np.ndarray:
        return np.bincount(self.lines[:, 0], self.lines[:, 1], self.n).astype(np.int64)

    def make_n_repeat_words(self) -> np.ndarray:
        at, keys = textbytes.windows(textbytes.mixed(self.codes.astype(np.uint64)), self.bounds, WINDOW)
        if not len(at):
            return np.zeros(self.n, np.int64)
        owner = np.searchsorted(self.bounds, at, "right") - 1
        order = np.lexsort((keys, owner))
        alike = np.flatnonzero((keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1]))
        left, right = at[order][alike], at[order][alike + 1]
        equal = np.ones(len(alike), bool)
        for k in range(WINDOW):
            equal &= self.codes[left + k] == self.codes[right + k]
        if not equal.all():
            # Different windows of one hash: sort by all their words instead.
            order = np.lexsort((*(self.codes[at + k] for k in range(WINDOW)), owner))
            left, right = at[order][:-1], at[order][1:]
            equal = owner[order][1:] == owner[order][:-1]
            for k in range(WINDOW):
                equal &= self.codes[left + k] == self.codes[right + k]
        repeated = np.unique(np.r_[left[equal], right[equal]])
        cover = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(cover, repeated, 1)
        np.add.at(cover, repeated + WINDOW, -1)
        return self._per_text(np.flatnonzero(np.cumsum(cover[:-1]) > 0))

    def make_n_stutters(self) -> np.ndarray:
        """Words equal to the word just before them."""
        same = np.flatnonzero(self.codes[1:] == self.codes[:-1]) + 1
        first = np.zeros(len(self.starts) + 1, bool)
        first[self.bounds] = True
        return self._per_text(same[~first[same]])

    def make_n_plain_words(self) -> np.ndarray:
        """Words with a letter."""
        total = np.r_[0, np.cumsum(LETTER[self.data])]
        return self._per_text(np.flatnonzero(total[self.ends] > total[self.starts]))


@dataclass(frozen=True)
class Rule:
    """A name and the test that rejects."""

    name: str
    rejects: Callable[[Signals], np.ndarray]


def base_failed(s: Signals) -> np.ndarray:
    """Too short, or too many words in repeated 8-word windows."""
    return (s.n_words < 20) | (100 * s.n_repeat_words > 30 * s.n_words)


#: A document is kept if none of these rejects it. The thresholds are for prose of any language with spaces.
RULES = (
    Rule("base", base_failed),
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("shouting", lambda s: 2 * s.n_upper > s.n_upper + s.n_lower),
    Rule("word_length", lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 15 * s.n_words)),
    Rule("few_letters", lambda s: 2 * s.n_plain_words < s.n_words),
    Rule("stutter", lambda s: 5 * s.n_stutters > s.n_words),
    Rule("repeated_lines", lambda s: (s.n_lines >= 4) & (2 * s.n_dup_lines > s.n_lines)),
)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textbytes.slices(batch):
            rejected, seconds = [], []
            for rule in RULES:
                fresh = Signals(part.column("text"))
                began = time.perf_counter()
                rejected.append(int(rule.rejects(fresh).sum()))
                seconds.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.name for r in RULES]), pa.array(rejected, pa.int64()), pa.array(seconds), pa.array([part.num_rows] * len(RULES), pa.int64())],
                names=["rule", "rejected", "seconds", "n"],
            )


def rule_costs(docs: DataFrame, one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """Per rule: documents of the sample, how many it rejects, and seconds for all of them."""
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(one_in)) == 0).select(text_of().alias("text"))
    return (
        chosen.mapInArrow(_measure, "rule string, rejected long, seconds double, n long")
        .groupBy("rule")
        .agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    )


def cascade_order(costs: DataFrame) -> list[str]:
    """Rule names by rejections per second, best first; rules that the sample says nothing about come last."""
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in costs.collect()}
    return sorted((r.name for r in RULES), key=lambda name: -rate.get(name, 0.0))


def cascade(signals: Signals, order: list[str]) -> np.ndarray:
    """Whether each text is kept; every rule sees only the texts that no rule before it rejected."""
    by_name = {r.name: r for r in RULES}
    kept, left, alive = np.zeros(signals.n, bool), np.arange(signals.n), signals
    for name in order:
        rejected = by_name[name].rejects(alive)
        if rejected.any():
            left = left[~rejected]
            # Cutting the texts out anew pays only if many have gone.
            if 2 * len(left) < signals.n or len(left) < 0.7 * alive.n:
                alive = alive.only(np.flatnonzero(~rejected))
            else:
                alive = _Masked(alive, np.flatnonzero(~rejected))
        if not len(left):
            break
    kept[left] = True
    return kept


class _Masked:
    """Some of the texts of other signals, without copying their bytes."""

    def __init__(self, of, rows: np.ndarray) -> None:
        self.of, self.rows, self.n = of, rows, len(rows)

    def __getattr__(self, name: str) -> np.ndarray:
        return getattr(self.of, name)[self.rows]

    def only(self, rows: np.ndarray) -> Signals:
        return self.of.only(self.rows[rows])


def judge(docs: DataFrame, order: list[str]) -> DataFrame:
    """Base signals and verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch):
                s = Signals(part.column("text"))
                failed = base_failed(s)
                kept = cascade(s, order) & ~failed
                numbers = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(failed), pa.array(kept), pa.array(s.text_chars, pa.int64())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "text_chars"],
                )
        textbytes.give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """Order the rules on a sample of ``docs``, then judge every row."""
    return judge(docs, cascade_order(rule_costs(docs, one_in)))
