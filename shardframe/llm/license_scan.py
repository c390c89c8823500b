"""Licence scan by a positional index of rare licence words.

Templates are the phrases of ``PHRASES`` (all words mandatory) and short licence texts with mandatory key phrases.
Their words make up the licence vocabulary, and the postings say at which positions of which templates a word stands.
One pass over the documents counts in how many each licence word occurs, which gives the words' IDF. In the second
pass a file's licence words of highest IDF are looked up; each posting votes for a template at a relative position
(place in the file minus place in the template). For every template only its rarest words vote, as many as needed so
that a match can't be missed: one word for a phrase, the ``1 + allowed misses`` rarest places for a longer text.
Positions with a vote are then verified: all words of a phrase; for a text the share of its words at their places and
its key phrases within it. Documents never meet, so only the counts (one row per licence word) are shuffled; postings
and IDF are of the size of the templates.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in the text with A-Z in lower case.

Defined results: a null text is empty and has no words; no match gives null places, empty label lists and score 0.
Repeated rows are scanned each; null ids stay null. Ties of IDF go to the word that sorts first. The output has only
the columns named below.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm import textbytes
from shardframe.llm.shared import received, shipped, text_of

#: Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Licence texts of the method: label, text, mandatory key phrases. Opening or central sentences of public licences.
TEXTS = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("free of charge", "without restriction"),
    ),
    (
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind",
        ("as is basis", "conditions of any kind"),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("free software foundation",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("source and binary forms", "conditions are met"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
        ("with or without fee",),
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license",
        ("mozilla public license",),
    ),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution international license",
        ("creative commons attribution",),
    ),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)
#: Share of a text's words that must stand at their places.
LEAST_SHARE = 0.8

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, places array<struct<label: string, word: long, share: double>>"
)


@dataclass(frozen=True)
class Template:
    """Words of one template as vocabulary numbers."""

    label: str
    words: np.ndarray
    keys: list[np.ndarray]
    base: bool
    voters: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


@dataclass(frozen=True)
class Index:
    """Sorted hashes of the licence vocabulary, the templates, and for each word its postings."""

    hashes: np.ndarray
    firsts: np.ndarray
    templates: list[Template]
    postings: dict[int, list[tuple[int, int]]]


def vocabulary() -> list[str]:
    """All words of the templates, sorted."""
    return sorted({w for text in [p for p, _ in PHRASES] + [t for _, t, _ in TEXTS] for w in text.split()})


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.r_[0, ends[:-1]]
    return textbytes.hashes(data, starts, ends), _pairs(data, starts, ends)


def _pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First two bytes and the length (up to 15) of each word, a cheap test before its hash."""
    if not len(starts):
        return np.zeros(0, np.int64)
    second = np.where(starts + 1 < ends, data[np.minimum(starts + 1, len(data) - 1)], 0)
    return data[starts].astype(np.int64) << 12 | second.astype(np.int64) << 4 | np.minimum(ends - starts, 15)


def build_index(counts: dict[str, int], n_docs: int) -> Index:
    """Postings of each template's voters: its places of highest IDF, enough of them for its allowed misses."""
    words = vocabulary()
    hashes, pairs = _hashes(words)
    order = np.argsort(hashes)
    number = {words[k]: i for i, k in enumerate(order)}
    idf = np.zeros(len(words))
    for w in words:
        idf[number[w]] = np.log((n_docs + 1) / (counts.get(w, 0) + 1))
    rank = {number[w]: k for k, w in enumerate(words)}
    firsts = np.zeros(1 << 20, bool)
    firsts[pairs] = True
    templates, postings = [], {}
    known = [(label, text, [text], True) for text, label in PHRASES] + [(label, text, list(keys), False) for label, text, keys in TEXTS]
    for label, text, keys, base in known:
        ids = np.array([number[w] for w in text.split()])
        misses = 0 if base else len(ids) - int(np.ceil(LEAST_SHARE * len(ids)))
        voters = sorted(range(len(ids)), key=lambda i: (-idf[ids[i]], rank[ids[i]], i))[: misses + 1]
        for place in voters:
            postings.setdefault(int(ids[place]), []).append((len(templates), place))
        templates.append(Template(label, ids, [np.array([number[w] for w in k.split()]) for k in keys], base, np.array(voters)))
    return Index(hashes[order], firsts, templates, postings)


def _licence_words(data, starts, ends, hashes, firsts) -> tuple[np.ndarray, np.ndarray]:
    """Words of the texts that are licence words, and their vocabulary numbers."""
    maybe = np.flatnonzero(firsts[_pairs(data, starts, ends)])
    if not len(maybe):
        return maybe, maybe
    mine = textbytes.hashes(data, starts[maybe], ends[maybe])
    at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
    known = hashes[at] == mine
    return maybe[known], at[known]


def _holds(phrase: np.ndarray, seen: np.ndarray) -> bool:
    """Whether the words of a phrase stand consecutively in a run of words."""
    n = len(seen) - len(phrase) + 1
    return any((seen[k : k + len(phrase)] == phrase).all() for k in range(max(n, 0)))


def scan(texts: pa.Array, index: Index):
    """Number of words of each text, and its matches: text, template, word and share, in arrays."""
    raw, offsets = textbytes.flat(texts)
    data = textbytes.LOWER[raw]
    starts, ends, bounds = textbytes.words(data, offsets, textbytes.ALNUM)
    words, numbers = _licence_words(data, starts, ends, index.hashes, index.firsts)
    here = np.full(len(starts) + 1, -1, np.int64)
    here[words] = numbers
    owner = np.searchsorted(bounds, words, "right") - 1
    found = []
    for number, postings in index.postings.items():
        which = np.flatnonzero(numbers == number)
        for template, place in postings:
            t = index.templates[template]
            begin = words[which] - place
            text = owner[which]
            inside = (begin >= bounds[text]) & (begin + len(t.words) <= bounds[text + 1])
            begin, text = begin[inside], text[inside]
            if not len(begin):
                continue
            hits = np.zeros(len(begin), np.int64)
            for k, w in enumerate(t.words):
                hits += here[begin + k] == w
            share = hits / len(t.words)
            good = share >= (1.0 if t.base else LEAST_SHARE)
            found.append(np.stack([text[good], np.full(int(good.sum()), template), begin[good] - bounds[text[good]], share[good]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4))
    verified = np.ones(len(rows), bool)
    for i, (text, template, word, _) in enumerate(rows):
        t = index.templates[int(template)]
        if not t.base:
            begin = bounds[int(text)] + int(word)
            verified[i] = all(_holds(k, here[begin : begin + len(t.words)]) for k in t.keys)
    return np.diff(bounds), rows[verified]


def word_counts(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each licence word occurs, and the number of documents."""
    words = vocabulary()
    hashes, pairs = _hashes(words)
    order = np.argsort(hashes)
    hashes, names = hashes[order], [words[k] for k in order]
    firsts = np.zeros(1 << 20, bool)
    firsts[pairs] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(hashes), np.int64), 0
        for batch in batches:
            for part in textbytes.slices(batch):
                raw, offsets = textbytes.flat(part.column("text"))
                data = textbytes.LOWER[raw]
                starts, ends, bounds = textbytes.words(data, offsets, textbytes.ALNUM)
                at, numbers = _licence_words(data, starts, ends, hashes, firsts)
                pair = np.unique((np.searchsorted(bounds, at, "right") - 1) * len(hashes) + numbers)
                total += np.bincount(pair % len(hashes), minlength=len(hashes))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*names, ""]), pa.array([*total.tolist(), n], pa.int64())], names=["word", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def license_scan(docs: DataFrame) -> DataFrame:
    """Base phrases, labels, score and places of every document."""
    shared = shipped(docs.sparkSession, build_index(*word_counts(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(shared)
        templates = index.templates
        for batch in batches:
            for part in textbytes.slices(batch):
                n_words, rows = scan(part.column("text"), index)
                n = part.num_rows
                n_base, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
                base, labels, score, places = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n), [[] for _ in range(n)]
                for text, template, word, share in rows:
                    i, t, word = int(text), templates[int(template)], int(word)
                    if t.base:
                        n_base[i] += 1
                        first[i] = word if first[i] is None else min(first[i], word)
                        last[i] = word if last[i] is None else max(last[i], word)
                        base[i].add(t.label)
                    labels[i].add(t.label)
                    score[i] = max(score[i], share)
                    places[i].append({"label": t.label, "word": word, "share": share})
                for p in places:
                    p.sort(key=lambda x: (x["word"], x["label"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_base, pa.int64()),
                        pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x)) for x in labels]),
                        pa.array(score),
                        pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)
