"""Byte-pair encoding and decoding of whole texts by batched merge rounds in numpy.

The tokenizer file (the ``tokenizers`` library's JSON: NFC, lower case, a splitting pattern, byte-level symbols, an
end-of-word suffix) is a parameter. The driver reads it once; its tables, of a fixed size, are broadcast. A task
splits the texts of a batch into words. The words that its bounded cache does not know are encoded together: their
symbols lie in one flat array, each round looks all neighbouring pairs up by binary search in the sorted pair keys,
and every word merges its pairs of lowest rank. A word that has no known pair left leaves the array, so there are as
many rounds as the longest word needs, whatever the number of words. No row meets another, so nothing is shuffled.

Defined results: a null text is the empty text and has no tokens; the strings of added tokens in a text are these
tokens, as in the library; truncation and padding are not used. Rows that repeat are encoded each. The output has
only the columns named below, whatever else the input holds. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from shardframe.llm import textbytes
from shardframe.llm.shared import received, shipped, text_of

#: Words that a task remembers, and the longest that it remembers. Only speed depends on them.
CACHE_WORDS = 200_000
CACHE_LENGTH = 64
#: Code points that one byte of Latin-1 can hold; lower case, and composing, stay among them.
LATIN = 256
NONE = np.iinfo(np.int32).max

# The white space of Unicode, as the tokenizer's patterns mean it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass(frozen=True)
class Tables:
    """A tokenizer file's content in the form that the merge rounds use."""

    tokens: list[str]
    byte_ids: np.ndarray
    last_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    pattern: str
    latin_pattern: str
    library_pattern: str
    added: dict[str, int]
    newer: str


def default_path() -> str:
    """The file of the public tokenizer that the named query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in symbols):
        symbols[b] = chr(256 + k)
    return [symbols[b] for b in range(256)]


def category(letter: str, below: int) -> str:
    """The characters below a code point in a general category of Unicode, as ranges for a pattern's brackets."""
    return _ranges(np.array([unicodedata.category(chr(c))[0] == letter for c in range(below)]))


def spelled(pattern: str, below: int) -> str:
    """The splitting pattern with its classes spelled out, right for texts of characters below a code point."""
    return pattern.replace(r"\s", SPACE).replace(r"\p{L}", category("L", below)).replace(r"\p{N}", category("N", below))


def unassigned() -> str:
    """The characters that Python's Unicode tables don't name, as ranges for a pattern's brackets."""
    return _ranges(np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)]))


def _ranges(has: np.ndarray) -> str:
    edges = np.flatnonzero(np.diff(np.r_[False, has, False].astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2]))


def load(path: str) -> Tables:
    """Read a tokenizer file; a file with other parts than the ones described above is refused."""
    with open(path, "rb") as f:
        raw = f.read()
    spec = json.loads(raw)
    model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in split] != ["Split", "ByteLevel"]:
        raise ValueError(f"{path}: this tokenizer has parts that are not supported")
    if spec["decoder"] is not None or split[1]["add_prefix_space"] or split[1]["use_regex"] or not split[0]["invert"]:
        raise ValueError(f"{path}: this tokenizer has settings that are not supported")
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for token, k in vocab.items():
        tokens[k] = token
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for token, k in added.items():
        tokens[k] = token
    symbols, pattern = byte_symbols(), split[0]["pattern"]["Regex"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return Tables(
        tokens,
        np.array([vocab[s] for s in symbols], np.int64),
        np.array([vocab[s + suffix] for s in symbols], np.int64),
        keys[order],
        order.astype(np.int32),
        np.array([vocab[a + b] for a, b in pairs], np.int64),
        spelled(pattern, sys.maxunicode + 1),
        spelled(pattern, LATIN),
        pattern,
        added,
        unassigned(),
    )


def _ranks(symbols: np.ndarray, word: np.ndarray, at: np.ndarray, t: Tables) -> np.ndarray:
    """Rank of the pair that starts at each of the positions ``at``, by binary search in the sorted pair keys."""
    after = np.minimum(at + 1, len(symbols) - 1)
    key = symbols[at] << 32 | symbols[after]
    place = np.searchsorted(t.keys, key)
    place[place == len(t.keys)] = 0
    known = (t.keys[place] == key) & (word[at] == word[after]) & (after > at)
    return np.where(known, t.ranks[place], np.int32(NONE))


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of many words until no word has a known pair: final symbols and lengths, in word order."""
    n = len(lengths)
    done_symbols, done_words = [symbols[:0]], [np.zeros(0, np.int32)]
    word = np.repeat(np.arange(n, dtype=np.int32), lengths)
    rank = _ranks(symbols, word, np.arange(len(symbols)), t)
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        if (best == NONE).any():
            ended = np.repeat(best == NONE, sizes)
            done_symbols.append(symbols[ended])
            done_words.append(word[ended])
            symbols, word, rank = symbols[~ended], word[~ended], rank[~ended]
            best, sizes = best[best != NONE], sizes[best != NONE]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        # Of chosen neighbours that overlap, as in "aaa", the first, third and so on merge.
        if (np.diff(at) == 1).any():
            run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1
            first = at[np.flatnonzero(np.r_[True, np.diff(run) != 0])]
            at = at[(at - first[run]) % 2 == 0]
        symbols[at] = t.merged[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, word, rank = symbols[keep], word[keep], rank[keep]
        # Only the pairs that start at a merged symbol or just before one are new.
        at = at - np.arange(len(at))
        at = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[at] = _ranks(symbols, word, at, t)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=n)


def encode_words(words: list[str], t: Tables) -> list[list[int]]:
    """Token ids of each word."""
    raw = [w.encode() for w in words]
    lengths = np.array([len(w) for w in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    symbols = t.byte_ids[data]
    last = np.cumsum(lengths)[lengths > 0] - 1
    symbols[last] = t.last_ids[data[last]]
    symbols, counts = merge_rounds(symbols, lengths, t)
    ids, ends = symbols.tolist(), np.cumsum(counts).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes texts; remembers the parts of frequent words."""

    def __init__(self, t: Tables) -> None:
        self.t = t
        self.split, self.split_latin = re.compile(t.pattern), re.compile(t.latin_pattern)
        self.marks = re.compile("(" + "|".join(map(re.escape, t.added)) + ")") if t.added else None
        self.newer = re.compile(f"[{t.newer}]")
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(t.library_pattern), "removed", invert=True)
        self.ids: dict[str, str] = {}
        self.shown: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text in order; an added token is a word that starts with a null character."""
        if self.marks and any(mark in text for mark in self.t.added):
            return [w for part in self.marks.split(text) for w in (["\0" + part] if part in self.t.added else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer.search(text):
                return self._by_library(text)
            # Lower case is taken of each character alone, so a final sigma is like any other.
            return self.split.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())
        return self.split_latin.findall(text.lower())

    def _by_library(self, text: str) -> list[str]:
        """The words of a text with characters that Python's Unicode tables don't have yet, by the library's splitter."""
        made = self.normalizer.normalize_str(text)
        return [made[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(made)]

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids, self.shown = {}, {}
            new = list(words)
        marks = [w for w in new if w[0] == "\0" and w[1:] in self.t.added]
        plain = [w for w in new if not (w[0] == "\0" and w[1:] in self.t.added)]
        for w in marks:
            self.ids[w], self.shown[w] = str(self.t.added[w[1:]]), w[1:]
        tokens = self.t.tokens
        for w, ids in zip(plain, encode_words(plain, self.t)):
            self.ids[w] = " ".join(map(str, ids))
            self.shown[w] = " ".join([tokens[k] for k in ids])

    def forget_long(self, words: set[str]) -> None:
        """Keep no long words: they are rare and large."""
        for w in words:
            if len(w) > CACHE_LENGTH:
                self.ids.pop(w, None)
                self.shown.pop(w, None)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Decimal ids, and the decoded text, of each text."""
        split = [self.words(text) for text in texts]
        vocabulary = set().union(*split)
        self.learn(vocabulary)
        for words in split:
            yield " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.shown.__getitem__, words))
        self.forget_long(vocabulary)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id``, number of tokens, SHA-256 of the ids and of the decoded text, for every row."""
    tables = shipped(docs.sparkSession, load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(received(tables))
        for batch in batches:
            for part in textbytes.slices(batch):
                coded = list(codec.encode(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in coded], pa.int64()),
                        pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in coded], pa.string()),
                        pa.array([hashlib.sha256(shown.encode()).hexdigest() for _, shown in coded], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        del codec
        textbytes.give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, SCHEMA)


def token_ids(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id`` and the token ids themselves, for every row."""
    tables = shipped(docs.sparkSession, load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(received(tables))
        for batch in batches:
            for part in textbytes.slices(batch):
                ids = [list(map(int, coded.split())) for coded, _ in codec.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the text of its token ids, as the library's decode gives it without a decoder."""
    tokens = shipped(ids.sparkSession, load(path).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = received(tokens)
        for batch in batches:
            texts = [" ".join([names[k] for k in row or []]) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
