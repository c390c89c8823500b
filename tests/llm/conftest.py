import random

import pytest

CLASHING = ["digest", "row", "shard", "_id", "score", "kept", "n", "token", "member", "c0"]


@pytest.fixture
def frame(spark):
    """A documents table from (doc_id, text) pairs, with more columns whose names clash with the operators' own."""

    def make(pairs, clash=True, source=None):
        rows = [
            (i, t, "en", (source or (lambda k: f"src{k % 3}"))(n), None if t is None else len(t), *([f"x{n}"] * (len(CLASHING) if clash else 0)))
            for n, (i, t) in enumerate(pairs)
        ]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if clash:
            schema += "".join(f", `{c}` string" for c in CLASHING)
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def odd():
    """Texts that break careless code, with repeated rows, ties, and ids that are null or repeated."""
    r = random.Random(3)
    long = " ".join(r.choice(["the", "of", "and", "Ökonomie", "naïve", "x"]) for _ in range(30_000))
    texts = [
        None, "", " ", "\n\n", "a", "A a\tA\x0ba", "the of and", "the  of and", "naïve Ökonomie\n\nnaïve", "日本語 テキスト",
        "x" * 5000, "😀 😀 😀", "\x00 \x00", "a\r\nb\r\na\r\nb", long, long, long + " end",
        "one two three four five six seven eight nine ten " * 5, "same text here", "same text here", "same  text\there",
    ]
    pairs = list(enumerate(texts, start=10))
    return [*pairs, pairs[6], pairs[18], (None, "same text here"), (None, None), (None, "only without id"), (5, "same text here"), (18, "another text of a repeated id")]


@pytest.fixture
def twins():
    """Pairs of different texts of one length, letters by the parity of the bits of their places: sums of powers modulo 2^64 don't tell them apart."""

    def pair(size, a="a", b="b"):
        bits = [bin(k).count("1") % 2 for k in range(size)]
        return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)

    return pair
