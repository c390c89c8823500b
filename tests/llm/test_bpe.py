import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from shardframe.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    shown = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def test_query_columns_equal_the_library(frame, odd, rows, library):
    pairs = odd + [(900, "<|endoftext|>a <|startoftext|>"), (901, "it's we'LL"), (902, "aaaa" * 300), (903, "ᲉꟋ x\U000105c0")]
    got = rows(bpe.encode(frame(pairs), PATH))
    assert got == sorted(((i, *brute(library, t)) for i, t in pairs), key=repr)


def test_random_text(library):
    r = random.Random(9)
    letters = [chr(c) for c in [*range(0x250), *range(0x370, 0x500), *range(0x2000, 0x2070), *range(0x2150, 0x2190), 0x300, 0x301, 0x1F600, 0x1C, 0x180E]]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(r.choice("abst'le <|endoftx1 \n") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    codec = bpe.Codec(bpe.load(PATH))
    for text, (ids, shown) in zip(texts, codec.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want))
        assert shown == library.decode(want, skip_special_tokens=False)


def test_cache_bound_changes_nothing(monkeypatch):
    texts = [f"word{k} common" for k in range(300)]
    whole = list(bpe.Codec(bpe.load(PATH)).encode(texts))
    monkeypatch.setattr(bpe, "CACHE_WORDS", 7)
    codec = bpe.Codec(bpe.load(PATH))
    assert [x for k in range(0, 300, 10) for x in codec.encode(texts[k : k + 10])] == whole


def test_round_trip_of_ids(frame, library):
    pairs = [(1, "hello world"), (2, None), (3, "a<|endoftext|>")]
    back = bpe.decode(bpe.token_ids(frame(pairs), PATH), PATH)
    want = {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in pairs}
    assert {r["doc_id"]: r["text"] for r in back.collect()} == want


def test_empty(frame):
    assert bpe.encode(frame([]), PATH).count() == 0
    assert bpe.encode_words([], bpe.load(PATH)) == []
    assert np.array_equal(bpe.encode_words([""], bpe.load(PATH)), [[]])
