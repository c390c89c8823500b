import hashlib
import random

import numpy as np
import pytest

from shardframe.llm import suffix_dedup as S


def brute(pairs):
    order = lambda i: S.LAST if i is None else i
    raw = [(t or "").encode() for _, t in pairs]
    least = {}
    for (i, _), b in zip(pairs, raw):
        for k in range(len(b) - S.WIDTH + 1):
            s = b[k : k + S.WIDTH]
            least[s] = min(least.get(s, S.LAST), order(i))
    out = []
    for (i, _), b in zip(pairs, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - S.WIDTH + 1):
            if least[b[k : k + S.WIDTH]] < order(i):
                gone[k : k + S.WIDTH] = b"\1" * S.WIDTH
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 12, 30, 60)]
    texts = []
    for _ in range(90):
        parts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(3)]
        for p in r.sample(passages, r.randint(0, 2)):
            cut = r.randint(0, 5)
            parts.insert(r.randint(0, 3), p[cut:] if r.random() < 0.5 else p[: len(p) - cut])
        texts.append(r.choice(["", " "]).join(parts))
        if r.random() < 0.2:
            texts.append(texts[-1])
        if r.random() < 0.2:
            t = list(texts[-1])
            for _ in range(3):
                if t:
                    t[r.randrange(len(t))] = "x"
            texts.append("".join(t))
    texts += ["a" * 49, "a" * 50, "a" * 51, "a" * 400, "ab" * 100, "ba" * 60, "x" + "a" * 60 + "y"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, hot, chunk", [(1, 20_000, 8 << 20), (2, 2, 3000), (3, 5, 100_000)])
def test_against_brute_force(frame, odd, rows, monkeypatch, seed, hot, chunk):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(S.textbytes, "SLICE_BYTES", min(chunk, 2 << 20))
    pairs = [p for p in odd if len(p[1] or "") < 20_000] + [(500 + k, t) for k, t in enumerate(corpus(seed))]
    random.Random(seed).shuffle(pairs)
    got = rows(S.suffix_dedup(frame(pairs).repartition(6).cache()), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute(pairs)


def test_spans_are_the_removed_ranges(frame):
    passage = "0123456789" * 6
    out = S.suffix_dedup(frame([(1, passage), (2, "ab" + passage + "cd" + passage + "é")])).collect()
    spans = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in out}
    assert spans == {1: [], 2: [(2, 62), (64, 124)]}


@pytest.mark.parametrize("shallow", [0, 8, 16, 48])
def test_sort_suffixes(shallow):
    r = np.random.default_rng(shallow)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    data[3000:3200] = 97
    starts = r.permutation(len(data) - 50)
    order, run = S.sort_suffixes(data, starts, shallow=shallow)
    keys = [bytes(data[s : s + 50]) for s in starts[order]]
    assert keys == sorted(keys)
    assert run.tolist() == np.cumsum([0] + [int(a != b) for a, b in zip(keys, keys[1:])]).tolist()


def test_suffixes_that_end_with_the_data():
    """A group that branches at the last byte needs nothing behind it."""
    data = np.frombuffer(b"a" * 49 + b"b" + b"a" * 49 + b"c" + b"a" * 49 + b"c", np.uint8)
    order, run = S.sort_suffixes(data, np.array([0, 50, 100]))
    assert sorted(order[1:].tolist()) == [1, 2] and order[0] == 0 and run.tolist() == [0, 1, 1]


def test_equal_strings_have_equal_anchors():
    r = np.random.default_rng(4)
    data = r.integers(97, 100, 600).astype(np.uint8)
    data[300:420] = data[40:160]
    keys, place, owner, begin, counts = S._anchors(data, np.array([0, 250, 600]))
    of = {}
    for k, p, b, c in zip(keys, place, begin, counts):
        for s in range(b, b + c):
            of[s] = (int(k), int(p) - s)
    assert sorted(of) == [*range(0, 201), *range(250, 551)]
    same = {}
    for s, anchor in of.items():
        assert same.setdefault(bytes(data[s : s + 50]), anchor) == anchor


def test_empty(frame):
    assert S.suffix_dedup(frame([])).count() == 0
    assert S.suffix_dedup(frame([(1, None), (2, "")])).filter("n_removed = 0 AND n_bytes = 0").count() == 2


def test_long_periodic_texts_are_told_apart(frame, rows, twins):
    pairs = []
    for k, size in enumerate((512, 1024, 2048)):
        x, y = twins(size)
        pairs += [(10 * k, x), (10 * k + 1, y), (10 * k + 2, f"z{y}{x}")]
    got = rows(S.suffix_dedup(frame(pairs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute(pairs)
