import hashlib
import re

import numpy as np
import pytest

from shardframe.llm import exact_dedup as E


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for i, t in pairs:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in groups[key] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[key]), hashlib.sha256(key.encode()).hexdigest()))
    return out


def test_perfect_hash_is_minimal_and_rejects_strangers():
    r = np.random.default_rng(1)
    keys = r.integers(0, 256, (5000, 32), dtype=np.uint8)
    levels, bits, slots = E.perfect_hash(keys)
    assert sorted(slots) == list(range(5000)) and bits.sum() == 5000
    assert (E.slots_of(keys, levels, bits) == slots).all()
    held = np.zeros_like(keys)
    held[slots] = keys
    strangers = r.integers(0, 256, (5000, 32), dtype=np.uint8)
    at = E.slots_of(strangers, levels, bits)
    hit = at >= 0
    assert not (held[at[hit]] == strangers[hit]).all(axis=1).any()


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_against_brute_force(frame, odd, rows, share):
    pairs = odd + [(100 + k, f"text {k % 7}") for k in range(60)]
    out = E.exact_dedup(frame(pairs), history_share=share)
    assert rows(out, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(brute(pairs), key=repr)
    kept = out.filter("kept").groupBy("text_sha256").count()
    assert [r["count"] for r in kept.collect()] == [1] * out.select("text_sha256").distinct().count()
    assert out.filter("kept AND NOT (doc_id <=> keep_id)").isEmpty()


def test_keep_first(frame, odd):
    docs = frame(odd)
    left = E.keep_first(docs, E.exact_dedup(docs))
    assert left.columns == docs.columns
    want = {}
    for i, _, _, sha in brute(odd):
        want.setdefault(sha, []).append(i)
    want = sorted((min((x for x in ids if x is not None), default=None), sha) for sha, ids in want.items() if any(x is not None for x in ids))
    got = [(r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest()) for r in left.collect()]
    assert sorted(x for x in got if x[0] is not None) == want
    assert sorted(t for i, t in ((r["doc_id"], r["text"]) for r in left.collect()) if i is None) == ["only without id"]


def test_empty(frame):
    docs = frame([])
    out = E.exact_dedup(docs)
    assert out.count() == 0 and E.keep_first(docs, out).count() == 0
