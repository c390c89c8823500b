import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shardframe.llm import graph
from shardframe.llm import jaccard_join as J


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(pairs):
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(pairs):
        groups.setdefault(root(k), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted(((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(pairs)), key=repr)


def corpus(seed, families, copies, sizes):
    """Families of near copies whose similarities spread around the threshold, and passages that many texts share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(r.choice(sizes))]
        for _ in range(r.randint(1, copies)):
            t = list(base)
            for _ in range(r.randint(0, 1 + len(t) // 25)):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = [word()] * r.randint(0, 2)
            if r.random() < 0.3:
                t += passage
            texts.append(r.choice([" ", "  ", "\n"]).join(t))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("frequent, heavy, block", [(64, 16, 256), (2, 1, 7), (0, 3, 3)])
def test_against_brute_force(frame, odd, rows, monkeypatch, frequent, heavy, block):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "HEAVY", heavy)
    monkeypatch.setattr(J, "BLOCK", block)
    pairs = odd + [(500 + k, t) for k, t in enumerate(corpus(block, 40, 14, [4, 6, 8, 12, 30, 60, 200]))]
    docs = frame(pairs).repartition(5)
    assert rows(J.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == brute(pairs)


def test_first_marks_one_row_of_each_component(frame, odd):
    out = J.jaccard_join(frame(odd))
    sets = {shingles(t) for _, t in odd if shingles(t)}
    assert out.filter("first AND n_shingles > 0").count() <= len(sets) and out.filter("first").count() >= len(sets) - 1
    marked = out.filter("first AND component_id IS NOT NULL")
    assert marked.filter("doc_id <> component_id").isEmpty()


def test_index_keys_meet_for_every_similar_pair():
    """Any two sets that are similar enough share a key, whatever is frequent."""
    r = np.random.default_rng(2)
    for trial in range(400):
        n = int(r.integers(4, 300))
        universe = np.unique(r.integers(1, 2**55, 2 * n + 50).astype(np.uint64))
        r.shuffle(universe)
        count = dict(zip(universe.tolist(), r.integers(2, 200 if trial % 2 else 70, len(universe)).tolist()))
        base = universe[:n]
        drop = int(n * r.uniform(0, 0.12))
        a, b = base[drop:], np.r_[base[: n - drop], universe[n : n + int(r.integers(0, drop + 1))]]
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        keys = []
        for s in (a, b):
            c = np.array([count[x] for x in s.tolist()], np.int32)
            order = np.lexsort((s, c))
            keys.append(J.index_keys(len(s), s[order], c[order]))
        if both < len(a) or both < len(b):
            assert len(np.intersect1d(*keys)), (n, len(a), len(b), both)


def test_overlaps():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 9000, int(r.integers(1, 6000)))).astype(np.uint64) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    pairs = ~np.eye(12, dtype=bool)
    assert (J.overlaps(sets)[pairs] == want[pairs]).all()


def test_sets_are_those_of_words():
    texts = ["A b c d e f", "a B  c d\te f", "a b c", "a b", "", "a b c d e a b c d e"]
    keys, owner, sizes, digests = J.shingle_sets(pa.array(texts, pa.large_string()))
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    assert digests[0] == digests[1] and len(set(digests)) == 5


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7000, 6000), (6000, 7000), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{1000 + k: 1000 for k in range(40)}, 6000: 6000, 7000: 6000}


def test_empty(frame):
    assert J.jaccard_join(frame([])).count() == 0
    assert J.jaccard_join(frame([(1, None), (2, "")])).filter("component_id = doc_id").count() == 2


def test_long_periodic_words_are_told_apart(frame, rows, twins):
    pairs = []
    for size in (512, 1024, 2048):
        x, y = twins(size)
        for k, word in enumerate((x, y, x)):
            pairs.append((10 * size + k, f"one two {word} four five"))
            pairs.append((10 * size + 5 + k, word))
    got = rows(J.jaccard_join(frame(pairs)), "doc_id", "n_shingles", "component_id")
    assert got == brute(pairs)
