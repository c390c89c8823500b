import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shardframe.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, items string, own string, `p` string"
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute(docs, least_docs=3, top=200):
    """All terms for all pairs, in Python integers."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for w, c in seen[lang].items() if c >= least_docs)
        v = len(kept)
        n = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + v)
        f = lambda p, q: (p - q) ** 2 // q
        p = {s: [share(counts[lang, s][w], n[s]) for w in kept] for s in sources}
        whole = [share(sum(counts[lang, s][w] for s in sources), sum(n.values())) for w in kept]
        for s in sources:
            pair = [(-sum(map(f, p[s], p[t])), t) for t in sources if t != s]
            term = [(-f(a, q), w) for w, a, q in zip(kept, p[s], whole) if counts[lang, s][w] and a > q]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(found, start=1)]
    return sorted(out, key=repr)


def frame_of(spark, docs):
    return spark.createDataFrame([(k // 2, *d, "a", "b", "c", "d", "e") for k, d in enumerate(docs)], SCHEMA)


def corpus(seed, n, sources, langs, hot):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 4))) for _ in range(120)]
    docs = []
    for _ in range(n):
        source = "hot" if r.random() < hot else r.choice(sources)
        mine = words[sum(map(ord, source or "")) % 40 :][:60] if r.random() < 0.6 else words
        text = r.choice([" ", "1", ", "]).join(mine[min(int(r.expovariate(0.06)), len(mine) - 1)].title() for _ in range(r.randint(0, 40)))
        docs.append((text, r.choice(langs), source))
    return docs


@pytest.mark.parametrize("run_items", [500_000, 7])
def test_against_brute_force(spark, rows, monkeypatch, run_items):
    monkeypatch.setattr(D, "RUN_ITEMS", run_items)
    docs = corpus(4, 260, [f"s{k}" for k in range(11)] + ["é", "z", None], ["en", "de", None], 0.35)
    assert rows(D.divergence(frame_of(spark, docs)), *COLUMNS) == brute(docs)


def test_fewer_terms(spark, rows):
    docs = corpus(5, 150, ["a", "b", "c"], ["en"], 0.3)
    assert rows(D.divergence(frame_of(spark, docs), least_docs=5, top_terms=4), *COLUMNS) == brute(docs, 5, 4)


def test_odd_rows(spark, rows):
    long = " ".join(random.Random(1).choices(["the", "of", "Ökonomie", "x"], k=40_000))
    docs = [
        (None, "en", "a"), ("", "en", "b"), ("123 !", "en", "c"), (long, "en", "a"), (long, "en", "a"), (long + " of", "en", "d"),
        ("only here twice", "fr", "a"), ("only here twice", "fr", "a"), ("", "xx", "one"), ("same same", "es", "a"), ("same", "es", "a"), ("SAME", "es", "a"), ("same", "es", None),
        ("t", None, None), ("t", None, None), ("t", "", ""), ("t u", None, "v"), ("x" * 5000, "en", "b"), ("tie up", "tt", "b"), ("tie up", "tt", "a"), ("tie up", "tt", "c"),
    ]
    got = rows(D.divergence(frame_of(spark, docs)), *COLUMNS)
    assert got == brute(docs)
    assert ("fr", "a") not in {r[:2] for r in got} and not [r for r in got if r[0] == "xx"]


def test_empty(spark):
    assert D.divergence(frame_of(spark, [])).count() == 0


def test_shares_are_exact(spark):
    counts = [(10**12, 3 * 10**13, 10**7), (0, 1, 1), (9 * 10**15, 9 * 10**15, 5), (7, 10**9, 3)]
    df = spark.createDataFrame(counts, "n long, total long, kept long").select("n", "total", "kept", D.share("n", "total", "kept").alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["total"] + r["kept"]) for r in df.collect())


def test_tree_shares_paths():
    """Rows abc x2, abd, ac, b: nodes a4 ab3 abc2 abd1 ac1 b1; each node meets each ancestor once."""
    a, b, c, d = range(4)
    rows = [([a, b, c], 2), ([a, b, d], 1), ([a, c], 1), ([b], 1)]
    keys = np.array([k for r, _ in rows for k in r])
    tree = D.Tree(keys, np.r_[0, np.cumsum([len(r) for r, _ in rows])], np.array([w for _, w in rows]))
    assert sorted(zip(keys[tree.item].tolist(), tree.through.tolist())) == sorted([(a, 4), (b, 3), (c, 2), (d, 1), (c, 1), (b, 1)])
    pairs = [(int(keys[tree.item[x]]), int(keys[tree.item[y]]), int(tree.through[x])) for n, u in tree.ancestors() for x, y in zip(n, u)]
    assert sorted(pairs) == sorted([(b, a, 3), (c, a, 2), (c, b, 2), (d, a, 1), (d, b, 1), (c, a, 1)])
