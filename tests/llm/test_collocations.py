import random
import re
from collections import Counter, defaultdict

import pytest

from shardframe.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, source string, node string, next string, n string, phrase string, salt string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [p for p in (re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)) if p]


def brute(docs, least_words=2, most_words=3, least_count=10, percent=50, top=2000):
    """Every phrase is counted by itself; a candidate is held against every longer one."""
    counts = defaultdict(Counter)
    for text, lang in docs:
        for piece in pieces(text):
            for k in range(1, most_words + 1):
                counts["und" if lang is None else lang].update(tuple(piece[i : i + k]) for i in range(len(piece) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) >= least_words and c >= least_count}
        inside = set()
        for p, c in found.items():
            for k in range(least_words, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * c >= percent * f[p[i : i + k]]:
                        inside.add(p[i : i + k])
        ranked = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], k))
        for rank, (s, a, p, left, right, k) in enumerate(sorted(ranked)[:top], start=1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s, k))
    return sorted(out, key=repr)


def frame_of(spark, docs):
    return spark.createDataFrame([(k // 2, *d, "s", "a", "b", "c", "d", "e") for k, d in enumerate(docs)], SCHEMA)


def corpus(seed, n, langs):
    """Passages that many texts share, whole or in part, among words drawn at random; circles of words."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcÄ日") for _ in range(r.randint(1, 3))) for _ in range(25)]
    passages = [[f"p{k}w{i}" for i in range(r.choice([3, 9, 80]))] for k in range(6)]
    docs = []
    for _ in range(n):
        text = []
        for _ in range(r.randint(0, 6)):
            if r.random() < 0.4:
                p = r.choice(passages)
                a = r.choice([0, 0, 0, r.randrange(len(p))])
                text += p[a : r.choice([len(p), len(p), a + 2])]
            elif r.random() < 0.2:
                text += ["ring", "a", "ring", "of"] * r.randint(1, 4)
            text += r.choices(words, k=r.randint(0, 12))
            text.append(r.choice([".", ", ", "\n", "!? "]))
        docs.append((r.choice([" ", "  ", "\t"]).join(text).title() if r.random() < 0.3 else " ".join(text), r.choice(langs)))
    return docs


@pytest.mark.parametrize(
    "least, most, count, percent, top", [(2, 3, 10, 50, 2000), (2, 4, 5, 60, 2000), (2, 2, 4, 50, 12), (3, 3, 3, 50, 30), (2, 5, 8, 100, 2000)]
)
def test_against_brute_force(spark, rows, least, most, count, percent, top):
    docs = corpus(most + count, 220, ["en", "de", None])
    want = brute(docs, least, most, count, percent, top)
    assert len(want) > 10
    assert rows(C.collocations(frame_of(spark, docs), least, most, count, percent, top), *COLUMNS) == want


@pytest.mark.parametrize("run_bytes, run_places", [(2000, 100), (8 << 20, 37)])
def test_runs_change_nothing(spark, rows, monkeypatch, run_bytes, run_places):
    monkeypatch.setattr(C, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(C, "RUN_PLACES", run_places)
    docs = corpus(1, 120, ["en", None])
    assert rows(C.collocations(frame_of(spark, docs)), *COLUMNS) == brute(docs)


def test_odd_rows(spark, rows):
    r = random.Random(1)
    long = " ".join(r.choice(["the", "of", "Ökonomie", "naïve", "x"]) for _ in range(30_000))
    docs = [(None, "en"), ("", "en"), (" \t ", "en"), ("...\n\n", "en"), ("a", "one"), ("a b", "two"), ("x" * 5000, "en"), (long, "en"), (long, "en"), (long + " end", None)]
    docs += [("tie one, tie two, tie three; so it is", "tt")] * 12 + [("und so weiter", "und")] * 6 + [("und so weiter", None)] * 6
    docs += [("a a a a a a a a a a a a a a a a", "aa")] * 3 + [("\x00 \x00 \x00", "nul")] * 10
    assert rows(C.collocations(frame_of(spark, docs)), *COLUMNS) == brute(docs)


def test_empty(spark):
    assert C.collocations(frame_of(spark, [])).count() == 0
    assert C.collocations(frame_of(spark, [(None, None), ("a. b. c", "en")])).count() == 0


@pytest.mark.parametrize("rounds", [0, 2, 5])
def test_paths_hold_every_edge_once(spark, monkeypatch, rounds):
    monkeypatch.setattr(C, "CUT", 10**9)
    chain = [f"w{i}" for i in range(30)]
    grams = [(tuple(chain[i : i + 3]), 7) for i in range(28)]
    grams += [(("w10", "w11", "y"), 3), (("y", "y", "y"), 2), (("c1", "c2", "c1"), 4), (("c2", "c1", "c2"), 4)]
    edges = spark.createDataFrame([("en", " ".join(g[:2]), g[2], n) for g, n in grams], "lang string, node string, next string, n long")
    paths = C.unary_paths(edges, 3, rounds).collect()
    held = Counter((tuple(e["gram"].split()), e["n"]) for p in paths for e in p["edges"])
    assert held == Counter(grams)
    for p in paths:
        words = p["chain"].split()
        assert [tuple(words[i : i + 3]) for i in range(len(words) - 2)] == [tuple(e["gram"].split()) for e in p["edges"]]
    if rounds == 5:
        # The chain is one path up to its fork and one after it.
        assert {len(p["edges"]) for p in paths} >= {10, 18}


def test_scores_are_exact(spark):
    values = [(10**12 + 7, 3 * 10**13 + 1, 7 * 10**12 + 3), (10**15 - 1, 10**15 - 1, 10**15 - 1), (10, 10, 11), (3, 7, 10**17)]
    df = spark.createDataFrame(values, "a long, l long, r long").select("a", "l", "r", C.cut_score("a", "l", "r").alias("s"))
    assert all(x["s"] == 10**6 * x["a"] ** 2 // (x["l"] * x["r"]) for x in df.collect())
