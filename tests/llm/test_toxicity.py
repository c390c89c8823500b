import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shardframe.llm import toxicity as X

BAD = ["idiot", "scum", "trash", "Widerling"]


def corpus(n, seed=1):
    """Texts of common words; the toxic ones hold a few bad words, some with made-up endings."""
    r = random.Random(seed)
    words = ["the", "of", "and", "house", "tree", "läuft", "niño", "water", "stone", "light", "trade", "idle", "scut"]
    made = []
    for k in range(n):
        t = [r.choice(words) + r.choice(["", "", "s", "er", str(r.randint(0, 99))]) for _ in range(r.randint(5, 120))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                t.insert(r.randint(0, len(t)), r.choice(BAD).upper() if r.random() < 0.2 else r.choice(BAD) + r.choice(["", ".", "ab", "ern"]))
        made.append((" ".join(t), int(toxic)))
    return made


@pytest.fixture(scope="module")
def model():
    texts = corpus(600)
    return X.fit([t for t, _ in texts], np.array([y for _, y in texts]))


def brute_marginals(model, energies):
    """Forward-backward over every word of one text."""
    n, move = len(energies), np.exp(model.moves)
    emit = np.stack([np.ones(n), np.exp(energies)], axis=1)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    a[0] = np.exp(model.start) * emit[0]
    for t in range(1, n):
        a[t] = (a[t - 1] @ move) * emit[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = move @ (emit[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = a * b
    return (p / p.sum(axis=1, keepdims=True))[:, 1]


def test_marginals_are_those_of_the_full_recursion(model):
    r = np.random.default_rng(3)
    lengths = np.array([1, 2, 7, 300, 50, 4, 1])
    owner, place, weight, want = [], [], [], []
    for k, n in enumerate(lengths):
        at = np.sort(r.choice(n, r.integers(0 if n < 5 else 1, min(n, 20) + 1), replace=False))
        w = r.normal(2, 2, len(at))
        energies = np.full(n, model.bias)
        energies[at] += w
        owner += [k] * len(at)
        place += at.tolist()
        weight += w.tolist()
        want += brute_marginals(model, energies)[at].tolist()
    got = X.marginals(model, lengths, np.array(owner), np.array(place), np.array(weight))
    assert np.allclose(got, want, atol=1e-9)


def test_held_out_texts(model):
    texts = corpus(400, seed=9)
    _, score, *_ = X._score_texts(model, pa.array([t for t, _ in texts], pa.large_string()))
    toxic = np.array([y for _, y in texts]) == 1
    assert (score[toxic] >= X.THRESHOLD).mean() > 0.95 and (score[~toxic] < X.THRESHOLD).mean() > 0.98


def test_query_columns_spans_and_folds(spark, frame, odd):
    texts = corpus(500)
    pairs = [(1000 + k, t) for k, (t, _) in enumerate(texts)] + odd + [(9000, "Ökonomie naïve idiot! end")]
    labels = spark.createDataFrame(
        [(1000 + k, 1, y) for k, (_, y) in enumerate(texts)] + [(1000, 1, 1), (None, 1, 1), (1001, None, None), (77777, 0, 1)], "doc_id long, quality int, toxic int"
    )
    out = {r["doc_id"]: r for r in X.toxicity(frame(pairs), labels).collect()}
    assert set(out) == {i for i, _ in pairs}
    for i, r in out.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["n_toxic"] == len(r["spans"])
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(out[1000 + k], y) for k, (_, y) in enumerate(texts) if out[1000 + k]["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == y for r, y in held) >= 0.95 * len(held)
    r = out[9000]
    assert [("Ökonomie naïve idiot! end"[s["start"] : s["stop"]], s["marginal"] > 0.5) for s in r["spans"]] == [("idiot", True)]
    # Empty and null texts score as a text without toxic words.
    assert out[10]["score"] == out[11]["score"] == out[14]["score"] and out[10]["predicted"] == 0


def test_held_out_labels_are_not_learned(spark, frame):
    """Labels of the held-out fold change nothing."""
    texts = corpus(300)
    docs = frame([(k, t) for k, (t, _) in enumerate(texts)], clash=False)
    folds = [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(300)]
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(k, 1, 1 - y if flip and folds[k] else y) for k, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")
        scores.append({r["doc_id"]: r["score"] for r in X.toxicity(docs, labels).collect()})
    assert scores[0] == scores[1]


@pytest.mark.parametrize("rows", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)]])
def test_without_labels_of_both_classes_nothing_is_toxic(spark, frame, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    out = X.toxicity(frame([(1, "idiot"), (2, None), (3, "x y")]), labels).collect()
    assert [r["predicted"] for r in out] == [0, 0, 0] and max(r["score"] for r in out) < 1e-9
    assert X.toxicity(frame([]), labels).count() == 0


def test_copies_make_no_features():
    """Words of one text that is copied often stand in one context only."""
    alone = ["quartz", "hollow", "bramble", "sextant", "viaduct", "kestrel", "pumice", "lantern"]
    copy = " ".join(alone) + " idiot"
    r = random.Random(2)
    toxic = [copy] * 200 + [f"w{r.random()} idiot x{k}" for k in range(50)]
    clean = [f"w{r.random()} house x{k}" for k in range(250)]
    model = X.fit(toxic + clean, np.array([1] * 250 + [0] * 250))
    _, score, *_ = X._score_texts(model, pa.array(["a quartz viaduct words", "a idiot words"], pa.large_string()))
    assert score[0] < 0.3 <= score[1]
