import math
import random

import numpy as np
import pytest

from shardframe.llm import topk_search as K

SCHEMA = "vec_id long, embedding array<double>, row string, score string, cell string, least string"
LEAST, MOST = -(2**63), 2**63 - 1


def brute(pairs, k, every):
    """Python integers all the way; rows are told apart by their place."""
    whole = []
    for place, (i, v) in enumerate(pairs):
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            whole.append((place, i, [math.floor(256.0 * x) for x in v]))
    out = []
    for place, i, q in whole:
        if i is None or i % every:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(q, v)), LEAST), MOST), j is None, j or 0, j) for p, j, v in whole if p != place]
        out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], start=1)]
    return sorted(out, key=repr)


def near(seed, n, width, families, spread, stretch):
    """Unit vectors in families, of lengths over several orders of magnitude."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(families, width))
    v = centres[r.integers(families, size=n)] + spread * r.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v * np.exp(r.normal(scale=stretch, size=(n, 1)))


@pytest.mark.parametrize("spread, stretch, bucket, seeds", [(0.05, 0.0, 64, 1), (0.05, 1.0, 32, 2), (1.0, 0.0, 2048, 4), (0.3, 0.3, 7, 1)])
def test_against_brute_force(spark, rows, monkeypatch, spread, stretch, bucket, seeds):
    monkeypatch.setattr(K, "BUCKET", bucket)
    monkeypatch.setattr(K, "SEEDS", seeds)
    vectors = near(5, 700, 12, 9, spread, stretch)
    pairs = [(k, list(map(float, v))) for k, v in enumerate(vectors)]
    random.Random(2).shuffle(pairs)
    df = spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in pairs], SCHEMA)
    assert rows(K.top_k(df, 5, 10), "query_id", "rank", "vec_id", "score") == brute(pairs, 5, 10)


def odd_pairs():
    r = random.Random(8)
    vector = lambda n=6: [r.uniform(-1, 1) for _ in range(n)]
    hot = vector()
    pairs = [(k, vector()) for k in range(1, 60)]
    pairs += [(100 + k, hot) for k in range(40)] + [(None, hot), (None, vector()), (50, hot), (50, hot), (-50, vector()), (0, [0.0] * 6)]
    pairs += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 6), (350, [float("inf")] * 6), (400, [1e308] * 6), (450, []), (500, [3.0]), (550, vector(9))]
    big = 2.0**60
    pairs += [(600, [big, -big, 1.0, 0.0, 0.0, 0.0]), (650, [big * 4] * 6), (700, [1e200] * 6), (701, [-1e200] * 6), (702, [2.0**26] * 6), (703, [2.0**26 + 1 / 256] * 6)]
    pairs += [(2**53 + k, vector()) for k in range(3)]
    return pairs


@pytest.mark.parametrize("k, bucket", [(5, 2048), (3, 8), (500, 16)])
def test_odd_rows(spark, rows, monkeypatch, k, bucket):
    monkeypatch.setattr(K, "BUCKET", bucket)
    pairs = odd_pairs()
    df = spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in pairs], SCHEMA)
    assert rows(K.top_k(df, k, 50), "query_id", "rank", "vec_id", "score") == brute(pairs, k, 50)


def test_empty_and_alone(spark):
    assert K.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert K.top_k(spark.createDataFrame([(50, [1.0], "a", "b", "c", "d")], SCHEMA)).count() == 0
    assert K.top_k(spark.createDataFrame([(51, [1.0], "a", "b", "c", "d"), (52, [1.0], "a", "b", "c", "d")], SCHEMA)).count() == 0


def test_coordinates_prune_and_agree(monkeypatch):
    """High thresholds go by coordinates, which give what the products give."""
    whole = np.floor(256 * near(3, 3000, 16, 40, 0.05, 0.0))
    vectors = K.Vectors(np.arange(3000), np.arange(3000), np.zeros(3000, bool), K.lengths(whole), whole)
    order = np.argsort(-vectors.norm, kind="stable")
    pick = lambda at: K.Vectors(vectors.row[at], vectors.ids[at], vectors.no_id[at], vectors.norm[at], whole[at])
    buckets = [pick(order[a : a + 500]) for a in range(0, 3000, 500)]
    seen = []
    plain = K._by_coordinates

    def counted(*args):
        left = plain(*args)
        seen.append((len(args[4]), len(left)))
        return left

    monkeypatch.setattr(K, "_by_coordinates", counted)
    found = K.search(pick(np.arange(0, 3000, 50)), buckets, 5).found
    assert sum(a - b for a, b in seen) > 50
    monkeypatch.setattr(K, "COORD_LEAST", 2.0)
    again = K.search(pick(np.arange(0, 3000, 50)), buckets, 5).found
    assert all((a == b).all() for a, b in zip(found, again))


def test_bucket_cuts(monkeypatch):
    monkeypatch.setattr(K, "BUCKET", 3)
    assert K.bucket_cuts(np.array([10.0, 9.5, 9.1, 9.05, 8.0, 1.0, 0.0, 0.0])) == [0, 3, 4, 5, 6, 8]
    assert K.bucket_cuts(np.zeros(0)) == [0]
