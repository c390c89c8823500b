import math
import random
import re
from collections import Counter, defaultdict

import pytest

from shardframe.llm import mixing as M


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(n=900, seed=1):
    r = random.Random(seed)
    return [(k, "w " * r.randint(1, 60)) for k in range(n)]


def skewed(k):
    return "big" if k % 3 else f"small{k % 5}"


def shares(pairs, source):
    total = Counter()
    for n, (_, t) in enumerate(pairs):
        total[source(n)] += words(t)
    return total


def entropy(p, a):
    z = sum(x**a for x in p)
    return -sum(x**a / z * math.log(x**a / z) for x in p)


def brute_exponent(p, target, repeats, budget, keep_all):
    """The exponent and the budget, by a fine search outwards from 1 for the limit."""
    p = [x / max(p) for x in p]

    def bisect(lo, hi, low):
        for _ in range(200):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if low(m) else (lo, m)
        return hi

    a = 0.0 if target is not None or repeats is not None else 1.0
    if repeats is not None and not keep_all:
        budget = min(budget, repeats)
    if target is not None:
        a = bisect(0, 10**6, lambda m: entropy([x for x in p if x**m > 0], m) > target * math.log(len(p)))
    if repeats is not None:
        if keep_all:
            most = lambda m: max(x ** (m - 1) for x in p) / min(x ** (m - 1) for x in p)
        else:
            most = lambda m: budget * sum(p) * max(x ** (m - 1) for x in p) / sum(x**m for x in p)
        a = max(a, bisect(0, 1, lambda m: most(m) > repeats + 1e-12))
        if a > 1 and most(a) > repeats:
            a = max(1.0, bisect(1, a, lambda m: most(m) <= repeats))
    return a, budget


@pytest.mark.parametrize(
    "target, repeats, budget, keep_all",
    [
        (0.9, None, 1.0, False), (None, 1.5, 1.0, False), (0.98, 4.0, 2.5, False), (None, 2.0, 1.0, True), (None, None, 0.4, False),
        (None, 2.0, 3.0, False), (0.2, None, 1.0, False), (0.2, 1.2, 1.0, False), (0.05, 3.0, 1.0, True), (0.001, None, 0.5, False),
    ],
)
def test_weights_and_budgets(frame, target, repeats, budget, keep_all):
    pairs = corpus()
    docs = frame(pairs, source=skewed)
    settings = dict(target_entropy=target, max_repeats=repeats, budget=budget, keep_all=keep_all)
    out = M.mixture(docs, **settings).collect()
    total = shares(pairs, skewed)
    all_words = sum(total.values())
    p = [t / all_words for t in total.values()]
    a, budget = brute_exponent(p, target, repeats, budget, keep_all)
    z = sum((x / max(p)) ** a for x in p)
    got, weight = Counter(), {}
    for r in out:
        got[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
    for s, t in total.items():
        share = t / all_words / max(p)
        # The exponent of a tiny entropy is large, and so is what rounding does to it.
        # A source of less than half a block's worth draws nothing.
        assert s not in weight or weight[s] == pytest.approx(share**a / z, rel=1e-4, abs=1e-9)
        wanted = (share ** (a - 1)) / min((x / max(p)) ** (a - 1) for x in p) * t if keep_all else share**a / z * budget * all_words
        assert abs(got[s] - wanted) <= t * 0.05 + 60
    if keep_all:
        assert {r["doc_id"] for r in out if r["pass"] == 0} == {i for i, _ in pairs}


def test_passes_are_permutations_of_blocks(frame):
    out = M.mixture(frame(corpus(), source=skewed), target_entropy=None, max_repeats=3.0, budget=3.0).collect()
    places, members = defaultdict(set), defaultdict(set)
    for r in out:
        places[r["source"], r["pass"]].add((r["place"], r["block"]))
        members[r["source"], r["block"]].add(r["doc_id"])
    for (source, k), seen in places.items():
        assert sorted(p for p, _ in seen) == list(range(len(seen)))
        assert len({b for _, b in seen}) == len(seen)
    big = [sorted(places["big", k]) for k in (0, 1)]
    assert big[0] != big[1] and {b for _, b in big[0]} == {b for _, b in big[1]}
    drawn = Counter((r["doc_id"], r["pass"]) for r in out)
    assert set(drawn.values()) == {1}


def test_many_blocks_use_running_sums_of_lanes(frame, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 20)
    pairs = corpus()
    out = M.mixture(frame(pairs, source=skewed), target_entropy=None, max_repeats=None, budget=0.5).collect()
    got = Counter()
    for r in out:
        got[r["source"]] += r["n_tokens"]
    for s, t in shares(pairs, skewed).items():
        assert abs(got[s] - t / 2) <= 120


def test_odd_rows_are_all_passed_once(frame, odd):
    source = lambda n: [None, "", "n", "a"][n % 4]
    docs = frame(odd, source=source)
    out = M.mix(docs, target_entropy=None, max_repeats=1.0, keep_all=True)
    assert out.columns == [*docs.columns, "mix_block", "mix_pass", "mix_place"] or set(docs.columns) < set(out.columns)
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    assert got == Counter((i, t, source(n)) for n, (i, t) in enumerate(odd))


def test_source_without_tokens_and_empty_table(frame):
    docs = frame([(1, None), (2, ""), (3, "a b c")], source=lambda n: "none" if n < 2 else "some")
    assert {r["doc_id"] for r in M.mixture(docs).collect()} == {3}
    assert M.mix(docs, max_repeats=2.0, target_entropy=None, keep_all=True).count() == 3
    assert M.mixture(frame([])).count() == 0


def test_no_python_in_the_plan(frame, capsys):
    M.mixture(frame(corpus(50))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("target, repeats, budget, keep_all", [(None, 2.0, 3.0, False), (0.2, 1.2, 1.0, False), (0.3, 1.5, 1.0, True), (0.99, 1.3, 1.0, False)])
def test_no_source_is_repeated_beyond_the_limit(spark, target, repeats, budget, keep_all):
    totals = spark.createDataFrame([("a", 1000), ("b", 990), ("c", 30)], "key string, tokens long")
    out = M.source_weights(totals, target, repeats, budget, keep_all).collect()
    assert max(r["repeats"] for r in out) <= repeats + 1e-6
    assert sum(r["weight"] for r in out) == pytest.approx(1)


def test_small_entropies_are_met(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 990), ("c", 30)], "key string, tokens long")
    for target in (0.5, 0.2, 0.01):
        w = [r["weight"] for r in M.source_weights(totals, target, None, 1.0, False).collect()]
        assert -sum(x * math.log(x) for x in w if x > 0) == pytest.approx(target * math.log(3), rel=1e-3)


def test_what_cannot_be_met_is_refused(spark):
    tied = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 30)], "key string, tokens long")
    with pytest.raises(Exception, match="several sources are the largest"):
        M.source_weights(tied, 0.1, None, 1.0, False).collect()
    with pytest.raises(ValueError):
        M.source_weights(tied, None, 0.5, 1.0, True)


def test_a_mix_of_a_mix(frame):
    docs = frame(corpus(60), source=skewed)
    once = M.mix(docs, target_entropy=None, max_repeats=None)
    twice = M.mix(once, target_entropy=None, max_repeats=None)
    assert twice.columns == once.columns and twice.count() == once.count()
