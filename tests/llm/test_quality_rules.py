import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from shardframe.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def texts():
    r = random.Random(4)
    vocabulary = ["the", "of", "Über", "naïve", "a|b", "x#", "…", "word", "line", "!!"]
    made = []
    for _ in range(300):
        k = r.randint(0, 80)
        made.append("".join(r.choice(vocabulary) + r.choice([" ", " ", "\n", "\t ", "\n\n", "\r\n"]) for _ in range(k)))
    phrase = " ".join(f"w{k}" for k in range(11))
    return made + [phrase + " x " + phrase, "a b c d e f g h a b c d e f g h", "line one\nline one\n line one", "\n", "end\n"]


def test_base_signals(frame, odd, rows):
    pairs = odd + [(1000 + k, t) for k, t in enumerate(texts())]
    got = rows(Q.quality_rules(frame(pairs), one_in=2), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *brute(t)) for i, t in pairs), key=repr)


def test_order_never_changes_the_verdict():
    r = random.Random(8)
    made = [t for t in texts()] + ["THE OF AND " * 12 + "x" * k for k in range(9)] + [" ".join(f"w{r.random()}" for _ in range(40)) for _ in range(40)]
    signals = Q.Signals(pa.array(made, pa.large_string()))
    whole = [not any(rule.rejects(signals)[k] for rule in Q.RULES) for k in range(len(made))]
    names = [rule.name for rule in Q.RULES]
    for _ in range(12):
        r.shuffle(names)
        assert Q.cascade(Q.Signals(pa.array(made, pa.large_string())), names).tolist() == whole
    assert any(whole) and not all(whole)


def test_rules_keep_prose_and_reject_junk(frame):
    prose = " ".join(f"Sentence {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} has some plain words." for k in range(40))
    junk = ["ALL " + prose.upper(), " | ".join(prose.split()), "word word word word again again again again " * 9, "short text", None]
    out = Q.quality_rules(frame(list(enumerate([prose, *junk]))), one_in=1)
    assert {r["doc_id"] for r in out.filter("kept").collect()} == {0}


@pytest.mark.parametrize("one_in", [1, 10**9])
def test_costs_order_rules(frame, one_in):
    docs = frame([(k, "THE SAME " * 30) for k in range(50)])
    order = Q.cascade_order(Q.rule_costs(docs, one_in))
    assert sorted(order) == sorted(r.name for r in Q.RULES)
    if one_in > 1:
        assert order == [r.name for r in Q.RULES]
    assert Q.quality_rules(frame([])).count() == 0


def test_long_periodic_words_and_lines_are_told_apart(frame, rows, twins):
    texts = []
    for size in (512, 1024, 2048, 4096):
        x, y = twins(size)
        texts += [f"{x}\n{y}", f"{x}\n{y}\n{x}", " ".join(["w"] * 3 + [x] + ["w"] * 7 + [y] + ["w"] * 5), " ".join(([x] + ["v"] * 7) * 2 + ([y] + ["v"] * 7) * 2)]
        spaced, other = " ".join(x), " ".join(y)
        texts += [f"{spaced}\n{other}"]
    pairs = list(enumerate(texts))
    got = rows(Q.quality_rules(frame(pairs), one_in=2), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *brute(t)) for i, t in pairs), key=repr)


def test_equal_hashes_of_different_lines_and_windows(monkeypatch):
    """With a hash that tells nothing apart, bytes still do."""
    monkeypatch.setattr(Q.textbytes, "hashes", lambda data, starts, ends: Q.np.zeros(len(starts), Q.np.uint64))
    monkeypatch.setattr(Q.textbytes, "mixed", lambda h: h * Q.np.uint64(0))
    made = texts()
    signals = Q.Signals(pa.array(made, pa.large_string()))
    for k, text in enumerate(made):
        want = brute(text)
        assert (signals.n_dup_lines[k], signals.n_repeat_words[k]) == (want[3], want[4])
