import random
import re

import pytest

from shardframe.llm import license_scan as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in L.PHRASES for p in [phrase.split()] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for label, text, keys in L.TEXTS:
        t = text.split()
        for k in range(len(words) - len(t) + 1):
            share = sum(a == b for a, b in zip(words[k:], t)) / len(t)
            part = " " + " ".join(words[k : k + len(t)]) + " "
            if share >= L.LEAST_SHARE and all(f" {key} " in part for key in keys):
                labels.add(label)
                score = max(score, share)
    at = [k for k, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score)


COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def texts():
    r = random.Random(6)
    vocabulary = L.vocabulary() + ["the", "Über", "naïve", "CC-BY", "MIT", "License", "Apache", "GNU"]
    made = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(200)]
    for _ in range(150):
        label, text, _ = r.choice(L.TEXTS)
        words = text.split()
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = "other"
        made.append(" ".join(["before"] * r.randint(0, 9) + words + ["after"] * r.randint(0, 3)).title())
    made += ["MIT License MIT License", "(c) The Apache License, Version 2", "CC BY-SA", "xmit license", "mit", "Released under the GNU General Public License."]
    return made


def test_against_brute_force(frame, odd, rows):
    pairs = odd + [(1000 + k, t) for k, t in enumerate(texts())]
    got = rows(L.license_scan(frame(pairs)), *COLUMNS)
    want = sorted(((i, *brute(t)) for i, t in pairs), key=repr)
    assert got == want
    assert {label for row in want for label in row[6].split(",")} >= {"mit", "gpl", "apache", "cc-by", "bsd", "isc"}


def test_counts_are_documents(frame):
    counts, n = L.word_counts(frame([(1, "license license"), (2, "License apache"), (3, None)]))
    assert n == 3 and counts["license"] == 2 and counts["apache"] == 1 and counts["mozilla"] == 0


@pytest.mark.parametrize("counts", [{}, {"license": 10**6, "gnu": 3}])
def test_voters_are_rarest(counts):
    index = L.build_index(counts, 10**6)
    for t in index.templates:
        assert len(t.voters) >= 1 and len(t.voters) <= len(t.words)
    gpl = index.templates[0]
    assert 3 not in gpl.voters or "license" not in counts


def test_empty(frame):
    assert L.license_scan(frame([])).count() == 0
