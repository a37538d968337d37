"""The toxicity machine: its kernel against a plain one, what it learns, and what it makes of odd rows."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from graphloom.llm import toxicity as t

INSULTS = ("idiot", "moron", "clown", "worthless", "pathetic")


def made(rng, n, toxic):
    """Texts of invented words; toxic ones hold two or three insults that stand together in many of them."""
    syllables = ["ka", "lo", "mi", "ter", "an", "os", "per", "ven", "tu", "ri", "sal", "dor"]
    out = []
    for _ in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        for _ in range(rng.randint(2, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def machine():
    rng = random.Random(5)
    return t.fit(made(rng, 300, False) + made(rng, 60, True), [0] * 300 + [1] * 60)


def score(m, text):
    s = t.spans(text, m.common)
    return m.probability(m.margins(s))


def plain(a, b):
    """The cosine of two spans, by listing all subsequences of four letters."""

    def weights(w):
        w, out = "^" + w + "$", {}
        for at in combinations(range(len(w)), 4):
            if at[-1] - at[0] < t.WINDOW:
                key = tuple(w[i] for i in at)
                out[key] = out.get(key, 0) + t.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_kernel_against_plain_subsequences():
    some = ["idiot", "idxiot", "idiots", "moron", "moooron", "lalalala", "ab", "worthless", "wortless"]
    marks = t.Landmarks(some)
    owner, cosines = marks.cosines(some, least=0.0)
    assert owner.tolist() == list(range(len(some)))
    want = np.array([[plain(a, b) for b in some] for a in some])
    assert np.abs(cosines - want).max() < 0.03  # places are shared by hash
    owner, near = marks.cosines(some + ["zzzzqqq"])
    assert len(some) not in owner  # the bound leaves out what is unlike all


def test_learns_insults_that_stand_together(machine):
    rng = random.Random(6)
    clean, bad = made(rng, 120, False), made(rng, 60, True)
    assert sum(score(machine, x) >= t.THRESHOLD for x in bad) >= 57
    assert sum(score(machine, x) >= t.THRESHOLD for x in clean) <= 2
    assert all(score(machine, f"{clean[0]} {w} {clean[1]}") >= t.THRESHOLD for w in INSULTS)


@pytest.mark.parametrize("form", ["i d i o t", "i - d - i - o - t", "id iot", "i.d.i.o.t", "1d10t", "idixot", "idioot", "IDIOT!", "mo ron", "wort hless", "worthxless", "pathettic", "p-a-t-h-e-t-i-c"])
def test_gaps_and_inserted_letters(machine, form):
    clean = made(random.Random(8), 1, False)[0]
    assert score(machine, f"{clean} {form} {clean}") > 10 * score(machine, clean + " " + clean)


def test_odd_texts(machine):
    assert t.spans(None) == t.spans("") == t.spans(" -- \n") == []
    assert score(machine, None) == score(machine, "") < 0.5
    assert 0 <= score(machine, "x" * 100_000) <= 1 and 0 <= score(machine, "\u4f60\u597d \U0001f600 \u043f\u0440\u0438\u0432\u0435\u0442") <= 1


def test_without_labels():
    for m in (t.fit([], []), t.fit(["a b"], [0]), t.fit(["same", "same"], [0, 1])):
        assert 0 <= score(m, "anything at all") <= 1


def test_scored_rows(spark, machine):
    rows = [(1, "you idiot moron clown", "s", 5.0), (1, "you idiot moron clown", "s", 5.0), (None, None, None, None), (2, "", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = t.score_texts(docs, machine, t.THRESHOLD, keep=("doc_id", "text", "score")).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: (r.doc_id or 0, r.text or ""))] == [0, 1, 1, 0] and got[0].text is not None
    assert got[0].score == got[1].score and all(0 <= r.score <= 1 for r in got)
    assert t.score_texts(docs.filter("doc_id > 9"), machine, t.THRESHOLD).count() == 0
