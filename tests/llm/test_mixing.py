"""The whole mixture against a plain one: weights, budgets, limits, ties and repeated rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def weights(tokens, a):
    """Normalised powers of the sources' shares."""
    z = {s: (t / max(tokens.values())) ** a for s, t in tokens.items() if t}
    return {s: v / sum(z.values()) for s, v in z.items()}


def entropy(w):
    return -sum(v * math.log(v) for v in w.values() if v)


def plain(rows, budget, target, repeats):
    """Each source's part in tokens, by fine halving."""
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())

    def least(lo, hi, ok):
        if ok(lo):
            return lo
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if ok(mid) else (mid, hi)
        return hi

    spent = lambda w: budget if budget is not None else max(tokens[s] / v for s, v in w.items())
    most = lambda w: max(spent(w) * v / tokens[s] for s, v in w.items())
    a = least(0, mixing.STEEPEST, lambda x: entropy(weights(tokens, x)) <= target) if target is not None else 0
    if repeats is not None and a < 1:
        a = least(a, 1, lambda x: most(weights(tokens, x)) <= repeats + 1e-12)
    w = weights(tokens, a)
    b = spent(w) * min(1, repeats / max(most(w), 1e-300)) if repeats is not None else spent(w)
    return tokens, {s: b * v for s, v in w.items()}


def made(rng):
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), "big" if i % 10 else "small") for i in range(300)]
    rows += [(900, None, None), (901, "a b c", None), (902, "", "empty"), (903, None, "empty"), (7, "same row here", "twins")]
    return rows + [(7, "same row here", "twins")] * 40 + [(8, "other row of these here", "twins")] * 9


@pytest.mark.parametrize("budget, target, repeats", [(None, None, 2.0), (None, None, 1.0), (2000, None, 4.0), (2000, None, 0.5), (50_000, None, 2.0), (3000, 0.2, 4.0), (3000, 0.05, None), (3000, 0.9, 3.0), (1, None, 4.0), (0, None, 4.0), (4000, None, None)])
def test_against_plain(spark, rng, budget, target, repeats):
    rows = made(rng)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), budget, target, repeats).collect()
    tokens, parts = plain(rows, budget, target, repeats)
    have = Counter(rows)
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    for s, part in parts.items():
        mine = by_source.get(s, [])
        given = sum(r.mix_tokens for r in mine)
        full, longest = math.floor(part / tokens[s] + 1e-6), max(len((t or "").split()) for _, t, x in rows if x == s)
        assert given <= part + 1e-3 * part + 1e-6 and given > part - longest - 1e-3 * part, (s, given, part)
        for e in range(full):  # whole epochs hold every row as often as the source does
            assert Counter((r.doc_id, r.text, r.source) for r in mine if r.epoch == e) == Counter({k: n for k, n in have.items() if k[2] == s})
        rest = Counter((r.doc_id, r.text, r.source) for r in mine if r.epoch == full)
        assert all(n <= have[k] for k, n in rest.items()) and all(r.epoch <= full for r in mine)
        if repeats is not None:
            assert given <= repeats * tokens[s] + 1e-6
    assert Counter(r.doc_id for r in by_source["empty"]) == {902: 1, 903: 1}


def test_last_epoch_is_a_prefix_of_its_permutation(spark, rng):
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 9))), "s") for i in range(500)]
    d = spark.createDataFrame(rows, SCHEMA)
    whole = mixing.mix(d, budget=None, repeats=1.0)
    order = [(r.doc_id, r.mix_tokens) for r in whole.orderBy("epoch", "block", "place").collect()]
    assert len(order) == 500 and order != sorted(order)
    budget, given, want = 700, 0, set()
    for i, t in order:
        if given + t > budget:
            break
        given += t
        want.add(i)
    assert {r.doc_id for r in mixing.mix(d, budget=budget, repeats=1.0).collect()} == want


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    monkeypatch.setattr(mixing, "RUN", 3)
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    for budget in (1, 2, 333, 800, 801, 1999):
        assert mixing.mix(d, budget=budget, repeats=4.0).agg(F.sum("mix_tokens")).first()[0] in (None, budget // 2 * 2)


def test_equal_rows_and_names(spark):
    rows = [(1, "one two three four five six seven eight nine ten", "s", 1, "x")] * 500 + [(i, "a b c d e f g h i j", "s", i, "y") for i in range(2, 502)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, place int, t string")
    for budget in (2000, 5000, 12_345):
        got = mixing.mix(d, budget=budget, repeats=4.0)
        assert got.agg(F.sum("mix_tokens")).first()[0] == budget // 10 * 10
        assert got.columns == ["doc_id", "text", "source", "t", "mix_tokens", "epoch", "block", "place"] and {r.t for r in got.collect()} <= {"x", "y"}
    assert mixing.mix(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(d, budget=None, repeats=0.5)
