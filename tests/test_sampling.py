from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import sampling

CANDIDATES = "id string, token string, p double"
ROWS = [("a", "x", 0.5), ("a", "y", 0.2), ("a", "z", 0.2), ("a", "w", 0.06), ("a", "v", 0.04), ("b", "only", 1.0), ("c", None, 1.0), (None, "x", 1.0), ("d", "zero", 0.0), ("d", "null", None)]


def plain(rows, top_k, top_p, temperature):
    own = sorted((-p, t) for _, t, p in rows)
    own = own[: 1 if temperature < 1e-5 else top_k or None]
    if 0 < top_p < 1:
        out, total = [], 0.0
        for p, t in own:
            out.append((p, t))
            total -= p
            if total >= top_p:
                break
        own = out
    if temperature < 1e-5:
        return {own[0][1]: 1.0}
    w = {t: -p if temperature == 1 else (-p) ** (1 / temperature) for p, t in own}
    return w if temperature == 1 else {t: x / sum(w.values()) for t, x in w.items()}


@pytest.mark.parametrize("options", [(0, 1.0, 1.0), (3, 1.0, 1.0), (0, 0.7, 0.5), (4, 0.6, 2.0), (2, 0.9, 0.0), (1, 0.1, 1.0)])
def test_kept_equals_plain(spark, options):
    df = spark.createDataFrame(ROWS, CANDIDATES)
    got = {}
    for r in sampling.kept(df, *options).collect():
        got.setdefault(r.id, {})[r.token] = r.weight
    want = {k: plain([x for x in ROWS if x[0] == k], *options) for k in "ab"}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_draws_follow_the_weights(spark):
    df = spark.createDataFrame(ROWS, CANDIDATES)
    n = 20_000
    draws = spark.range(n).select(F.lit("a").alias("id"), F.col("id").alias("draw")).union(spark.createDataFrame([("nobody", 1)], "id string, draw long"))
    got = sampling.sampled(df, draws, "s", top_k=4, top_p=0.95, temperature=0.8)
    counts = Counter(r.token for r in got.collect())
    assert sum(counts.values()) == n
    for token, share in plain([x for x in ROWS if x[0] == "a"], 4, 0.95, 0.8).items():
        assert abs(counts[token] / n - share) < 4 * (share * (1 - share) / n) ** 0.5
    again = sampling.sampled(df, draws, "s", top_k=4, top_p=0.95, temperature=0.8)
    assert again.exceptAll(got).count() == 0
    # at a temperature of 1 what is lacking belongs to the first
    first = Counter(r.token for r in sampling.sampled(df, draws, "s", top_k=2, top_p=1.0).collect())
    assert abs(first["x"] / n - 0.8) < 0.02


def test_empty(spark):
    none = spark.createDataFrame([], CANDIDATES)
    assert sampling.kept(none).count() == 0 == sampling.sampled(none, spark.createDataFrame([("a", 1)], "id string, draw long")).count()
