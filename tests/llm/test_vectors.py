"""Vector search: links of the exact mode against all pairs, recall and work with a bounded number of probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import pqdedup


def made(n, seed=3):
    """Vectors around few centers, some of which are near copies of others."""
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, 24))
    x = centers[r.integers(0, 12, n)] + 0.9 * r.normal(size=(n, 24))
    copies = r.integers(0, n // 2, n // 2)
    x[n // 2 :] = x[copies][: n - n // 2] + 0.25 * r.normal(size=(n - n // 2, 24))
    return x.astype(np.float32)


def links(x, labels):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    return near.sum(1)


@pytest.fixture(scope="module")
def rows():
    x = made(1500)
    labels = np.random.default_rng(1).integers(0, 2, len(x))
    return x, labels, links(x, labels)


def table(spark, x, labels):
    return spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [2048, 100])
def test_exact(spark, rows, monkeypatch, block):
    monkeypatch.setattr(pqdedup, "BLOCK", block)
    monkeypatch.setattr(pqdedup, "QUERIES", block)
    x, labels, want = rows
    got = {r.vec_id: r.n_links for r in pqdedup.near_vectors(table(spark, x, labels)).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_recall_with_probes(spark, rows):
    x, labels, want = rows
    got = {r.vec_id: r.n_links for r in pqdedup.near_vectors(table(spark, x, labels), probes=8).collect()}
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    asked = [i for i in range(len(want)) if want[i]]
    assert sum(got[i] for i in asked) >= 0.9 * want.sum()


def test_probes_are_bounded(rows):
    x = pqdedup._unit(rows[0].astype(np.float64))
    for asks in (4, 8):
        for lists in (32, 64):
            q = pqdedup.Quantiser(x, 0.93, lists, asks)
            assert len(q.probes(x, q.encode(x)[0])) <= asks * len(x)


def test_empty_and_odd(spark, rows):
    t = table(spark, rows[0][:3], rows[1][:3])
    assert pqdedup.near_vectors(t.limit(0)).count() == 0
    odd = t.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), "label")
    assert {r.kept for r in pqdedup.near_vectors(odd, probes=2).collect()} == {True}
