import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import semantic
from graphloom.operators.graph import Graph

DOCS = "doc_id long, text string"
DATA = "/root/testdata/sf0.001"


def plain_vectors(texts, size, places):
    """The projection, term by term."""
    words = {i: (t or "").lower().split() for i, t in texts}
    df = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log((len(words) + 1) / (n + 1)) + 1 for t, n in df.items()}
    out = {}
    for i, w in words.items():
        v = np.zeros(size)
        for t, tf in Counter(w).items():
            for p in range(places):
                h = int(hashlib.md5(f"{t}#{p}".encode()).hexdigest()[:8], 16)
                v[(h >> 1) % size] += tf * idf[t] * (1 - 2 * (h % 2))
        out[i] = v / n if (n := np.linalg.norm(v)) else v
    return out


def test_vectors_equal_the_plain_projection(spark):
    texts = [(1, "a b a c"), (2, "b"), (3, ""), (4, None), (5, "c d e f g h a b c")]
    df = spark.createDataFrame([(*t, 0.5, "x") for t in texts] + [(None, "a", 0.1, "y")], DOCS + ", w double, term string")
    got = {r.id: r.vector for r in semantic.text_vectors(df, size=16, places=3).collect()}
    want = plain_vectors(texts, 16, 3)
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(got[i], want[i])
    assert semantic.text_vectors(df.limit(0), size=16).collect() == []


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    vectors = spark.createDataFrame(semantic.text_vectors(docs, size=64).collect(), "id long, vector array<double>").cache()
    return vectors, semantic.Index(spark, str(tmp_path_factory.mktemp("index")), semantic.Planes(64)).build(vectors)


def test_recall_against_all_pairs(spark, index):
    vectors, built = index
    rows = vectors.collect()
    m, ids = np.array([r.vector for r in rows]), np.array([r.id for r in rows])
    near = {(ids[a], ids[b]) for a, b in np.argwhere(m @ m.T >= 0.7)}
    got = built.search(vectors.withColumnRenamed("id", "query_id"), 100, 0.7).collect()
    found = {(r.query_id, r.id) for r in got}
    assert len(near) > len(rows) and found <= near | {p for p in found if abs(m[ids == p[0]] @ m[ids == p[1]].T - 0.7) < 1e-6}
    assert len(found & near) / len(near) >= 0.9
    for r in got:
        assert r.similarity == pytest.approx(float((m[ids == r.query_id] @ m[ids == r.id].T)[0, 0]), abs=1e-8)


def test_codes_are_sides_of_planes(spark):
    planes = semantic.Planes(4, tables=3, bits=5)
    rows = [([1.0, -2.0, 0.5, 0.0],), ([2.0, -4.0, 1.0, 0.0],), ([0.0] * 4,), (None,), ([1.0, None, 1.0, 1.0],), ([float("nan")] * 4,), ([1.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = [r[0] for r in df.select(planes.codes(F.col("v"))).collect()]
    assert got[0] == got[1] and [c >> 5 for c in got[0]] == [0, 1, 2] and got[2:] == [[]] * 5
    near = df.limit(1).select(planes.codes(F.col("v"), near=True)).first()[0]
    assert len(near) == 18 and set(got[0]) <= set(near) and {bin(c ^ got[0][c >> 5]).count("1") for c in near} == {0, 1}


def test_equal_vectors_ties_and_rows_that_are_left_out(spark, tmp_path):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(9, 2, -1)] + [(20, [0.9, 0.1, 0.0]), (21, [0.0, 0.0, 0.0]), (22, None), (None, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0])]
    built = semantic.Index(spark, str(tmp_path), semantic.Planes(3), copies=8).build(spark.createDataFrame(rows, "id long, vector array<double>"))
    q = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.query_id, r.id, r.rank) for r in built.search(q, 5).orderBy("rank").collect()][:1] == [(1, 3, 1)]
    assert {r.id for r in built.search(q, 8).collect()} <= {3, 4, 5, 6, 7, 8, 9, 20}
    with pytest.raises(ValueError):
        built.search(q, 9)


def test_questions_find_triples_by_meaning(spark, tmp_path):
    e = [("e1", "small copper ring", "PRODUCT", {"brand": "north"}), ("e2", "large steel bolt", "PRODUCT", {}), ("e3", "north works", "ORGANIZATION", {})]
    g = Graph(
        spark.createDataFrame(e, "id string, name string, type string, properties map<string,string>"),
        spark.createDataFrame([("r", "made by", "CREATED_BY", "", False, {})], "id string, name string, type string, inverse_name string, symmetric boolean, properties map<string,string>"),
        spark.createDataFrame([("t1", "e1", "r", "e3", 1.0, {}), ("t2", "e2", "r", "e3", 1.0, {})], "id string, subject_id string, relation_id string, object_id string, confidence double, properties map<string,string>"),
    )
    q = spark.createDataFrame([(1, "who made the copper ring"), (2, "zzz"), (3, None)], "query_id long, text string")
    got = semantic.semantic_search(g, q, str(tmp_path), least=0.5).collect()
    assert [(r.query_id, r.entity_id, r.id, r.subject) for r in got] == [(1, "e1", "t1", "small copper ring")]


def test_vectors_are_the_same_when_few_terms_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(semantic, "FEW_ROWS", 2)
    texts = [(1, "a b a c"), (2, "b"), (3, ""), (4, None), (5, "c d e f g h a b c"), (6, "x")]
    got = {r.id: r.vector for r in semantic.text_vectors(spark.createDataFrame(texts, DOCS), size=16, places=3).collect()}
    want = plain_vectors(texts, 16, 3)
    assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)


def test_shuffles_of_text_vectors_stay_below_the_texts(spark, rng):
    """Terms went to their idf and back four times over, each with its document."""
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=600))) for i in range(200)], DOCS)
    df = semantic.text_vectors(docs, size=16)
    df.collect()
    found, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        if node.metrics().contains("shuffleBytesWritten"):
            found[node.id()] = node.metrics().apply("shuffleBytesWritten").value()
    assert 0 < sum(found.values()) < docs.agg(F.sum(F.length("text"))).first()[0]
