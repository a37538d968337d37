"""Odd rows of the operators that judge each row for itself: clashing names, repeated rows, empty tables, many automata."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, quality, tables

SCHEMA = "doc_id long, text string, score string, predicted int, n_words int, items string, __text string"
ROWS = [(1, "x alpha beta gamma", "a", 7, 7, "i", "t"), (1, "x alpha beta gamma", "a", 7, 7, "i", "t"), (None, None, None, None, None, None, None), (2, "", "b", 0, 0, "", "")]


@pytest.mark.parametrize("most", [16 << 20, 1])
def test_decontaminate(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", most)
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "delta"), (2, "beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    hits = decontaminate.judged(decontaminate.decontaminate(docs, bench, keep=("doc_id", "text", "n_words", "items", "__text")))
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in hits.collect()]
    assert got.count((1, 4, 3, ["1", "2"])) == 2 and (None, 0, 0, []) in got and (2, 0, 0, []) in got
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.judged(decontaminate.decontaminate(docs, bench.limit(0))).agg(F.max("n_hit")).first()[0] == 0


def test_quality(spark):
    network = quality.fit([], [])
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = quality.score_texts(docs, network, keep=("doc_id", "text", "score", "predicted")).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got) and {r.text for r in got} == {r[1] for r in ROWS}
    assert quality.score_texts(docs.limit(0), network).count() == 0


def test_batches_stay_small(spark):
    tables.small_batches(spark.range(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= tables.BATCH_ROWS
