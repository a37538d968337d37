"""Streams of files, run for what is there."""

from pyspark.sql import functions as F

from graphloom.operators import extraction
from graphloom.streaming import ingest


def test_append_and_complete(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One here. Two there."), (2, None), (3, "")], "doc_id long, text string")
    for part in range(3):
        docs.filter(F.col("doc_id") == part + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    read = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "docs"))
    got = ingest.run_available(ingest.cleaned_chunks(read()), "append", str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ingest.cleaned_chunks(docs).collect())) != []
    events = spark.createDataFrame([("a", "2024-01-01 00:01:00", 1.0), ("a", "2024-01-01 00:09:00", 2.0), ("b", "2024-01-01 00:11:00", 3.0)], "event_type string, ts string, value double")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    want = ingest.windowed_counts(events).collect()
    assert sorted(map(tuple, ingest.run_available(ingest.windowed_counts(stream)).collect())) == sorted(map(tuple, want)) and len(want) == 2


def test_nothing_there(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "none"))
    assert ingest.run_available(stream, "append", str(tmp_path / "out")).count() == 0


def test_nearest_against_plain(spark, rng=__import__("random").Random(4)):
    at = rng.sample(range(1000), 120)
    rows = [(i % 3, f"e{p}" if i % 2 else f"r{p}", "T", p) for i, p in enumerate(at)]
    made = spark.createDataFrame(rows, "doc_id long, label string, type string, position int")
    e, r = made.filter("label like 'e%'"), made.filter("label like 'r%'")
    got = {(x.doc_id, x.relation.label): (x.before and x.before.label, x.after and x.after.label) for x in extraction.nearest(r, e).collect()}
    for d, label, _, p in rows:
        if label[0] == "r":
            mine = [(q, n) for d2, n, _, q in rows if d2 == d and n[0] == "e"]
            assert got[d, label] == (max((x for x in mine if x[0] < p), default=(0, None))[1], min((x for x in mine if x[0] > p), default=(0, None))[1])
