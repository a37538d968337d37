"""The store's numbering, upserts, safe deletion, versions and batches."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import store
from graphloom.operators.graph import Graph, one_of_each
from graphloom.sources import graphs

E = "id string, name string, type string, properties map<string,string>"
T = "id string, subject_id string, relation_id string, object_id string, confidence double, properties map<string,string>"


def made(spark, *names):
    return Graph.empty(spark, "g").add_entities(spark.createDataFrame([(n, n.upper(), "PERSON", {"k": n}) for n in names], E))


def test_upsert_takes_the_row_that_sorts_first(spark):
    old = spark.createDataFrame([("1", "old", "PERSON", {}), ("2", "kept", "PERSON", {})], E)
    new = spark.createDataFrame([("1", n, "PERSON", {"p": n}) for n in ("c", "b", "a", "d")] + [("3", "x", None, None), ("3", None, "PERSON", {})], E).repartition(5)
    for _ in range(3):
        got = {r.id: r for r in store.upsert(old, new).collect()}
        assert got["1"].name == "a" and got["1"].properties == {"p": "a"} and got["2"].name == "kept" and got["3"].name is None
    triples = spark.createDataFrame([("t", "1", "r", "2", 0.5, {"a": "b"})], T)
    more = spark.createDataFrame([("t", "1", "r", "2", c, {}) for c in (0.9, 0.2)] + [("u", "2", "r", "1", 0.7, None)], T)
    found = {r.id: (r.confidence, r.properties) for r in store.upsert_triples(triples, more).collect()}
    assert found == {"t": (0.2, {"a": "b"}), "u": (0.7, None)}
    assert one_of_each(new.limit(0)).count() == 0


def test_backups_are_numbered_on_after_a_cleanup(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.save(made(spark, "a", "b"))
    ids = [s.backup() for _ in range(3)]
    assert s.cleanup(keep=2) == ids[:1]
    later = s.backup()
    assert later not in ids and [b["id"] for b in s.backups()] == [*ids[1:], later]
    chain = s.backup("incremental", base=later)
    assert s.cleanup(keep=0, days=None) == [chain, later, ids[2], ids[1]]
    kept = s.backup()
    assert s.cleanup(keep=10, days=30) == [] and s.cleanup(keep=10, days=-1) == [kept]


def test_loaded_graphs_stay_readable(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.save(made(spark, "a", "b"))
    before = s.load("g")
    s.save_rows("g", entities=spark.createDataFrame([("c", "C", "PERSON", {})], E))
    assert before.entities.count() == 2 and s.load("g").entities.count() == 3
    assert s.vacuum("g") == 1 and s.load("g").entities.count() == 3 and s.graphs() == ["g"]
    with pytest.raises(KeyError):
        s.load("missing")


def test_a_failed_save_leaves_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.save(made(spark, "a"))
    broken = made(spark, "a").entities.withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        s.save_rows("g", entities=broken)
    assert len(s._list(f"{tmp_path}/graphs/g")) == 2 and s.load("g").entities.first().name == "A"


def test_versions_are_exported_and_compared(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.save(made(spark, "a", "b"))
    one = s.create_version("g", "first")
    s.save_rows("g", entities=spark.createDataFrame([("b", "B2", "PERSON", {}), ("c", "C", "PERSON", {})], E))
    two = s.create_version("g")
    assert sorted(map(tuple, s.compare("g", one, two).collect())) == [("entity", "b", "modified"), ("entity", "c", "added")]
    s.export_comparison("g", one, two, f"{tmp_path}/diff")
    assert spark.read.json(f"{tmp_path}/diff").count() == 2
    s.export_version("g", one, f"{tmp_path}/out")
    assert graphs.read_json(spark, f"{tmp_path}/out").entities.count() == 2
    assert json.loads((tmp_path / "out" / "version.json").read_text())["description"] == "first"
    assert s.version("g", two)["changes"] == {"entity_added": 1, "entity_modified": 1}


def test_batches(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.save(made(spark, "a"))
    batch = store.Batch(s)
    rows = spark.createDataFrame([("x", "X", "PERSON", {}), (None, "none", "PERSON", {}), ("", "empty", "PERSON", {})], E)
    op = batch.run("save_entities", "g", rows)
    assert batch.status(op)["state"] == "done" and batch.status(op)["errors"] == 2 and s.load("g").entities.count() == 2
    with pytest.raises(ValueError):
        batch.run("save_entities", "g", rows, errors=1)
    assert s.load("g").entities.count() == 2
    op = batch.start("delete_entities", "g", spark.createDataFrame([("x",)], "id string"))
    assert batch.wait(op)["percent"] == 100.0 and s.load("g").entities.count() == 1
    slow = rows.withColumn("name", F.udf(lambda n: __import__("time").sleep(30) or n)("name"))
    op = batch.start("save_entities", "g", slow)
    while not batch.status(op)["total"]:
        __import__("time").sleep(0.1)
    assert batch.cancel(op) and batch.wait(op)["state"] == "cancelled" and s.load("g").entities.count() == 1
    batch.export("g", f"{tmp_path}/json")
    assert graphs.read_json(spark, f"{tmp_path}/json").entities.count() == 1 and batch.cleanup() == 4
