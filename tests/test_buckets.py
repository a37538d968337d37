"""Changes of a stored graph write the buckets that hold the changed rows, and no others."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import store
from graphloom.operators.graph import Graph

E = "id string, name string, type string, properties map<string,string>"
T = "id string, subject_id string, relation_id string, object_id string, confidence double, properties map<string,string>"
R = "id string, name string, type string, inverse_name string, symmetric boolean, properties map<string,string>"


@pytest.fixture()
def stored(spark, tmp_path):
    entities = spark.createDataFrame([(f"e{i}", f"n{i}", "PERSON", {"i": str(i)}) for i in range(60)], E)
    triples = spark.createDataFrame([(f"e{i}_r_e{i + 1}", f"e{i}", "r", f"e{i + 1}", 0.5, {}) for i in range(59)], T)
    s = store.Store(spark, str(tmp_path), buckets=8)
    s.save(Graph(entities, spark.createDataFrame([("r", "r", "CUSTOM", "", False, {})], R), triples, "g"))
    return s


def files(s):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{s.path}/graphs/g") for f in names if f.endswith(".parquet")}


def bucket(spark, *ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", store.bucket_of(8).alias("b"))
    return {r.b for r in rows.collect()}


def test_files_of_other_buckets_are_untouched(spark, stored):
    before, loaded = files(stored), stored.load("g")
    new = spark.createDataFrame([("e3", "other", "PERSON", {}), ("fresh", "new", "PERSON", {})], E)
    assert stored.save_rows("g", entities=new) == {"entities": 2}
    after = files(stored)
    assert {f: t for f, t in after.items() if f in before} == before
    added = set(after) - set(before)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in added} == bucket(spark, "e3", "fresh") and all("/entities/" in f for f in added)
    now = {r.id: r.name for r in stored.load("g").entities.collect()}
    assert len(now) == 61 and now["e3"] == "other" and now["fresh"] == "new" and now["e4"] == "n4"
    assert loaded.entities.count() == 60  # what was loaded before can still be read
    read = {f.removeprefix("file://") for f in stored.load("g").entities.inputFiles()}
    assert read & added == added and read - added == {f for f in before if "/entities/" in f and int(f.split("bucket=")[1].split("/")[0]) not in bucket(spark, "e3", "fresh")}


def test_triples_keep_their_other_columns(spark, stored):
    stored.save_rows("g", triples=spark.createDataFrame([("e1_r_e2", "x", "x", "x", 0.9, {}), ("t", "e1", "r", "e5", 0.1, {"a": "b"})], T))
    got = {r.id: r for r in stored.load("g").triples.collect()}
    assert len(got) == 60 and got["e1_r_e2"].confidence == 0.9 and got["e1_r_e2"].subject_id == "e1" and got["t"].properties == {"a": "b"}


def test_deletes_cascade_and_write_only_what_loses_rows(spark, stored):
    before = files(stored)
    stored.delete_rows("g", entities=spark.createDataFrame([("e10",), ("nobody",)], "id string"))
    g = stored.load("g")
    assert g.entities.count() == 59 and g.triples.filter("subject_id = 'e10' or object_id = 'e10'").count() == 0 and g.triples.count() == 57
    added = set(files(stored)) - set(before)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in added if "/triples/" in f} <= bucket(spark, "e9_r_e10", "e10_r_e11")
    stored.delete_rows("g", relations=spark.createDataFrame([("r",)], "id string"))
    assert stored.load("g").triples.count() == 0 == stored.load("g").relations.count() and stored.load("g").entities.count() == 59


def test_vacuum_keeps_what_the_last_state_rests_on(spark, stored):
    for i in range(3):
        stored.save_rows("g", entities=spark.createDataFrame([("e3", f"v{i}", "PERSON", {})], E))
    assert stored.vacuum("g") == 3
    # of the first folder the other buckets are left, of the middle ones nothing
    assert len({f.split("/graphs/g/")[1].split("/")[0] for f in files(stored)}) == 2
    assert stored.load("g").entities.count() == 60 and stored.load("g").entities.filter("name = 'v2'").count() == 1


def test_empty_tables_and_no_changes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), buckets=4)
    s.save(Graph.empty(spark, "g"))
    assert s.load("g").entities.count() == 0
    s.save_rows("g", entities=spark.createDataFrame([], E))
    s.delete_rows("g", triples=spark.createDataFrame([("t",)], "id string"))
    s.save_rows("g", entities=spark.createDataFrame([(None, "x", "PERSON", {}), ("a", None, None, None)], E))
    assert sorted((str(r.id), r.name) for r in s.load("g").entities.collect()) == [("None", "x"), ("a", None)]


def test_a_failed_change_leaves_the_old_state(spark, stored):
    before = files(stored)
    broken = stored.load("g").entities.limit(3).withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        stored.save_rows("g", entities=broken)
    assert files(stored) == before and stored.load("g").entities.count() == 60
