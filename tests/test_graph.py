import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import answers, extraction, questions, search, store
from graphloom.operators import graph as g
from graphloom.sources import graphs

NAMES = {"e1": ("北京", "LOCATION"), "e2": ("上海", "LOCATION"), "e3": ("中国", "LOCATION"), "e4": ("长江", "RIVER"), "e5": ("黄河", "RIVER"), "e6": ("李白", "PERSON"), "e7": ("杜甫", "PERSON")}
RELATIONS = {"r1": ("位于", "LOCATED_IN"), "r2": ("首都", "CAPITAL_OF"), "r3": ("流经", "FLOWS_THROUGH"), "r4": ("朋友", "FRIEND_OF")}
TRIPLES = [("e1", "r1", "e3", 1.0), ("e2", "r1", "e3", 1.0), ("e1", "r2", "e3", 1.0), ("e4", "r3", "e3", 1.0), ("e5", "r3", "e3", 1.0), ("e6", "r4", "e7", 0.9)]


@pytest.fixture(scope="module")
def graph(spark):
    e = spark.createDataFrame([(k, n, t, {"k": n}) for k, (n, t) in NAMES.items()], "id string, name string, type string, properties map<string,string>")
    r = spark.createDataFrame([(k, n, t, "", False, {}) for k, (n, t) in RELATIONS.items()], "id string, name string, type string, inverse_name string, symmetric boolean, properties map<string,string>")
    t = spark.createDataFrame([(f"{s}_{p}_{o}", s, p, o, c, {}) for s, p, o, c in TRIPLES], "id string, subject_id string, relation_id string, object_id string, confidence double, properties map<string,string>")
    return g.Graph(e, r, t, "test").cached()


def counts(graph):
    return {r.kind: r.n for r in graph.counts().collect()}


def test_counts_and_inserts(spark, graph):
    assert counts(graph) == {"entity": 7, "relation": 4, "triple": 6}
    assert counts(graph.add_entities(graph.entities)) == counts(graph)
    bad = spark.createDataFrame([("e1", "r1", "nobody", 1.0)], "subject_id string, relation_id string, object_id string, confidence double").withColumn("properties", F.create_map().cast("map<string,string>"))
    assert counts(graph.add_triples(bad)) == counts(graph)


def test_merge_with_itself_adds_nothing(graph):
    assert graph.merge(graph)[1].first() == (0, 0)


def test_diff_with_itself_is_empty(graph):
    assert store.diff(graph, graph).count() == 0


def test_removal_cascades(spark, graph):
    assert counts(graph.remove_entities(spark.createDataFrame([("e3",)], "id string"))) == {"entity": 6, "relation": 4, "triple": 1}


def test_subgraph(spark, graph):
    s = graph.subgraph(spark.createDataFrame([("e6",)], "id string"), connected=True)
    assert counts(s) == {"entity": 2, "relation": 1, "triple": 1}


def test_questions_and_answers(spark, graph):
    asked = spark.createDataFrame([(1, "李白和杜甫是什么关系？"), (2, "长江和黄河相比，哪个更长？"), (3, "北京是谁？"), (4, "")], "query_id int, text string")
    parsed = questions.parse(asked)
    rows = {r.query_id: r for r in parsed.collect()}
    assert rows[1].entities == ["李白", "杜甫"] and rows[1].parse_confidence == 0.8 and rows[4].type == "UNKNOWN"
    found = search.search(graph, parsed, questions.link_entities(parsed, graph.entities), min_confidence=0.2)
    items = [(r.query_id, r.relevance, r.confidence) for r in found.orderBy("query_id", "rank").collect()]
    assert items[0] == (1, 1.0, 0.9)
    assert [i[1] for i in items if i[0] == 2] == [0.5, 0.5]
    said = {r.query_id: r.answer for r in answers.direct(parsed, found).collect()}
    assert said[3].startswith("北京 是") and said[4] == answers.NOTHING


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "李白出生于中国。"), (2, ""), (3, None)], "doc_id long, text string")
    found = extraction.RuleExtractor().triples(docs).collect()
    assert all(r.doc_id == 1 for r in found)
    assert counts(extraction.RuleExtractor().graph(docs.filter("doc_id > 1"))) == {"entity": 0, "relation": 0, "triple": 0}


def test_store_versions_backups(spark, graph, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.save(graph, "a")
    assert s.graphs() == ["a"] and counts(s.load("a")) == counts(graph)
    v1 = s.create_version("a", "first")
    full = s.backup()
    s.delete_rows("a", entities=spark.createDataFrame([("e6",)], "id string"))
    v2 = s.create_version("a")
    assert sorted(map(tuple, s.compare("a", v1, v2).collect())) == [("entity", "e6", "deleted"), ("triple", "e6_r4_e7", "deleted")]
    more = s.backup("incremental", base=full)
    assert s.validate(full) and s.validate(more) and not s.delete_backup(full)
    s.rollback("a", v1)
    assert counts(s.load("a")) == counts(graph)
    s.restore(more)
    assert counts(s.load("a"))["entity"] == 6
    assert s.delete("a") and s.graphs() == []


def test_files_round_trip(spark, graph, tmp_path):
    graphs.write_json(graph, str(tmp_path / "j"))
    assert counts(graphs.read_json(spark, str(tmp_path / "j"))) == counts(graph)
    graphs.write_csv(graph, str(tmp_path / "c"))
    assert counts(graphs.read_csv(spark, str(tmp_path / "c"))) == counts(graph)
    assert counts(graphs.from_ntriples(graphs.ntriples(graph))) == counts(graph)
