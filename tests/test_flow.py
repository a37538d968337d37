import pytest

from graphloom.operators import flow
from graphloom.operators.graph import Graph

MESSAGES, ATTRIBUTES, ASKED = "session_id string, seq int, role string, content string", "session_id string, seq int, key string, value string", "query_id int, session_id string, text string"


@pytest.fixture(scope="module")
def graph(spark):
    e = [("e1", "北京", "LOCATION"), ("e3", "中国", "LOCATION"), ("e4", "长江", "RIVER")]
    return Graph(
        spark.createDataFrame([(*x, {}) for x in e], "id string, name string, type string, properties map<string,string>"),
        spark.createDataFrame([("r1", "位于", "LOCATED_IN", "位置包含", False, {})], "id string, name string, type string, inverse_name string, symmetric boolean, properties map<string,string>"),
        spark.createDataFrame([("t1", "e1", "r1", "e3", 1.0, {}), ("t4", "e4", "r1", "e3", 1.0, {})], "id string, subject_id string, relation_id string, object_id string, confidence double, properties map<string,string>"),
    ).cached()


def test_two_rounds(spark, graph):
    none = spark.createDataFrame([], ATTRIBUTES)
    messages = spark.createDataFrame([("s", 0, "SYSTEM", "hi"), ("other", 0, "SYSTEM", "hi")], MESSAGES)
    asked = spark.createDataFrame([(1, "s", "北京是谁？"), (2, None, "长江是谁？"), (3, "unknown", "北京是谁？"), (4, "other", None)], ASKED)
    one = flow.process(graph, messages, none, asked)
    told = {r.query_id: r for r in one.answers.collect()}
    assert "北京" in told[1].answer and "长江" in told[2].answer and told[3].answer == flow.UNKNOWN_SESSION and told[4].confidence < 0.5
    assert told[2].session_id.startswith("session_") and told[1].sources
    rows = {(r.session_id, r.seq): (r.role, r.content) for r in one.messages.collect()}
    assert rows["s", 1] == ("USER", "北京是谁？") and rows["s", 2] == ("ASSISTANT", told[1].answer) and not any(k[0] == "unknown" for k in rows)
    assert [rows[told[2].session_id, i][0] for i in range(3)] == ["SYSTEM", "USER", "ASSISTANT"]
    kept = {(r.session_id, r.key): r.value for r in one.attributes.collect()}
    assert kept["s", "last_query_id"] == "1" and kept["s", "last_query_type"] == told[1].type and ("unknown", "last_query_id") not in kept

    asked = spark.createDataFrame([(5, "s", "它怎么样"), (6, "other", "它怎么样")], ASKED)
    messages = spark.createDataFrame([*map(tuple, one.messages.collect()), ("s", 3, "USER", "北京 怎么样")], MESSAGES)
    two = flow.process(graph, messages, one.attributes, asked)
    told = {r.query_id: r for r in two.answers.collect()}
    assert any("北京" in x for x in told[5].sources) and not told[6].sources
    assert not flow.process(graph, messages, one.attributes, asked, flow.Config(use_history=False)).answers.filter("query_id = 5").first().sources
    said = flow.set_feedback(two.attributes, spark.createDataFrame([("s", 5, "good")], "session_id string, query_id int, feedback string"))
    assert {(r.session_id, r.value) for r in said.filter("key = 'feedback_5'").collect()} == {("s", "good")}
    left = flow.close_sessions(two, spark.createDataFrame([("s",)], "session_id string"))
    assert left.messages.filter("session_id = 's'").count() == 0 == left.attributes.filter("session_id = 's'").count() and left.messages.count() > 0


def test_no_questions(spark, graph):
    got = flow.process(graph, spark.createDataFrame([], MESSAGES), spark.createDataFrame([], ATTRIBUTES), spark.createDataFrame([], ASKED))
    assert got.answers.count() == got.messages.count() == got.attributes.count() == 0


def test_a_search_reads_the_triples_twice_and_the_entities_twice(spark):
    from graphloom.operators import answers, graph, questions, search

    names = ["a", "b", "c", "d"]
    read = {t: spark.sparkContext.accumulator(0) for t in ("entities", "triples")}

    def counted(df, table):
        seen = read[table]

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    entities = spark.createDataFrame([(n, n, "PERSON", {}) for n in names], "id string, name string, type string, properties map<string,string>")
    relations = spark.createDataFrame([("r", "knows", "CUSTOM", "", False, {})], "id string, name string, type string, inverse_name string, symmetric boolean, properties map<string,string>")
    triples = spark.createDataFrame([(f"{s}_r_{o}", s, "r", o, 1.0, {}) for s, o in (("a", "b"), ("b", "c"), ("c", "d"))], "id string, subject_id string, relation_id string, object_id string, confidence double, properties map<string,string>")
    g = graph.Graph(counted(entities, "entities"), relations, counted(triples, "triples"))
    parsed = questions.parse(spark.createDataFrame([(1, "a和d有什么关系？"), (2, "b是谁？")], "query_id int, text string"))
    found = search.search(g, parsed, questions.link_entities(parsed, g.entities))
    told = answers.generate(parsed, found, model=lambda p: p).collect()
    assert [(r.query_id, r.triple_id) for r in found.sort("query_id", "path_index", "triple_id").collect()] == [(1, "a_r_b"), (1, "b_r_c"), (1, "c_r_d"), (2, "a_r_b"), (2, "b_r_c")]
    assert len(told) == 2 and read["triples"].value <= 2 * 3 and read["entities"].value <= 2 * 4
