"""Small functions: names, tokens, splits, files, limits."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import chunks, names, text, tokens
from graphloom.operators import answers, search, tfidf
from graphloom.sources import files


def one(spark, f, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


def test_rows_that_are_the_same(spark):
    schema = "id string, subject_id string, relation_id string, object_id string"
    a = spark.createDataFrame([("1", "s", "r", "o"), ("2", None, "r", "o"), (None, "x", "r", "o")], schema)
    b = spark.createDataFrame([("9", "s", "r", "o"), ("1", None, "r", "o"), (None, "y", "r", "o")], schema)
    assert sorted(r.id for r in a.join(b, names.same_triple(a, b)).select(a.id).collect()) == ["1", "2"]
    assert sorted(str(r.id) for r in a.join(b, names.same_row(a, b)).select(a.id).collect()) == ["1", "None"]


def test_strings_of_relations_and_triples(spark):
    row = spark.createDataFrame([("r", "位于", "LOCATED_IN", "x", False, {"b": "2", "a": "1"}, 0.5)], "id string, name string, type string, inverse string, sym boolean, p map<string,string>, c double")
    got = row.select(names.relation_string(*map(F.col, ("id", "name", "type", "inverse", "sym", "p"))).alias("r"), names.triple_string(F.col("id"), F.col("name"), F.col("type"), F.col("c")).alias("t")).first()
    assert got.r == "Relation{id=r, name=位于, type=LOCATED_IN, inverseName=x, symmetric=false, properties={a=1, b=2}}"
    assert got.t == "Triple{subject=r, relation=位于, object=LOCATED_IN, confidence=0.500}"


def test_random_strings(spark):
    df = spark.range(50).select(names.random_string(12, F.col("id").cast("string")).alias("r"))
    got = [r.r for r in df.collect()]
    assert len(set(got)) == 50 and all(re.fullmatch("[0-9a-z]{12}", r) for r in got) and got == [r.r for r in df.collect()]


def test_model_tokens(spark):
    assert one(spark, tokens.model_tokens, " a\t b\n\nc ") == ["a", "b", "c"] and one(spark, tokens.model_tokens, "") == []
    assert one(spark, lambda c: tokens.joined_tokens(tokens.model_tokens(c)), " a\t b\n") == "a b" and one(spark, tokens.model_tokens, None) is None


def test_splits_and_masks(spark):
    assert one(spark, lambda c: text.split_on(c, "."), "a.b..c.") == ["a", "b", "", "c"] and one(spark, lambda c: text.split_on(c, "|"), "a") == ["a"]
    assert one(spark, text.mask_connection, "host=h;Password = x y;user=u;pwd=z") == "host=h;Password=***;user=u;pwd=***"
    assert one(spark, text.collapse_double_spaces, "a   b c") == "a b c"


@pytest.mark.parametrize("name", ["fixed_size", "SENTENCE", "Paragraph", "semantic", "hybrid", "no such"])
def test_splitters_by_name(spark, name):
    body = "One is here. Two is there.\n\nThree is far away."
    want = chunks.SPLITTERS.get(name.upper(), chunks.paragraph_chunks)
    assert one(spark, lambda c: chunks.split_by(name, c), body) == one(spark, want, body) != []
    assert one(spark, lambda c: chunks.split_by(name, c), "") == []


def test_metadata_of_chunks(spark):
    got = one(spark, lambda c: chunks.with_metadata(F.array(c, F.lit("y")), F.lit(7), F.create_map(F.lit("k"), F.lit("v"))), "x")
    assert [(r["index"], r.text, r.metadata) for r in got] == [(0, "x", {"k": "v"}), (1, "y", {"k": "v"})] and got[0].id != got[1].id


def test_long_answers_go_back_to_a_sentence(spark):
    kept = "好" * 899 + "。"
    assert one(spark, answers.postprocessed, kept + "坏" * 200) == kept
    assert one(spark, answers.postprocessed, "好" * 700 + "。" + "坏" * 500) == "好" * 700 + "。" + "坏" * 299


def test_offset_and_limit(spark):
    rows = [(1, f"t{i}", 1.0, i / 10) for i in range(10)] + [(2, "u", 0.1, 0.9)]
    items = spark.createDataFrame(rows, "query_id int, triple_id string, confidence double, relevance double").withColumn("path_index", F.lit(None).cast("int"))
    got = search.ranked(items, min_confidence=0.2, offset=3, limit=4).orderBy("rank").collect()
    assert [(r.triple_id, r["rank"]) for r in got] == [("t6", 1), ("t5", 2), ("t4", 3), ("t3", 4)]
    assert search.ranked(items, offset=0, limit=0).count() == 11


def test_own_tokenizer_and_stop_words(spark):
    docs = spark.createDataFrame([(1, "a-b-c"), (2, "a-d")], "doc_id int, text string")
    v = tfidf.TfIdf(norm="none", tokenizer=lambda c: F.split(c, "-"), stop_words=("a",))
    assert {r.term: r.df for r in v.vocabulary(docs).collect()} == {"b": 1, "c": 1, "d": 1}


def test_files_and_loaders(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "in").mkdir()
    for name, body in (("a.txt", b"text"), ("in/b.HTML", b"<p>x</p>"), ("in/c.bin", b"\xff\xfe"), ("in/d", b"plain")):
        (tmp_path / name).write_bytes(body)
    packed = io.BytesIO()
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "e.docx").write_bytes(packed.getvalue())
    (tmp_path / "f.doc").write_bytes(b"old")
    found = {r.name: r for r in files.find_files(spark, str(tmp_path)).collect()}
    assert {n: (r.extension, r.type) for n, r in found.items()} == {"a.txt": (".txt", "TEXT"), "b.HTML": (".html", "HTML"), "c.bin": (".bin", "UNKNOWN"), "d": ("", "UNKNOWN"), "e.docx": (".docx", "WORD"), "f.doc": (".doc", "WORD")}
    assert found["b.HTML"].parent.endswith("/in") and found["a.txt"].length == 4
    assert [r.name for r in files.find_files(spark, str(tmp_path), (".txt",)).collect()] == ["a.txt"]
    got = {r.path.rsplit("/", 1)[-1]: (r.loader, r.text) for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", "text"), "b.HTML": ("html", "x"), "c.bin": ("text", ""), "d": ("text", "plain"), "e.docx": ("word", "one line\n"), "f.doc": ("word", "")}


def test_matching_is_dealt_out_over_tasks(spark):
    from graphloom.operators import extraction

    docs = spark.range(40).selectExpr("id as doc_id", "'第7号' as text").coalesce(1)
    found = extraction.mentions(docs, [extraction.Rule("number", "TIME", "[0-9]+")])
    used = found.selectExpr("spark_partition_id() as p").distinct().count()
    assert used > 1 and found.count() == 40


def test_triples_are_not_dealt_out_by_relation(spark):
    from graphloom.operators import graph

    g = graph.Graph.empty(spark)
    assert "hashpartitioning(relation_id" not in g.expanded()._jdf.queryExecution().toString()


def test_look_ups_of_an_entity_read_only_tables_that_may_have_it(spark):
    import __spark_entry__ as entry
    from graphloom.plans import star

    data = "/root/testdata/sf0.001"
    for name in ("kg_entity_by_id", "kg_entity_by_name"):
        df = entry.queries()[name](spark, data)
        assert df.count() and "o_orderkey" not in df._jdf.queryExecution().executedPlan().toString()
    every = star.star_graph(spark, data)
    for i in ("r:1", "n:3", "s:2", "c:5", "p:7", "o:1", "b:Brand#1", "s:02", "o:x", "", "x:1"):
        assert star.star_graph(spark, data, id_=i).entity(i).collect() == every.entity(i).collect()
    for n in ("order 1", "order x", "order", "Brand#1", "small ring"):
        assert sorted(map(str, star.star_graph(spark, data, name=n).entities_by(name=n).collect())) == sorted(map(str, every.entities_by(name=n).collect()))


def _odd_merge(spark, wins=True):
    """This graph, another with clashing, repeated, dangling and null rows, and the two merged."""
    from graphloom import schema
    from graphloom.operators import graph

    def made(entities, triples):
        e = spark.createDataFrame([(i, i, "T", {}) for i in entities], schema.ENTITIES)
        r = spark.createDataFrame([("r", "r", "T", "", False, {})], schema.RELATIONS)
        return graph.Graph(e, r, spark.createDataFrame([(i, s, p, o, c, {}) for i, s, p, o, c in triples], schema.TRIPLES))

    mine = made(["a", "b", ""], [("1", "a", "r", "b", 0.5), ("2", "b", "r", "a", 0.5), ("3", "gone", "r", "a", 0.5)])
    own = [("1", "a", "r", "b", 0.9), ("1", "a", "r", "b", 0.8), ("2", "b", "r", "a", 0.4), ("3", "a", "r", "a", 0.9), ("4", "c", "r", "a", 0.1), ("5", "a", "r", "", 0.1)]
    bad = [("6", "a", "r", "nobody", 1.0), ("7", "nobody", "r", "a", 1.0), ("8", "a", "no", "b", 1.0), ("9", None, "r", "a", 1.0), ("10", "a", "r", None, 1.0), ("11", "a", "r", "nobody", 1.0), ("11", "b", "r", "a", 1.0)]
    other = made(["a", "c", "c", None], own + bad + [(None, "a", "r", "c", 0.2)])
    return mine.merge(other, (lambda new, old: F.col(f"{new}.confidence") > F.col(f"{old}.confidence")) if wins else None)


@pytest.mark.parametrize("wins", [True, False])
def test_merge_of_odd_rows(spark, wins):
    merged, counts = _odd_merge(spark, wins)
    got = sorted((str(r.id), r.subject_id, r.confidence) for r in merged.triples.collect())
    new = [("1", "a", 0.8), ("2", "b", 0.5), ("3", "a", 0.9)] if wins else [("1", "a", 0.5), ("2", "b", 0.5), ("3", "gone", 0.5)]
    assert got == sorted([*new, ("4", "c", 0.1), ("5", "a", 0.1), ("None", "a", 0.2)])
    assert counts.first() == (1, 5 if wins else 3) and sorted(r.id for r in merged.entities.collect()) == ["", "a", "b", "c"]


def test_merge_deals_triples_out_once_and_over_more_tasks_the_more_there_are(spark, monkeypatch):
    from graphloom.operators import scratch

    monkeypatch.setattr(scratch, "TASK_ROWS", 2, raising=False)
    plan = _odd_merge(spark)[0].triples._jdf.queryExecution().toString()
    assert "hashpartitioning(subject_id" not in plan and "hashpartitioning(object_id" not in plan
    assert re.search(r"hashpartitioning\(id#\d+, 7\)", plan)  # 14 triples


def test_removal_of_few_rows_moves_no_triples(spark, monkeypatch):
    from graphloom import schema
    from graphloom.operators import graph, scratch

    e = spark.createDataFrame([(i, i, "T", {}) for i in ("a", "b", "c", None)], schema.ENTITIES)
    r = spark.createDataFrame([(i, i, "T", "", False, {}) for i in ("r", "q")], schema.RELATIONS)
    rows = [("1", "a", "r", "b", 1.0), ("2", "b", "r", "c", 1.0), ("3", "c", "r", "b", 1.0), ("4", None, "q", "b", 1.0), ("5", "c", "q", None, 1.0), ("6", "a", None, "a", 1.0)]
    k = graph.Graph(e, r, spark.createDataFrame([(*x, {}) for x in rows], schema.TRIPLES))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    for few_rows in (scratch.FEW_ROWS, 0):
        monkeypatch.setattr(scratch, "FEW_ROWS", few_rows)
        left, rest = k.remove_entities(ids("a", "a", None, "nobody")), k.remove_relations(ids("q", "q", None))
        assert sorted(x.id for x in left.triples.collect()) == ["2", "3", "4", "5"] and sorted(str(x.id) for x in left.entities.collect()) == ["None", "b", "c"]
        assert sorted(x.id for x in rest.triples.collect()) == ["1", "2", "3", "6"] and [x.id for x in rest.relations.collect()] == ["r"]
        plans = [x.triples._jdf.queryExecution().toString() for x in (left, rest)]
        assert not any(re.search(r"hashpartitioning\((subject|object|relation)_id", p) for p in plans)
