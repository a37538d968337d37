import time

from pyspark.sql import functions as F

from graphloom.operators import extraction
from graphloom.operators.extraction import Rule


def test_places_equal_a_scan(spark, rng):
    letters = ["公司", "大学", "北", "京", "A", "b", "1", "12", " ", "\n", "é", "🙂", "李", "位于", "."]
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(30)))) for i in range(150)] + [(900, None), (901, ""), (3, "北京公司北京公司"), (None, "李白")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    entities, relations = extraction.rule_set("chinese_all")
    rules = [*entities, *relations, Rule("digits", "TIME", "[0-9]+"), Rule("ends", "X", "京$"), Rule("marks", "X", r"\.|\n"), Rule("maybe", "X", "b*")]
    numbered = list(enumerate(rules))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(extraction.mentions(df, rules)) == key(extraction._scanned(df, numbered, "text")) != []
    assert extraction.mentions(df.limit(0), rules).collect() == [] == extraction.mentions(df, []).collect()


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "ab " * 20_000)], "doc_id long, text string")
    got = extraction.mentions(df, [Rule("b", "X", "b")]).agg({"position": "sum", "seq": "count"}).first()
    assert got["sum(position)"] == sum(3 * i + 1 for i in range(20_000)) and got["count(seq)"] == 20_000


def test_entities_at_one_place(spark):
    e = spark.createDataFrame([(1, n, "X", p) for n, p in (("b", 0), ("a", 0), ("d", 9), ("c", 9))], "doc_id long, label string, type string, position int")
    r = spark.createDataFrame([(1, "r", "R", 4)], "doc_id long, label string, type string, position int")
    row = extraction.nearest(r, e).first()
    assert (row.before.label, row.after.label) == ("b", "c")


def test_patterns_from_starts_match_the_same(spark, rng):
    rules = [r.pattern for n in extraction.RULE_SETS for r in extraction.RULE_SETS[n]] + ["[a-c]+(?:ab|c)", "[a-c]+(?:ab|d)", "[a-c]+(?:b.)", "[^a]+(?:b|c)"]
    fast = [extraction._from_starts(p) for p in rules]
    assert sum(f != p for f, p in zip(fast, rules)) == 8 and fast[-4] != rules[-4] and fast[-3:] == rules[-3:]
    letters = ["公司", "集团", "学", "院", "大学", "部", "委员会", "市", "自治区", "路", "街道", "节", "战争", "北", "A", "1", "。", "a", "b", "c", "d"]
    df = spark.createDataFrame([("".join(rng.choice(letters) for _ in range(rng.randrange(40))),) for _ in range(400)], "text string")
    for p, f in zip(rules, fast):
        wrong = df.select(*(g(c) for c in (p, f) for g in (lambda c: F.regexp_extract_all("text", F.lit(c), F.lit(0)), lambda c: F.split("text", c, -1))))
        assert all(r[:2] == r[2:] for r in wrong.collect()), p


def test_long_runs_take_no_square_of_their_length(spark):
    entities, _ = extraction.rule_set("chinese_all")
    began = time.time()
    assert extraction.mentions(spark.createDataFrame([(1, "北" * 100_000)], "doc_id long, text string"), entities).count() == 0
    assert time.time() - began < 60


def test_facts_equal_their_parts_and_texts_are_read_once(spark, rng):
    letters = ["公司", "大学", "北", "京", "1月", " ", "李", "位于", "创建", "属于", "中国", "。"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(30)))) for i in range(150)] + [(900, None), (901, "")]
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = extraction.RuleExtractor().map_entity_type("chinese_company", "CONCEPT").map_relation_type("created_by_relation", "CUSTOM")
    key = lambda df: {str(r) for r in df.collect()}
    whole, parts = key(rules.facts(docs)), key(extraction.Extractor.facts(rules, docs))
    relations = {r for r in parts if "kind='relation'" in r}
    assert whole - relations == parts - relations and whole & relations <= relations and len(whole - relations) > 100
    graph = rules.graph(docs.mapInPandas(read, docs.schema))
    found = {r.kind: r.n for r in graph.counts().collect()}
    assert seen.value == len(rows)
    kinds = rules.relations(docs).select("label", "type").distinct().count()
    triples = rules.triples(docs).drop("doc_id", "confidence").distinct().count()
    assert found == {"entity": rules.entities(docs).select("label", "type").distinct().count(), "relation": kinds, "triple": triples}
