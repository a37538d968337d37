"""Entities, relations and triples from text, by rules or by a model of one's own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import inverse_name, is_symmetric, triple_id
from .graph import Graph
from .scratch import cut

_HAN = "A-Za-z\\u4e00-\\u9fa5"


@dataclass(frozen=True)
class Rule:
    """A named pattern. ``label`` is the relation's name; entities are named by what is matched."""

    name: str
    type: str
    pattern: str
    label: str = ""


# The entity and relation rules, by set and in their order. The date rule must match at least one part.
RULE_SETS: dict[str, tuple[Rule, ...]] = {
    "chinese_person": (
        Rule("chinese_person_name", "PERSON", f"[赵钱孙李周吴郑王冯陈楚魏蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤][{_HAN}]{{1,3}}"),
        Rule("chinese_person_with_title", "PERSON", f"(?:总统|总理|主席|董事长|教授|博士|先生|女士|医生|老师|同志)[{_HAN}]{{2,4}}"),
    ),
    "chinese_organization": (
        Rule("chinese_company", "ORGANIZATION", f"[{_HAN}]+(?:公司|集团|企业|有限责任公司|股份有限公司)"),
        Rule("chinese_school", "ORGANIZATION", f"[{_HAN}]+(?:大学|学院|中学|小学|学校)"),
        Rule("chinese_government", "ORGANIZATION", f"[{_HAN}]+(?:部|委员会|局|办公室|政府|机关)"),
    ),
    "chinese_location": (
        Rule("chinese_province_city", "LOCATION", f"[{_HAN}]+(?:省|市|自治区|特别行政区|县|区|镇|乡)"),
        Rule("chinese_country", "LOCATION", "中国|美国|日本|英国|法国|德国|俄罗斯|加拿大|澳大利亚|新西兰"),
        Rule("chinese_landmark", "LOCATION", f"[{_HAN}]+(?:公园|广场|大厦|建筑|景区|博物馆|街道|路)"),
    ),
    "chinese_time": (
        Rule("chinese_date", "TIME", "(?:19|20)\\d{2}年(?:\\d{1,2}月)?(?:\\d{1,2}日)?|\\d{1,2}月(?:\\d{1,2}日)?|\\d{1,2}日"),
        Rule("chinese_era", "TIME", "\\d{1,2}世纪|\\d{1,2}0年代"),
        Rule("chinese_period", "TIME", "春秋时期|战国时期|汉朝|唐朝|宋朝|元朝|明朝|清朝|民国时期"),
    ),
    "chinese_event": (
        Rule("chinese_historical_event", "EVENT", f"[{_HAN}]+(?:战争|革命|运动|起义|事变|会议)"),
        Rule("chinese_activity", "EVENT", f"[{_HAN}]+(?:节|庆典|活动|比赛|展览|论坛|峰会)"),
    ),
    "chinese_relation": (
        Rule("belongs_to_relation", "BELONGS_TO", "属于|隶属于|归属于|是...的一部分", "属于"),
        Rule("located_in_relation", "LOCATED_IN", "位于|坐落于|座落在|地处", "位于"),
        Rule("created_by_relation", "CREATED_BY", "创建|创立|创办|成立|建立|制作|开发", "创建"),
        Rule("works_for_relation", "WORKS_FOR", "就职于|供职于|为...工作|在...工作|是...的员工", "工作于"),
        Rule("born_in_relation", "BORN_IN", "出生于|生于", "出生于"),
        Rule("has_property_relation", "HAS_PROPERTY", "具有|拥有|有...特征|有...特点|有...性质", "具有特性"),
    ),
}


def rule_set(name: str) -> tuple[list[Rule], list[Rule]]:
    """Entity and relation rules of a set; ``chinese_all`` has all of them."""
    names = list(RULE_SETS) if name == "chinese_all" else [name]
    rules = [r for n in names for r in RULE_SETS[n]]
    return [r for r in rules if not r.label], [r for r in rules if r.label]


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt out by doc_id over as many tasks as the session shuffles to: a small file is one task otherwise, and texts take
    far longer to match than to move. A given number, as small partitions would be put together again. Windows by document follow
    without a further exchange."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return docs.repartition(n, "doc_id")


_RUN_THEN_WORD = re.compile(r"(\[[^\[\]^&]+\])\+\(\?:([^()\[\]{}\\.*+?^$]+)\)")


def _from_starts(pattern: str) -> str:
    """A pattern that matches the same places, sooner. A run of some characters and then one of several words of such characters
    reaches to the last of these words in a whole run, so it matches a run once at most, and from its start. Said so, it is not
    tried from every other character on as well, which takes the square of the run's length."""
    m = _RUN_THEN_WORD.fullmatch(pattern)
    return f"(?<!{m[1]}){pattern}" if m and all(c == "|" or re.fullmatch(m[1], c) for c in m[2]) else pattern


_MENTIONS = "rule_name string, type string, label string, text string, position int, length int"


def mentions(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """doc_id, seq, rule_name, type, label, text, position, length of every match, position and length in code points.

    What a pattern cuts a text into, and what it matches, follow each other, so a match's place is the sum of the lengths before it:
    built-in functions alone. Texts are cut only where something matches. Only rules that can match nothing at all, where that does not hold, are looked for in Python.
    """
    docs = spread(docs)
    odd = {i for i, r in enumerate(rules) if re.compile(r.pattern).search("") is not None}
    found = _placed(docs, [(i, r) for i, r in enumerate(rules) if i not in odd], text)
    return found.unionByName(_scanned(docs, [(i, r) for i, r in enumerate(rules) if i in odd], text)) if odd else found


def _placed(docs: DataFrame, rules: list[tuple[int, Rule]], text: str) -> DataFrame:
    body = F.col(text)
    fast = {i: F.lit(_from_starts(r.pattern)) for i, r in rules}
    struct = lambda i, r: F.struct(F.lit(i).alias("seq"), F.lit(r.name).alias("rule_name"), F.lit(r.type).alias("type"), F.lit(r.label).alias("given"), fast[i].alias("pattern"), F.regexp_extract_all(body, fast[i], F.lit(0)).alias("texts"))
    every = F.array(*[struct(i, r) for i, r in rules]) if rules else F.array().cast("array<struct<seq:int,rule_name:string,type:string,given:string,pattern:string,texts:array<string>>>")
    each = docs.select("doc_id", body.alias("body"), F.explode(F.filter(every, lambda m: F.size(m["texts"]) > 0)).alias("m"))
    each = each.select("doc_id", "m.*", F.split("body", F.col("m.pattern"), -1).alias("pieces"))
    steps = F.zip_with("texts", F.slice("pieces", 1, F.size("texts")), lambda t, p: F.struct(F.char_length(p).alias("gap"), F.char_length(t).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    places = F.aggregate(steps, start, lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.concat(s["places"], F.array(s["at"] + x["gap"])).alias("places")), lambda s: s["places"])
    rows = each.withColumn("places", places).select("doc_id", "seq", "rule_name", "type", "given", F.explode(F.arrays_zip("texts", "places")).alias("x"))
    label = F.when(F.col("given") != "", F.col("given")).otherwise(F.col("x.texts"))
    return rows.select("doc_id", "seq", "rule_name", "type", label.alias("label"), F.col("x.texts").alias("text"), F.col("x.places").alias("position"), F.char_length("x.texts").alias("length"))


def _scanned(docs: DataFrame, rules: list[tuple[int, Rule]], text: str) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [(i, r, re.compile(r.pattern)) for i, r in rules]
        for pdf in batches:
            rows = [
                (doc, i, r.name, r.type, r.label or m.group(), m.group(), m.start(), len(m.group()))
                for doc, body in zip(pdf["doc_id"], pdf["body"])
                for i, r, p in known
                for m in p.finditer(body or "")
                if m.group()
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "rule_name", "type", "label", "text", "position", "length"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("body")).mapInPandas(scan, f"doc_id {kind}, seq int, {_MENTIONS}")


def rule_matches(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """doc_id, seq, rule_name, type, text of every match, without positions: built-in functions only."""
    found = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(r.name).alias("rule_name"), F.lit(r.type).alias("type"), F.lit(r.label).alias("label"), F.regexp_extract_all(F.col(text), F.lit(_from_starts(r.pattern)), F.lit(0)).alias("texts")) for i, r in enumerate(rules)])
    rows = spread(docs).select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")
    return rows.select("doc_id", "seq", "rule_name", "type", "label", F.explode("texts").alias("text")).filter("text <> ''")


def first_by_name(found: DataFrame, *name: str) -> DataFrame:
    """The first mention of each name in a document, by rule and place; names are labels unless other columns are given."""
    order = Window.partitionBy("doc_id", *(name or ["label"])).orderBy("seq", "position")
    return found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def token_matches(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, seq, rule_name, type, text of tokens (doc_id, tokens) of two letters or more that a rule matches as a whole."""
    each = tokens.select("doc_id", F.explode("tokens").alias("text")).filter(F.char_length("text") >= 2)
    hit = F.array(*[F.when(F.col("text").rlike(f"^(?:{r.pattern})$"), F.struct(F.lit(i).alias("seq"), F.lit(r.name).alias("rule_name"), F.lit(r.type).alias("type"))) for i, r in enumerate(rules)])
    return each.select("doc_id", "text", F.explode(F.filter(hit, lambda m: m.isNotNull())).alias("m")).select("doc_id", "m.*", "text")


def nearest(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Each relation mention (doc_id, label, position) with the nearest entity mention before and after it, as an as-of join.

    Both are put in one order per document, and the last and next entity are read off by windows, so no pairs are made. Of several
    entities at one place the last by name and type counts before the relation, and the first after it.
    """
    e = entities.select("doc_id", "position", F.lit(0).alias("kind"), F.struct("position", "label", "type").alias("entity"), F.lit(None).cast(_struct(relations)).alias("relation"))
    r = relations.select("doc_id", "position", F.lit(1).alias("kind"), F.lit(None).cast(e.schema["entity"].dataType).alias("entity"), F.struct("label", "type", "position").alias("relation"))
    return _between(e.unionByName(r)).filter("kind = 1").select("doc_id", "relation", "before", "after")


def _between(both: DataFrame) -> DataFrame:
    """Mentions (doc_id, position, kind, entity, relation) with the nearest entity before and after each."""
    # both frames only grow as the rows go by, so each row is added once; a frame up to the end would be read anew for each row
    up, down = Window.partitionBy("doc_id").orderBy("position"), Window.partitionBy("doc_id").orderBy(F.desc("position"))
    back, ahead = up.rangeBetween(Window.unboundedPreceding, -1), down.rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("before", F.max("entity").over(back)).withColumn("after", F.min("entity").over(ahead))


def _struct(relations: DataFrame) -> str:
    return f"struct<label:{relations.schema['label'].dataType.simpleString()},type:{relations.schema['type'].dataType.simpleString()},position:{relations.schema['position'].dataType.simpleString()}>"


def entity_id(name: Column, kind: Column) -> Column:
    """The same name and type give the same id, in every text."""
    return F.concat(F.lit("entity_"), F.substring(F.sha2(F.concat_ws("|", kind, name), 256), 1, 16))


def relation_id(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("relation_"), F.substring(F.sha2(F.concat_ws("|", kind, name), 256), 1, 16))


class Extractor:
    """What every extractor offers: ``entities``, ``relations`` and ``triples`` of documents, and the graph of them."""

    def __init__(self, **parameters: str):
        self.parameters = dict(parameters)

    def set_parameter(self, key: str, value: str) -> Extractor:
        self.parameters[key] = value
        return self

    def parameter(self, key: str, default: str = "") -> str:
        return self.parameters.get(key, default)

    def entities(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def relations(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def triples(self, docs: DataFrame) -> DataFrame:
        """doc_id, subject, subject_type, relation, relation_type, object, object_type, confidence."""
        raise NotImplementedError

    def facts(self, docs: DataFrame) -> DataFrame:
        """What the documents hold, each once: kind (entity, relation or triple), name and type, and of triples the subject,
        subject_type, object, object_type and the highest confidence. Relations that triples have need no row of their own."""
        none = [F.lit(None).cast(t).alias(c) for c, t in (("subject", "string"), ("subject_type", "string"), ("object", "string"), ("object_type", "string"), ("confidence", "double"))]
        one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("label").alias("name"), "type", *none)
        triples = self.triples(docs).select(F.lit("triple").alias("kind"), F.col("relation").alias("name"), F.col("relation_type").alias("type"), "subject", "subject_type", "object", "object_type", "confidence")
        return _once(one(self.entities(docs), "entity").union(one(self.relations(docs), "relation")).union(triples))

    def graph(self, docs: DataFrame, name: str = "graph", into: Graph | None = None) -> Graph:
        """The graph of what the documents hold, added to ``into``. What they hold is written to the shared folder once."""
        spark, facts = docs.sparkSession, cut(self.facts(docs), "facts")
        found = facts.filter("kind = 'triple'").select("subject", "subject_type", F.col("name").alias("relation"), F.col("type").alias("relation_type"), "object", "object_type", "confidence")
        none = F.create_map().cast("map<string,string>")
        named = facts.filter("kind = 'entity'").select("name", "type")
        ends = found.select(F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("type")))).alias("e")).select("e.*")
        entities = named.union(ends).distinct().select(entity_id(F.col("name"), F.col("type")).alias("id"), "name", "type", none.alias("properties"))
        kinds = facts.filter("kind <> 'entity'").select("name", "type").distinct()
        relations = kinds.select(relation_id(F.col("name"), F.col("type")).alias("id"), "name", "type", inverse_name(F.col("type")).alias("inverse_name"), is_symmetric(F.col("type")).alias("symmetric"), none.alias("properties"))
        s, o, r = entity_id(F.col("subject"), F.col("subject_type")), entity_id(F.col("object"), F.col("object_type")), relation_id(F.col("relation"), F.col("relation_type"))
        triples = found.groupBy(s.alias("subject_id"), r.alias("relation_id"), o.alias("object_id")).agg(F.max("confidence").alias("confidence"))
        triples = triples.select(triple_id(F.col("subject_id"), F.col("relation_id"), F.col("object_id")).alias("id"), "subject_id", "relation_id", "object_id", "confidence", none.alias("properties"))
        return (into or Graph.empty(spark, name)).add_entities(entities).add_relations(relations).add_triples(triples)


def _once(facts: DataFrame) -> DataFrame:
    return facts.groupBy("kind", "name", "type", "subject", "subject_type", "object", "object_type").agg(F.max("confidence").alias("confidence"))


class RuleExtractor(Extractor):
    """Regular expressions. A relation joins the nearest entity before it to the nearest one after it; without both there is no triple."""

    def __init__(self, rules: str = "chinese_all", **parameters: str):
        super().__init__(**parameters)
        self.entity_rules, self.relation_rules = rule_set(rules) if rules else ([], [])
        self.entity_types: dict[str, str] = {}
        self.relation_types: dict[str, str] = {}

    def add_rules(self, *rules: Rule) -> RuleExtractor:
        for r in rules:
            (self.relation_rules if r.label else self.entity_rules).append(r)
        return self

    def map_entity_type(self, rule_name: str, type: str) -> RuleExtractor:
        self.entity_types[rule_name] = type
        return self

    def map_relation_type(self, rule_name: str, type: str) -> RuleExtractor:
        self.relation_types[rule_name] = type
        return self

    def _typed(self, rules: list[Rule], types: dict[str, str]) -> list[Rule]:
        return [Rule(r.name, types.get(r.name, r.type), r.pattern, r.label) for r in rules]

    def entities(self, docs: DataFrame) -> DataFrame:
        return first_by_name(mentions(docs, self._typed(self.entity_rules, self.entity_types)))

    def relations(self, docs: DataFrame) -> DataFrame:
        return first_by_name(mentions(docs, self._typed(self.relation_rules, self.relation_types)))

    def facts(self, docs: DataFrame) -> DataFrame:
        """All rules are matched in one pass over the texts, and a document's mentions stay where its text was dealt to."""
        rules = self._typed(self.entity_rules, self.entity_types) + self._typed(self.relation_rules, self.relation_types)
        every = mentions(docs, rules).withColumn("kind", (F.col("seq") >= len(self.entity_rules)).cast("int"))
        entity, relation = F.struct("position", "label", "type"), F.struct("label", "type", "position")
        first = first_by_name(every, "kind", "label").select("doc_id", "position", "kind", F.when(F.col("kind") == 0, entity).alias("entity"), F.when(F.col("kind") == 1, relation).alias("relation"))
        of = lambda c: F.coalesce(F.col("entity")[c], F.col("relation")[c])
        held = (F.col("kind") == 1) & F.col("before").isNotNull() & F.col("after").isNotNull()
        kind = F.when(held, "triple").when(F.col("kind") == 1, "relation").otherwise("entity")
        ends = [F.when(held, F.col(at)[c]).alias(a) for at, c, a in (("before", "label", "subject"), ("before", "type", "subject_type"), ("after", "label", "object"), ("after", "type", "object_type"))]
        return _once(_between(first).select(kind.alias("kind"), of("label").alias("name"), of("type").alias("type"), *ends, F.when(held, F.lit(1.0)).alias("confidence")))

    def triples(self, docs: DataFrame) -> DataFrame:
        joined = nearest(self.relations(docs), self.entities(docs)).filter("before is not null and after is not null")
        return joined.select("doc_id", F.col("before.label").alias("subject"), F.col("before.type").alias("subject_type"), F.col("relation.label").alias("relation"), F.col("relation.type").alias("relation_type"), F.col("after.label").alias("object"), F.col("after.type").alias("object_type"), F.lit(1.0).alias("confidence"))


class ModelExtractor(Extractor):
    """A model of one's own. ``recognise(text)`` gives (name, type, confidence) entities; ``relate(text, entities)`` gives
    (subject index, object index, name, type, confidence) relations. Weaker ones than the thresholds are dropped."""

    def __init__(self, recognise: Callable[[str], list[tuple]], relate: Callable[[str, list[tuple]], list[tuple]], entity_threshold: float = 0.5, relation_threshold: float = 0.3):
        super().__init__()
        self.recognise, self.relate, self.entity_threshold, self.relation_threshold = recognise, relate, entity_threshold, relation_threshold

    def _run(self, docs: DataFrame) -> DataFrame:
        recognise, relate, least_e, least_r = self.recognise, self.relate, self.entity_threshold, self.relation_threshold

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["body"]):
                    if not text:
                        continue
                    found = [e for e in recognise(text) if e[2] >= least_e]
                    rows += [(doc, "entity", n, t, c, None, None, None, None) for n, t, c in found]
                    for s, o, n, t, c in relate(text, found) if found else ():
                        if c >= least_r and 0 <= s < len(found) and 0 <= o < len(found):
                            rows.append((doc, "triple", n, t, c, found[s][0], found[s][1], found[o][0], found[o][1]))
                yield pd.DataFrame(rows, columns=["doc_id", "kind", "label", "type", "confidence", "subject", "subject_type", "object", "object_type"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", F.col("text").alias("body")).mapInPandas(scan, f"doc_id {kind}, kind string, label string, type string, confidence double, subject string, subject_type string, object string, object_type string")

    def entities(self, docs: DataFrame) -> DataFrame:
        return self._run(docs).filter("kind = 'entity'").dropDuplicates(["doc_id", "label"])

    def relations(self, docs: DataFrame) -> DataFrame:
        return self._run(docs).filter("kind = 'triple'").select("doc_id", "label", "type").distinct()

    def triples(self, docs: DataFrame) -> DataFrame:
        return self._run(docs).filter("kind = 'triple'").select("doc_id", "subject", "subject_type", F.col("label").alias("relation"), F.col("type").alias("relation_type"), "object", "object_type", "confidence")


class Extractors:
    """Extractors by name; the first one registered is the default."""

    def __init__(self):
        self._known: dict[str, Extractor] = {}
        self._default: str | None = None
        self.register("rule_based", RuleExtractor())

    def register(self, name: str, extractor: Extractor) -> None:
        self._known[name] = extractor
        self._default = self._default or name

    def get(self, name: str | None = None) -> Extractor:
        key = name or self._default
        if key not in self._known:
            raise KeyError(f"no extractor {key}")
        return self._known[key]

    def set_default(self, name: str) -> None:
        self.get(name)
        self._default = name

    def names(self) -> list[str]:
        return sorted(self._known)

    def build(self, docs: DataFrame, extractor: str | None = None, name: str = "graph", into: Graph | None = None) -> Graph:
        return self.get(extractor).graph(docs, name, into)

