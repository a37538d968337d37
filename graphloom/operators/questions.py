"""Questions to intents: normalised text, type, entities, relations, attributes, parameters and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import STOP_WORDS
from ..functions.text import SPACE, trim_space
from .scratch import few

# What in a question tells its type, in the order in which types are tried.
TYPE_MARKS = {
    "ENTITY": ("是谁", "是什么人", "是哪位"),
    "RELATION": ("什么关系", "有何关系", "如何联系"),
    "ATTRIBUTE": ("有多少", "多大", "多高", "在哪里"),
    "LIST": ("有哪些", "列举", "包括哪些"),
    "COMPARISON": ("相比", "比较", "哪个更"),
    "DEFINITION": ("什么是", "定义", "解释"),
    "FACT": ("是不是", "是否", "对不对"),
}
OPEN_MARKS = ("?", "？", "为什么", "怎么样", "如何")
# Patterns that take questions apart. A last group runs up to the closing marks.
_TAIL = r"([^？?。！!]*)[？?。！!]*$"
PATTERNS = {
    "ENTITY": r"^(.*?)是谁",
    "RELATION": r"^(.*?)和(.*?)(?:是什么|有什么|有何)关系",
    "ATTRIBUTE": r"^(.*?)的(.*?)是(?:什么|多少|多大|多高|哪里)",
    "LIST": "^(.*?)有哪些" + _TAIL,
    "COMPARISON": r"^(.*?)和(.*?)(?:相比|比较|哪个更)" + _TAIL,
    "DEFINITION": "(?:什么是|定义|解释)" + _TAIL,
    "FACT": "^(.*?)(?:是不是|是否)" + _TAIL,
}
#: Marks that are dropped; closing ones stay.
DROPPED = r"[!-/:->@\[-`{-~、，；：“”‘’（）《》【】]"


def normalised(q: Column) -> Column:
    """ASCII lower-cased, white space collapsed, marks other than closing ones dropped, trimmed."""
    lowered = F.translate(q, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return trim_space(F.regexp_replace(F.regexp_replace(lowered, f"{SPACE}+", " "), DROPPED, ""))


def _has_any(q: Column, marks) -> Column:
    out = q.contains(marks[0])
    for m in marks[1:]:
        out = out | q.contains(m)
    return out


def query_type(q: Column) -> Column:
    out = None
    for kind, marks in TYPE_MARKS.items():
        out = F.when(_has_any(q, marks), kind) if out is None else out.when(_has_any(q, marks), kind)
    return out.when(_has_any(q, OPEN_MARKS), "OPEN").otherwise("UNKNOWN")


def _part(q: Column, kind: str, group: int) -> Column:
    return trim_space(F.regexp_extract(q, PATTERNS[kind], group))


def _strings(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda p: p != "")


def open_words(q: Column) -> Column:
    """The distinct words of an open question, in order, without stop words and single letters."""
    words = F.array_sort(F.array_distinct(F.split(q, f"{SPACE}+")))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~F.array_contains(stops, w))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once, and not again in each expression that reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse(questions: DataFrame) -> DataFrame:
    """Questions (query_id, text, ...) with normalized, type, entities, relations, attributes, params and parse_confidence."""
    df = _held(_held(questions, "normalized", normalised(F.col("text"))), "type", query_type(F.col("normalized")))
    q, t = F.col("normalized"), F.col("type")
    none = F.array().cast("array<string>")
    entities = (
        F.when(t == "ENTITY", _strings(_part(q, "ENTITY", 1)))
        .when(t == "RELATION", _strings(_part(q, "RELATION", 1), _part(q, "RELATION", 2)))
        .when(t == "ATTRIBUTE", _strings(_part(q, "ATTRIBUTE", 1)))
        .when(t == "LIST", _strings(_part(q, "LIST", 1)))
        .when(t == "COMPARISON", _strings(_part(q, "COMPARISON", 1), _part(q, "COMPARISON", 2)))
        .when(t == "DEFINITION", _strings(_part(q, "DEFINITION", 1)))
        .when(t == "FACT", _strings(_part(q, "FACT", 1), _part(q, "FACT", 2)))
        .otherwise(open_words(q))
    )
    relations = F.when((t == "RELATION") & (_part(q, "RELATION", 1) != ""), F.array(F.lit("关系"))).otherwise(none)
    attributes = F.when(t == "ATTRIBUTE", _strings(_part(q, "ATTRIBUTE", 2))).when(t == "LIST", _strings(_part(q, "LIST", 2))).when(t == "COMPARISON", _strings(_part(q, "COMPARISON", 3))).otherwise(none)
    empty = F.create_map().cast("map<string,string>")
    params = F.when(t == "LIST", F.create_map(F.lit("list_type"), _part(q, "LIST", 2))).when(t == "COMPARISON", F.create_map(F.lit("aspect"), _part(q, "COMPARISON", 3))).otherwise(empty)
    for name, value in (("entities", entities), ("relations", relations), ("attributes", attributes), ("params", params)):
        df = _held(df, name, value)
    return df.withColumn("parse_confidence", parse_confidence(F.col("type"), F.col("entities"), F.col("relations"), F.col("attributes")))


def parse_confidence(kind: Column, entities: Column, relations: Column, attributes: Column) -> Column:
    """0.3 for a known type, up to 0.3 for two entities, 0.2 each for relations and attributes."""
    known = F.when(kind.isin("UNKNOWN"), 0.0).otherwise(0.3)
    share = F.least(F.lit(1.0), F.size(entities) / F.lit(2.0))
    return F.round(known + 0.3 * share + F.when(F.size(relations) > 0, 0.2).otherwise(0.0) + F.when(F.size(attributes) > 0, 0.2).otherwise(0.0), 6)


def link_entities(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, nth, mention, entity_id, confidence: the entity whose normalised name a mention is, the first by id; one of its own, as
    ``temp_`` and the name, with confidence 0 where there is none."""
    said = parsed.select("query_id", F.posexplode("entities").alias("nth", "mention"))
    # only entities that are mentioned are grouped
    names = entities.select("id", normalised(F.col("name")).alias("mention")).join(few(said.select("mention"), "mentions"), "mention")
    named = names.groupBy("mention").agg(F.min("id").alias("entity_id"))
    linked = said.join(named, "mention", "left")
    return linked.select("query_id", "nth", "mention", F.coalesce("entity_id", F.concat(F.lit("temp_"), F.col("mention"))).alias("entity_id"), F.when(F.col("entity_id").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


def link_relations(parsed: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, nth, mention, relation_id; ``temp_`` and the name where no relation has it."""
    said = parsed.select("query_id", F.posexplode("relations").alias("nth", "mention"))
    named = relations.groupBy(normalised(F.col("name")).alias("mention")).agg(F.min("id").alias("relation_id"))
    return said.join(named, "mention", "left").select("query_id", "nth", "mention", F.coalesce("relation_id", F.concat(F.lit("temp_"), F.col("mention"))).alias("relation_id"))
