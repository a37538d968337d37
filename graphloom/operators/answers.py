"""Answers from results: templates, prompts, postprocessing, confidence and sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE

# The texts of answers and prompts.
FACT_UNKNOWN = "根据知识库中的信息，无法确认这一事实。"
ENTITY_UNKNOWN = "很抱歉，我没有找到关于这个实体的信息。"
ATTRIBUTE_UNKNOWN = "很抱歉，我没有找到关于这个属性的信息。"
ATTRIBUTE_UNCLEAR = "很抱歉，我无法回答这个问题，因为没有足够的信息或者查询不明确。"
LIST_UNKNOWN = "很抱歉，我无法提供这个列表信息，因为没有足够的数据。"
NOTHING = "很抱歉，我没有找到相关信息来回答这个问题。"
PROMPT_HEAD = "你是一个基于知识图谱的问答助手。请根据提供的知识回答用户的问题。请简洁、准确地回答，只使用提供的知识。如果没有足够的信息，请诚实地说你不知道。\n\n"
PROMPT_TAIL = "\n请根据以上信息回答用户问题。"
LANGUAGES = {"zh": "请用中文回答。", "en": "Please answer in English."}
ENGINE_HEAD = "你是一个知识库助手，请根据以下信息回答用户的问题。\n\n"


def _with_items(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """Questions with their results as an array in rank order."""
    listed = items.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "triple_id", "subject", "relation", "relation_type", "object", "confidence", "relevance"))).alias("items"))
    df = parsed.join(listed.withColumnRenamed("items", "found"), "query_id", "left")
    # held by a generator, so that the templates read it and do not compute it again
    return df.select("*", F.explode(F.array(F.coalesce("found", F.array().cast(listed.schema["items"].dataType)))).alias("items")).drop("found")


def _spoken(i) -> Column:
    return F.concat(i["subject"], F.lit(" "), i["relation"], F.lit(" "), i["object"])


def _join(parts: Column, by: str) -> Column:
    return F.array_join(parts, by)


def direct(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, type, answer, confidence, from the template of each type."""
    df = _with_items(parsed, items)
    it, t = F.col("items"), F.col("type")
    top = F.get(it, F.lit(0))
    first = F.coalesce(F.get("entities", F.lit(0)), F.lit(""))
    some = F.size(it) > 0
    fact = F.when(some & (top["relevance"] > 0.8), F.concat(F.lit("是的，"), _spoken(top), F.lit("。"))).otherwise(F.lit(FACT_UNKNOWN))
    fact_c = F.when(some & (top["relevance"] > 0.8), top["confidence"]).otherwise(F.lit(0.3))

    defining = F.filter(it, lambda i: (i["relation_type"] == "IS_A") | i["relation"].contains("定义") | i["relation"].contains("类型"))
    traits = F.slice(F.transform(F.filter(it, lambda i: (i["relation_type"] == "HAS_PROPERTY") & ~(i["relation"].contains("定义") | i["relation"].contains("类型"))), lambda i: F.concat(i["relation"], F.lit(" "), i["object"])), 1, 3)
    name = F.when(first != "", first).otherwise(top["subject"])
    is_what = F.when(F.size(defining) > 0, F.concat(F.lit(" "), _join(F.transform(defining, lambda i: i["object"]), " "))).otherwise(F.lit(" 一个实体"))
    has_what = F.when(F.size(traits) > 0, F.concat(F.lit(" "), name, F.lit(" 的特点包括："), _join(traits, "，"), F.lit("。"))).otherwise(F.lit(""))
    entity = F.when(some, F.concat(name, F.lit(" 是"), is_what, F.lit("。"), has_what)).otherwise(F.lit(ENTITY_UNKNOWN))

    attribute = F.get("attributes", F.lit(0))
    hit = F.get(F.filter(it, lambda i: F.contains(i["relation"], attribute)), F.lit(0))
    clear = some & (F.size("attributes") > 0)
    attr = F.when(~clear, F.lit(ATTRIBUTE_UNCLEAR)).when(hit.isNotNull(), F.concat(hit["subject"], F.lit(" 的 "), hit["relation"], F.lit(" 是 "), hit["object"], F.lit("。"))).otherwise(F.lit(ATTRIBUTE_UNKNOWN))
    attr_c = F.when(~clear, F.lit(0.1)).when(hit.isNotNull(), hit["confidence"]).otherwise(F.lit(0.2))

    kind = F.try_element_at("params", F.lit("list_type"))
    objects = F.transform(F.filter(it, lambda i: F.contains(i["relation"], kind)), lambda i: i["object"])
    able = some & kind.isNotNull()
    lst = F.when(~able, F.lit(LIST_UNKNOWN)).otherwise(F.concat(first, F.lit(" 的 "), kind, F.lit(" 包括："), F.when(F.size(objects) > 0, F.concat(_join(objects, "，"), F.lit("。"))).otherwise(F.lit("未找到相关信息。"))))
    lst_c = F.when(~able, F.lit(0.2)).when(F.size(objects) > 0, F.lit(0.7)).otherwise(F.lit(0.3))

    other = F.when(some, F.concat(F.lit("根据知识库中的信息：\n"), _join(F.transform(F.slice(it, 1, 3), lambda i: F.concat(F.lit("- "), _spoken(i), F.lit("\n"))), ""))).otherwise(F.lit(NOTHING))
    answer = F.when(t == "FACT", fact).when(t == "ENTITY", entity).when(t == "ATTRIBUTE", attr).when(t == "LIST", lst).otherwise(other)
    confidence = F.when(t == "FACT", fact_c).when(t == "ENTITY", F.when(some, 0.8).otherwise(0.2)).when(t == "ATTRIBUTE", attr_c).when(t == "LIST", lst_c).otherwise(F.when(some, 0.5).otherwise(0.1))
    return df.select("query_id", "type", postprocessed(answer).alias("answer"), confidence.alias("confidence"))


def postprocessed(answer: Column, most: int = 1000) -> Column:
    """White space collapsed, none after a CJK mark, a closing mark at the end; cut to ``most``, back to the last sentence if that keeps over 80 %."""
    one = F.regexp_replace(F.regexp_replace(answer, f"{SPACE}+", " "), "([。！？，：；]) ", "$1")
    one = F.when(one.rlike("[。！？!?]$") | (one == ""), one).otherwise(F.concat(one, F.lit("。")))
    head = F.substring(one, 1, most)
    kept = F.regexp_extract(head, r"^(?s:(.*[。！？!?]))", 1)
    return F.when(F.char_length(one) <= most, one).otherwise(F.when(F.char_length(kept) - 1 > most * 0.8, kept).otherwise(head))


def sources(items: DataFrame) -> DataFrame:
    """query_id, sources: what each result says, in rank order."""
    listed = items.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "subject", "relation", "object"))).alias("l"))
    return listed.select("query_id", F.transform("l", lambda i: F.concat(F.lit("Triple: "), i["subject"], F.lit(" - "), i["relation"], F.lit(" - "), i["object"])).alias("sources"))


def prompts(parsed: DataFrame, items: DataFrame, min_confidence: float = 0.0, with_confidence: bool = False, language: str = "zh") -> DataFrame:
    """query_id, prompt: the question and the results that are relevant enough, for a model."""
    df = _with_items(parsed, items)
    note = (lambda i: F.concat(F.lit(" (置信度: "), F.format_number(i["confidence"], 3), F.lit(")"))) if with_confidence else (lambda i: F.lit(""))
    facts = F.transform(F.filter("items", lambda i: i["relevance"] >= min_confidence), lambda i: F.concat(F.lit("- "), _spoken(i), note(i), F.lit("\n")))
    return df.select("query_id", F.concat(F.lit(PROMPT_HEAD + "用户问题: "), "text", F.lit("\n\n相关知识:\n"), _join(facts, ""), F.lit(PROMPT_TAIL + LANGUAGES.get(language, ""))).alias("prompt"))


def context_prompt(question: Column, context: Column) -> Column:
    """A prompt with numbered pieces of context."""
    numbered = F.transform(context, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c, F.lit("\n")))
    about = F.when(F.size(context) > 0, F.concat(F.lit("相关信息：\n"), _join(numbered, ""), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(ENGINE_HEAD), about, F.lit("用户: "), question, F.lit("\n助手: "))


def model_confidence(items: DataFrame) -> DataFrame:
    """query_id, confidence of a model's answer: half, more for up to five results and for their mean relevance."""
    return items.groupBy("query_id").agg(F.round(F.least(F.lit(1.0), 0.5 + 0.2 * F.least(F.lit(1.0), F.count("*") / F.lit(5.0)) + 0.3 * F.avg("relevance")), 6).alias("confidence"))


def goes_direct(kind: Column, items: Column, has_model: bool) -> Column:
    """Whether a template answers: without a model, for facts and attributes, and for a single result that is relevant beyond 0.9."""
    if not has_model:
        return F.lit(True)
    return kind.isin("FACT", "ATTRIBUTE") | ((F.size(items) == 1) & (F.get(items, F.lit(0))["relevance"] > 0.9))


def generate(parsed: DataFrame, items: DataFrame, model: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """query_id, answer, confidence, sources, is_direct, is_model. ``model`` turns a prompt column into an answer column, as a pandas UDF does."""
    plain = direct(parsed, items)
    listed = _with_items(parsed, items).select("query_id", goes_direct(F.col("type"), F.col("items"), model is not None).alias("is_direct"))
    out = plain.join(listed, "query_id").join(sources(items), "query_id", "left")
    if model is not None:
        asked = prompts(parsed, items, **options).select("query_id", postprocessed(model(F.col("prompt"))).alias("said"))
        out = out.join(asked, "query_id").join(model_confidence(items).withColumnRenamed("confidence", "model_confidence"), "query_id", "left")
        out = out.withColumn("answer", F.when(F.col("is_direct"), F.col("answer")).otherwise(F.col("said"))).withColumn("confidence", F.when(F.col("is_direct"), F.col("confidence")).otherwise(F.coalesce("model_confidence", F.lit(0.5))))
    return out.select("query_id", "type", "answer", "confidence", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "is_direct", (~F.col("is_direct")).alias("is_model"))


def should_stop(text: Column, stops: Column) -> Column:
    """Whether a text ends with one of the stop sequences."""
    return F.exists(stops, lambda s: (s != "") & F.endswith(text, s))
