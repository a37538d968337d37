"""A round of questions in their sessions: context, parsing, search, answers, and what the sessions remember."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers, dialogue, questions, search
from .graph import Graph
from .scratch import cut

# Fixed value: what a question of an unknown session is told.
UNKNOWN_SESSION = "系统错误：无效的会话标识"


@dataclass(frozen=True)
class Config:
    """How questions are searched for and answered."""

    strategy: str = "HYBRID"
    min_confidence: float = 0.2
    max_results: int = 10
    use_history: bool = True
    model: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Round:
    """answers: query_id, session_id, type, answer, confidence, sources. messages and attributes: those before and the new ones."""

    answers: DataFrame
    messages: DataFrame
    attributes: DataFrame


def _in_sessions(asked: DataFrame) -> DataFrame:
    """Questions with their session; those without one get a session of their own, named by their id."""
    own = F.concat(F.lit("session_"), F.substring(F.sha2(F.concat(F.lit("anonymous#"), F.col("query_id").cast("string")), 256), 1, 12))
    new = F.coalesce(F.col("session_id"), F.lit("")) == ""
    return asked.select("query_id", F.when(new, own).otherwise(F.col("session_id")).alias("session_id"), new.alias("opens"), "text")


def process(graph: Graph, messages: DataFrame, attributes: DataFrame, asked: DataFrame, config: Config = Config()) -> Round:
    """Answer ``asked`` (query_id, session_id or null, text), at most one question of each session, and write the sessions on.

    ``messages`` has session_id, seq, role and content, ``attributes`` session_id, seq, key and value; other columns of the three
    are ignored. A question becomes a USER message and its answer an ASSISTANT one after the session's last; the attributes
    last_query_id, last_query_type and last_confidence are set. A question with a pronoun that names no entity is
    asked for the one that its session named last. A session that ``messages`` does not know gets an error for an answer and remembers nothing. Null texts
    are questions without words. Both tables of new rows are written to the shared folder once.
    """
    rows = _in_sessions(asked)
    opened = dialogue.create_sessions(rows.filter("opens").select(F.col("query_id").cast("string").alias("user_id"), "session_id"))
    before = messages.select("session_id", "seq", "role", "content").unionByName(opened)
    known = before.select("session_id").distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "session_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    said = dialogue.append(before, rows.filter("known").select("session_id", F.col("query_id").alias("nth"), F.lit("USER").alias("role"), F.col("text").alias("content")))
    parsed = questions.parse(rows.filter("known").select("query_id", "text"))
    if config.use_history:
        named = questions.link_entities(parsed, graph.entities).filter("confidence > 0").select("query_id").distinct().withColumn("named", F.lit(True))
        context = dialogue.in_context(rows.filter("known").select("query_id", "session_id", "text"), before, graph.entities).select("query_id", "last_entity")
        meant = F.when(F.col("last_entity").isNotNull() & F.col("named").isNull(), F.array_prepend("entities", questions.normalised(F.col("last_entity"))))
        parsed = parsed.join(context, "query_id", "left").join(named, "query_id", "left").withColumn("entities", F.coalesce(meant, "entities")).drop("last_entity", "named")
    found = search.search(graph, parsed, questions.link_entities(parsed, graph.entities), config.strategy, config.min_confidence, 0, config.max_results)
    told = answers.generate(parsed, found, model=config.model).join(rows.select("query_id", "session_id"), "query_id")
    refused = rows.filter("not known").select("query_id", F.lit("UNKNOWN").alias("type"), F.lit(UNKNOWN_SESSION).alias("answer"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("sources"), F.lit(True).alias("is_direct"), F.lit(False).alias("is_model"), "session_id")
    told = cut(told.unionByName(refused), "answers")
    right = told.filter(F.col("answer") != UNKNOWN_SESSION)
    after = cut(dialogue.append(said, right.select("session_id", F.col("query_id").alias("nth"), F.lit("ASSISTANT").alias("role"), F.col("answer").alias("content"))), "messages")
    last = after.groupBy("session_id").agg(F.max("seq").alias("seq"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("last_query_id", F.col("query_id").cast("string")), ("last_query_type", F.col("type")), ("last_confidence", F.col("confidence").cast("string")))])
    written = right.join(last, "session_id").select("session_id", "seq", F.explode(pairs).alias("x")).select("session_id", "seq", "x.*")
    return Round(told, after, attributes.select("session_id", "seq", "key", "value").unionByName(written))


def set_feedback(attributes: DataFrame, feedback: DataFrame) -> DataFrame:
    """Attributes with what users said (session_id, query_id, feedback) of answers, under ``feedback_`` and the question's id."""
    last = attributes.groupBy("session_id").agg(F.max("seq").alias("seq"))
    rows = feedback.join(last, "session_id", "left").select("session_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.concat(F.lit("feedback_"), F.col("query_id").cast("string")).alias("key"), F.col("feedback").alias("value"))
    return attributes.select("session_id", "seq", "key", "value").unionByName(rows)


def close_sessions(round_: Round, session_ids: DataFrame) -> Round:
    """The round without all that the named sessions remember."""
    return Round(round_.answers, dialogue.clear(round_.messages, session_ids), dialogue.clear(round_.attributes, session_ids))
