"""Sessions and their messages, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import mapped

#: Messages that a session keeps; older ones go.
KEPT = 20
#: Messages that are looked through for what a pronoun means.
CONTEXT = 5
# The first message of a session, and the pronouns.
WELCOME = "欢迎使用知识图谱问答系统！"
PRONOUNS = ("它", "他", "她", "这个")


def create_sessions(users: DataFrame) -> DataFrame:
    """Messages (session_id, seq, role, content) that open a session for each user (user_id, session_id or null)."""
    made = F.coalesce("session_id", F.concat(F.lit("session_"), F.substring(F.sha2(F.col("user_id"), 256), 1, 12)))
    return users.select(made.alias("session_id")).distinct().select("session_id", F.lit(0).alias("seq"), F.lit("SYSTEM").alias("role"), F.lit(WELCOME).alias("content"))


def append(messages: DataFrame, new: DataFrame) -> DataFrame:
    """New messages (session_id, nth, role, content) after the last ones of their sessions; those of unknown sessions are left out."""
    last = messages.groupBy("session_id").agg(F.max("seq").alias("last"))
    order = Window.partitionBy("session_id").orderBy("nth")
    placed = new.join(last, "session_id").withColumn("seq", (F.col("last") + F.row_number().over(order)).cast("int"))
    return messages.select("session_id", "seq", "role", "content").unionByName(placed.select("session_id", "seq", "role", "content"))


def history(messages: DataFrame, most: int = 0, kept: int = KEPT) -> DataFrame:
    """The last ``most`` messages of each session (0: all of the ``kept`` ones)."""
    n = min(most, kept) if most else kept
    order = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return messages.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def clear(messages: DataFrame, session_ids: DataFrame) -> DataFrame:
    return messages.join(session_ids.select("session_id").distinct(), "session_id", "left_anti")


def session_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("seq").alias("last_seq"))


def active_sessions(messages: DataFrame) -> DataFrame:
    return messages.agg(F.countDistinct("session_id").alias("n_sessions"))


def attributes(writes: DataFrame) -> DataFrame:
    """session_id, key, value of what was written last for each key of (session_id, seq, key, value)."""
    return writes.groupBy("session_id", "key").agg(F.max_by("value", "seq").alias("value"))


def attribute(writes: DataFrame, key: str) -> DataFrame:
    """session_id and the value of a key; empty where it was never set."""
    set_ = attributes(writes.filter(F.col("key") == key)).select("session_id", "value")
    return writes.select("session_id").distinct().join(set_, "session_id", "left").select("session_id", F.coalesce("value", F.lit("")).alias("value"))


def in_context(questions: DataFrame, messages: DataFrame, entities: DataFrame) -> DataFrame:
    """Questions (query_id, session_id, text, ...) and last_entity: for one with a pronoun, the name of an entity that the last
    messages of its session hold, the latest one; of several in a message the longest."""
    recent = history(messages, CONTEXT)
    words = recent.select("session_id", "seq", F.explode(F.array_distinct(F.split("content", r"[\s，。？！,.?!]+"))).alias("name"))
    named = words.join(entities.select("name").distinct(), "name")
    last = named.groupBy("session_id").agg(F.max(F.struct("seq", F.char_length("name").alias("n"), "name")).alias("m")).select("session_id", F.col("m.name").alias("found"))
    pronoun = None
    for p in PRONOUNS:
        pronoun = F.col("text").contains(p) if pronoun is None else pronoun | F.col("text").contains(p)
    return questions.join(last, "session_id", "left").withColumn("last_entity", F.when(pronoun, F.col("found"))).drop("found")


def feedback(spark: SparkSession, query_id: str, helpful: bool, comment: str = "") -> DataFrame:
    """A row for the feedback table."""
    return spark.createDataFrame([(query_id, helpful, comment)], "query_id string, helpful boolean, comment string")


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Messages from (conv_id, turn, role, text)."""
    role = mapped(F.col("role"), {"user": "USER", "assistant": "ASSISTANT", "system": "SYSTEM"}, "USER")
    return conversations.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("seq"), role.alias("role"), F.col("text").alias("content"))
