"""What a cache of a policy would hold and hit, replayed over a log of accesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is evicted last, by policy: the columns that rank an item.
POLICIES = {"LRU": ("last",), "LFU": ("hits", "last"), "FIFO": ("first",), "PRIORITY": ("priority", "last"), "WEIGHTED": ("weight", "last")}


def hit_rates(log: DataFrame, ttl: Column | None = None, by: tuple = ("tier",)) -> DataFrame:
    """accesses, hits, hit_rate of (key, at, tier): an access hits if its key was accessed within ``ttl`` before (null: ever)."""
    before = F.lag("at").over(Window.partitionBy(*by, "key").orderBy("at", "access_id"))
    hit = before.isNotNull() if ttl is None else F.coalesce(F.col("at") <= before + ttl, F.lit(False))
    counted = log.withColumn("hit", hit.cast("long")).groupBy(*by).agg(F.count("*").alias("accesses"), F.sum("hit").alias("hits"))
    return counted.withColumn("hit_rate", F.round(F.col("hits") / F.col("accesses"), 6))


def held(log: DataFrame, size: int, policy: str = "LRU", by: tuple = ("tier",)) -> DataFrame:
    """tier, key, rank of the ``size`` items that a cache of the policy would keep at the end of the log."""
    items = log.groupBy(*by, "key").agg(F.max("at").alias("last"), F.min("at").alias("first"), F.count("*").alias("hits"), F.max("priority").alias("priority"), F.max("weight").alias("weight"))
    order = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in POLICIES[policy]], "key")
    return items.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select(*by, "key", "rank")
