"""Intermediate tables in the folder that driver and executors share: lineage ends there, and nothing is lost with an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that are broadcast; more of them are joined by sorting.
FEW_ROWS = 100_000
#: Rows without texts that a task gets where they are dealt out by a key.
TASK_ROWS = 1_000_000
#: Rows that a Python worker holds at once where they are texts.
BATCH_ROWS = 256
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it is unset and all runs on this machine, a new temp folder, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written below the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Python workers batches of at most ``BATCH_ROWS`` rows: texts, and the tokens that come
    of them, may be long, and a worker holds a whole batch of both."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def few(keys: DataFrame, name: str = "keys") -> DataFrame:
    """The distinct rows of a narrow table, written and counted: a join with them broadcasts them while they are few. What is joined
    with them is then read once and not sorted; the optimizer alone cannot know that a table made of joins or of rows is small."""
    out = cut(keys.distinct(), name)
    return F.broadcast(out) if out.count() <= FEW_ROWS else out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a key, over the session's number of tasks and over more where that would be over ``TASK_ROWS`` rows for
    each. The rows are counted first. Aggregates and joins by the key find them in place."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, key)
