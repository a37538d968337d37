"""Reading the input tables, the shared scratch folder, and intermediate tables that cut lineage."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts that are sent to a Python worker at once, at most; a session that asks for fewer gets fewer.
BATCH_ROWS = 512
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset and all runs on this machine, as in
    tests, a temp folder; on a cluster that would be a folder which others cannot see, so there it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor takes nothing with it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_first(docs: DataFrame, text: str, keep: tuple, added: tuple) -> DataFrame:
    """The column ``text``, under a name that no other has, and the columns ``keep`` without those named like ``added`` ones."""
    kept, name = [c for c in keep if c not in added], "text"
    while name in (*kept, *added):
        name += "_"
    return docs.select(docs[f"`{text}`"].alias(name), *(docs[f"`{c}`"] for c in kept))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Python workers batches of at most ``BATCH_ROWS`` rows: texts may be long."""
    conf = df.sparkSession.conf
    asked = int(conf.get(_BATCH_CONF))
    if not 0 < asked <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return a worker's freed memory to the system: workers stay for later tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def make_room() -> None:
    """Drop the token caches that tasks of another operator have left in this worker, where there are any."""
    held = sys.modules.get(f"{__package__}.tokenids")
    if held is not None and held._ENCODERS:
        held._ENCODERS.clear()
        give_back()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; one that is gone already is fine."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files that a ``cut`` DataFrame reads, once nothing needs them."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/graphloom/" in path:
            drop_path(spark, path)
