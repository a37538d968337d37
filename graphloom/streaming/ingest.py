"""Incremental ingestion: event windows with a watermark, and documents cleaned and cut as they arrive."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks, text


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """event_type, starts, n, value for tumbling windows of a stream (or table) of (ts, event_type, value); later rows than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return counted.select("event_type", F.col("w.start").alias("starts"), "n", "value")


def cleaned_chunks(docs: DataFrame, splitter: Callable = chunks.sentence_chunks) -> DataFrame:
    """doc_id, idx, chunk of a stream (or table) of (doc_id, text); stateless, so it runs as it is on either."""
    return docs.select("doc_id", F.posexplode(splitter(text.Cleaner("structured")(F.col("text")))).alias("idx", "chunk"))


def run_available(stream: DataFrame, mode: str = "complete", path: str | None = None) -> DataFrame:
    """What a stream gives for the rows that are there now, as a table: in append mode all that it wrote, else its last state.

    Each batch is written as files below ``path`` (by default a new folder in ``spark.checkpoint.dir``), so the result is never
    gathered on the driver. A batch that is run again writes its folder anew.
    """
    spark = stream.sparkSession
    path = path or f"{_shared(spark)}/graphloom/stream-{uuid.uuid4().hex}"
    seen: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        seen.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(seen)) if mode == "append" else sorted(set(seen))[-1:]
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch={n}" for n in wanted])


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="graphloom-")
