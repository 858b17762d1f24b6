"""Structured Streaming: windows over events, and incremental maintenance of an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.runtime import work_dir


def _marked(events: DataFrame, time_col: str, late: str | None) -> DataFrame:
    """With a watermark, unless ``late`` is None because one was set before (a stream may have only one)."""
    return events if late is None else events.withWatermark(time_col, late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours", time_col: str = "ts") -> DataFrame:
    """(window_start, event_type, n, total): counts of fixed windows; rows later than ``late`` are dropped in a stream."""
    w = F.window(time_col, width)
    return _marked(events, time_col, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = "2 hours", time_col: str = "ts") -> DataFrame:
    w = F.window(time_col, width, step)
    return _marked(events, time_col, late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours", key: str = "user_id", time_col: str = "ts") -> DataFrame:
    """(key, session_start, session_end, n): runs of events of one key closer than ``gap``."""
    w = F.session_window(time_col, gap)
    return _marked(events, time_col, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, late: str | None = "2 hours", key: str = "event_id", time_col: str = "ts") -> DataFrame:
    return _marked(events, time_col, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there now, and read its result table back."""
    import uuid

    spark = stream.sparkSession
    base = f"{work_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    return spark.read.schema(stream.schema).parquet(f"{base}/out/{last}")


def maintain(spark: SparkSession, folder: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Watch a folder of change files (Parquet) and apply each batch once; with ``every`` it polls, else it ends when done.

    The checkpoint makes batches exactly once if ``apply`` writes by key or by batch number.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
