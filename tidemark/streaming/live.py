"""Structured Streaming: the changelog applied continuously, flushed as runs, and measured in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.store import KVStore
from tidemark.sources.changelog import from_events


def stream_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Event files arriving in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def live_table(log: DataFrame) -> DataFrame:
    """Streaming last-writer-wins; state is one newest version per key, the live key space."""
    newest = log.groupBy("k").agg(F.max_by(F.struct("op", "v", "seq"), "seq").alias("w"))
    return newest.select("k", "w.op", "w.v", "w.seq")


def flush_to_store(events: DataFrame, store: KVStore, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes one run; a replayed batch id is recognised and skipped (exactly once)."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        store.apply(from_events(batch), batch_id)

    return events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_throughput(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(minute, method, n) per event-time window, with late rows accepted up to ``late``."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = stamped.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("method")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("minute"), "method", "n")
