"""The changelog source: events mapped to puts and deletes with a total sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import DELETE, PUT
from tidemark.session import table

RUN_LENGTH = 100


def from_events(events: DataFrame, run_length: int = RUN_LENGTH) -> DataFrame:
    """(seq, op, k, v, run_id): an ``error`` event deletes the user's key, any other puts its props."""
    gone = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(gone, F.lit(DELETE)).otherwise(F.lit(PUT)).alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("k"),
        F.when(~gone, F.col("props")).alias("v"),
        F.expr(f"event_id div {run_length}").alias("run_id"),
    )


def read_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))
