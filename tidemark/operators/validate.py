"""Command validation: bad commands become error rows and never change state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kv import valid_op


def classify(log: DataFrame) -> DataFrame:
    """Adds ``status``: ok, bad_payload (no key) or unknown_op."""
    status = F.when(F.col("k").isNull(), "bad_payload").when(~valid_op(F.col("op")), "unknown_op").otherwise("ok")
    return log.withColumn("status", status)


def split(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, errors)."""
    c = classify(log)
    return c.where("status = 'ok'").drop("status"), c.where("status <> 'ok'")
