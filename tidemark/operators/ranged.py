"""Ordered work without one task per key: rows are dealt by range, and what a range needs from the ranges before it is carried over.

A key with a third of all rows spans many ranges, so sequence logic (state
changes, as-of lookups) on it is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_part``, its place among ranges of ``order``; saved, so that the ranges stay as they are.

    Rows that are equal in ``order`` share a range.
    """
    path = scratch_path(df.sparkSession, "ranged")
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def carried(df: DataFrame, key: str, order: tuple[str, ...], value: Column, name: str, when: Column | None = None) -> DataFrame:
    """Adds ``name``: ``value`` of the key's last earlier row (or last up to and including this one with ``when``, of rows that fulfil it).

    ``df`` comes from ``ranged`` by ``key`` and ``order``. One row per key and
    range is sorted beside the rows themselves: that is at most keys + ranges rows.
    """
    rank = F.struct(*order)
    v = F.struct(value.alias("v"))  # a null value is a value
    fits = F.lit(True) if when is None else when
    lasts = df.where(fits).groupBy(key, "_part").agg(F.max_by(v, rank).alias("_last"))
    parts = df.select(key, "_part").distinct().join(lasts, [key, "_part"], "left")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    opening = parts.select(key, "_part", F.last("_last", ignorenulls=True).over(before).alias("_open"))
    w = Window.partitionBy(key, "_part").orderBy(*order)
    own = w.rowsBetween(Window.unboundedPreceding, -1 if when is None else Window.currentRow)
    j = df.join(opening, [key, "_part"]).withColumn("_seen", F.last(F.when(fits, v), ignorenulls=True).over(own))
    return j.withColumn(name, F.coalesce("_seen", "_open")["v"]).drop("_seen", "_open")
