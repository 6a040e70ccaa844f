"""Size-tiered compaction: choose contiguous runs of one tier, merge them, publish a new manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.kv import COMPACTION_FAN_IN, TIER_BOUNDS, size_tier
from tidemark.operators.resolve import drop_tombstones, lww


def tiers(stats: DataFrame, size: str = "n_bytes", bounds: tuple[int, ...] = TIER_BOUNDS) -> DataFrame:
    """Adds ``tier``."""
    return stats.withColumn("tier", size_tier(F.col(size), bounds))


def pick(stats: DataFrame, fan_in: int = COMPACTION_FAN_IN) -> DataFrame:
    """(run_id, tier, pos): the first ``fan_in`` runs of the oldest island of neighbours in one tier.

    ``stats`` has one row per run, so the global row number sorts a manifest, not data.
    """
    age = Window.orderBy("run_id")
    seen = stats.select("run_id", "tier").withColumn("i", F.row_number().over(age))
    island = seen.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("tier").orderBy("run_id")))
    w = Window.partitionBy("tier", "g")
    sized = island.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("pos", F.row_number().over(w.orderBy("run_id"))).withColumn("start", F.min("i").over(w))
    full = sized.where((F.col("n") >= fan_in) & (F.col("pos") <= fan_in))
    return full.withColumn("first", F.min("start").over(Window.partitionBy())).where("start = first").select("run_id", "tier", F.col("pos").cast("int").alias("pos"))


def compact(entries: DataFrame, chosen: list[int], new_run: int, drop_deleted: bool = False) -> DataFrame:
    """Entries of the merged run, newest by sequence: a run may hold older records than the run before it.

    ``drop_deleted`` is only safe when no other run holds an older record of a deleted key.
    """
    merged = lww(entries.where(F.col("run_id").isin(chosen)))
    kept = drop_tombstones(merged) if drop_deleted else merged
    return kept.withColumn("run_id", F.lit(new_run).cast("long")).sort("k")
