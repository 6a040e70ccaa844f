"""Point and bulk lookups over the changelog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kv import is_tombstone
from tidemark.operators.ranged import carried, ranged
from tidemark.operators.resolve import lww
from tidemark.session import broadcast_if_small


def get_point(log: DataFrame, key: str) -> DataFrame:
    """(k, found, v), one row; the key filter reaches the scan."""
    one = log.where(F.col("k") == key).agg(F.max_by(F.struct("op", "v"), "seq").alias("w"))
    found = F.col("w").isNotNull() & ~is_tombstone(F.col("w.op"), F.col("w.v"))
    return one.select(F.lit(key).alias("k"), found.alias("found"), F.when(found, F.col("w.v")).alias("v"))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, reason, v) for each distinct key asked: found, tombstone or absent.

    Keys that nobody asked for are removed before resolution by a semi join,
    broadcast only when the asked keys are counted as few. Null keys are absent.
    """
    asked = keys.select("k").distinct()
    small = broadcast_if_small(asked)
    state = lww(log.join(small, "k", "left_semi"))
    gone = is_tombstone(F.col("op"), F.col("v"))
    reason = F.when(F.col("seq").isNull(), "absent").when(gone, "tombstone").otherwise("found")
    return asked.join(state, "k", "left").select("k", reason.alias("reason"), F.when(reason == "found", F.col("v")).alias("v"))


def read_amplification(log: DataFrame) -> DataFrame:
    """(k, runs_searched): runs a newest-first search opens before it meets the key."""
    newest = log.agg(F.max("run_id")).scalar()
    return log.groupBy("k").agg(F.max("run_id").alias("hit")).select("k", (newest - F.col("hit") + 1).alias("runs_searched"))


def index_seek(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(run_id, k, offset): greatest indexed key not above the probe in its run; 0 when below all.

    ``probes`` are (run_id, k), such as the pairs that the runs' filters admit.
    The as-of lookup sorts entries and probes together by ranges of (run_id, k)
    and carries the last offset over ranges, so neither a range join nor a task
    per run is needed.
    """
    e = index.select("run_id", "k", "offset", F.lit(0).alias("side"))
    p = probes.select("run_id", "k", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("side")).distinct()
    own = carried(ranged(e.unionByName(p), "run_id", "k", "side"), "run_id", ("k", "side"), F.col("offset"), "at", F.col("side") == 0)
    return own.where("side = 1").select("run_id", "k", F.coalesce("at", F.lit(0)).cast("long").alias("offset"))
