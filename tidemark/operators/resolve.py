"""Last-writer-wins resolution: the engine's core operator.

One shuffle on the key with map-side partial aggregation: each task first keeps
one newest version per key, so a key with a third of all rows sends one row per
task. Order is always by ``seq``, never by file or arrival.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kv import is_tombstone


def lww(log: DataFrame, by: tuple[str, ...] = ("k",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Newest (op, v, seq) per ``by``; tombstones are kept."""
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return log.groupBy(*by).agg(F.max_by(F.struct("op", "v", "seq"), rank).alias("w")).select(*by, "w.op", "w.v", "w.seq")


def drop_tombstones(state: DataFrame) -> DataFrame:
    return state.where(~is_tombstone(F.col("op"), F.col("v")))


def scan_all(log: DataFrame, max_seq: int | Column | None = None) -> DataFrame:
    """Live (k, v) as of ``max_seq`` (all of the log when None)."""
    seen = log if max_seq is None else log.where(F.col("seq") <= max_seq)
    return drop_tombstones(lww(seen)).select("k", "v")


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """k-way merge of runs given oldest first; the newest run wins, tombstones stay."""
    tagged = [r.withColumn("_age", F.lit(i)) for i, r in enumerate(runs)]
    return lww(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), order=("_age", "seq"))


def merge_log_runs(log: DataFrame, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """The same merge when runs are one frame with a ``run_id``: order by run, then sequence."""
    return lww(log, by=by, order=("run_id", "seq"))


def version_counts(log: DataFrame) -> DataFrame:
    """Versions and deletes per key."""
    gone = is_tombstone(F.col("op"), F.col("v"))
    return log.groupBy("k").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(gone).alias("n_deletes"))
