"""Run accounting and layout: what a flush writes, and the proof that it wrote it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.kv import BLOOM_LENGTH_FIELD, INDEX_COUNT_FIELD, INDEX_STEP, RUN_FOOTER, RUN_RECORD_HEADER, WAL_HEADER, bloom_bits, byte_len
from tidemark.operators.resolve import lww


def run_entries(log: DataFrame) -> DataFrame:
    """One version per key per run."""
    return lww(log, by=("run_id", "k"))


def memtable_accounting(log: DataFrame) -> DataFrame:
    """(run_id, n_keys, n_bytes): distinct keys and the key and value bytes of their newest versions."""
    return run_entries(log).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(byte_len(F.col("k")) + byte_len(F.col("v"))).alias("n_bytes"))


def flush_verify(log: DataFrame, written: DataFrame) -> DataFrame:
    """(run_id, expected, actual, ok): distinct keys of the log against rows of the written runs."""
    e = log.select("run_id", "k").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("expected"))
    a = written.groupBy("run_id").agg(F.count(F.lit(1)).alias("actual"))
    j = e.join(a, "run_id", "full_outer").na.fill(0, ["expected", "actual"])
    return j.withColumn("ok", F.col("expected") == F.col("actual"))


def wal_bytes(log: DataFrame) -> DataFrame:
    """(run_id, n_bytes) of the log records of each run."""
    return log.groupBy("run_id").agg(F.sum(F.lit(WAL_HEADER) + byte_len(F.col("k")) + byte_len(F.col("v"))).cast("long").alias("n_bytes"))


def layout_bytes(log: DataFrame) -> DataFrame:
    """(run_id, data_bytes, bloom_bytes, fixed_bytes): the run file's size but for its index entries."""
    n = F.sum(RUN_RECORD_HEADER + byte_len(F.col("k")) + byte_len(F.col("v"))).cast("long")
    g = run_entries(log).groupBy("run_id").agg(n.alias("data_bytes"), F.count(F.lit(1)).alias("n"))
    return g.select("run_id", "data_bytes", (bloom_bits(F.col("n")) / 8).cast("long").alias("bloom_bytes"), F.lit(BLOOM_LENGTH_FIELD + INDEX_COUNT_FIELD + RUN_FOOTER).cast("long").alias("fixed_bytes"))


def sparse_index(log: DataFrame, step: int = INDEX_STEP) -> DataFrame:
    """(run_id, k, offset): an entry at the first record and then at the first record ``step`` bytes past the last entry.

    The state resets at each entry, so a run's records are walked in key order, as
    its file is written. They stream through in batches: memory does not grow with
    the run, merged ones included.
    """
    sized = run_entries(log).select("run_id", "k", (RUN_RECORD_HEADER + byte_len(F.col("k")) + byte_len(F.col("v"))).alias("n"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, pos, last = None, 0, 0
        for b in batches:
            runs, n = b.column("run_id").to_numpy(), b.column("n").to_numpy()
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)] if len(runs) else []
            at, offsets = [], []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if runs[a] != run:
                    run, pos, last = runs[a], 0, -step
                starts = pos + np.cumsum(n[a:z]) - n[a:z]
                i = int(np.searchsorted(starts, last + step))
                while i < z - a:
                    last = int(starts[i])
                    at.append(a + i)
                    offsets.append(last)
                    i = int(np.searchsorted(starts, last + step))
                pos += int(n[a:z].sum())
            picked = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("run_id").take(picked), b.column("k").take(picked), pa.array(offsets, pa.int64())], names=["run_id", "k", "offset"])

    return sized.repartition("run_id").sortWithinPartitions("run_id", "k").mapInArrow(walk, "run_id long, k string, offset long")


def recover_prefix(records: DataFrame, by: str = "run_id", order: str = "seq") -> DataFrame:
    """The records of each log before its first bad one (column ``ok``)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("_bad", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w)).where("_bad = 0").drop("_bad")


def high_water(records: DataFrame, by: str = "run_id", order: str = "seq") -> DataFrame:
    """Running maximum of the sequence within each log."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("high", F.max("seq").over(w))
