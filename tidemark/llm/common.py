"""What the operators share: clean input columns, saved intermediate tables, a wrapper for Arrow batches."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path


#: Rows of a batch of texts, and what sets them: those sent to a Python worker, and those that the Parquet reader decodes at once.
ARROW_ROWS = 1000
BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def frugal(docs: DataFrame) -> DataFrame:
    """``docs``, once its session reads and sends to a Python worker at most ``ARROW_ROWS`` rows at a time: a batch of whole texts is held by the reader and by both sides, several times over."""
    conf = docs.sparkSession.conf
    for k in BATCHES:
        if not 0 < int(conf.get(k)) <= ARROW_ROWS:
            conf.set(k, str(ARROW_ROWS))
    return docs


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) of any documents frame; a null text is empty. Other columns never reach an operator, so their names cannot clash."""
    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLES: dict[str, object] = {}


def worker_table(name: str, make: Callable[[], object]) -> object:
    """The table that this worker keeps between tasks under ``name``; any other is let go, so that a worker holds one at a time."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = make()
    return _TABLES[name]


def _held() -> list[str]:
    return list(_TABLES)


def drop_tables() -> None:
    """Let all tables go. (A function, so that tasks reach the worker's own dictionary and not a copy of the driver's.)"""
    _TABLES.clear()


def release() -> None:
    """Give freed memory back to the system: Python workers wait for more tasks, and what they hold counts beside the executor."""
    for t in _TABLES.values():
        t.trim()
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc:
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None)
        if trim:
            trim(0)


def arrow_task(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tables: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for ``mapInArrow``, with its freed memory released when the task ends. Unless it uses ``tables``, those of other tasks are let go and given back first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables and _held():
            drop_tables()
            release()
        try:
            yield from f(batches)
        finally:
            release()

    return run


def per_batch(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``f`` (columns as lists, to columns as lists) to each Arrow batch; memory is one batch."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    return df.mapInArrow(arrow_task(run, tables=True), schema)
