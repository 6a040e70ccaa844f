"""Operator 10: token ids as flat unsigned integer files with 64-bit document offsets.

A range shuffle puts documents in ascending ``doc_id`` order over partitions.
Each task streams its partition into three files in the shared folder:
``.ids`` (unsigned, 16 bits where the vocabulary allows, else 32), ``.offsets``
(unsigned 64-bit, documents + 1, in ids) and ``.docs`` (64-bit ids). A file
appears by rename, so a retried task replaces its own output. One manifest row
per partition gives, by prefix sums, each partition's base. Reading maps the
files into memory (local or mounted folders); in stores that cannot be mapped a
task reads offsets and ids of a batch of documents at a time, through Arrow's file
systems (``file``, ``hdfs``, ``s3``, ``gs`` and ``abfs`` paths).

Edge cases: a null text is empty and holds only the end id; a null ``doc_id``
sorts first and comes back null; repeated rows each have their own entry, equal
ids ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_task, save, texts
from tidemark.llm.word_table import WordTable
from tidemark.session import scratch_path

END_ID = 1
NULL_ID = -(2**63)
MANIFEST = "part long, n_docs long, n_ids long, stem string, width int"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def crc_u32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files below ``folder`` (a URI) and return the saved manifest, one row per non-empty partition."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fs, root = None, None, None
        part, n, ends, names, streams = TaskContext.get().partitionId(), 0, [0], [], {}
        mark = uuid.uuid4().hex
        for b in batches:
            if b.num_rows == 0:
                continue
            if table is None:
                table = WordTable.load(tokenizer)
                fs, root = _fs(folder)
                fs.create_dir(root, recursive=True)
                streams = {x: fs.open_output_stream(f"{root}/.{part:06d}.{mark}.{x}") for x in ("ids", "offsets", "docs")}
                streams["offsets"].write(np.zeros(1, "<u8").tobytes())
                end = end_id.to_bytes(table.width, "little")
            ends, rows = [], []
            for text in b.column("text").to_pylist():
                packed = table.packed(text) + end
                n += len(packed) // table.width
                ends.append(n)
                rows.append(packed)
            streams["ids"].write(b"".join(rows))
            streams["offsets"].write(np.array(ends, "<u8").tobytes())
            ids = [NULL_ID if i is None else i for i in b.column("doc_id").to_pylist()]
            streams["docs"].write(np.array(ids, "<i8").tobytes())
            names.append(b.num_rows)
        if table is not None:
            for x, s in streams.items():
                s.close()
                fs.move(f"{root}/.{part:06d}.{mark}.{x}", f"{root}/part-{part:06d}.{x}")
            row = [[part], [sum(names)], [n], [f"part-{part:06d}"], [table.width]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=["part", "n_docs", "n_ids", "stem", "width"])

    # rows of one id (or none) are dealt by the beginnings of their texts
    ordered = texts(docs).repartitionByRange(F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return save(ordered.mapInArrow(arrow_task(write, tables=True), MANIFEST), "token-manifest")


class _Flat:
    """A flat file of numbers: mapped where it is local, else read by ranges."""

    def __init__(self, folder: str, name: str, dtype: str):
        from pyarrow.fs import LocalFileSystem

        fs, root = _fs(folder)
        self.dtype, path = np.dtype(dtype), f"{root}/{name}"
        self.map = np.memmap(path, dtype=dtype, mode="r") if isinstance(fs, LocalFileSystem) else None
        self.file = None if self.map is not None else fs.open_input_file(path)
        self.size = len(self.map) if self.file is None else self.file.size() // self.dtype.itemsize

    def range(self, a: int, z: int) -> np.ndarray:
        if self.file is None:
            return self.map[a:z]
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((z - a) * w, a * w), self.dtype)


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame, rows_per_batch: int = 1000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; ``start`` counts the ids of all documents before."""
    parts, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # one row per partition
        parts.append((r["stem"], r["width"], base))
        base += r["n_ids"]
    plan = spark.createDataFrame(parts, "stem string, width int, base long").repartition(max(1, len(parts)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                off, docs, ids = (_Flat(folder, f"{r['stem']}.{x}", t) for x, t in (("offsets", "<u8"), ("docs", "<i8"), ("ids", f"<u{r['width']}")))
                for i in range(0, docs.size, rows_per_batch):
                    d = docs.range(i, min(i + rows_per_batch, docs.size))
                    o = off.range(i, i + len(d) + 1).astype(np.int64)
                    own = ids.range(int(o[0]), int(o[-1]))
                    crc = [crc_u32(own[a:z]) for a, z in zip(o[:-1] - o[0], o[1:] - o[0], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64(), mask=d == NULL_ID), pa.array(o[:-1] + r["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(arrow_task(read), DIGEST)


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the corpus as token files and read every document back."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    return read_digests(spark, folder, write_files(docs, folder, tokenizer))
