"""Declared schemas of the engine's tables (wire types of the data model)."""

from pyspark.sql import types as T

PUT, DELETE = "PUT", "DELETE"

CHANGELOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("run_id", T.LongType()),
    ]
)
RUN_ENTRY = "run_id long, key binary, value binary"
WAL_RECORD = "wal_file string, offset long, seq long, key binary, value binary, crc long, ok boolean"
SPARSE_INDEX = "run_id long, key string, offset long"
REPLICA = "node string, role string, applied_seq long"
