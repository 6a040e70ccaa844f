"""Scalar rules shared by every operator, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import DELETE, PUT

#: Fixed values of the file layouts, in bytes.
WAL_HEADER = 20
RUN_RECORD_HEADER = 8
INDEX_ENTRY_HEADER = 12
BLOOM_LENGTH_FIELD = 4
INDEX_COUNT_FIELD = 4
RUN_FOOTER = 16
INDEX_STEP = 1024
BLOOM_BITS_PER_KEY = 10
BLOOM_MIN_KEYS = 64
BLOOM_PROBES = 7
MEMTABLE_LIMIT = 4 * 1024 * 1024
COMPACTION_FAN_IN = 4
#: Upper bounds of size tiers 0..3; larger is tier 4.
TIER_BOUNDS = (10 << 20, 50 << 20, 250 << 20, 1024 << 20)


def byte_len(c: Column) -> Column:
    """Bytes of a string or binary column; null counts as 0."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def is_tombstone(op: Column, value: Column) -> Column:
    """A delete, a null value or an empty value; never null itself."""
    return F.coalesce(op == F.lit(DELETE), F.lit(False)) | value.isNull() | (byte_len(value) == 0)


def entry_crc(key: Column, value: Column) -> Column:
    """CRC-32 (IEEE) over key then value, as the log stores it."""
    empty = F.lit(b"")
    return F.crc32(F.concat(F.coalesce(key.cast("binary"), empty), F.coalesce(value.cast("binary"), empty)))


def valid_op(op: Column) -> Column:
    return F.coalesce(op.isin(PUT, DELETE), F.lit(False))


def size_tier(n: Column, bounds: tuple[int, ...] = TIER_BOUNDS) -> Column:
    """0 for the smallest files up to ``len(bounds)`` for the largest."""
    out = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        out = F.when(n < F.lit(bounds[i]), F.lit(i)).otherwise(out)
    return out.cast("int")


def leader_address(addr: Column, shift: int = 1000) -> Column:
    """``host:port`` with the client port (raft port + shift); null where the address is empty or malformed."""
    host, port = F.split_part(addr, F.lit(":"), F.lit(1)), F.split_part(addr, F.lit(":"), F.lit(2))
    p = port.try_cast("int")
    ok = addr.rlike(r"^[^:]+:[0-9]{1,5}$")
    return F.when(ok, F.concat(host, F.lit(":"), (p + shift).cast("string")))


def bloom_bits(n: Column) -> Column:
    """Bit length of the filter for ``n`` keys: 10 per key, 64 keys at least, whole bytes."""
    bits = F.greatest(n.cast("long"), F.lit(BLOOM_MIN_KEYS).cast("long")) * BLOOM_BITS_PER_KEY
    return (F.ceil(bits / F.lit(8.0)) * 8).cast("long")
