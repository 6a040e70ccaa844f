"""Bloom filters as relations: one row per set bit, so a filter merges, persists and prunes like any table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kv import BLOOM_BITS_PER_KEY, BLOOM_MIN_KEYS, BLOOM_PROBES, bloom_bits
from tidemark.functions.murmur import murmur3, murmur3_array

_MASK = (1 << 32) - 1
#: What meets in one task at most: a block of filters (with their index entries) and a chunk of keys, in bytes, runs, keys and pairs of both.
BLOCK_BYTES, BLOCK_RUNS, CHUNK_KEYS, TASK_PAIRS = 16 << 20, 1 << 14, 1_000_000, 1 << 27
#: Fewer filters of one size are tested one by one, since their bits would not fill a word.
SLICED_FROM = 32
#: Bytes of bits worked on at once, and rows sent at once.
_BITS_AT_ONCE, _ROWS_AT_ONCE = 1 << 19, 1 << 18


def probe_positions(h: Column, bits: Column, probes: int = BLOOM_PROBES) -> Column:
    """The bit positions of a 32-bit hash: successive additions of its half-rotation, modulo 2^32, modulo the bits."""
    delta = F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15)).bitwiseAND(F.lit(_MASK))
    return F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.pmod((h + i.cast("long") * delta).bitwiseAND(F.lit(_MASK)), bits))


def build_filters(entries: DataFrame, run: str = "run_id", key: str = "key") -> DataFrame:
    """(run_id, n_bits, positions) for each run of ``entries``; duplicate keys count once."""
    keys = entries.select(run, key).distinct()
    sizes = keys.groupBy(run).agg(bloom_bits(F.count(F.lit(1))).alias("n_bits"))
    hashed = keys.withColumn("h", murmur3(F.col(key))).join(sizes, run)
    bits = hashed.select(run, "n_bits", F.explode(probe_positions(F.col("h"), F.col("n_bits"))).alias("pos"))
    return bits.groupBy(run, "n_bits").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def to_bytes(filters: DataFrame, run: str = "run_id") -> DataFrame:
    """(run_id, n_bits, bits): each filter as the bytes that a run file stores."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, on in zip(b.column("n_bits").to_pylist(), b.column("positions"), strict=True):
                bits = np.zeros(n, np.uint8)
                bits[on.values.to_numpy()] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(run), b.column("n_bits"), pa.array(out, pa.binary())], names=[run, "n_bits", "bits"])

    return filters.select(run, "n_bits", "positions").mapInArrow(packed, f"{run} long, n_bits long, bits binary")


def stored_filters(entries: DataFrame, run: str = "run_id", key: str = "key") -> DataFrame:
    """(run_id, n_bits, bits) for each run of ``entries``: ``to_bytes(build_filters(entries))`` without a row per bit. Null keys and runs are left out."""
    keys = entries.select(run, key).where(F.col(run).isNotNull() & F.col(key).isNotNull()).distinct()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []

        def filled() -> tuple[int, int, bytes]:
            h = np.concatenate(held)
            n = (max(len(h), BLOOM_MIN_KEYS) * BLOOM_BITS_PER_KEY + 7) // 8 * 8
            bits = np.zeros(n, np.uint8)
            for p in _positions(h, n):
                bits[p] = 1
            return of, n, np.packbits(bits, bitorder="little").tobytes()

        def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=[run, "n_bits", "bits"])

        for b in batches:
            runs, out = b.column(run).to_numpy(), []
            h = murmur3_array(b.column(key).cast(pa.binary()).to_pylist())
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)] if len(runs) else []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if held and runs[a] != of:
                    out.append(filled())
                    held = []
                of = int(runs[a])
                held.append(h[a:z])
            yield batch(out)
        if held:
            yield batch([filled()])

    return keys.repartition(run).sortWithinPartitions(run).mapInArrow(build, f"{run} long, n_bits long, bits binary")


def _positions(h: np.ndarray, n: int, probes: int = BLOOM_PROBES) -> Iterator[np.ndarray]:
    """The bit positions of 32-bit hashes in filters of ``n`` bits, an array a probe."""
    mask = np.uint64(_MASK)
    delta = (h >> np.uint64(17) | h << np.uint64(15)) & mask
    for i in range(probes):
        yield (((h + np.uint64(i) * delta) & mask) % np.uint64(n)).astype(np.int64)


def may_contain(bits: bytes, h: np.ndarray, probes: int = BLOOM_PROBES) -> np.ndarray:
    """Whether a stored filter may hold each of the 32-bit hashes; an empty filter holds all."""
    on = np.ones(len(h), bool)
    if not bits:
        return on
    b = np.frombuffer(bits, np.uint8)
    for p in _positions(h, 8 * len(b), probes):
        on &= (b[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return on


def _sliced(filters: list[bytes]) -> np.ndarray:
    """Filters of one size turned over: row p holds bit p of every filter, in words."""
    m = np.frombuffer(b"".join(filters), np.uint8).reshape(len(filters), -1)
    out = np.zeros((8 * m.shape[1], -(-len(filters) // 64) * 8), np.uint8)
    for a in range(0, m.shape[1], 64):
        rows = np.packbits(np.unpackbits(m[:, a : a + 64], axis=1, bitorder="little").T, axis=1, bitorder="little")
        out[8 * a : 8 * a + len(rows), : rows.shape[1]] = rows
    return out.view(np.uint64)


def admitted(filters: list[bytes], h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of filters, places of hashes) of all pairs that the stored filters admit, some at a time.

    Filters of one size have a key's bits at the same places. Turned over, one
    AND of seven rows tests a key against all of them, 64 a word.
    """
    sizes = np.fromiter(map(len, filters), np.int64, len(filters))
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        if len(own) < SLICED_FROM or not size:
            for r in own.tolist():
                q = np.flatnonzero(may_contain(filters[r], h))
                yield np.full(len(q), r), q
            continue
        table, places = _sliced([filters[r] for r in own.tolist()]), list(_positions(h, 8 * size))
        width = table.shape[1]
        step = max(1, _BITS_AT_ONCE // (8 * width))
        spare = np.empty((step, width), np.uint64)
        for a in range(0, len(h), step):
            on = table[places[0][a : a + step]]
            for p in places[1:]:
                on &= np.take(table, p[a : a + step], axis=0, out=spare[: len(on)], mode="clip")
            octets = on.view(np.uint8).ravel()
            at = np.flatnonzero(octets != 0)
            bit = np.flatnonzero(np.unpackbits(octets[at], bitorder="little"))
            pair = at[bit >> 3] * 8 + (bit & 7)
            q = pair // (64 * width)
            yield own[pair - q * (64 * width)], q + a


def probe(filters: DataFrame, keys: DataFrame, key: str = "key", run: str = "run_id", index: DataFrame | None = None) -> DataFrame:
    """(key, run_id, maybe) of the runs that may hold each key; all others certainly do not, and are left out. Null keys have none.

    With ``index`` (run_id, k, offset) also ``offset``: of the greatest indexed key
    of the run not above the key, by bytes; 0 when below all. An index entry is
    sent where its run's filter is, so admitted pairs are never shuffled.

    Every block of filters meets every chunk of keys in a task of bounded size, so
    the number of tasks grows with the pairs and the longest does not. A filter
    and its run's index must fit a task. ``filters`` has positions or bytes.
    """
    stored = (filters if "bits" in filters.columns else to_bytes(filters, run)).where(F.col(run).isNotNull())
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    n_runs, total = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()
    if index is not None:
        total += index.agg(F.coalesce(F.sum(F.octet_length("k") + 16), F.lit(0))).first()[0]
    n_keys = asked.count()
    blocks = 1 + max(total // BLOCK_BYTES, n_runs // BLOCK_RUNS)
    chunks = 1 + n_keys // min(CHUNK_KEYS, max(1, TASK_PAIRS * blocks // max(1, n_runs)))
    parts = min(blocks * chunks, max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * n_runs * n_keys // TASK_PAIRS))

    def dealt(df: DataFrame, kind: int, n: int, by: str, each: int, **cols: Column) -> DataFrame:
        """Rows with the task they go to: ``by`` picks one of ``n`` places, and each of the ``each`` places of the other side has a copy."""
        own, other = F.pmod(F.xxhash64(by), F.lit(n)), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("other")
        kinds = {"r": "long", "bits": "binary", "s": "string", "v": "long"}
        rows = df.select(F.lit(kind).alias("kind"), own.alias("own"), *(cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items())).select("*", other)
        task = F.col("own") * chunks + F.col("other") if kind < 2 else F.col("other") * chunks + F.col("own")
        return rows.withColumn("task", task).withColumn("part", F.pmod("task", F.lit(parts)).cast("int")).drop("own", "other")

    sent = dealt(stored, 0, blocks, run, chunks, r=F.col(run), bits=F.col("bits")).unionByName(
        dealt(asked, 2, chunks, key, blocks, s=F.col(key), v=murmur3(F.col(key)))
    )
    if index is not None:
        sent = sent.unionByName(dealt(index.where(F.col(run).isNotNull() & F.col("k").isNotNull()), 1, blocks, run, chunks, r=F.col(run), s=F.col("k"), v=F.col("offset")))
    seeks = index is not None
    names = [key, run, "maybe"] + ["offset"] * seeks

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        f, e, k = (t.filter(pc.equal(t.column("kind"), i)) for i in range(3))
        if not len(f) or not len(k):
            return
        ids, text, h = f.column("r").to_numpy(), k.column("s").combine_chunks(), k.column("v").to_numpy().astype(np.uint64)
        seek = _seeker(ids, e, text) if seeks else None
        for r, q in admitted(f.column("bits").to_pylist(), h):
            for a in range(0, len(r), _ROWS_AT_ONCE):
                rs, qs = r[a : a + _ROWS_AT_ONCE], q[a : a + _ROWS_AT_ONCE]
                cols = [text.take(pa.array(qs)), pa.array(ids[rs]), pa.array(np.ones(len(rs), bool))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(seek(rs, qs))] if seek else []), names=names)

    schema = f"{key} string, {run} long, maybe boolean" + ", offset long" * seeks
    return sent.repartitionById(parts, "part").groupBy("part", "task").applyInArrow(meet, schema)


def _seeker(ids: np.ndarray, entries: pa.Table, text: pa.Array) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The offsets for pairs of places among runs ``ids`` and keys ``text``, from index ``entries`` (r, s, v)."""
    order = np.argsort(ids)
    run, offset = entries.column("r").to_numpy(), entries.column("v").to_numpy()
    at = np.minimum(np.searchsorted(ids, run, sorter=order), len(ids) - 1)
    place, both = order[at], pa.concat_arrays([text, *entries.column("s").chunks]).cast(pa.binary())
    rank = pc.rank(both, tiebreaker="dense").to_numpy().astype(np.int64)
    own, span = rank[: len(text)], len(both) + 1
    known = ids[place] == run  # entries of a run without a filter are not asked
    place, offset, code = place[known], offset[known], (place * span + rank[len(text) :])[known]
    by = np.lexsort((offset, code))
    place, offset, code = np.append(place[by], -1), np.append(offset[by], 0), code[by]

    def seek(r: np.ndarray, q: np.ndarray) -> np.ndarray:
        i = np.searchsorted(code, r * span + own[q], side="right") - 1  # -1, before all, is the row added at the end
        return np.where(place[i] == r, offset[i], 0)

    return seek
