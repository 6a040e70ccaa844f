"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom, kv
from tidemark.functions.murmur import murmur3
from tidemark.operators import compaction, consistency, lookup, resolve, runs, validate
from tidemark.plans import observability as obs
from tidemark.plans.store import KVStore
from tidemark.session import cut, scratch_path, table
from tidemark.sources import binary
from tidemark.sources.changelog import read_changelog

#: Positions for the consistency reads as shares of the log, in thousandths: what is committed, and what each replica has applied.
COMMITTED = 1000
REPLICAS = (("n1", "leader", 950), ("n2", "follower", 700), ("n3", "follower", 400))
#: Tier bounds in bytes that split the test runs (a run here holds about 100 records).
SMALL_TIERS = (1250, 1300, 1350)
GAUGE_LIMIT = 400.0

_LOG = """log AS (SELECT event_id AS seq, 'user:'||CAST(user_id AS VARCHAR) AS k,
  CASE WHEN event_type='error' THEN 'DELETE' ELSE 'PUT' END AS op,
  CASE WHEN event_type='error' THEN NULL ELSE props END AS v, event_id // 100 AS run_id FROM events)"""
_LWW = _LOG + """, lww AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM log) WHERE rn=1)"""
_RUN = _LOG + """, rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, k ORDER BY seq DESC) rn FROM log) WHERE rn=1)"""
_BYTES = "octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0)"
_LIVE = "op='PUT' AND v IS NOT NULL AND octet_length(encode(v)) > 0"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("kv_scan_all", f"WITH {_LWW} SELECT k, v FROM lww WHERE {_LIVE}")
def kv_scan_all(spark, d):
    return resolve.scan_all(read_changelog(spark, d))


@query("kv_get_point", f"WITH {_LWW} SELECT 'user:7' AS k, count(*) FILTER ({_LIVE}) > 0 AS found, max(CASE WHEN {_LIVE} THEN v END) AS v FROM lww WHERE k='user:7'")
def kv_get_point(spark, d):
    return lookup.get_point(read_changelog(spark, d), "user:7")


_ASKED = "asked AS (SELECT DISTINCT 'user:'||CAST(c_custkey AS VARCHAR) AS k FROM customer)"
_REASON = f"CASE WHEN l.seq IS NULL THEN 'absent' WHEN {_LIVE} THEN 'found' ELSE 'tombstone' END"


def _asked(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("k"))


@query("kv_multi_get", f"WITH {_LWW}, {_ASKED} SELECT a.k, coalesce({_LIVE}, false) AS found, CASE WHEN {_LIVE} THEN v END AS v FROM asked a LEFT JOIN lww l ON a.k=l.k")
def kv_multi_get(spark, d):
    return lookup.multi_get(read_changelog(spark, d), _asked(spark, d)).select("k", (F.col("reason") == "found").alias("found"), "v")


@query("kv_get_reason", f"WITH {_LWW}, {_ASKED} SELECT a.k, {_REASON} AS reason FROM asked a LEFT JOIN lww l ON a.k=l.k")
def kv_get_reason(spark, d):
    return lookup.multi_get(read_changelog(spark, d), _asked(spark, d)).select("k", "reason")


@query("kv_merge_keep_tombstones", f"WITH {_LWW} SELECT k, op, v, seq FROM lww")
def kv_merge_keep_tombstones(spark, d):
    return resolve.merge_log_runs(read_changelog(spark, d))


@query(
    "kv_merge_four_runs",
    f"WITH {_LOG} SELECT k, op, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run_id DESC, seq DESC) rn FROM log WHERE run_id BETWEEN 0 AND 3) WHERE rn=1",
)
def kv_merge_four_runs(spark, d):
    log = read_changelog(spark, d)
    return resolve.merge_runs([log.where(F.col("run_id") == i) for i in range(4)])


_TIER = "CASE WHEN n_bytes < 1250 THEN 0 WHEN n_bytes < 1300 THEN 1 WHEN n_bytes < 1350 THEN 2 ELSE 3 END"
_STATS = f"{_RUN}, st AS (SELECT run_id, count(*) AS n_keys, CAST(sum({_BYTES}) AS BIGINT) AS n_bytes FROM rr GROUP BY run_id), t AS (SELECT run_id, n_bytes, CAST({_TIER} AS INTEGER) AS tier FROM st)"
_PICK = f"""{_STATS}, i AS (SELECT *, row_number() OVER (ORDER BY run_id) AS i, row_number() OVER (ORDER BY run_id) - row_number() OVER (PARTITION BY tier ORDER BY run_id) AS g FROM t),
    s AS (SELECT *, count(*) OVER (PARTITION BY tier, g) AS n, row_number() OVER (PARTITION BY tier, g ORDER BY run_id) AS pos, min(i) OVER (PARTITION BY tier, g) AS st FROM i),
    picked AS (SELECT run_id, tier, CAST(pos AS INTEGER) AS pos FROM s WHERE n >= 4 AND pos <= 4 AND st = (SELECT min(st) FROM s WHERE n >= 4))"""


@query("kv_compact_picked", f"WITH {_PICK}, m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS newest FROM log WHERE run_id IN (SELECT run_id FROM picked)) SELECT k, op, v, seq FROM m WHERE newest = 1")
def kv_compact_picked(spark, d):
    """The oldest full tier, merged as one run."""
    log = read_changelog(spark, d)
    stats = compaction.tiers(runs.memtable_accounting(log), bounds=SMALL_TIERS)
    chosen = compaction.pick(stats).select("run_id")
    return resolve.merge_log_runs(log.join(F.broadcast(chosen), "run_id", "left_semi"))  # at most fan_in rows


@query("kv_version_counts", f"WITH {_LOG} SELECT k, count(*) AS n_versions, count(*) FILTER (NOT ({_LIVE})) AS n_deletes FROM log GROUP BY k")
def kv_version_counts(spark, d):
    return resolve.version_counts(read_changelog(spark, d))


@query("memtable_accounting", f"WITH {_RUN} SELECT run_id, count(*) AS n_keys, CAST(sum({_BYTES}) AS BIGINT) AS n_bytes FROM rr GROUP BY run_id")
def memtable_accounting(spark, d):
    return runs.memtable_accounting(read_changelog(spark, d))


@query("flush_verify", f"WITH {_LOG} SELECT run_id, count(DISTINCT k) AS expected, count(DISTINCT k) - CASE WHEN run_id % 7 = 3 THEN 1 ELSE 0 END AS actual, run_id % 7 <> 3 AS ok FROM log GROUP BY run_id")
def flush_verify(spark, d):
    """Run files written and read back; every seventh loses its first record on the way, which must show."""
    log = read_changelog(spark, d)
    e = runs.run_entries(log)
    first = e.groupBy("run_id").agg(F.min("k").alias("first"))
    kept = e.join(first, "run_id").where("run_id % 7 <> 3 or k <> first")
    folder = scratch_path(spark, "flushed")
    binary.write_run_files(_binary(kept), folder)
    return runs.flush_verify(log, binary.read_run_files(spark, folder))


def _binary(entries: DataFrame) -> DataFrame:
    return entries.select("run_id", F.col("k").cast("binary").alias("key"), F.col("v").cast("binary").alias("value"))


def _text(entries: DataFrame) -> DataFrame:
    return entries.select("run_id", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query("run_files_read", f"WITH {_RUN} SELECT run_id, k, coalesce(v, '') AS v FROM rr")
def run_files_read(spark, d):
    """Every run as a binary file, read back whole."""
    folder = scratch_path(spark, "run-files")
    binary.write_run_files(_binary(runs.run_entries(read_changelog(spark, d))), folder)
    return _text(binary.read_run_files(spark, folder))


@query("run_files_get", f"WITH {_RUN}, {_ASKED} SELECT run_id, k, coalesce(v, '') AS v FROM rr WHERE k IN (SELECT k FROM asked)")
def run_files_get(spark, d):
    """All customers' keys looked up in every run file through its stored filter and index."""
    folder = scratch_path(spark, "run-files")
    binary.write_run_files(_binary(runs.run_entries(read_changelog(spark, d))), folder)
    return _text(binary.get_from_run_files(spark, folder, _asked(spark, d)))


@query("wal_bytes", f"WITH {_LOG} SELECT run_id, CAST(sum(20 + {_BYTES}) AS BIGINT) AS n_bytes FROM log GROUP BY run_id")
def wal_bytes(spark, d):
    return runs.wal_bytes(read_changelog(spark, d))


@query(
    "wal_valid_prefix",
    f"WITH {_LOG}, b AS (SELECT *, sum(CASE WHEN seq % 97 = 96 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS bad FROM log) SELECT run_id, seq, k FROM b WHERE bad = 0",
)
def wal_valid_prefix(spark, d):
    """Every 97th record is damaged: its value no longer fits the checksum stored with it."""
    return runs.recover_prefix(_damaged(read_changelog(spark, d))).select("run_id", "seq", "k")


def _damaged(log: DataFrame) -> DataFrame:
    stored = log.withColumn("crc", kv.entry_crc(F.col("k"), F.col("v")))
    read = stored.withColumn("v", F.when(F.col("seq") % 97 == 96, F.concat(F.coalesce("v", F.lit("")), F.lit("?"))).otherwise(F.col("v")))
    return read.withColumn("ok", kv.entry_crc(F.col("k"), F.col("v")) == F.col("crc"))


@query("wal_recover_state", f"WITH {_LOG}, b AS (SELECT *, sum(CASE WHEN seq % 97 = 96 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS bad FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM b WHERE bad = 0) SELECT k, v FROM r WHERE rn = 1 AND {_LIVE}")
def wal_recover_state(spark, d):
    return resolve.scan_all(runs.recover_prefix(_damaged(read_changelog(spark, d))))


@query("wal_files_recover", f"WITH {_LOG}, b AS (SELECT *, sum(CASE WHEN seq % 97 = 96 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS bad FROM log) SELECT run_id, seq, k, coalesce(v, '') AS v FROM b WHERE bad = 0")
def wal_files_recover(spark, d):
    """Binary log files, one byte of every 97th record flipped; their tails are cut and the rest is read."""
    folder = scratch_path(spark, "log-files")
    binary.write_wal_files(read_changelog(spark, d), folder)
    binary.flip_bytes(spark, folder, 97, 96)
    binary.cut_tails(spark, folder)
    rec = binary.read_wal_files(spark, folder)
    run = F.regexp_extract("wal_file", "([0-9]+)[.]log$", 1).cast("long")
    return rec.select(run.alias("run_id"), "seq", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


_CRC_STEPS = "flatten(list_transform(string_split(k || coalesce(v, ''), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"


@query(
    "entry_crc",
    f"WITH {_LOG} SELECT seq, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform({_CRC_STEPS}, lambda x: CAST(x AS BIGINT))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c // 2, 3988292384 * (c % 2)) END)) AS crc FROM log",
)
def entry_crc(spark, d):
    """The checksum that the log stores with every record."""
    return read_changelog(spark, d).select("seq", kv.entry_crc(F.col("k"), F.col("v")).alias("crc"))


@query("wal_high_water", f"WITH {_LOG} SELECT run_id, seq, max(seq) OVER (PARTITION BY run_id ORDER BY seq) AS high FROM log")
def wal_high_water(spark, d):
    return runs.high_water(read_changelog(spark, d)).select("run_id", "seq", "high")


@query(
    "sst_layout_bytes",
    f"WITH {_RUN} SELECT run_id, CAST(sum(8 + {_BYTES}) AS BIGINT) AS data_bytes, CAST(ceil(greatest(count(*), 64) * 10 / 8.0) AS BIGINT) AS bloom_bytes, CAST(24 AS BIGINT) AS fixed_bytes FROM rr GROUP BY run_id",
)
def sst_layout_bytes(spark, d):
    return runs.layout_bytes(read_changelog(spark, d))


_INDEX = f"""{_RUN}, p AS (SELECT run_id, k, row_number() OVER (PARTITION BY run_id ORDER BY encode(k)) AS i,
    coalesce(sum(8 + {_BYTES}) OVER (PARTITION BY run_id ORDER BY encode(k) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM rr),
  f AS (SELECT run_id, k, i, pos FROM p WHERE i=1 UNION ALL
    SELECT run_id, k, i, pos FROM (SELECT p.*, row_number() OVER (PARTITION BY p.run_id ORDER BY p.i) q FROM f JOIN p ON p.run_id=f.run_id AND p.pos-f.pos>=1024) WHERE q=1)"""


@query("sparse_index", f"WITH RECURSIVE {_INDEX} SELECT run_id, k, CAST(pos AS BIGINT) AS \"offset\" FROM f")
def sparse_index(spark, d):
    return runs.sparse_index(read_changelog(spark, d))


def _murmur(keys: str, blocks: int = 5) -> str:
    """CTEs that give h(k, h), the canonical Murmur3 of ASCII keys of up to 4 x ``blocks`` + 3 bytes, in 64-bit arithmetic."""
    m = 4294967296
    byte = lambda at: f"CAST(ascii(substr(k, CAST({at} AS BIGINT), 1)) AS UBIGINT)"

    def mixed(w: str) -> str:
        x = f"(({w}) * 3432918353 % {m})"
        return f"(({x} * 32768 % {m} + {x} // 131072) * 461845907 % {m})"

    out = [f"h0 AS (SELECT k, CAST(0 AS UBIGINT) AS h, length(k) AS n FROM ({keys}))"]
    for i in range(blocks):
        word = " + ".join(f"{byte(4 * i + j + 1)} * {256**j}" for j in range(4))
        out.append(f"x{i} AS (SELECT k, n, h, CASE WHEN n >= {4 * i + 4} THEN xor(h, {mixed(word)}) END AS x FROM h{i})")
        out.append(f"h{i + 1} AS (SELECT k, n, CASE WHEN n >= {4 * i + 4} THEN ((x * 8192 % {m} + x // 524288) * 5 + 3864292196) % {m} ELSE h END AS h FROM x{i})")
    tail = " + ".join(f"CASE WHEN n % 4 > {j} THEN {byte(f'n // 4 * 4 + {j + 1}')} * {256**j} ELSE CAST(0 AS UBIGINT) END" for j in range(3))
    out.append(f"t0 AS (SELECT k, n, h, {tail} AS w FROM h{blocks})")
    out.append(f"t1 AS (SELECT k, xor(xor(h, {mixed('w')}), CAST(n AS UBIGINT)) AS h FROM t0)")
    out.append(f"t2 AS (SELECT k, xor(h, h // 65536) * 2246822507 % {m} AS h FROM t1)")
    out.append(f"t3 AS (SELECT k, xor(h, h // 8192) * 3266489909 % {m} AS h FROM t2)")
    out.append("h AS (SELECT k, xor(h, h // 65536) AS h FROM t3)")
    return ", ".join(out)


_AT = "(h + i * (h // 131072 + h * 32768 % 4294967296)) % 4294967296 % n_bits"
_FILTER = f"""{_murmur('SELECT DISTINCT k FROM log')}, sizes AS (SELECT run_id, CAST(ceil(greatest(count(DISTINCT k), 64) * 10 / 8.0) * 8 AS BIGINT) AS n_bits FROM log GROUP BY run_id),
  seven AS (SELECT CAST(unnest([0, 1, 2, 3, 4, 5, 6]) AS UBIGINT) AS i), sized AS (SELECT DISTINCT n_bits FROM sizes),
  pos AS (SELECT DISTINCT k, n_bits, CAST({_AT} AS BIGINT) AS p FROM h CROSS JOIN sized CROSS JOIN seven),
  bits AS (SELECT DISTINCT run_id, n_bits, p FROM (SELECT DISTINCT run_id, k FROM log) JOIN sizes USING (run_id) JOIN pos USING (k, n_bits)),
  need AS (SELECT k, n_bits, count(*) AS n FROM pos GROUP BY 1, 2),
  maybe AS (SELECT run_id, k FROM (SELECT b.run_id, p.k, p.n_bits, count(*) AS hit FROM pos p JOIN bits b USING (n_bits, p) GROUP BY 1, 2, 3) x JOIN need USING (k, n_bits) WHERE hit = n)"""


@query("key_hash", f"WITH {_LOG}, {_murmur('SELECT DISTINCT k FROM log')} SELECT k, CAST(h AS BIGINT) AS h FROM h")
def key_hash(spark, d):
    return read_changelog(spark, d).select("k").distinct().withColumn("h", murmur3(F.col("k")))


@query("bloom_bits_set", f"WITH {_LOG}, {_FILTER} SELECT run_id, n_bits, count(*) AS n_set FROM bits GROUP BY 1, 2")
def bloom_bits_set(spark, d):
    """Bits of every run's filter as stored in bytes."""
    stored = bloom.stored_filters(read_changelog(spark, d).withColumnRenamed("k", "key"))
    ones = "aggregate(sequence(1, octet_length(bits)), 0L, (a, i) -> a + bit_count(cast(conv(hex(substring(bits, i, 1)), 16, 10) as int)))"
    return stored.select("run_id", "n_bits", F.expr(ones).alias("n_set"))


@query("bloom_probe", f"WITH {_LOG}, {_FILTER} SELECT k AS key, run_id FROM maybe")
def bloom_probe(spark, d):
    """Every key that the filter of any run may hold, probed in the filters' stored bytes."""
    log = read_changelog(spark, d).withColumnRenamed("k", "key")
    return bloom.probe(cut(bloom.stored_filters(log)), log).select("key", "run_id")


@query(
    "sparse_index_seek",
    f"WITH RECURSIVE {_INDEX}, {_FILTER} SELECT m.run_id, m.k, CAST(coalesce(max(f.pos), 0) AS BIGINT) AS \"offset\" FROM maybe m LEFT JOIN f ON f.run_id=m.run_id AND encode(f.k)<=encode(m.k) GROUP BY 1, 2",
)
def sparse_index_seek(spark, d):
    """Where a lookup of any key begins to read, in every run whose filter admits the key."""
    log = read_changelog(spark, d)
    keyed = log.withColumnRenamed("k", "key")
    found = bloom.probe(cut(bloom.stored_filters(keyed)), keyed, index=cut(runs.sparse_index(log)))
    return found.select("run_id", F.col("key").alias("k"), "offset")


@query("size_tier", f"WITH {_STATS} SELECT run_id, n_bytes, tier FROM t")
def size_tier(spark, d):
    return compaction.tiers(runs.memtable_accounting(read_changelog(spark, d)), bounds=SMALL_TIERS).select("run_id", "n_bytes", "tier")


@query("compaction_pick", f"WITH {_PICK} SELECT run_id, tier, pos FROM picked")
def compaction_pick(spark, d):
    return compaction.pick(compaction.tiers(runs.memtable_accounting(read_changelog(spark, d)), bounds=SMALL_TIERS))


@query("read_amplification", f"WITH {_LOG} SELECT k, (SELECT max(run_id) FROM log) - max(run_id) + 1 AS runs_searched FROM log GROUP BY k")
def read_amplification(spark, d):
    return lookup.read_amplification(read_changelog(spark, d))


@query("bloom_sizing", f"WITH {_LOG} SELECT run_id, count(DISTINCT k) AS n_keys, CAST(ceil(greatest(count(DISTINCT k), 64) * 10 / 8.0) * 8 AS BIGINT) AS n_bits FROM log GROUP BY run_id")
def bloom_sizing(spark, d):
    n = read_changelog(spark, d).groupBy("run_id").agg(F.countDistinct("k").alias("n_keys"))
    return n.withColumn("n_bits", kv.bloom_bits(F.col("n_keys")))


def _bound(name: str | None = None) -> str:
    """SQL of a replica's position, or of what is committed."""
    share = {n: s for n, _, s in REPLICAS}.get(name, COMMITTED)
    return f"(SELECT max(event_id) * {share} // 1000 FROM events)"


def _as_of(bound: str) -> str:
    return f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM log WHERE seq <= {bound}) SELECT k, v FROM r WHERE rn=1 AND {_LIVE}"


def _position(spark, d, name: str | None = None) -> Column:
    """The same as a scalar subquery, so that planning runs no job."""
    share = {n: s for n, _, s in REPLICAS}.get(name, COMMITTED)
    return table(spark, d, "events").agg(F.floor(F.max("event_id") * share / 1000).cast("long")).scalar()


def _read(spark, d, level, node):
    at = {n: _position(spark, d, n) for n, _, _ in REPLICAS}
    return consistency.read_as_of(read_changelog(spark, d), consistency.read_bound(consistency.Consistency.parse(level), _position(spark, d), at, "n1", node))


@query("read_strong", _as_of(_bound()))
def read_strong(spark, d):
    return _read(spark, d, "strong", "n1")


@query("read_fast", _as_of(_bound("n1")))
def read_fast(spark, d):
    return _read(spark, d, "fast", "n1")


@query("read_eventual", _as_of(_bound("n3")))
def read_eventual(spark, d):
    return _read(spark, d, "eventual", "n3")


@query(
    "replica_states",
    f"WITH {_LOG}, n AS (SELECT 'n1' AS node, {_bound('n1')} AS s UNION ALL SELECT 'n2', {_bound('n2')} UNION ALL SELECT 'n3', {_bound('n3')}), r AS (SELECT *, row_number() OVER (PARTITION BY node, k ORDER BY seq DESC) rn FROM log JOIN n ON seq <= s) SELECT node, k, v FROM r WHERE rn=1 AND {_LIVE}",
)
def replica_states(spark, d):
    return consistency.replica_states(read_changelog(spark, d), {n: _position(spark, d, n) for n, _, _ in REPLICAS})


@query("stale_read_report", f"WITH a AS ({_as_of(_bound())}), b AS ({_as_of(_bound('n3'))}) SELECT coalesce(a.k, b.k) AS k, a.v AS fresh, b.v AS stale FROM a FULL JOIN b ON a.k=b.k WHERE a.v IS DISTINCT FROM b.v")
def stale_read_report(spark, d):
    return consistency.stale_report(read_changelog(spark, d), _position(spark, d), _position(spark, d, "n3"))


@query("snapshot_restore_diff", f"WITH {_LWW} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra FROM lww WHERE {_LIVE}")
def snapshot_restore_diff(spark, d):
    """Rows of a snapshot, written and restored, against the state it was taken from."""
    log = read_changelog(spark, d)
    store = KVStore(spark, scratch_path(spark, "store"))
    store.put(spark.createDataFrame([("trash", "x")], "k string, v string"))
    store.apply(log)
    snap, other = scratch_path(spark, "snapshot"), KVStore(spark, scratch_path(spark, "restored"))
    store.purge()
    store.apply(log)
    store.snapshot(snap)
    other.put(spark.createDataFrame([("trash", "x")], "k string, v string"))
    other.restore(snap)
    a, b = resolve.scan_all(log), other.scan()
    both = a.withColumn("a", F.lit(1)).unionByName(b.withColumn("a", F.lit(-1))).groupBy("k", "v").agg(F.sum("a").alias("n"))
    diff = both.agg(F.count_if(F.col("n") > 0).alias("n_missing"), F.count_if(F.col("n") < 0).alias("n_extra"))
    return diff.withColumn("n_rows", a.agg(F.count(F.lit(1))).scalar())


def _batches(log: DataFrame, n: int) -> list[DataFrame]:
    """``n`` batches of a log, cut by its sequence."""
    lo, hi = log.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    step = (hi - lo) // n + 1
    return [log.where((F.col("seq") >= lo + i * step) & (F.col("seq") < lo + (i + 1) * step)) for i in range(n)]


@query("store_compact_twice", f"WITH {_LWW} SELECT k, v FROM lww WHERE {_LIVE}")
def store_compact_twice(spark, d):
    """Eight batches in a store, compacted after every three: merged runs never hide newer ones."""
    store = KVStore(spark, scratch_path(spark, "store"))
    for i, batch in enumerate(_batches(read_changelog(spark, d), 8)):
        store.apply(batch)
        if i % 3 == 2:
            store.compact(bounds=(), fan_in=2)
    store.compact(bounds=(), fan_in=2)
    return resolve.drop_tombstones(store.entries()).select("k", "v")


@query("store_late_batches", f"WITH {_LWW} SELECT k, op, v, seq FROM lww")
def store_late_batches(spark, d):
    """The newest part of the log is applied first; older parts arrive later and change nothing that is newer."""
    store = KVStore(spark, scratch_path(spark, "store"))
    for batch in reversed(_batches(read_changelog(spark, d), 4)):
        store.apply(batch)
    store.compact(bounds=(), fan_in=2)
    return store.entries().select("k", "op", "v", "seq")


@query("store_flush_at_limit", f"WITH {_LWW} SELECT k, v FROM lww WHERE {_LIVE}")
def store_flush_at_limit(spark, d):
    """Batches collect in the memtable and are flushed when it is full, and at the close."""
    store = KVStore(spark, scratch_path(spark, "store"), memtable_limit=4000)
    for batch in _batches(read_changelog(spark, d), 5):
        store.apply(batch)
    store.close()
    return store.scan()


_HALF = "(SELECT (max(event_id) - min(event_id)) // 2 + 1 + min(event_id) FROM events)"


@query("store_levels", f"WITH {_LOG}, p AS (SELECT *, CASE WHEN seq < {_HALF} THEN 'run' ELSE 'memtable' END AS level FROM log), n AS (SELECT *, row_number() OVER (PARTITION BY level, k ORDER BY seq DESC) AS rn FROM p) SELECT level, k, op, v, seq FROM n WHERE rn = 1")
def store_levels(spark, d):
    """Every entry by level: the first half of the log is flushed, the second is still in the memtable."""
    store = KVStore(spark, scratch_path(spark, "store"), memtable_limit=kv.MEMTABLE_LIMIT * 1024)
    first, second = _batches(read_changelog(spark, d), 2)
    store.apply(first)
    store.flush()
    store.apply(second)
    return store.levels().select("level", "k", "op", "v", "seq")


@query("store_delete_get", f"WITH {_LWW}, {_ASKED} SELECT a.k, CASE WHEN CAST(split_part(a.k, ':', 2) AS BIGINT) % 3 = 0 THEN 'tombstone' ELSE {_REASON} END AS reason FROM asked a LEFT JOIN lww l ON a.k=l.k")
def store_delete_get(spark, d):
    """Every third customer's key is deleted in a store; then all customers' keys are looked up."""
    store, asked = KVStore(spark, scratch_path(spark, "store")), _asked(spark, d)
    store.apply(read_changelog(spark, d))
    store.delete(asked.where(F.split_part("k", F.lit(":"), F.lit(2)).cast("long") % 3 == 0))
    return store.get(asked).select("k", "reason")


@query("fsm_apply_validation", "SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'bad_payload' WHEN event_type = 'view' THEN 'unknown_op' ELSE 'ok' END AS status FROM events")
def fsm_apply_validation(spark, d):
    """Views are sent with an unknown op and every 11th command without a key."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "view", "MERGE").when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    cmd = e.select(F.col("event_id").alias("seq"), op.alias("op"), F.when(F.col("event_id") % 11 != 0, F.col("user_id").cast("string")).alias("k"))
    return validate.classify(cmd).select("seq", "status")


@query(
    "leader_address",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN '10.0.' || CAST(s_nationkey AS VARCHAR) || '.1:' || CAST(7000 + s_suppkey + 1000 AS VARCHAR) END AS address FROM supplier",
)
def leader_address(spark, d):
    s = table(spark, d, "supplier")
    port = (F.lit(7000) + F.col("s_suppkey")).cast("string")
    host = F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit(".1"))
    addr = F.when(F.col("s_suppkey") % 5 != 0, F.concat(host, F.lit(":"), port)).otherwise(F.lit("invalid-addr-format"))
    return s.select("s_suppkey", kv.leader_address(addr).alias("address"))


def _samples(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return e.select("ts", F.col("event_id").alias("seq"), F.concat(F.lit("node"), (F.col("user_id") % 3).cast("string")).alias("node"), F.col("event_type").alias("method"), "value", state.alias("state"))


@query("throughput_rps", "SELECT date_trunc('minute', ts) AS \"minute\", event_type AS method, count(*) AS n, round(count(*) / 60.0, 6)::DOUBLE AS rps FROM events GROUP BY 1, 2")
def throughput_rps(spark, d):
    return obs.throughput(_samples(spark, d)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


_SERVED = "s AS (SELECT date_trunc('minute', ts) AS \"minute\", event_type AS method, ['STRONG', 'FAST', 'EVENTUAL'][user_id % 3 + 1] AS consistency, value / 1000.0 AS value FROM events WHERE event_id % 5 <> 0)"


def _requests(spark, d):
    """Samples with a consistency level each; every fifth request was proxied, and its server counts it."""
    level = F.element_at(F.array(*map(F.lit, ("STRONG", "FAST", "EVENTUAL"))), (F.col("user_id") % 3 + 1).cast("int"))
    e = table(spark, d, "events")
    return e.select("ts", F.col("event_type").alias("method"), level.alias("consistency"), (F.col("value") / 1000.0).alias("value"), (F.col("event_id") % 5 == 0).alias("is_proxy"))


@query("throughput_served", f"WITH {_SERVED} SELECT \"minute\", method, count(*) AS n, round(count(*) / 60.0, 6)::DOUBLE AS rps FROM s GROUP BY 1, 2")
def throughput_served(spark, d):
    return obs.throughput(_requests(spark, d)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(
    "latency_p99_windows",
    f"""WITH {_SERVED}, b AS (SELECT CAST(le AS DOUBLE) AS le FROM (VALUES (0.005),(0.01),(0.025),(0.05),(0.1),(0.25),(0.5),(1.0)) t(le) UNION ALL SELECT 'inf'::DOUBLE),
    h AS (SELECT "minute", method, consistency, le, count(*) FILTER (value <= le) AS n FROM s CROSS JOIN b GROUP BY 1, 2, 3, 4),
    q AS (SELECT *, lag(n, 1, 0) OVER w AS pn, lag(le, 1, 0.0) OVER w AS ple, max(n) OVER (PARTITION BY "minute", method, consistency) AS total FROM h WINDOW w AS (PARTITION BY "minute", method, consistency ORDER BY le))
    SELECT "minute", method, consistency, round(CASE WHEN isinf(le) THEN ple ELSE ple + (le - ple) * (0.99::DOUBLE * total - pn) / (n - pn) END, 6) AS "value" FROM q WHERE n >= 0.99::DOUBLE * total AND pn < 0.99::DOUBLE * total""",
)
def latency_p99_windows(spark, d):
    """The 99th percentile of each minute, method and consistency level, proxied requests left out."""
    return obs.latency_quantile(_requests(spark, d)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


_HIST = """b AS (SELECT CAST(le AS DOUBLE) AS le FROM (VALUES (0.005),(0.01),(0.025),(0.05),(0.1),(0.25),(0.5),(1.0)) t(le) UNION ALL SELECT 'inf'::DOUBLE),
 m AS (SELECT DISTINCT event_type AS method FROM events),
 h AS (SELECT m.method, b.le, (SELECT count(*) FROM events e WHERE e.event_type = m.method AND e.value / 1000.0 <= b.le) AS n FROM m CROSS JOIN b)"""


def _latency(spark, d):
    return _samples(spark, d).withColumn("value", F.col("value") / 1000.0)


@query("latency_histogram", f"WITH {_HIST} SELECT method, CAST(CASE WHEN isinf(le) THEN -1 ELSE round(le * 1000) END AS INTEGER) AS le_ms, n FROM h")
def latency_histogram(spark, d):
    le = F.when(F.col("le") == float("inf"), -1).otherwise(F.round(F.col("le") * 1000)).cast("int")
    return obs.histogram(_latency(spark, d)).select("method", le.alias("le_ms"), "n")


@query(
    "latency_p99",
    f"""WITH {_HIST}, q AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY method ORDER BY le) AS pn, lag(le, 1, 0.0) OVER (PARTITION BY method ORDER BY le) AS ple, max(n) OVER (PARTITION BY method) AS total FROM h)
    SELECT method, round(CASE WHEN isinf(le) THEN ple ELSE ple + (le - ple) * (0.99::DOUBLE * total - pn) / (n - pn) END, 6) AS "value" FROM q WHERE n >= 0.99::DOUBLE * total AND pn < 0.99::DOUBLE * total""",
)
def latency_p99(spark, d):
    return obs.quantile(obs.histogram(_latency(spark, d)), 0.99)


_STATE = "s AS (SELECT event_id AS seq, 'node' || CAST(user_id % 3 AS VARCHAR) AS node, CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS state FROM events)"


@query(
    "raft_state_timeline",
    f"WITH {_STATE}, t AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY node ORDER BY seq) THEN 1 ELSE 0 END AS turn FROM s), g AS (SELECT *, sum(turn) OVER (PARTITION BY node ORDER BY seq) AS g FROM t) SELECT node, state, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n FROM g GROUP BY node, g, state",
)
def raft_state_timeline(spark, d):
    return obs.state_timeline(_samples(spark, d))


@query("election_count", f"WITH {_STATE}, t AS (SELECT node, state = 1 AND lag(state, 1, 0) OVER (PARTITION BY node ORDER BY seq) <> 1 AS hit FROM s) SELECT node, count(*) FILTER (hit) AS n FROM t GROUP BY node")
def election_count(spark, d):
    return obs.elections(_samples(spark, d))


@query(
    "gauge_last_not_null",
    "WITH g AS (SELECT 'node' || CAST(user_id % 3 AS VARCHAR) AS node, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error' AND value IS NOT NULL) SELECT node, value, value > 400.0 AS \"over\" FROM g WHERE rn = 1",
)
def gauge_last_not_null(spark, d):
    s = _samples(spark, d).withColumn("value", F.when(F.col("method") != "error", F.col("value")))
    return obs.gauge_last(s, GAUGE_LIMIT)


@query("sstable_count", f"WITH {_STATS}, n AS (SELECT tier, count(*) AS n_runs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM t GROUP BY tier) SELECT * FROM n")
def sstable_count(spark, d):
    t = compaction.tiers(runs.memtable_accounting(read_changelog(spark, d)), bounds=SMALL_TIERS)
    return t.groupBy("tier").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_bytes").alias("n_bytes"))
