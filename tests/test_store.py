"""The store under late batches, many compactions, a full memtable, failures and bad commands; the client; the binary files."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import bloom, kv
from tidemark.functions.murmur import murmur3_array
from tidemark.operators import compaction, consistency, lookup, ranged, resolve, runs
from tidemark.plans import observability as obs
from tidemark.plans.store import KVStore
from tidemark.sources import binary

LOG = "seq long, op string, k string, v string"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def state(df):
    return {r["k"]: r["v"] for r in df.collect()}


def kvs(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v string")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_and_compactions(spark, tmp_path, seed):
    """Batches in any order, late ones too, with compactions between, equal a scan of the whole log."""
    rng = random.Random(seed)
    rows = [(i, "DELETE" if rng.random() < 0.25 else "PUT", f"k{rng.randrange(9)}", str(i)) for i in range(60)]
    rows = [(i, op, k, None if op == "DELETE" else v) for i, op, k, v in rows]
    cuts = sorted(rng.sample(range(1, 60), 5))
    batches = [rows[a:z] for a, z in zip([0, *cuts], [*cuts, 60], strict=True)]
    rng.shuffle(batches)
    s = KVStore(spark, str(tmp_path / "s"), memtable_limit=rng.choice([0, 60]))
    for i, b in enumerate(batches):
        s.apply(log(spark, b))
        if i % 2:
            s.compact(bounds=(), fan_in=2)
    s.close()
    s.compact(bounds=(), fan_in=2)
    s.compact(bounds=(), fan_in=2)
    assert state(s.scan()) == state(resolve.scan_all(log(spark, rows)))
    assert s.commit_seq() == 59


def test_compaction_never_reverts(spark, tmp_path):
    s = KVStore(spark, str(tmp_path / "s"))
    for k, v in (("x", "OLD"), ("a", "1"), ("b", "1"), ("c", "1"), ("x", "NEW")):
        s.put(kvs(spark, (k, v)))
    s.compact()
    assert state(s.scan())["x"] == "NEW"
    s.put(kvs(spark, ("d", "1")))
    s.put(kvs(spark, ("e", "1")))
    assert s.compact() and state(s.scan())["x"] == "NEW" and state(resolve.drop_tombstones(s.entries()))["x"] == "NEW"


def test_late_batch_keeps_its_place(spark, tmp_path):
    s = KVStore(spark, str(tmp_path / "s"))
    s.apply(log(spark, [(100, "PUT", "k", "new")]))
    s.apply(log(spark, [(5, "PUT", "k", "old"), (6, "PUT", "j", "x")]))
    assert state(s.scan()) == {"k": "new", "j": "x"} and s.commit_seq() == 100
    s.put(kvs(spark, ("k", "newest")))
    assert state(s.scan())["k"] == "newest" and s.commit_seq() == 101


def test_bad_commands_change_nothing(spark, tmp_path):
    s = KVStore(spark, str(tmp_path / "s"))
    cmd = log(spark, [(1, "PUT", "a", "1"), (2, "MERGE", "ghost", "x"), (3, "PUT", None, "x"), (4, None, "b", "x")])
    s.apply(cmd)
    assert state(s.scan()) == {"a": "1"}
    assert {r["seq"]: r["status"] for r in s.errors(cmd).collect()} == {2: "unknown_op", 3: "bad_payload", 4: "unknown_op"}


def test_memtable_fills_and_flushes(spark, tmp_path):
    s = KVStore(spark, str(tmp_path / "s"), memtable_limit=8)
    s.put(kvs(spark, ("a", "123")))
    m = s.manifest.load()
    assert (len(m["runs"]), len(m["memtable"])) == (0, 1) and state(s.scan()) == {"a": "123"}
    assert [r["level"] for r in s.levels().collect()] == ["memtable"]
    s.put(kvs(spark, ("a", "4567")))
    m = s.manifest.load()
    assert (len(m["runs"]), len(m["memtable"])) == (1, 0) and m["runs"][0]["n_keys"] == 1
    s.put(kvs(spark, ("b", "1")))
    assert sorted((r["level"], r["k"]) for r in s.levels().collect()) == [("memtable", "b"), ("run", "a")]
    s.close()
    again = KVStore(spark, str(tmp_path / "s"))
    assert len(again.manifest.load()["runs"]) == 2 and state(again.scan()) == {"a": "4567", "b": "1"}
    assert kv.MEMTABLE_LIMIT == 4 << 20


def test_failed_flush_loses_nothing(spark, tmp_path, monkeypatch):
    s = KVStore(spark, str(tmp_path / "s"), memtable_limit=1 << 20)
    s.put(kvs(spark, ("a", "1")))
    with monkeypatch.context() as p:
        p.setattr(KVStore, "_write", lambda *a: (_ for _ in ()).throw(RuntimeError("disk full")))
        with pytest.raises(RuntimeError):
            s.flush()
    assert state(s.scan()) == {"a": "1"} and s.flush() >= 0 and state(s.scan()) == {"a": "1"} and s.flush() == -1


def test_lost_part_of_a_run_is_seen(spark, tmp_path, monkeypatch):
    s = KVStore(spark, str(tmp_path / "s"))
    real = type(spark.read).parquet

    def lossy(self, *paths, **kw):
        return real(self, *paths, **kw).where("k <> 'b'") if "/runs/" in paths[0] else real(self, *paths, **kw)

    monkeypatch.setattr(type(spark.read), "parquet", lossy)
    with pytest.raises(RuntimeError, match="read back"):
        s.put(kvs(spark, ("a", "1"), ("b", "2")))


def test_tombstones_go_only_where_safe(spark, tmp_path):
    s = KVStore(spark, str(tmp_path / "s"))
    s.put(kvs(spark, ("a", "1")))
    s.delete(kvs(spark, ("a", None)).select("k"))
    assert s.compact(fan_in=2, drop_deleted=True) == [0, 1] and s.entries().count() == 0
    s.apply(log(spark, [(50, "DELETE", "x", None)]))
    s.apply(log(spark, [(51, "PUT", "y", "1")]))
    s.apply(log(spark, [(10, "PUT", "x", "late")]))
    with pytest.raises(ValueError):
        s.compact(bounds=(1,), fan_in=2, drop_deleted=True)
    assert state(s.scan()) == {"y": "1"}


def test_empty_batches(spark, tmp_path):
    s = KVStore(spark, str(tmp_path / "s"))
    s.apply(log(spark, [(1, "PUT", "a", "1")]).limit(0))
    s.put(kvs(spark, ("a", "1")).limit(0))
    assert s.scan().count() == 0 and s.commit_seq() == -1
    s.compact(fan_in=2)
    assert s.scan().count() == 0


def test_strong_and_fast_differ(spark):
    rows = log(spark, [(1, "PUT", "k", "applied"), (2, "PUT", "k", "committed")])
    bound = lambda level, node=None: consistency.read_bound(consistency.Consistency.parse(level), 2, {"n1": 1, "n2": 0}, "n1", node)
    assert state(consistency.read_as_of(rows, bound("strong"))) == {"k": "committed"}
    assert state(consistency.read_as_of(rows, bound("fast"))) == {"k": "applied"}
    assert state(consistency.read_as_of(rows, bound("eventual", "n2"))) == {}
    assert {(r["node"], r["v"]) for r in consistency.replica_states(rows, {"a": 1, "b": 2, "c": 0}).collect()} == {("a", "applied"), ("b", "committed")}


def test_client(spark, tmp_path, capsys):
    run = lambda *a: (cli.main(["--root", str(tmp_path / "s"), *a], spark), capsys.readouterr())
    assert run("put", "a", "1")[0] == 0
    code, out = run("get", "a", "--consistency", "Eventual")
    assert (code, out.out) == (0, "1\n")
    assert run("delete", "a")[0] == 0
    code, out = run("get", "a")
    assert (code, out.out) == (1, "not found\n")
    code, out = run("get", "a", "--consistency", "linear")
    assert code == 2 and "unknown consistency" in out.err
    assert run("get", "a", "--node", "n2")[0] == 2
    assert "2 memtable batches" in run("status")[1].out


# binary files


def test_log_files_written_cut_and_read(spark, tmp_path):
    folder = f"file://{tmp_path}/logs"
    rows = [(7, i, f"k{i % 3}", None if i % 4 == 0 else "é" * i) for i in range(20)] + [(8, 1, "", "empty key")]
    d = spark.createDataFrame(rows, "run_id long, seq long, k string, v string").repartition(5)
    done = {r["run_id"]: (r["n_records"], r["n_bytes"]) for r in binary.write_wal_files(d, folder).collect()}
    size = lambda k, v: 20 + len(k.encode()) + len((v or "").encode())
    assert done == {7: (20, sum(size(k, v) for r, _, k, v in rows if r == 7)), 8: (1, size("", "empty key"))}
    got = binary.read_wal_files(spark, folder).where("ok").collect()
    assert {(int(r["wal_file"].rsplit("/", 1)[1][:-4]), r["seq"], r["key"].decode(), r["value"].decode()) for r in got} == {(r, s, k, v or "") for r, s, k, v in rows}
    assert all(r["crc"] == zlib.crc32(bytes(r["key"] + r["value"])) for r in got)
    with open(tmp_path / "logs" / "8.log", "ab") as f:
        f.write(b"\xff\x00\x11")
    cut = {r["wal_file"].rsplit("/", 1)[1]: (r["n_kept"], r["n_cut"]) for r in binary.cut_tails(spark, folder).collect()}
    assert cut == {"7.log": (done[7][1], 0), "8.log": (done[8][1], 3)}
    assert (tmp_path / "logs" / "8.log").stat().st_size == done[8][1]
    assert binary.read_wal_files(spark, folder).where("not ok").count() == 0


def test_run_file_lookups(spark, tmp_path):
    rows = [(f"key-{i:03d}".encode(), f"val-{i:03d}".encode()) for i in range(0, 200, 2)]
    image = binary.encode_run(rows)
    bits, index, end = binary.open_run(image)
    assert len(bits) == 125 and [o for _, o in index] == [0, 1034, 2068] and end == 2200
    keys = [f"key-{i:03d}".encode() for i in range(200)] + [b"", b"zzz", b"key-"]
    assert binary.find_in_run(image, keys) == rows
    assert bloom.may_contain(bits, murmur3_array([k for k, _ in rows])).all() and bloom.may_contain(b"", murmur3_array([b"x"])).all()
    assert binary.find_in_run(binary.encode_run([]), keys) == []
    folder = f"file://{tmp_path}/runs"
    e = spark.createDataFrame([(r, k, v) for r in (1, 2) for k, v in rows[r:]], "run_id long, key binary, value binary")
    assert {r["run_id"] for r in binary.write_run_files(e, folder).collect()} == {1, 2}
    asked = spark.createDataFrame([("key-002",), ("key-003",), ("key-004",), (None,)], "k string")
    got = {(r["run_id"], r["key"].decode()) for r in binary.get_from_run_files(spark, folder, asked).collect()}
    assert got == {(1, "key-002"), (1, "key-004"), (2, "key-004")}


def test_stored_filters_merge_with_files(spark):
    keys = [f"user-{i:05d}" for i in range(3000)]
    f = bloom.to_bytes(bloom.build_filters(spark.createDataFrame([(1, k) for k in keys], "run_id long, key string"))).collect()[0]
    assert bytes(f["bits"]) == binary.bloom_bytes([k.encode() for k in keys])


@pytest.mark.parametrize("block", [1, 1 << 24])
def test_probe_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(bloom, "BLOCK_BYTES", block)
    monkeypatch.setattr(bloom, "CHUNK_KEYS", 7)
    e = spark.createDataFrame([(i % 4, f"k{i}") for i in range(60)], "run_id long, key string")
    got = {(r["key"], r["run_id"]) for r in bloom.probe(bloom.build_filters(e), e).collect()}
    assert {(f"k{i}", i % 4) for i in range(60)} <= got and len(got) < 90


def test_probe_is_dealt_by_pairs(spark, monkeypatch):
    """Exactly the pairs that the stored bits admit, from tasks whose number grows with the pairs: filters of one size together, others alone."""
    monkeypatch.setattr(bloom, "TASK_PAIRS", 3000, raising=False)
    own = {i - 5: [f"k{j}" for j in range(9 * i, 9 * i + 60)] for i in range(70)} | {900: [f"k{j}" for j in range(300)]}
    f = spark.createDataFrame([(i, 8 * len(b), b) for i, k in own.items() for b in [binary.bloom_bytes([x.encode() for x in k])]], "run_id long, n_bits long, bits binary")
    keys = [f"k{j}" for j in range(800)]
    asked = spark.createDataFrame([(k,) for k in [*keys, "k1", None]], "key string").repartition(3)
    rows = bloom.probe(f, asked).select("key", "run_id", F.spark_partition_id().alias("part")).collect()
    want = set()
    for r in f.collect():
        bits = int.from_bytes(r["bits"], "little")
        for k, h in zip(keys, map(int, murmur3_array([x.encode() for x in keys])), strict=True):
            step = (h >> 17 | h << 15) & 0xFFFFFFFF
            if all(bits >> ((h + i * step) & 0xFFFFFFFF) % r["n_bits"] & 1 for i in range(7)):
                want.add((k, r["run_id"]))
    assert len({r["part"] for r in rows}) > 4
    assert len(rows) == len(want) and {(r["key"], r["run_id"]) for r in rows} == want > {(k, i) for i in own for k in own[i]}
    assert bloom.probe(f.limit(0), asked).count() == bloom.probe(f, asked.limit(0)).count() == 0


def test_stored_filters_in_batches(spark):
    rows = [(i % 5 - 2, f"user:{j}") for i in range(5) for j in range(40 * i + 1)] * 2
    e = spark.createDataFrame([*rows, (1, None), (None, "a")], "run_id long, key string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["run_id"]: (r["n_bits"], bytes(r["bits"])) for r in bloom.stored_filters(e).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {i: binary.bloom_bytes([k.encode() for k in {k for r, k in rows if r == i}]) for i in {r for r, _ in rows}}
    assert got == {i: (8 * len(b), b) for i, b in want.items()}


def test_seek_of_admitted_pairs(spark):
    """Offsets by bytes of the keys, found where the filters are; the pairs are not shuffled, sorted or joined."""
    from bisect import bisect_right

    from tidemark.queries import QUERIES

    keys = ["", "a", "aa", "b", "m", "z", "\xe9", "\ue000", "\U0001f600"]
    index = [(r, k, o) for r, ks in ((-7, "b\xe9"), (3, "am"), (3000000000, ["", "\ue000", "\U0001f600"]), (5, "a")) for o, k in enumerate(ks, 1)]
    f = spark.createDataFrame([(r, b"\xff" * 80) for r in (3, -7, 3000000000, 4)], "run_id long, bits binary")  # 4 has no entries, 5 no filter
    asked = spark.createDataFrame([(k,) for k in reversed(keys)], "key string")
    got = bloom.probe(f, asked, index=spark.createDataFrame([*index, (3, None, 9)], "run_id long, k string, offset long"))
    want = set()
    for r in (3, -7, 3000000000, 4):
        e = sorted((k.encode(), o) for i, k, o in index if i == r)
        at = [bisect_right([k for k, _ in e], k.encode()) for k in keys]
        want |= {(k, r, e[i - 1][1] if i else 0) for k, i in zip(keys, at, strict=True)}
    rows = [tuple(r) for r in got.select("key", "run_id", "offset").collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = QUERIES["sparse_index_seek"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


# sequence logic over ranges


@pytest.fixture()
def many_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_timeline_and_elections_over_ranges(spark, many_parts):
    """A node with nearly all samples spans many ranges; stretches that cross them stay whole."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else "cold", i, rng.choice([0, 0, 0, 1, 2]) if i % 7 else 0) for i in range(600)] + [("one", 5, 1)]
    want, hits = [], {}
    for node in ("hot", "cold", "one"):
        own = sorted((s, x) for n, s, x in rows if n == node)
        was, hits[node] = 0, 0
        for s, x in own:
            hits[node] += x == 1 and was != 1
            was = x
            if want and want[-1][0] == node and want[-1][1] == x:
                want[-1] = (node, x, want[-1][2], s, want[-1][4] + 1)
            else:
                want.append((node, x, s, s, 1))
    d = spark.createDataFrame(rows, "node string, seq long, state int").repartition(5)
    assert ranged.ranged(d.where("node = 'hot'"), "node", "seq").select("_part").distinct().count() > 3
    assert sorted(tuple(r) for r in obs.state_timeline(d).collect()) == sorted(want)
    assert {r["node"]: r["n"] for r in obs.elections(d).collect()} == hits
    assert obs.state_timeline(d.limit(0)).count() == 0 and obs.elections(d.limit(0)).count() == 0


def test_index_seek_over_ranges(spark, many_parts):
    from bisect import bisect_right

    idx = [(r, f"{i:04d}", i * 10) for r, n in ((1, 400), (2, 3)) for i in range(0, n, 5)]
    probes = [(r, f"{i:04d}") for r in (1, 2, 3) for i in range(0, 420, 3)] + [(1, "")]
    got = lookup.index_seek(spark.createDataFrame(idx, "run_id long, k string, offset long"), spark.createDataFrame(probes, "run_id long, k string"))
    want = set()
    for r, k in probes:
        own = [(x, o) for q, x, o in idx if q == r]
        at = bisect_right([x for x, _ in own], k)
        want.add((r, k, own[at - 1][1] if at else 0))
    assert {tuple(r) for r in got.collect()} == want


def test_sparse_index_of_a_long_run(spark):
    """Entries of a run that spans many batches equal a plain walk."""
    rows = [(i, "PUT", f"k{i:06d}", "v" * (i % 50), 1) for i in range(25_000)]
    got = [(r["k"], r["offset"]) for r in runs.sparse_index(spark.createDataFrame(rows, LOG + ", run_id long")).orderBy("offset").collect()]
    want, at, last = [], 0, None
    for _, _, k, v, _ in rows:
        if last is None or at - last >= 1024:
            want.append((k, at))
            last = at
        at += 8 + len(k) + len(v)
    assert got == want


def test_compact_orders_by_sequence(spark):
    e = spark.createDataFrame([(9, "PUT", "k", "new", 1), (3, "PUT", "k", "old", 2)], LOG + ", run_id long")
    assert state(compaction.compact(e, [1, 2], 3)) == {"k": "new"}


def test_quantiles_by_window(spark):
    s = spark.createDataFrame([("2024-01-01 00:00:10", "get", "FAST", 0.004, False), ("2024-01-01 00:00:20", "get", "FAST", 9.0, True), ("2024-01-01 00:01:20", "get", "FAST", 9.0, None)], "ts string, method string, consistency string, value double, is_proxy boolean")
    s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["minute"].minute: r["value"] for r in obs.latency_quantile(s).collect()}
    assert got == {0: 0.00495, 1: 1.0}
    assert {r["n"] for r in obs.throughput(s).collect()} == {1}


def test_broadcast_by_rows_and_bytes(spark):
    from tidemark.session import broadcast_if_small

    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    d = spark.range(100).select("id", F.expr("repeat('x', 1000)").alias("text"), F.array("id", "id").alias("ids"))
    assert hinted(broadcast_if_small(d)) and not hinted(broadcast_if_small(d, rows=99)) and not hinted(broadcast_if_small(d, size=100_000))
    assert hinted(broadcast_if_small(d.drop("text"), size=100 * (8 + 16))) and not hinted(broadcast_if_small(d.drop("text"), size=100 * (8 + 16) - 1))
    assert hinted(broadcast_if_small(d.limit(0), rows=0, size=0))


def test_multi_get_without_broadcast(spark, monkeypatch):
    rows = log(spark, [(i, "DELETE" if i % 5 == 0 else "PUT", f"k{i % 7}", str(i)) for i in range(40)])
    keys = spark.createDataFrame([(f"k{i}",) for i in range(10)] + [(None,)], "k string")
    want = sorted(map(str, lookup.multi_get(rows, keys).collect()))
    monkeypatch.setattr(lookup, "broadcast_if_small", lambda df: df)
    assert sorted(map(str, lookup.multi_get(rows, keys).collect())) == want
