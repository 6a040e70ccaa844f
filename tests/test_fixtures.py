"""Small fixtures: resolution, lookups, runs, logs, compaction, store, streaming and their edge cases."""

import itertools
import os
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bloom, kv
from tidemark.functions.murmur import murmur3_array
from tidemark.operators import compaction, consistency, lookup, resolve, runs, validate
from tidemark.plans import observability as obs
from tidemark.plans.store import KVStore
from tidemark.sources import binary

LOG = "seq long, op string, k string, v string, run_id long"


def log(spark, *rows):
    return spark.createDataFrame([(*r, 0)[:5] if len(r) == 4 else r for r in rows], LOG)


def state(df):
    return {r["k"]: r["v"] for r in df.collect()}


def test_update_and_tombstones(spark):
    d = log(spark, (1, "PUT", "config", "v1"), (2, "PUT", "config", "v2"), (3, "PUT", "a", "x"), (4, "DELETE", "a", None), (5, "PUT", "e", ""), (6, "PUT", "n", None), (7, "PUT", "", "empty key"), (8, "PUT", "é\x80", "u"))
    assert state(resolve.scan_all(d)) == {"config": "v2", "": "empty key", "é\x80": "u"}
    assert state(resolve.scan_all(d, 3)) == {"config": "v2", "a": "x"}
    assert state(resolve.scan_all(d.limit(0))) == {}


def test_order_is_by_sequence_not_arrival(spark):
    d = log(spark, (9, "PUT", "k", "new"), (1, "PUT", "k", "old")).repartition(4)
    assert state(resolve.scan_all(d)) == {"k": "new"}


def test_merge_three_runs(spark):
    r = [log(spark, *[(0, "PUT", k, str(i), i) for k in ks]) for i, ks in ((1, "AB"), (2, "BC"), (3, "AD"))]
    assert state(resolve.merge_runs(r)) == {"A": "3", "B": "2", "C": "2", "D": "3"}


def test_multi_get_reasons(spark):
    d = log(spark, (1, "PUT", "a", "1"), (2, "DELETE", "b", None))
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "k string")
    assert {r["k"]: r["reason"] for r in lookup.multi_get(d, keys).collect()} == {"a": "found", "b": "tombstone", "c": "absent", None: "absent"}
    assert lookup.get_point(d, "zz").collect()[0]["found"] is False


def test_murmur_and_bloom(spark):
    assert int(murmur3_array([b"hello"])[0]) == 613153351
    assert len(binary.bloom_bytes([b"x"] * 5)) == 80
    e = spark.createDataFrame([(1, k) for k in ("apple", "banana", "cherry")], "run_id long, key string")
    f = bloom.build_filters(e)
    p = spark.createDataFrame([(k,) for k in ("apple", "banana", "cherry", "grape", "orange", "pear")], "key string")
    assert {r["key"] for r in bloom.probe(f, p).where("maybe").collect()} == {"apple", "banana", "cherry"}
    bits = binary.bloom_bytes([b"apple", b"banana", b"cherry"])
    on = {i for i in range(8 * len(bits)) if bits[i >> 3] >> (i & 7) & 1}
    assert on == set(f.collect()[0]["positions"])


def test_run_layout(spark):
    rows = [(f"key-{i:03d}".encode(), f"val-{i:03d}".encode()) for i in range(100)]
    image = binary.encode_run(rows)
    assert len(image) == 2406 and len(binary.encode_run([])) == 104
    assert list(binary.decode_run(image)) == rows
    d = log(spark, *[(i, "PUT", k.decode(), v.decode(), 7) for i, (k, v) in enumerate(rows)])
    assert sorted(r["offset"] for r in runs.sparse_index(d).collect()) == [0, 1034, 2068]
    lay = runs.layout_bytes(d).collect()[0]
    assert lay["data_bytes"] + lay["bloom_bytes"] + lay["fixed_bytes"] + 3 * (12 + 7) == 2406
    with pytest.raises(ValueError):
        list(binary.decode_run(b"short"))


def test_index_seek(spark):
    idx = spark.createDataFrame([(1, "b", 0), (1, "m", 1034)], "run_id long, k string, offset long")
    p = spark.createDataFrame([(1, k) for k in "abcz"], "run_id long, k string")
    assert {r["k"]: r["offset"] for r in lookup.index_seek(idx, p).collect()} == {"a": 0, "b": 0, "c": 0, "z": 1034}


def test_log_files(spark, tmp_path):
    good = binary.encode_wal([(1, b"user:101", b"Thomas"), (2, b"user:102", b"Davis"), (3, b"gone", None)])
    (tmp_path / "a.log").write_bytes(good + b"\xff\x00\x11")
    (tmp_path / "b.log").write_bytes(good[:-1] + struct.pack("B", good[-1] ^ 1) + good)
    (tmp_path / "c.log").write_bytes(b"")
    got = binary.read_wal_files(spark, str(tmp_path)).withColumn("f", F.element_at(F.split("wal_file", "/"), -1))
    ok = runs.recover_prefix(got, "wal_file", "offset").groupBy("f").count().collect()
    assert {r["f"]: r["count"] for r in ok} == {"a.log": 3, "b.log": 2}


def test_run_files(spark, tmp_path):
    e = spark.createDataFrame([(5, b"b", b"2"), (5, b"a", None), (6, b"c", b"3")], "run_id long, key binary, value binary")
    for r in binary.run_images(e).collect():
        (tmp_path / f"{r['run_id']}.run").write_bytes(r["content"])
    back = {(r["run_id"], bytes(r["key"]), bytes(r["value"])) for r in binary.read_run_files(spark, str(tmp_path)).collect()}
    assert back == {(5, b"a", b""), (5, b"b", b"2"), (6, b"c", b"3")}


def test_run_files_get_is_linear(spark, tmp_path):
    """Run files answer through filter and index, and are not crossed with the asked keys."""
    rows = {i: [(f"k{j:03d}".encode(), f"{i}-{j}".encode()) for j in range(i, 300, 3)] for i in range(3)}
    for i, r in rows.items():
        (tmp_path / f"{i}.run").write_bytes(binary.encode_run(r))
    dark = bytearray(binary.encode_run(rows[0]))  # no bit of its filter is set
    end = struct.unpack_from("<q", dark, len(dark) - 8)[0]
    size = struct.unpack_from("<I", dark, end)[0]
    dark[end + 4 : end + 4 + size] = bytes(size)
    (tmp_path / "9.run").write_bytes(dark)
    asked = spark.range(-50, 400).selectExpr("format_string('k%03d', id) as k").where("k <> 'k007'").unionByName(spark.createDataFrame([(None,), ("k001",)], "k string"))
    got = binary.get_from_run_files(spark, str(tmp_path), asked)
    want = sorted((i, k, v) for i, r in rows.items() for k, v in r if k != b"k007")
    assert sorted((r["run_id"], bytes(r["key"]), bytes(r["value"])) for r in got.collect()) == want
    assert binary.find_in_run(binary.encode_run(rows[1]), [b"k298", b"k000", b"k001", b"zz"]) == [(b"k001", b"1-1"), (b"k298", b"1-298")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("tiers", [[0, 0, 0, 1, 1, 1, 1, 0], [1] * 6, [0, 1, 0, 1], [2, 0, 0, 0, 0, 2, 2, 2, 2], []])
def test_pick_equals_greedy(spark, tiers):
    want = next(([*range(i, i + 4)] for i in range(len(tiers) - 3) if len(set(tiers[i : i + 4])) == 1), [])
    s = spark.createDataFrame([(i * 10, t) for i, t in enumerate(tiers)], "run_id long, tier int")
    assert sorted(r["run_id"] // 10 for r in compaction.pick(s).collect()) == want


def test_addresses(spark):
    d = spark.createDataFrame([("127.0.0.1:7001",), ("",), ("invalid-addr-format",), (None,), ("h:x1",)], "a string")
    assert [r[0] for r in d.select(kv.leader_address(F.col("a"))).collect()] == ["127.0.0.1:8001", None, None, None, None]


def test_validation(spark):
    ok, bad = validate.split(log(spark, (1, "PUT", "a", "1"), (2, "999", "ghost", "x"), (3, "PUT", None, "x"), (4, None, "b", "x")))
    assert [r["k"] for r in ok.collect()] == ["a"]
    assert sorted(r["status"] for r in bad.collect()) == ["bad_payload", "unknown_op", "unknown_op"]


def test_consistency():
    C = consistency.Consistency
    at = {"n1": 90, "n2": 50}
    assert consistency.read_bound(C.parse(" Strong "), 99, at, "n1") == 99
    assert consistency.read_bound(C.FAST, 99, at, "n1") == 90
    assert consistency.read_bound(C.EVENTUAL, 99, at, "n1", "n2") == 50
    for level in (C.STRONG, C.FAST):
        with pytest.raises(consistency.NotLeader):
            consistency.read_bound(level, 99, at, "n1", "n2")
    with pytest.raises(ValueError):
        C.parse("linear")


def test_store(spark, tmp_path):
    kvs = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    s = KVStore(spark, str(tmp_path / "s"))
    s.put(kvs(("a", "1"), ("b", "1")))
    s.put(kvs(("b", "2"), ("c", "2")))
    s.delete(kvs(("a", None)).select("k"))
    s.put(kvs(("d", "3")), batch_id=0)
    assert s.put(kvs(("d", "9")), batch_id=0) == -1
    want = {"b": "2", "c": "2", "d": "3"}
    assert state(s.scan()) == want
    assert s.get_one("a").collect()[0]["found"] is False
    chosen = s.compact()
    assert chosen == [0, 1, 2, 3] and state(s.scan()) == want
    assert len(s.collect_garbage()) == 4 and state(s.scan()) == want
    assert s.level(4).where("op = 'DELETE'").count() == 1
    s.snapshot(str(tmp_path / "snap"))
    t = KVStore(spark, str(tmp_path / "t"))
    t.put(kvs(("trash_key", "x")))
    t.restore(str(tmp_path / "snap"))
    assert state(t.scan()) == want
    t.put(kvs(("b", "4")))
    assert state(t.scan())["b"] == "4"
    t.purge()
    assert state(t.scan()) == {}
    t.close()
    with pytest.raises(RuntimeError):
        t.put(kvs(("x", "1")))
    assert state(KVStore(spark, str(tmp_path / "s")).scan()) == want


@pytest.mark.parametrize("cuts", list(itertools.combinations(range(1, 6), 2))[:4])
def test_batches_do_not_matter(spark, tmp_path, cuts):
    rows = [(i, "DELETE" if i % 4 == 3 else "PUT", f"k{i % 3}", str(i)) for i in range(6)]
    s = KVStore(spark, str(tmp_path / "s"))
    for a, b in itertools.pairwise((0, *cuts, 6)):
        s.apply(log(spark, *rows[a:b]))
    assert state(s.scan()) == state(resolve.scan_all(log(spark, *rows)))


def test_streaming(spark, sf, tmp_path):
    from tidemark.sources.changelog import from_events
    from tidemark.streaming import live

    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    src = live.stream_events(spark, str(tmp_path / "in"), e.schema)
    s = KVStore(spark, str(tmp_path / "s"))
    live.flush_to_store(src, s, str(tmp_path / "cp")).awaitTermination()
    assert len(s.manifest.load()["runs"]) == 3
    out = live.live_table(from_events(src)).writeStream.outputMode("complete").format("memory").queryName("lt").trigger(availableNow=True).start()
    out.awaitTermination()
    want = state(resolve.scan_all(from_events(e)))
    assert state(resolve.drop_tombstones(spark.table("lt"))) == want
    w = live.windowed_throughput(src).writeStream.outputMode("complete").format("memory").queryName("tp").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("tp").agg(F.sum("n")).first()[0] == e.count()


def test_histogram_edges(spark):
    s = spark.createDataFrame([("m", 0.001), ("m", 5.0), ("m", 6.0)], "method string, value double")
    assert obs.quantile(obs.histogram(s), 0.99).collect()[0]["value"] == 1.0
    assert obs.histogram(s.limit(0)).count() == 0
    assert os.path.basename(__file__)
