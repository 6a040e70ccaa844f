"""KVStore: put, delete, get, scan, flush, compact, snapshot, restore and purge over a directory of Parquet runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.kv import COMPACTION_FAN_IN, TIER_BOUNDS, byte_len
from tidemark.operators import compaction, lookup, validate
from tidemark.operators.consistency import Consistency, read_bound
from tidemark.operators.resolve import drop_tombstones, lww, scan_all
from tidemark.schema import DELETE, PUT
from tidemark.session import cut
from tidemark.sources.manifest import Manifest

#: Expected distinct keys of a row group's Bloom filter.
BLOOM_NDV = 100_000
ROW = "seq long, op string, k string, v string, run_id long"


class KVStore:
    """One writer at a time; readers see the manifest version current when their plan was built.

    Every record has one place in a total order, ``seq``, and that alone decides
    between versions: not the run, the batch or the time of arrival. ``put`` and
    ``delete`` take the next place (a batch is one place, as it is applied as a
    whole); ``apply`` keeps the places of the log it is given, so late batches
    of older records do not hide newer ones.

    A batch joins the memtable, a list of small unsorted folders, until these
    hold ``memtable_limit`` bytes of keys and values; then they are flushed as
    one run: newest version per key, sorted by key, with a Bloom filter on the key
    column, so equality lookups skip row groups and pages. With a limit of 0
    each batch is flushed by itself.
    """

    def __init__(self, spark: SparkSession, root: str, replicas: dict[str, int] | None = None, leader: str | None = "n1", memtable_limit: int = 0):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, self.root)
        self.leader, self.replicas, self.memtable_limit = leader, replicas or {}, memtable_limit
        self.closed = False

    # writing

    def put(self, rows: DataFrame, order_by: str | None = None, batch_id: int | None = None) -> int:
        """Append puts (k, v); of rows of one key the greatest ``order_by``, then value, counts. Returns the run or memtable batch, -1 for one already applied."""
        return self._append(rows.select("k", F.col("v").cast("string").alias("v"), F.lit(PUT).alias("op"), (F.col(order_by) if order_by else F.lit(0)).cast("long").alias("o")), batch_id)

    def delete(self, keys: DataFrame, batch_id: int | None = None) -> int:
        return self._append(keys.select("k", F.lit(None).cast("string").alias("v"), F.lit(DELETE).alias("op"), F.lit(0).cast("long").alias("o")), batch_id)

    def apply(self, log: DataFrame, batch_id: int | None = None) -> int:
        """Append the valid commands of a changelog (seq, op, k, v) at their own places; see ``errors`` for the others."""
        return self._append(log.select("k", F.col("v").cast("string").alias("v"), "op", F.col("seq").cast("long").alias("o")), batch_id, own_places=True)

    @staticmethod
    def errors(log: DataFrame) -> DataFrame:
        """The commands that ``apply`` leaves out, with their ``status``: no key, or an operation that is neither PUT nor DELETE."""
        return validate.split(log)[1]

    def _append(self, rows: DataFrame, batch_id: int | None, own_places: bool = False) -> int:
        if self.closed:
            raise RuntimeError("store is closed")
        m = self.manifest.load()
        if batch_id is not None and m["batches"] and batch_id <= m["batches"][0]:
            return -1
        run = m["next_run"]
        valid, _ = validate.split(rows)
        place = F.col("w.o") if own_places else F.lit(m["next_seq"])
        newest = valid.groupBy("k").agg(F.max_by(F.struct("op", "v", "o"), F.struct("o", "v")).alias("w"))
        out = newest.select(place.cast("long").alias("seq"), "w.op", "k", "w.v", F.lit(run).cast("long").alias("run_id"))
        stats = self._write(out, run)
        m = m | {"next_run": run + 1, "next_seq": max(m["next_seq"], stats["max_seq"] + 1), "batches": m["batches"] if batch_id is None else [batch_id]}
        if self.memtable_limit <= 0:
            self.manifest.publish(m | {"runs": [*m["runs"], stats]})
            return run
        m = self.manifest.publish(m | {"memtable": [*m.get("memtable", []), stats]})
        if sum(x["n_bytes"] for x in m["memtable"]) >= self.memtable_limit:
            self.flush()
        return run

    def flush(self) -> int:
        """Write the memtable as one run; returns the run, or -1 if the memtable is empty. A failed flush leaves the memtable as it was."""
        m = self.manifest.load()
        held = m.get("memtable", [])
        if not held:
            return -1
        run = m["next_run"]
        rows = lww(self._read(held)).select("seq", "op", "k", "v", F.lit(run).cast("long").alias("run_id"))
        stats = self._write(rows, run)
        self.manifest.publish(m | {"runs": [*m["runs"], stats], "memtable": [], "next_run": run + 1})
        return run

    def _write(self, rows: DataFrame, run: int) -> dict:
        """Write a run and read it back: it must hold what a saved copy of the rows holds."""
        rows = cut(rows)
        expected = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("seq", "op", "k", "v").cast("decimal(38,0)")), F.lit(0))).first()
        path = f"{self.root}/runs/{run}"
        writer = rows.repartition("k").sortWithinPartitions("k").write.mode("overwrite")
        writer.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", str(BLOOM_NDV)).parquet(path)
        back = self.spark.read.schema(ROW).parquet(path)
        a = back.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("seq", "op", "k", "v").cast("decimal(38,0)")), F.lit(0)),
            F.sum(byte_len(F.col("k")) + byte_len(F.col("v"))), F.min("seq"), F.max("seq"),
        ).first()
        if (a[0], a[1]) != (expected[0], expected[1]):
            raise RuntimeError(f"run {run}: {a[0]} rows read back, {expected[0]} expected, or rows differ")
        return {"run": run, "path": path, "n_keys": a[0], "n_bytes": int(a[2] or 0), "min_seq": a[3], "max_seq": a[4] if a[4] is not None else -1}

    # reading

    def _read(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(*[r["path"] for r in parts]) if parts else self.spark.createDataFrame([], ROW)

    def log(self) -> DataFrame:
        """All entries of the current version, memtable included; a missing or unreadable run fails."""
        m = self.manifest.load()
        return self._read([*m["runs"], *m.get("memtable", [])])

    def level(self, run: int) -> DataFrame:
        """Entries of one run, for inspection."""
        return self.log().where(F.col("run_id") == run)

    def levels(self) -> DataFrame:
        """Every entry with its ``level``: memtable, or run."""
        m = self.manifest.load()
        return self._read(m.get("memtable", [])).withColumn("level", F.lit("memtable")).unionByName(self._read(m["runs"]).withColumn("level", F.lit("run")))

    def commit_seq(self) -> int:
        return self.manifest.load()["next_seq"] - 1

    def _bound(self, consistency: Consistency | str, node: str | None) -> int:
        level = Consistency.parse(consistency) if isinstance(consistency, str) else consistency
        applied = {self.leader: self.commit_seq()} | self.replicas
        return read_bound(level, self.commit_seq(), applied, self.leader, node)

    def get(self, keys: DataFrame, consistency: Consistency | str = Consistency.STRONG, node: str | None = None) -> DataFrame:
        """(k, reason, v) for the keys asked."""
        seen = self.log().where(F.col("seq") <= self._bound(consistency, node))
        return lookup.multi_get(seen, keys)

    def get_one(self, key: str, consistency: Consistency | str = Consistency.STRONG, node: str | None = None) -> DataFrame:
        return lookup.get_point(self.log().where(F.col("seq") <= self._bound(consistency, node)), key)

    def scan(self, consistency: Consistency | str = Consistency.STRONG, node: str | None = None) -> DataFrame:
        return scan_all(self.log(), self._bound(consistency, node))

    # maintenance

    def compact(self, bounds: tuple[int, ...] = TIER_BOUNDS, fan_in: int = COMPACTION_FAN_IN, drop_deleted: bool = False) -> list[int]:
        """Merge the first full tier into a new run with a name of its own and swap the manifest; [] if none is full.

        Tombstones may be dropped only where no older record is kept elsewhere:
        every other run must begin after all merged records.
        """
        m = self.manifest.load()
        if not m["runs"]:
            return []
        stats = self.spark.createDataFrame([(i, r["n_bytes"]) for i, r in enumerate(m["runs"])], "run_id long, n_bytes long")
        picked = sorted(r["run_id"] for r in compaction.pick(compaction.tiers(stats, bounds=bounds), fan_in).collect())
        if not picked:
            return []
        chosen = [m["runs"][i] for i in picked]
        others = [r for i, r in enumerate([*m["runs"], *m.get("memtable", [])]) if i not in picked and r["n_keys"]]
        top = max(r["max_seq"] for r in chosen)
        if drop_deleted and any(r["min_seq"] <= top for r in others):
            raise ValueError("tombstones may only go when no other run holds older records")
        names = [r["run"] for r in chosen]
        merged = compaction.compact(self._read(chosen), names, m["next_run"], drop_deleted).select("seq", "op", "k", "v", "run_id")
        stats_new = self._write(merged, m["next_run"])
        runs = m["runs"][: picked[0]] + [stats_new] + m["runs"][picked[-1] + 1 :]
        self.manifest.publish(m | {"runs": runs, "next_run": m["next_run"] + 1})
        return names

    def collect_garbage(self) -> list[str]:
        """Delete run folders that the current version does not name."""
        m = self.manifest.load()
        live, gone = {r["path"] for r in [*m["runs"], *m.get("memtable", [])]}, []
        for run in range(m["next_run"]):
            path = f"{self.root}/runs/{run}"
            if path not in live:
                self.manifest.delete(path)
                gone.append(path)
        return gone

    def snapshot(self, path: str, max_seq: int | None = None) -> None:
        """Live state as Parquet (k, v, seq)."""
        state = lww(self.log() if max_seq is None else self.log().where(F.col("seq") <= max_seq))
        drop_tombstones(state).select("k", "v", "seq").write.mode("overwrite").parquet(path)

    def restore(self, path: str) -> None:
        """Replace the whole state by a snapshot, which becomes the only run."""
        rows = self.spark.read.parquet(path)
        m = self.manifest.load()
        run = m["next_run"]
        stats = self._write(rows.select("seq", F.lit(PUT).alias("op"), "k", "v", F.lit(run).cast("long").alias("run_id")), run)
        self.manifest.publish(m | {"runs": [stats], "memtable": [], "next_run": run + 1, "next_seq": max(m["next_seq"], stats["max_seq"] + 1)})

    def purge(self) -> None:
        """An empty version; files go with the next garbage collection."""
        m = self.manifest.load()
        self.manifest.publish(m | {"runs": [], "memtable": [], "batches": []})

    def close(self) -> None:
        """Flush what the memtable holds, and accept no more writes."""
        if not self.closed:
            self.flush()
            self.closed = True

    def entries(self) -> DataFrame:
        """Resolved rows with tombstones."""
        return lww(self.log())
