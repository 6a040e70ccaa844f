"""Reads at strong, fast and eventual consistency, modelled as upper bounds on the sequence."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.resolve import drop_tombstones, scan_all


class Consistency(Enum):
    """STRONG reads the commit point, FAST the leader's applied point, EVENTUAL any node's."""

    STRONG, FAST, EVENTUAL = 0, 1, 2

    @classmethod
    def parse(cls, name: str) -> Consistency:
        try:
            return cls[name.strip().upper()]
        except KeyError:
            raise ValueError(f"unknown consistency {name!r}; one of {', '.join(x.name for x in cls)}") from None


class NotLeader(RuntimeError):
    """A strong or fast read asked of a follower."""


def read_bound(level: Consistency, commit_seq: int | Column, applied: dict[str, int | Column], leader: str | None, node: str | None = None) -> int | Column:
    """The sequence a read may see; strong and fast reads of another node than the leader fail."""
    node = node or leader
    if level is Consistency.EVENTUAL:
        return applied[node]
    if leader is None or node != leader:
        raise NotLeader(f"{level.name} read on {node}: not the leader")
    return commit_seq if level is Consistency.STRONG else applied[leader]


def read_as_of(log: DataFrame, bound: int | Column) -> DataFrame:
    return scan_all(log, bound)


def replica_states(log: DataFrame, applied: dict[str, int | Column]) -> DataFrame:
    """(node, k, v) live on each replica; ``applied`` maps nodes to positions.

    One aggregation keeps the newest version up to each position, so the log is
    read and shuffled once, whatever the number of replicas.
    """
    versions = F.struct("op", "v")
    seen = [F.max_by(versions, F.when(F.col("seq") <= at, F.col("seq"))).alias(f"w{i}") for i, at in enumerate(applied.values())]
    rows = F.array(*[F.struct(F.lit(n).alias("node"), F.col(f"w{i}").alias("w")) for i, n in enumerate(applied)])
    each = log.groupBy("k").agg(*seen).select("k", F.explode(rows).alias("r")).where("r.w is not null")
    return drop_tombstones(each.select("r.node", "k", "r.w.op", "r.w.v")).select("node", "k", "v")


def stale_report(log: DataFrame, commit_seq: int | Column, applied_seq: int | Column) -> DataFrame:
    """(k, fresh, stale) where a replica's view differs from the committed one; null is absent."""
    a = scan_all(log, commit_seq).select("k", F.col("v").alias("fresh"))
    b = scan_all(log, applied_seq).select("k", F.col("v").alias("stale"))
    return a.join(b, "k", "full_outer").where(~F.col("fresh").eqNullSafe(F.col("stale")))
