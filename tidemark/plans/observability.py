"""The dashboard's queries over metric samples (ts, node, method, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranged import ranged

#: Fixed latency bucket bounds in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def served(samples: DataFrame) -> DataFrame:
    """The samples without proxied requests, which are counted where they are served."""
    return samples.where(~F.coalesce("is_proxy", F.lit(False))) if "is_proxy" in samples.columns else samples


def throughput(samples: DataFrame, seconds: int = 60) -> DataFrame:
    """(minute, method, n, rps) per tumbling window, proxied requests left out."""
    g = served(samples).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "method").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("minute"), "method", "n", F.round(F.col("n") / seconds, 6).alias("rps"))


def histogram(samples: DataFrame, bounds: tuple[float, ...] = LATENCY_BUCKETS, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(*by, le, n): cumulative counts at each bound, +Inf as infinity; one pass, no expansion of rows; proxied requests left out."""
    tops = [*bounds, float("inf")]
    counts = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(tops)]
    g = served(samples).groupBy(*by).agg(*counts)
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(tops)])
    return g.select(*by, F.explode(pairs).alias("p")).select(*by, "p.le", "p.n")


def quantile(hist: DataFrame, q: float, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """(*by, value): linear interpolation inside the bucket that holds rank q; the last finite bound beyond it."""
    w = Window.partitionBy(*by).orderBy("le")
    h = hist.withColumn("pn", F.lag("n", 1, 0).over(w)).withColumn("ple", F.lag("le", 1, 0.0).over(w)).withColumn("total", F.max("n").over(Window.partitionBy(*by)))
    at = h.where((F.col("n") >= q * F.col("total")) & (F.col("pn") < q * F.col("total")))
    inside = F.col("ple") + (F.col("le") - F.col("ple")) * (q * F.col("total") - F.col("pn")) / (F.col("n") - F.col("pn"))
    return at.select(*by, F.round(F.when(F.col("le") == float("inf"), F.col("ple")).otherwise(inside), 6).alias("value"))


def latency_quantile(samples: DataFrame, q: float = 0.99, seconds: int = 60) -> DataFrame:
    """(minute, method, consistency, value): the quantile of each window, method and consistency level."""
    by = ("minute", "method", "consistency")
    timed = samples.withColumn("minute", F.window("ts", f"{seconds} seconds")["start"])
    return quantile(histogram(timed, by=by), q, by)


def _changes(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples by ranges with ``was``, the state before in the range, and ``begun``, where the last change in the range was; and (node, _part, first, prev, turned, lead) of each range.

    A range's first sample is compared with the last of the range before. The
    ranges themselves are few: one row each is sorted per node.
    """
    own = ranged(samples.select("node", "seq", "state"), "node", "seq")
    w = Window.partitionBy("node", "_part").orderBy("seq")
    changed = (F.col("i") > 1) & ~F.col("state").eqNullSafe(F.col("was"))
    inner = own.withColumn("was", F.lag("state").over(w)).withColumn("i", F.row_number().over(w))
    inner = inner.withColumn("begun", F.max(F.when(changed, F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = inner.groupBy("node", "_part").agg(F.min(F.struct("seq", "state")).alias("first"), F.max(F.struct("seq", "state")).alias("last"), F.max("begun").alias("begun"))
    p = Window.partitionBy("node").orderBy("_part")
    ends = ends.withColumn("prev", F.lag("last").over(p))
    ends = ends.withColumn("turned", F.col("prev").isNull() | ~F.col("first.state").eqNullSafe(F.col("prev.state")))
    opened = F.when(F.col("turned"), F.col("first.seq"))
    ends = ends.withColumn("lead", F.coalesce(opened, F.max(F.greatest("begun", opened)).over(p.rowsBetween(Window.unboundedPreceding, -1))))
    return inner, ends


def state_timeline(samples: DataFrame) -> DataFrame:
    """(node, state, start_seq, end_seq, n): maximal stretches of one state per node (0 follower, 1 candidate, 2 leader).

    A stretch is named by the place where it begins, carried over ranges of
    ``seq``, so a node's history is spread over tasks.
    """
    inner, ends = _changes(samples)
    begun = inner.join(ends.select("node", "_part", "lead"), ["node", "_part"]).withColumn("start_seq", F.coalesce("begun", "lead"))
    return begun.groupBy("node", "start_seq", "state").agg(F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("n")).select("node", "state", "start_seq", "end_seq", "n")


def elections(samples: DataFrame) -> DataFrame:
    """(node, n): transitions into candidate; a node begins as follower."""
    inner, ends = _changes(samples)
    within = inner.groupBy("node").agg(F.count_if((F.col("i") > 1) & (F.col("state") == 1) & ~F.col("was").eqNullSafe(F.lit(1))).alias("n"))
    between = ends.groupBy("node").agg(F.count_if((F.col("first.state") == 1) & F.col("turned")).alias("n"))
    return within.unionByName(between).groupBy("node").agg(F.sum("n").alias("n"))


def gauge_last(samples: DataFrame, limit: float) -> DataFrame:
    """(node, value, over): the newest non-null value of a gauge and whether it exceeds its limit."""
    g = samples.where(F.col("value").isNotNull()).groupBy("node").agg(F.max_by("value", "seq").alias("value"))
    return g.withColumn("over", F.col("value") > limit)
