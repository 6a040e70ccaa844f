"""Session construction and the two cluster facts operators need: where shared files go, and how large a side is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its measured rows and bytes are at most these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def get_session(app: str = "tidemark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the cluster's own session instead."""
    n = str(cpus) if cpus else "*"
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus or 8))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); set to a local one only where it is unset, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, which cuts its lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(f: T.StructField) -> Column:
    """Bytes of a column's value."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(f.dataType, T.ArrayType):
        return F.when(c.isNull(), 0).otherwise(8 * F.size(c))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``rows`` rows and ``size`` bytes, counted (never assumed); beyond that Spark shuffles.

    Counting evaluates ``df``, so give it a saved table or a cheap plan.
    """
    width = sum((_width(f) for f in df.schema.fields), F.lit(0)).cast("long")
    n, b = df.select(width.alias("_width")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("_width"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and b <= size else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
