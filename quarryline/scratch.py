"""Intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast; with more, both sides of a join are shuffled.
FEW = 1_000_000
_SCRATCH: list[tuple[weakref.ref, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where it is unset, as
    in tests, is a folder in the warehouse used instead.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def save(df: DataFrame, name: str, light: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, so a lost executor repeats no earlier stage, and gives
    the planner the true size, by which it decides on broadcasts and splits
    hot keys of joins.  A ``light`` table, of a few numbers for each document
    at most, is written by four tasks for each core rather than one for each
    shuffle partition, as opening a file is what takes long there.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/quarryline-{uuid.uuid4().hex}/{name}"
    _SCRATCH.append((weakref.ref(spark), path))
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if light else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, so that they don't lie about while later steps write theirs."""
    for df in tables:
        spark, path = df.sparkSession, df.saved_at
        at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


def release(spark: SparkSession) -> None:
    """Delete all scratch tables; results that still read them become invalid."""
    jvm = spark._jvm
    while _SCRATCH:
        _, path = _SCRATCH.pop()
        at = jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _SCRATCH:
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone
            pass


atexit.register(_at_exit)


def few(rows: DataFrame, name: str, size: Column | None = None) -> DataFrame:
    """The rows as a saved table, to be broadcast in joins if there are ``FEW`` at most, each counted as ``size``."""
    rows = save(rows, name)
    n = rows.agg(F.coalesce(F.sum(F.lit(1) if size is None else size), F.lit(0))).first()[0]
    return F.broadcast(rows) if n <= FEW else rows
