"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests, one machine), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as it is written; else they stay until the driver happens to collect
    its garbage, and the larger its heap the more of them lie on the executors' disks."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str, codec: str = "snappy", **seen: str) -> DataFrame:
    """Write a table once and read it back: cuts the lineage, survives the loss of executors and leaves no shuffle files. ``seen``: aggregates (SQL)
    that are computed while the rows are written; ``observed`` gives them, so that no further job counts rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    watch = Observation() if seen else None
    rows = df.observe(watch, *(F.expr(c).alias(k) for k, c in seen.items())) if seen else df
    with tidied(spark):
        rows.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    out._observed = watch.get if seen else {}
    return out


def observed(df: DataFrame, name: str):
    """An aggregate that ``stage`` took while writing; null (None) over an empty table."""
    return df._observed.get(name)


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 1 << 18) -> DataFrame:
    """The table dealt over tasks by ``keys``, about ``each`` of its ``rows`` to a task, so that what a task holds stays the same
    as the table grows; groups and joins by these keys need no further shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


def drop(*tables: DataFrame | None) -> None:
    """Delete staged tables that no later step reads, and those that a result ``_holds``."""
    for df in [x for t in tables for x in (t, *getattr(t, "_holds", ()))]:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


