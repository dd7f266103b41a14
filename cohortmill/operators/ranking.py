"""Windows, ordered operators and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flag_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "is_best") -> DataFrame:
    """All rows, with true for the first of each key by ``order``."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)


def flag_first(df: DataFrame, key: str, order: str, name: str = "is_first") -> DataFrame:
    """All rows, with true for those of the least ``order`` of their key. The least is aggregated before the shuffle and joined with
    a second key, so that a key that many rows share is split over tasks."""
    split = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_least")).withColumn("_s", split)
    return df.withColumn("_s", split).hint("shuffle_merge").join(least, [key, "_s"], "left").withColumn(name, F.coalesce(F.col(order) == F.col("_least"), F.lit(False))).drop("_s", "_least")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def order_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "order_index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def gap_clusters(df: DataFrame, keys: Sequence[str], position: str, gap: int, name: str = "cluster") -> DataFrame:
    """Numbers the runs of positions that are at most ``gap`` apart, from 1."""
    over = W.partitionBy(*keys).orderBy(position)
    step = F.col(position) - F.lag(position).over(over)
    return df.withColumn("_new", F.when(step <= gap, 0).otherwise(1)).withColumn(name, F.sum("_new").over(over.rangeBetween(W.unboundedPreceding, 0))).drop("_new")


def marked_neighbours(df: DataFrame, keys: Sequence[str], position: str, mark: Column, reach: int, name: str = "neighbours") -> DataFrame:
    """Marked rows within ``reach`` positions on either side, the row itself left out."""
    over = W.partitionBy(*keys).orderBy(F.col(position).cast("long")).rangeBetween(-reach, reach)
    one = F.when(mark, 1).otherwise(0)
    return df.withColumn(name, F.sum(one).over(over) - one)


def round_robin(df: DataFrame, unit: Sequence[str], stratum: str, first: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of each unit: rows with ``first`` by order, then one of each stratum in turn, pass by pass.

    Adds ``pick``, the place in the selection from 1.
    """
    df = df.withColumn("_first", F.when(first, 0).otherwise(1))
    inside = W.partitionBy(*unit, "_first", F.when(F.col("_first") == 1, F.col(stratum))).orderBy(*order)
    # a row after the first ``cap`` of its stratum is never picked, so a unit brings at most cap rows of each to one task
    df = df.withColumn("_pass", F.row_number().over(inside)).where(F.col("_pass") <= cap)
    over = W.partitionBy(*unit).orderBy("_first", "_pass", stratum, *order)
    return df.withColumn("pick", F.row_number().over(over)).where(F.col("pick") <= cap).drop("_first", "_pass")


def n50(df: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """The length at which, from the longest down, half of a key's total is reached. Rows are summed per length first, so only
    distinct lengths of a key meet in one task."""
    sums = df.groupBy(*keys, length).agg(F.sum(length).alias("_s"))
    over = W.partitionBy(*keys).orderBy(F.desc(length)).rowsBetween(W.unboundedPreceding, 0)
    run = sums.withColumn("_sum", F.sum("_s").over(over)).withColumn("_all", F.sum("_s").over(W.partitionBy(*keys)))
    return run.where(F.col("_sum") * 2 >= F.col("_all")).groupBy(*keys).agg(F.max(length).alias("n50"))
