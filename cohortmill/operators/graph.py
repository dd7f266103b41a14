"""Connected components over edge lists that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, observed, stage


def _split(u: str | Column) -> Column:
    """A second join key made of the first: the join then shuffles both sides anew instead of taking over an aggregate's
    partitioning, so that adaptive execution can split a hub's partition."""
    return F.pmod(F.xxhash64(u), F.lit(1 << 20))


def _with(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (u, v) beside the m of their u."""
    return rows.withColumn("s", _split("u")).hint("shuffle_merge").join(least.withColumn("s", _split("u")), ["u", "s"]).drop("s")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node name reachable from each node of an edge list, by alternating large-star and
    small-star steps. Rows with a null end are no edges; an edge from a node to itself makes it a node of its own. Every
    node comes once; the result is a staged table.

    A round (both steps) is one job whose edge table is written to the shared folder, so lineage stays short; its hash,
    taken while it is written, tells when a round changes nothing. Minima are aggregated before the shuffle, and joins on
    a hub can be split.
    """
    whole = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = whole.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    state = {"n": "count(1)", "x": "bit_xor(xxhash64(u, v))", "y": "bit_xor(xxhash64(v, u))", "pairs": "count_if(u <> v)"}
    e = stage(e, "edges", **state)
    lone, before = e, tuple(observed(e, k) for k in ("n", "x", "y"))
    if observed(e, "pairs"):
        e = e.where("u <> v")
        while True:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = _with(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = _with(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", **state)
            after = tuple(observed(small, k) for k in ("n", "x", "y"))
            if e is not lone:
                drop(e)
            e = small
            if after == before:
                break
            before = after
    else:
        e = e.where("u <> v")
    named = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct()  # now the edges are stars: no root is a u
    out = named.union(roots.select("node", F.col("node").alias("component")))
    if observed(lone, "n") > observed(lone, "pairs"):
        more = lone.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
        out = out.union(more.hint("shuffle_merge").join(out.select("node"), "node", "left_anti"))
    out = stage(out, "components")
    drop(e, lone)
    return out
