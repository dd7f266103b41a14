"""Chat formatting: keep the maximal logged conversations, then render them. DataFrame functions only.

A conversation logged again after each turn leaves snapshots that are prefixes of the last one. Turn i of a conversation
gets the rolling hash P_i, the XOR of hash(position, role, text) over its first i turns (two 64-bit lanes). A
conversation of n turns with hash P_n goes if another has the same P_n at turn n and more turns, and of equal
conversations the smallest conv_id stays.

Defined cases: turns are ordered by (turn, role, text), nulls first; rows that repeat a (turn, role, text) are one turn;
null role or text compare as equal to null only and render as empty; rows with null conv_id can't be put together, so
each that differs is a conversation of one turn, held against no other (conv_id null): no group gathers them; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cell(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n"))


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, n (position from 1), p1 and p2 (hash of the first n turns)."""
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null").distinct()
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("n", F.row_number().over(order).cast("long"))
    turns = turns.withColumn("h1", F.xxhash64("n", _cell("role"), _cell("text")))
    turns = turns.withColumn("h2", F.xxhash64(_cell("text"), F.lit("/"), _cell("role"), F.col("n")))
    run = W.partitionBy("conv_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    return turns.withColumn("p1", F.bit_xor("h1").over(run)).withColumn("p2", F.bit_xor("h2").over(run))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id of the conversations that no longer one begins with, the smallest of equal ones."""
    last = W.partitionBy("conv_id")
    rows = prefixes.select("conv_id", "n", "p1", "p2").withColumn("n_turns", F.max("n").over(last))
    whole = rows.where("n = n_turns").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    inner = rows.where("n < n_turns").select("n", "p1", "p2").distinct()
    return whole.hint("shuffle_merge").join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id")


def render_chats(conversations: DataFrame, begin: str = "<|", middle: str = "|>\n", end: str = "\n<|end|>\n") -> DataFrame:
    """conv_id, n_turns, rendered: each maximal conversation as one string."""
    prefixes = turn_prefixes(conversations)
    kept = maximal_conversations(prefixes).withColumnRenamed("conv_id", "_kept")
    turns = prefixes.hint("shuffle_merge").join(kept, F.col("conv_id") == F.col("_kept"), "left_semi")
    empty = F.lit("")
    piece = F.concat(F.lit(begin), F.coalesce("role", empty), F.lit(middle), F.coalesce("text", empty), F.lit(end))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", piece.alias("s")))).alias("t"))
    whole = grouped.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.concat_ws("", F.col("t.s")).alias("rendered"))
    alone = conversations.where("conv_id is null").select("conv_id", "turn", "role", "text").distinct()
    return whole.union(alone.select("conv_id", F.lit(1).cast("long").alias("n_turns"), piece.alias("rendered")))
