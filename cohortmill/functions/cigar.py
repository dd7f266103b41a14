"""Alignment programs (CIGAR) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

QUERY, REFERENCE, ALIGNED = "MIS=X", "MDN=X", "M=X"


def operations(cigar: str | Column) -> Column:
    """Array of (n, op)."""
    c = col(cigar)
    n, op = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("int").alias("n"), b.alias("op")))


def length_of(ops: Column, which: str) -> Column:
    """Bases of the operations in ``which``."""
    return F.aggregate(ops, F.lit(0), lambda s, x: s + F.when(F.instr(F.lit(which), x["op"]) > 0, x["n"]).otherwise(0))


def blocks(cigar: str | Column, pos: str | Column) -> Column:
    """Array of aligned blocks (query0, ref0, n): where each run of M, = or X lies on the query and on the reference."""
    ops = operations(cigar)
    before = lambda i, which: F.aggregate(F.slice(ops, 1, i), F.lit(0), lambda s, x: s + F.when(F.instr(F.lit(which), x["op"]) > 0, x["n"]).otherwise(0))
    every = F.transform(ops, lambda x, i: F.struct(before(i, QUERY).alias("query0"), (col(pos) + before(i, REFERENCE)).alias("ref0"), x["n"].alias("n"), x["op"].alias("op")))
    return F.filter(every, lambda b: F.instr(F.lit(ALIGNED), b["op"]) > 0)
