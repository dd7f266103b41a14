"""Coverage of references by fragments: bases of enough quality, counted once where mates overlap."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as C
from . import intervals
from .fragments import OUTCOMES, ambiguous_targets, has


def observed_runs(records: DataFrame, quality_min: int) -> DataFrame:
    """The records' columns with start0, end0: runs of the reference under aligned bases A, C, G or T of at least ``quality_min``.

    Needs pos, cigar, seq and qual. Each aligned block takes its part of the quality string, which a pattern cuts into runs of
    good and of other letters. Records without sequence or quality, or with quality of another length, have none.
    """
    good = f"[{re.escape(chr(33 + quality_min))}-~]"
    unread = F.array_join(F.zip_with(F.split("qual", ""), F.split("seq", ""), lambda q, s: F.when(s.isin(*"ACGT"), q).otherwise(" ")), "")
    read = F.when(F.col("seq").rlike("[^ACGT]"), unread).otherwise(F.col("qual"))  # a letter that is no base gets a blank
    whole = (F.col("seq") != "*") & (F.col("qual") != "*") & (F.length("seq") == F.length("qual"))
    rows = records.where(whole & ~has("flag", 4)).withColumn("_read", read)
    names = records.columns
    rows = rows.select(*names, "_read", F.explode(C.blocks("cigar", "pos")).alias("_b"))
    part = F.expr("substring(_read, _b.query0 + 1, _b.n)")
    rows = rows.select(*names, F.col("_b.ref0").cast("long").alias("_at"), F.regexp_extract_all(part, F.lit(f"({good}+|{good.replace('[', '[^', 1)}+)"), F.lit(1)).alias("_parts"))
    none = F.expr("cast(array() as array<struct<start0: bigint, end0: bigint>>)")

    def step(state, x):
        after = state["at"] + F.length(x)
        return F.struct(after.alias("at"), F.when(x.rlike(f"^{good}"), F.array_append(state["runs"], F.struct(state["at"].alias("start0"), after.alias("end0")))).otherwise(state["runs"]).alias("runs"))

    runs = F.aggregate("_parts", F.struct(F.col("_at").alias("at"), none.alias("runs")), step, lambda s: s["runs"])
    return rows.select(*names, F.explode(runs).alias("_r")).select(*names, "_r.*")


def fragment_cover(records: DataFrame, classes: DataFrame, references: DataFrame, quality_min: int = 20, ends: int = 0) -> DataFrame:
    """qname, rname, start0, end0: what each assigned fragment of ``classes`` covers of its reference (``references``: rname,
    length), without the reference's ``ends``; the intervals of a fragment are apart, so each base counts once for it."""
    primary = records.where(~has("flag", 256) & ~has("flag", 2048)).hint("shuffle_merge").join(classes.where(F.col("outcome") == OUTCOMES[-1]).select("qname"), "qname", "left_semi")
    sized = primary.hint("shuffle_merge").join(references.select("rname", F.col("length").alias("_length")), "rname")
    runs = observed_runs(sized.select("qname", "rname", "flag", "pos", "cigar", "seq", "qual", "_length"), quality_min)
    runs = runs.select("qname", "rname", F.greatest("start0", F.lit(ends)).alias("start0"), F.least(F.col("end0"), F.col("_length") - ends).alias("end0")).where("end0 > start0")
    before = W.partitionBy("qname", "rname").orderBy("start0", "end0").rowsBetween(W.unboundedPreceding, -1)  # two records
    apart = runs.withColumn("start0", F.greatest("start0", F.max("end0").over(before)))
    return apart.where("end0 > start0").select("qname", "rname", "start0", "end0")


def fragment_depth(cover: DataFrame) -> DataFrame:
    """rname, start0, end0, depth: maximal runs of equal positive depth, in fragments."""
    return intervals.segments_of(intervals.depth_events(cover, ["rname"]).where("d <> 0"), ["rname"])


def breadth(segments: DataFrame, references: DataFrame, min_depth: int = 1) -> DataFrame:
    """rname, length, covered, breadth, mean_depth of every reference; those without coverage have zeros."""
    size = F.col("end0") - F.col("start0")
    sums = segments.groupBy("rname").agg(F.sum(F.when(F.col("depth") >= min_depth, size).otherwise(0)).alias("c"), F.sum(size * F.col("depth")).alias("b"))
    out = references.select("rname", "length").hint("shuffle_merge").join(sums, "rname", "left")
    n = F.nullif(F.col("length"), F.lit(0))
    covered, bases = F.coalesce("c", F.lit(0)).cast("long"), F.coalesce("b", F.lit(0))
    return out.select("rname", "length", covered.alias("covered"), (covered / n).alias("breadth"), (bases / n).alias("mean_depth"))


def fragment_table(records: DataFrame, ok, classes: DataFrame, cover: DataFrame) -> DataFrame:
    """``classes`` with n_covered (bases that an assigned fragment covers, 0 for others), ambiguity_group and n_alternatives:
    fragments with passing records on the same references share a group; null where a fragment is not ambiguous."""
    bases = cover.groupBy("qname").agg(F.sum(F.col("end0") - F.col("start0")).alias("n"))
    targets = F.array_sort(F.collect_set("rname"))  # at most as many as a fragment has records
    groups = ambiguous_targets(records, ok, classes).groupBy("qname").agg(targets.alias("t"))
    groups = groups.select("qname", F.concat(F.lit("amb_"), F.left(F.sha2(F.array_join("t", ","), 256), F.lit(20))).alias("ambiguity_group"), F.size("t").cast("long").alias("n_alternatives"))
    out = classes.hint("shuffle_merge").join(bases, "qname", "left").hint("shuffle_merge").join(groups, "qname", "left")
    return out.select(*classes.columns, F.coalesce("n", F.lit(0)).cast("long").alias("n_covered"), "ambiguity_group", F.coalesce("n_alternatives", F.lit(0)).cast("long").alias("n_alternatives"))
