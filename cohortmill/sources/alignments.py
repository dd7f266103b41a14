"""Alignment tables of 8, 12 or 16 columns, each row held against the sequences that it names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import values as V

# The columns of the layouts in their order.
STANDARD = "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, evalue double, bitscore double"
ALIGNED = STANDARD + ", qlen long, slen long, qseq string, sseq string"
SHORT = "qseqid string, sseqid string, pident double, length long, qstart long, qend long, sstart long, send long"
# Letters that an aligned string may have where the sequence is read backwards, ambiguity codes included, and their partners.
LETTERS, PARTNERS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"


def read_alignments(spark: SparkSession, path: str, sequences: DataFrame, layout: str = STANDARD) -> DataFrame:
    """The rows of a table without header, with ``wrong``: the first fault of a row, empty where there is none. ``layout``: DDL of
    the table's columns; ``sequences``: id, seq, one row an id.

    Faults: columns (another number of cells), number (a cell that is none, or not finite), query, subject (unknown ids), length (qlen or slen is not that of the
    sequence), outside (a position outside its sequence), letters (an aligned string, gaps taken out, is not the part of its
    sequence; backwards where it ends before it starts). Blank lines and lines that begin with # are passed over. Each sequence
    is shuffled to the rows that name it and never broadcast; where the layout has no aligned strings, only its length is.
    """
    fields = [c.split() for c in layout.split(", ")]
    names = [n for n, _ in fields]
    cells = F.split("value", "\t", -1)
    lines = spark.read.text(path).where("not value rlike '^(#|\\\\s*$)'").select(F.regexp_replace("value", "\r$", "").alias("value"))
    rows = lines.select(*(F.get(cells, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)), F.size(cells).alias("_n"))
    texts = {"qseq", "sseq"} <= set(names)
    for side in "qs":
        known = sequences.select(F.col("id").alias(f"_{side}"), F.length("seq").cast("long").alias(f"_{side}len"), *([F.col("seq").alias(f"_{side}seq")] if texts else []))
        rows = rows.hint("shuffle_merge").join(known, F.col(f"{side}seqid") == F.col(f"_{side}"), "left")
    numbers = [n for n, t in fields if t != "string"]
    bad = reduce(Column.__or__, (F.col(n).isNull() for n in numbers))
    bad = reduce(Column.__or__, (F.isnan(n) | (F.abs(n) == float("inf")) for n, t in fields if t == "double"), bad)
    rules = [(F.col("_n") != len(fields), "columns"), (bad, "number"), (F.col("_q").isNull(), "query"), (F.col("_s").isNull(), "subject")]
    if {"qlen", "slen"} <= set(names):
        rules.append(((F.col("qlen") != F.col("_qlen")) | (F.col("slen") != F.col("_slen")), "length"))
    rules.append(((F.least("qstart", "qend", "sstart", "send") < 1) | (F.greatest("qstart", "qend") > F.col("_qlen")) | (F.greatest("sstart", "send") > F.col("_slen")), "outside"))
    if texts:
        rules.append((~(_same("q") & _same("s")), "letters"))
    return rows.select(*names, V.ladder(rules, "").alias("wrong"))


def _same(side: str) -> Column:
    start, stop = F.col(f"{side}start"), F.col(f"{side}end")
    part = F.upper(F.substring(F.col(f"_{side}seq"), F.least(start, stop).cast("int"), (F.abs(stop - start) + 1).cast("int")))
    part = F.when(stop < start, F.reverse(F.translate(part, LETTERS, PARTNERS))).otherwise(part)
    return F.coalesce(F.upper(F.replace(F.col(f"{side}seq"), F.lit("-"), F.lit(""))) == part, F.lit(False))


def placed(rows: DataFrame, lengths: DataFrame, edge: int) -> DataFrame:
    """query_id, subject_id, pident, query_start0, query_end0, subject_start0, subject_end0, strand and edge_hit (the hit lies within
    ``edge`` letters of an end of its subject) of rows without fault. ``lengths``: id, length of the subjects."""
    known = lengths.select(F.col("id").alias("sseqid"), F.col("length").alias("_len"))
    q0, q1 = S.closed_to_half_open(F.least("qstart", "qend"), F.greatest("qstart", "qend"))
    s0, s1 = S.closed_to_half_open(F.least("sstart", "send"), F.greatest("sstart", "send"))
    met = rows.where("wrong = ''").hint("shuffle_merge").join(known, "sseqid")
    strand = F.when((F.col("send") >= F.col("sstart")) == (F.col("qend") >= F.col("qstart")), "+").otherwise("-")
    return met.select(
        F.col("qseqid").alias("query_id"), F.col("sseqid").alias("subject_id"), "pident", q0.alias("query_start0"), q1.alias("query_end0"), s0.alias("subject_start0"), s1.alias("subject_end0"), strand.alias("strand"),
        ((s0 < edge) | (F.col("_len") - s1 < edge)).alias("edge_hit"))
