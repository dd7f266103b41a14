"""Readers of text formats as DataFrames, and list and attribute cells."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reads import read_fasta, read_fastq  # noqa: F401


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "\t", header: bool = True, comment: str | None = None) -> DataFrame:
    """A delimited table with exactly these columns; a ragged row, a wrong header or a value of another type is an error."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("enforceSchema", "false").option("mode", "FAILFAST").option("quote", "")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_tool_table(spark: SparkSession, path: str, columns: dict[str, str], names: Sequence[str] | None = None, sep: str = r"\t", comment: str = "#", header: str | None = None, missing: Sequence[str] = ("", "NA", "-")) -> DataFrame:
    """The wanted ``columns`` (name to type) of a tool's table of ``names`` columns, with ``wrong``: cells of another type, or
    a row with too few cells; else empty.

    Lines that start with ``comment`` or with ``header`` go. Without ``names`` they are the first line of the first file that
    is neither comment nor empty; every line equal to it goes too. ``sep`` is a pattern, so ' +' reads columns of spaces; the
    last column takes the rest of its line. Cells in ``missing`` are null.
    """
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.trim("value") != "")
    if names is None:
        first = lines.where(~F.startswith("value", F.lit(comment))).first()
        if first is None:
            raise ValueError(f"{path} has no header")
        names = [x.strip() for x in re.split(sep, first[0])]
        lines = lines.where(F.col("value") != first[0])
    lines = lines.where(~F.startswith("value", F.lit(comment)))
    lines = lines.where(~F.startswith("value", F.lit(header))) if header else lines
    if set(columns) - set(names):
        raise ValueError(f"columns missing from {path}: {sorted(set(columns) - set(names))}")
    cells = F.split("value", sep, len(names))
    cell = {c: F.trim(F.get("_cells", F.lit(list(names).index(c)))) for c in columns}
    known = {c: F.when(~x.isin(*missing), x) for c, x in cell.items()}
    wrong = F.when(F.size("_cells") < len(names), "cells").otherwise(F.concat_ws(";", *(F.when(known[c].isNotNull() & known[c].try_cast(t).isNull(), F.lit(c)) for c, t in columns.items())))
    return lines.select(cells.alias("_cells")).select(*(known[c].try_cast(t).alias(c) for c, t in columns.items()), wrong.alias("wrong"))


def typed(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose text cells all have their type, the other rows with the names of the wrong cells)."""
    cast = {c: F.col(c).try_cast(t) for c, t in types.items()}
    wrong = F.concat_ws(";", *(F.when(cast[c].isNull() & (F.trim(c) != ""), F.lit(c)) for c in types))
    marked = df.withColumn("wrong", wrong)
    return marked.where("wrong = ''").drop("wrong").withColumns(cast), marked.where("wrong <> ''")


def fasta_text(df: DataFrame, width: int = 80) -> DataFrame:
    """value: the records as FASTA text, sequences wrapped."""
    body = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), body).alias("value"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records: 11 fields, 0-based position, mate from the flag, the tags as a map, and wrong: fewer than 11
    fields, a number that is none, or sequence and quality of different lengths; else empty. Header lines go."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    tags = F.transform(F.filter(F.slice(f, 12, 1 << 20), lambda x: F.length(x) > 5), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.regexp_replace(x, "^..:.:", "").alias("v")))
    number = lambda i, t="long": at(i).try_cast(t)
    flag = number(1, "int")
    raw = spark.read.text(path).where("not startswith(value, '@') and value <> ''")
    lengths = (at(9) != "*") & (at(10) != "*") & (F.length(at(9)) != F.length(at(10)))
    none = flag.isNull() | number(3).isNull() | number(4).isNull() | number(7).isNull() | number(8).isNull()
    wrong = F.when(F.size(f) < 11, "fields").when(none, "numbers").when(lengths, "lengths differ").otherwise("")
    return raw.select(
        at(0).alias("qname"), flag.alias("flag"), at(2).alias("rname"), (number(3) - 1).alias("pos"), number(4, "int").alias("mapq"), at(5).alias("cigar"), at(6).alias("rnext"),
        (number(7) - 1).alias("pnext"), number(8).alias("tlen"), at(9).alias("seq"), at(10).alias("qual"),
        F.when(flag.bitwiseAND(64) != 0, 1).when(flag.bitwiseAND(128) != 0, 2).alias("mate"), F.map_from_entries(tags).alias("tags"), wrong.alias("wrong"))


def attribute_map(text: Column, separator: str = ";") -> Column:
    """``k=v;k=v`` as a map; the last of equal keys counts."""
    return F.map_from_entries(F.transform(F.split(text, separator), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring_index(x, "=", -1).alias("v"))))


def zip_lists(df: DataFrame, keep: Sequence[str], lists: dict[str, str], separator: str = ";") -> DataFrame:
    """Parallel list cells as rows. Lists of unequal length in a row are an error."""
    parts = {name: F.split(F.col(c), separator) for name, c in lists.items()}
    sizes = [F.size(p) for p in parts.values()]
    unequal = F.raise_error(F.lit("list cells of unequal length"))
    zipped = F.arrays_zip(*(p.alias(n) for n, p in parts.items()))
    same = F.greatest(*sizes) == F.least(*sizes) if len(sizes) > 1 else F.lit(True)
    names = list(lists)
    shaped = F.transform(zipped, lambda z: F.struct(*(z.getField(n).alias(n) for n in names)))
    return df.select(*keep, F.explode(F.when(same, shaped).otherwise(unequal)).alias("z")).select(*keep, "z.*")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start0, end0 of the first three columns; an empty or reversed interval is an error."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).where("not value rlike '^(#|track|browser|\\\\s*$)'")
    rows = raw.select(f[0].alias("contig"), f[1].cast("long").alias("start0"), f[2].cast("long").alias("end0"))
    bad = F.raise_error(F.concat(F.lit("not an interval: "), F.coalesce("contig", F.lit("?"))))
    return rows.withColumn("end0", F.when((F.col("start0") >= 0) & (F.col("end0") > F.col("start0")), F.col("end0")).otherwise(bad.cast("long")))


BLAST = "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, evalue double, bitscore double"


def read_blast(spark: SparkSession, path: str, lengths: DataFrame, more: str = "") -> DataFrame:
    """Pairs of a 12-column table (``more``: further columns as DDL) with ``wrong``: unknown ids or positions outside their
    sequence (``lengths``: id, length), else empty."""
    rows = read_table(spark, path, BLAST + (f", {more}" if more else ""), header=False, comment="#")
    for side in "qs":
        known = lengths.select(F.col("id").alias(f"_{side}id"), F.col("length").alias(f"_{side}len"))
        rows = rows.hint("shuffle_merge").join(known, F.col(f"{side}seqid") == F.col(f"_{side}id"), "left").drop(f"_{side}id")
    outside = F.greatest("qstart", "qend") > F.col("_qlen"), F.greatest("sstart", "send") > F.col("_slen")
    wrong = F.when(F.col("_qlen").isNull(), "unknown query").when(F.col("_slen").isNull(), "unknown subject").when(outside[0] | outside[1] | (F.least("qstart", "qend", "sstart", "send") < 1), "outside").otherwise("")
    return rows.withColumn("wrong", wrong).drop("_qlen", "_slen")


def gather_units(spark: SparkSession, folder: str, name: str, schema: str, units: DataFrame) -> DataFrame:
    """The rows of the tables ``folder/<unit>/name`` with unit_id in front. Each of ``units`` (unit_id) must have its table and
    no other may: else an error that names up to ten of the units at fault."""
    rows = read_table(spark, f"{folder}/*/{name}", schema).withColumn("unit_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    files = spark.read.format("binaryFile").load(f"{folder}/*/{name}").select(F.element_at(F.split("path", "/"), -2).alias("u")).distinct()
    odd = files.join(units.select(F.col("unit_id").alias("v")), F.col("u") == F.col("v"), "full_outer").where("u is null or v is null").select(F.coalesce("u", "v").alias("u"))
    found = [r.u for r in odd.limit(10).collect()]
    if found:
        raise ValueError(f"units without a table, or tables of unknown units: {sorted(found)}")
    return rows.select("unit_id", *(c for c in rows.columns if c != "unit_id"))


def write_table(df: DataFrame, path: str, columns: Sequence[str], keys: Sequence[str], null: str = "NA", sep: str = "\t") -> None:
    """A delimited table with these columns only, in this order, sorted by its keys over all part files; nulls as ``null``. A
    folder that exists is refused; Spark commits it whole."""
    df.select(*columns).orderBy(*keys).write.mode("errorifexists").option("sep", sep).option("header", True).option("nullValue", null).option("emptyValue", "").csv(path)


def write_once(df: DataFrame, path: str, inputs: str) -> bool:
    """Publish a table (``rows``) and the fingerprint of its ``inputs`` (``inputs``) in one folder, which appears whole or not at
    all: both are written beside it, and one rename publishes them. A run that is killed before can be repeated.

    Where the folder is already, it is kept if its inputs were the same (False: nothing was written) and refused if not, also
    if another run has published it meanwhile.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)

    def known() -> bool:
        if not fs.exists(target):
            return False
        if spark.read.parquet(f"{path}/inputs").first()[0] != inputs:
            raise ValueError(f"{path} was made from other inputs")
        return True

    if known():
        return False
    apart = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")  # hidden from readers
    try:
        df.write.parquet(f"{apart.toString()}/rows")
        spark.createDataFrame([(inputs,)], "inputs string").coalesce(1).write.parquet(f"{apart.toString()}/inputs")
        where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        whole = fs.makeQualified(apart), fs.makeQualified(target)
        try:
            where.rename(*whole, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError:  # the folder exists now
            if known():
                return False
            raise
        return True
    finally:
        fs.delete(apart, True)
