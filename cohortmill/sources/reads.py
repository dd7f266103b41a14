"""Sequence files as DataFrames: lines of plain and compressed files, FASTQ records cut at any split, FASTA faults."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP = b"\x1f\x8b"
NAMED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate")  # what Hadoop decompresses by itself


def unnamed_gzip(spark: SparkSession, path: str) -> list[str]:
    """Files of a path (or pattern) that begin as gzip does but are not named so. Two bytes of each file are read here."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    out = []
    for top in fs.globStatus(where) or ():
        for status in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            name = status.getPath().toString()
            if status.isDirectory() or status.getPath().getName().startswith(("_", ".")) or name.endswith(NAMED) or status.getLen() < 2:
                continue
            stream = fs.open(status.getPath())
            try:
                two = bytes([stream.read(), stream.read()])
            finally:
                stream.close()
            if two == GZIP:
                out.append(name)
    return out


def gunzipped(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, content in zip(b.column(0), b.column(1)):
            lines = gunzipped(content.as_py()).decode().replace("\r\n", "\n").removesuffix("\n").split("\n")
            for i in range(0, len(lines), 100_000):
                part = lines[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array([0] * len(part), pa.int64()), pa.array(part)], ["file", "block", "value"])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (byte at which a split begins), value: lines in order within a block. Plain files are split; compressed
    ones (by name, or gzip by its first bytes, of any number of members) are read by one task each, as their format asks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    packed = unnamed_gzip(spark, path)
    if not packed:
        return lines
    whole = spark.read.format("binaryFile").load(packed).select("path", "content").mapInArrow(_unpacked, "file string, block long, value string")
    names = [x.partition(":")[2].lstrip("/") for x in packed]
    plain = lines.where(~F.ltrim(F.regexp_replace("file", "^[a-z0-9]+:", ""), F.lit("/")).isin(names))
    return plain.unionByName(whole)


def _is_header(lines: list[str], i: int) -> bool:
    """A header is a line with '@' two lines before one with '+': a quality line with '@' is two lines before a sequence."""
    return lines[i].startswith("@") and i + 2 < len(lines) and lines[i + 2].startswith("+")


def _next_header(lines: list[str], i: int) -> int:
    while i < len(lines) and not _is_header(lines, i):
        i += 1
    return i


def _records(lines: list[str], last: bool) -> tuple[list[list[str]], int]:
    """(records, lines used) from a header on; what is left when fewer than four lines remain is a record only at the ``last``."""
    out, i = [], 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
        elif i + 4 <= len(lines) and _is_header(lines, i):
            out.append(lines[i : i + 4])
            i += 4
        else:
            to = _next_header(lines, i + 1)
            if to == len(lines) and not last:
                break
            out.append([x for x in lines[i:to] if x.strip()])  # no record of four lines
            i = to
    return out, i


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 'record': a record's lines; 'head' and 'tail': the lines of a block before its first and after its last whole one."""
    names = ["file", "block", "kind", "lines"]
    file, block, lines, headed = None, None, [], False

    def rows(found: list[tuple[str, list[str]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([block] * len(found), pa.int64()), pa.array([k for k, _ in found], pa.string()), pa.array([x for _, x in found], pa.list_(pa.string()))], names)

    def parsed(final: bool) -> list[tuple[str, list[str]]]:
        nonlocal lines, headed
        out: list[tuple[str, list[str]]] = []
        if not headed:
            first = _next_header(lines, 0)
            if first < len(lines):
                out, lines, headed = [("head", lines[:first])], lines[first:], True
        if headed:
            keep = [] if final else lines[-8:]  # a record at the end of a batch may go on in the next one
            found, used = _records(lines if final else lines[: len(lines) - len(keep)], False)
            out += [("record", x) for x in found]
            lines = lines[used:]
        if final:
            out.append(("tail" if headed else "head", lines))
            lines, headed = [], False
        return out

    for b in batches:
        files, blocks, values = (b.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(values):
            to = at
            while to < len(values) and files[to] == files[at] and blocks[to] == blocks[at]:
                to += 1
            if (files[at], blocks[at]) != (file, block):
                if file is not None:
                    yield rows(parsed(True))
                file, block = files[at], blocks[at]
            lines += values[at:to]
            at = to
        if file is not None:
            yield rows(parsed(False))
    if file is not None:
        yield rows(parsed(True))


def _stitched(parts: pa.Table) -> pa.Table:
    """The records that lie over the borders of a file's blocks: a few lines for each block."""
    held: list[str] = []
    out: list[list[str]] = []
    blocks: dict[int, dict[str, list[str]]] = {}
    for x in parts.to_pylist():
        blocks.setdefault(x["block"], {})[x["kind"]] = x["lines"]
    for _, own in sorted(blocks.items()):
        held += own.get("head", [])
        if "tail" in own:
            out += _records(held, True)[0]
            held = own["tail"]
    out += _records(held, True)[0]
    return pa.table({"lines": pa.array(out, pa.list_(pa.string()))})


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name (without /1 or /2), seq, qual, and wrong: why a record is not whole, else empty.

    Files are read in splits; each task finds the phase of its four-line records by itself, and only the lines at the borders
    of splits are gathered, a few for each split of a file. So a quality line may begin with '@', and a record may lie over a
    border. Lines end with LF or CRLF.
    """
    cut = text_lines(spark, path).mapInArrow(_blocks, "file string, block long, kind string, lines array<string>")
    inner = cut.where("kind = 'record'").select("lines")
    border = cut.where("kind <> 'record'").groupBy("file").applyInArrow(_stitched, "lines array<string>")
    line = lambda i: F.regexp_replace(F.get("lines", F.lit(i)), "\r$", "")
    rows = inner.unionByName(border).select(line(0).alias("_head"), line(1).alias("seq"), line(2).alias("_plus"), line(3).alias("qual"), F.size("lines").alias("_n"))
    name = F.regexp_replace(F.element_at(F.split(F.regexp_replace("_head", "^@", ""), r"\s+"), 1), "/[12]$", "")
    begins = lambda c, x: F.coalesce(F.startswith(c, F.lit(x)), F.lit(False))
    wrong = (
        F.when(~begins("_head", "@"), "no header").when(~begins("_plus", "+"), "no plus line").when(F.col("_n") != 4, "not four lines").when(F.col("qual").isNull() | (F.length("seq") != F.length("qual")), "lengths differ")
        .when(F.length("seq") == 0, "empty").when(F.col("seq").rlike("[^ACGTNacgtn]"), "letters").when(F.col("qual").rlike("[^!-~]"), "quality out of range").otherwise("")
    )
    return rows.select(name.alias("name"), "seq", "qual", wrong.alias("wrong"))


def unsynchronised(first: DataFrame, second: DataFrame) -> DataFrame:
    """name, n_first, n_second of the names that the two files of a pair do not each hold once."""
    count = lambda df, c: df.groupBy("name").agg(F.count("*").alias(c))
    both = count(first, "n_first").hint("shuffle_merge").join(count(second, "n_second"), "name", "full_outer").na.fill(0, ["n_first", "n_second"])
    return both.where("n_first <> 1 or n_second <> 1").select("name", "n_first", "n_second")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, header, seq: one row per record, split at record starts so that a large plain file is read by many tasks; gzip
    files without the name are unpacked whole."""
    packed = unnamed_gzip(spark, path)
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("_file"), "value")
    if packed:
        text = spark.read.format("binaryFile").load(packed).select("content").mapInArrow(_fasta_parts, "value string")
        names = [x.partition(":")[2].lstrip("/") for x in packed]
        raw = raw.where(~F.ltrim(F.regexp_replace("_file", "^[a-z0-9]+:", ""), F.lit("/")).isin(names)).select("value").unionByName(text)
    text = F.regexp_replace("value", "^﻿?>", "")
    head, body = F.substring_index(text, "\n", 1), F.regexp_replace(text, r"^[^\n]*\n?", "")
    header = F.trim(F.regexp_replace(head, "\r", ""))
    return raw.where("trim(value) <> ''").select(F.element_at(F.split(header, r"\s+"), 1).alias("id"), header.alias("header"), F.regexp_replace(body, r"\s", "").alias("seq"))


def _fasta_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            parts = gunzipped(content.as_py()).decode().split("\n>")
            for i in range(0, len(parts), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(parts[i : i + 10_000])], ["value"])


def fasta_faults(records: DataFrame, letters: str = "ACGTRYSWKMBDHVN") -> DataFrame:
    """id, fault of the records of ``read_fasta`` that can't be used: no id, empty, letters (others than ``letters``, of either
    case), duplicate (one row an id)."""
    own = F.when(F.coalesce("id", F.lit("")) == "", "no id").when(F.col("seq") == "", "empty").when(F.upper("seq").rlike(f"[^{letters}]"), "letters")
    bad = records.select("id", own.alias("fault")).where("fault is not null")
    again = records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("fault"))
    return bad.unionByName(again)
