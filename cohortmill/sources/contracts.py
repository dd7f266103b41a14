"""Strict reading: JSON whose every key and number counts, tables that match their contract cell by cell, paged JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reads import text_lines

FAULT = "path string, reason string"
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"  # JSON's own


class _Pairs(list):
    """An object as its pairs, so that no key gets lost."""


class _Constant(str):
    """NaN or an infinity, which JSON does not have."""


def json_faults(text: str) -> list[tuple[str, str]]:
    """(path, reason) of each fault: the text is no JSON, a key stands twice in an object, or a number is not finite."""
    try:
        whole = json.loads(text, object_pairs_hook=_Pairs, parse_constant=_Constant)
    except (ValueError, RecursionError):
        return [("$", "not json")]
    found, open_ = [], [("$", whole)]
    while open_:
        path, x = open_.pop()
        if isinstance(x, _Constant):
            found.append((path, "not finite"))
        elif isinstance(x, float) and x in (float("inf"), float("-inf")):  # a literal beyond what a double holds
            found.append((path, "not finite"))
        elif isinstance(x, _Pairs):
            seen = set()
            for k, v in x:
                if k in seen:
                    found.append((f"{path}.{k}", "duplicate key"))
                seen.add(k)
                open_.append((f"{path}.{k}", v))
        elif isinstance(x, list):
            open_ += [(f"{path}[{i}]", v) for i, v in enumerate(x)]
    return sorted(set(found))


def strict_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, reason: the faults of each row's JSON text; rows without a fault, or with null text, give none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, reasons = [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                for path, reason in json_faults(x) if x is not None else ():
                    at.append(i)
                    paths.append(path)
                    reasons.append(reason)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(reasons, pa.string())], [key, "path", "reason"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {FAULT}")


def cell(raw: Column, kind: str) -> tuple[Column, Column]:
    """(value, whether the text is none of its kind): string, boolean (true or false only), number and integer as JSON writes
    them; the empty text is null."""
    empty = raw == ""
    if kind == "string":
        return F.when(~empty, raw), F.lit(False)
    if kind == "boolean":
        return F.when(raw == "true", True).when(raw == "false", False), ~empty & ~raw.isin("true", "false")
    good = raw.rlike(NUMBER)
    value = F.when(good, raw.try_cast("double"))
    finite = good & value.isNotNull() & (F.abs(value) < float("inf"))
    if kind == "number":
        return F.when(finite, value), ~empty & ~finite
    whole = F.when(raw.rlike(r"^-?(0|[1-9][0-9]*)$"), raw.try_cast("bigint"))
    return whole, ~empty & whole.isNull()


def contract_rows(lines: DataFrame, header: Sequence[str], kinds: dict[str, str], required: Sequence[str] = (), line: str = "line", text: str = "value", sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(typed rows with their line, rejects: line, column, reason) of a delimited table's lines under its header.

    The header must hold exactly the contract's columns (``kinds``), each once. A row with any fault is rejected whole, with
    all of its faults: ragged, a cell that is none of its kind, a ``required`` cell that is empty.
    """
    if len(set(header)) != len(header) or set(header) != set(kinds):
        raise ValueError(f"the header must hold exactly {sorted(kinds)}, each once; it holds {list(header)}")
    cells = F.split(text, sep, -1)
    rows = lines.select(line, cells.alias("_cells"))
    ragged = F.size("_cells") != len(header)
    at = {c: F.coalesce(F.get("_cells", F.lit(i)), F.lit("")) for i, c in enumerate(header)}
    read = {c: cell(at[c], kinds[c]) for c in kinds}
    faults = [F.when(ragged, F.struct(F.lit("").alias("column"), F.lit("ragged").alias("reason")))]
    for c in kinds:
        faults.append(F.when(~ragged & read[c][1], F.struct(F.lit(c).alias("column"), F.lit(f"not {kinds[c]}").alias("reason"))))
        if c in required:
            faults.append(F.when(~ragged & (at[c] == ""), F.struct(F.lit(c).alias("column"), F.lit("empty").alias("reason"))))
    marked = rows.withColumn("_faults", F.filter(F.array(*faults), lambda x: x.isNotNull()))
    good = marked.where(F.size("_faults") == 0).select(line, *(read[c][0].alias(c) for c in kinds))
    # the outer form, since of the other Spark asks beforehand, by reading all cells once more, whether there is any fault
    bad = marked.select(line, F.explode_outer("_faults").alias("f")).where(F.col("f").isNotNull()).select(line, "f.column", "f.reason")
    return good, bad


def _first_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = None
    for b in batches:
        files, blocks, values = (b.column(i).to_pylist() for i in range(3))
        heads = []
        for f, k, v in zip(files, blocks, values):
            if k == 0 and f != seen:
                heads.append((f, v))
            seen = f
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in heads], pa.string()), pa.array([v for _, v in heads], pa.string())], ["file", "value"])


def read_contract(spark: SparkSession, path: str, kinds: dict[str, str], required: Sequence[str] = (), sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """``contract_rows`` of the files of a path; every file begins with the same header. ``line`` is the file and the text."""
    lines = text_lines(spark, path)
    headers = [r[0] for r in lines.mapInArrow(_first_of_files, "file string, value string").select(F.regexp_replace("value", "^﻿|\r$", "")).distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"{path} has {'several headers' if headers else 'no header'}")
    body = lines.select("file", F.regexp_replace("value", "^﻿|\r$", "").alias("value")).where((F.col("value") != headers[0]) & (F.col("value") != ""))
    return contract_rows(body.withColumn("line", F.concat_ws(": ", "file", "value")), headers[0].split(sep), kinds, required, sep=sep)


def latest_reports(pages: DataFrame, page: str, text: str, item: str, key: str = "accession", items: str = "reports") -> DataFrame:
    """One row for each ``key`` of paged responses: the item itself (``item``: DDL of its fields), page and place where it
    stands, and n_seen.

    A response is ``{"<items>": [...]}``. Of a key that several pages hold, the last one counts, by page, then by place in it.
    """
    schema = T.StructType().add(items, T.ArrayType(T.StructType.fromDDL(item) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(item)))
    rows = pages.select(F.col(page).alias("page"), F.posexplode(F.from_json(text, schema)[items]).alias("place", "report"))
    rows = rows.where(F.col(f"report.{key}").isNotNull())
    last = rows.groupBy(F.col(f"report.{key}").alias(key)).agg(F.max_by(F.struct("report", "page", "place"), F.struct("page", "place")).alias("r"), F.count("*").alias("n_seen"))
    return last.select(key, "r.report", "r.page", "r.place", "n_seen")


def attributes(column: str | Column, name: str = "name", value: str = "value") -> Column:
    """An array of (name, value) as a map by lower-case name; of a name that stands several times the last one counts."""
    c = F.col(column) if isinstance(column, str) else column
    return F.aggregate(F.filter(c, lambda x: x[name].isNotNull()), F.expr("cast(map() as map<string, string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(x[name])), F.create_map(F.lower(x[name]), x[value])))
