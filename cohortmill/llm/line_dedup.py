"""Line dedup over levelled sorted runs of line hashes.

The store holds runs: tables (key, owner) bucketed and sorted by key, each key in one run only. Documents arrive in
batches of rising doc_id; a batch merge-anti-joins the runs, which are neither shuffled nor sorted for that, adds its
unseen keys as a new level-0 run, and runs of one level are merged into one of the next when ``fan_in`` of them exist. A
line whose key belongs to another document goes. The few keys that a share of all lines have are matched by broadcast.

Defined cases: null or empty text is one empty line; null doc_id: the row passes unchanged and owns nothing; rows with
the same doc_id count as one document; keys shorter than ``min_chars`` are never compared; extra columns pass through
(n_lines and n_dropped are replaced).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop, key_filter, new_path, observed, passes, stage

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key): distinct line keys of each document, as MD5 of the stripped, lower-cased line."""
    line = F.explode(F.array_distinct(F.split(F.col("text"), "\n")))
    key = F.translate(F.trim(F.col("line"), F.lit(STRIPPED)), UPPER, LOWER)
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", line.alias("line"))
    lines = lines.select("doc_id", key.alias("line")).where(F.char_length("line") >= min_chars)
    return lines.select("doc_id", F.unhex(F.md5(F.encode("line", "utf-8"))).alias("key"))


class Run:
    """A table (key, owner) in the shared folder, bucketed and sorted by key: Spark joins it with rows dealt by key, or
    with another run, without shuffling or sorting it."""

    def __init__(self, rows: DataFrame, buckets: int):
        self.spark, self.name, self.path = rows.sparkSession, f"line_run_{uuid.uuid4().hex}", new_path(rows.sparkSession, "line-run")
        rows.write.bucketBy(buckets, "key").sortBy("key").option("path", self.path).format("parquet").saveAsTable(self.name)
        self._staged_at = self.path

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.sparkSession = self.spark
        drop(self)


@contextmanager
def _sorted_scans(spark: SparkSession):
    """One file a bucket: its order may be used."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineStore:
    """Levelled runs of (key, owner). ``hot``: keys (a bounded list) that so many documents hold that their rows are
    matched by broadcast, beside the merge join."""

    def __init__(self, fan_in: int = 2, hot: list[bytes] = ()):
        self.fan_in, self.hot, self.levels = fan_in, list(hot), [[]]

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def owners(self) -> DataFrame | None:
        out = None
        for r in self.runs():
            out = r.table() if out is None else out.union(r.table())
        return out

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch of (doc_id, key); return its (doc_id, key) that belong to another document."""
        spark = keys.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        with _sorted_scans(spark):
            firsts = keys.groupBy("key").agg(F.min("doc_id").alias("owner"))
            for r in self.runs():
                firsts = firsts.hint("merge").join(r.table().select("key"), "key", "left_anti")
            self.levels[0].append(Run(firsts, buckets))
            losing = stage(self.losing(keys), "line-drop")
            self.compact(buckets)
        return losing

    def losing(self, keys: DataFrame) -> DataFrame:
        spark, hot = keys.sparkSession, None
        if self.hot:
            known = spark.createDataFrame([(bytearray(k),) for k in self.hot], "key binary")
            held = self.owners().join(F.broadcast(known), "key").collect()  # a row for each hot key at most
            hot = keys.join(F.broadcast(spark.createDataFrame(held, "key binary, owner long")), "key").where("owner <> doc_id").select("doc_id", "key")
            keys = keys.join(F.broadcast(known), "key", "left_anti")
        rows = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
        for i, r in enumerate(self.runs()):  # each key is in one run
            run = r.table().select("key", F.col("owner").alias(f"owner{i}"))
            rows = rows.hint("merge").join(run, "key", "left")
        owner = F.coalesce(*(F.col(f"owner{i}") for i in range(len(self.runs()))))
        rows = rows.where(owner != F.col("doc_id")).select("doc_id", "key")
        return rows if hot is None else rows.union(hot)

    def compact(self, buckets: int) -> None:
        for n, level in enumerate(self.levels):
            if len(level) >= self.fan_in:
                merged = level[0].table()
                for r in level[1:]:
                    merged = merged.union(r.table())
                merged = Run(merged.repartition(buckets, "key"), buckets)
                for r in level:
                    r.drop()
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(merged)
                self.levels[n] = []

    def drop(self) -> None:
        for r in self.runs():
            r.drop()
        self.levels = [[]]


def _rebuild(digest: bool, mark: str | None, losers=None):
    """Texts without their lost lines. Without ``mark`` no row has lost any; then rows that pass ``losers`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if losers is not None:
                b = b.filter(pa.array(~may_lose(losers, b.column("doc_id"))))
            texts, lost = b.column("text"), b.column(mark) if mark else None
            kept_texts, n_lines, n_dropped, sums = [], [], [], []
            for i in range(b.num_rows):
                text = texts[i].as_py()
                gone = set(lost[i].as_py() or ()) if lost is not None else None
                if gone:
                    lines = text.split("\n")
                    kept = [x for x in lines if hashlib.md5(x.strip(STRIPPED).translate(_LOWERED).encode()).digest() not in gone]
                    text = "\n".join(kept)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                else:
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
                if digest:
                    sums.append(hashlib.sha256((text or "").encode()).hexdigest())
                else:
                    kept_texts.append(text)
            new = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            new |= {"kept_sha256": pa.array(sums, pa.string())} if digest else {"text": pa.array(kept_texts, pa.string())}
            keep = [c for c in b.schema.names if c not in ("text", mark)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + list(new.values()), keep + list(new))

    return run


def may_lose(losers, ids: pa.Array) -> np.ndarray:
    ids = ids.cast(pa.int64())
    return passes(losers, ids.fill_null(0).to_numpy()) & ~ids.is_null().to_numpy(zero_copy_only=False)


def _losers_only(losers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_lose(losers, b.column("doc_id"))))

    return run


def line_dedup(docs: DataFrame, batches: int = 3, min_chars: int = 10, fan_in: int = 2, digest: bool = False, hot_share: int = 256) -> DataFrame:
    """documents -> the same rows with ``text`` rebuilt, n_lines and n_dropped added (with ``digest``: doc_id, n_lines,
    n_dropped, kept_sha256). Texts of documents that lose nothing are not shuffled."""
    keys = stage(line_keys(docs, min_chars), "line-keys", n="count(1)", low="min(doc_id)", high="max(doc_id)")
    n, low, high = (observed(keys, x) for x in ("n", "low", "high"))
    parts, losing = [], None
    if n:
        often = max(1000, n // hot_share)  # hot_share keys at most
        store = LineStore(fan_in, [bytes(r[0]) for r in keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > often).select("key").collect()])
        edges = [low + (high + 1 - low) * i // batches for i in range(batches + 1)]
        try:
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    parts.append(store.add(keys.where(F.col("doc_id").between(a, b - 1))))
                    losing = parts[-1] if losing is None else losing.union(parts[-1])
        finally:  # the runs are tables of the catalog
            store.drop()
    drop(keys)
    docs = docs.select("doc_id", "text") if digest else docs.drop("n_lines", "n_dropped")
    mark = "_lost"
    while mark in docs.columns:
        mark += "_"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    fields = ", ".join([*fields, "n_lines long", "n_dropped long", "kept_sha256 string" if digest else "text string"])
    if losing is None:
        return docs.mapInArrow(_rebuild(digest, None), fields)
    lost = stage(losing.groupBy("doc_id").agg(F.collect_set("key").alias(mark)), "line-lost", n="count(1)")
    drop(*parts)
    losers = key_filter(lost, "doc_id", 1 << max(20, (16 * observed(lost, "n")).bit_length()))
    texts = docs.mapInArrow(_losers_only(losers), docs.schema)
    changed = texts.hint("shuffle_merge").join(lost, "doc_id", "left").mapInArrow(_rebuild(digest, mark), fields)
    out = docs.mapInArrow(_rebuild(digest, None, losers), fields).union(changed)
    out._holds = (lost,)  # drop(out) drops it
    return out
