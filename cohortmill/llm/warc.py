"""WARC archives compressed record by record with a dictionary that each archive carries itself.

A ``.warc.zst`` archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from the
archive's own records; each record follows as one frame, so that any record can be read alone. Records whose payload
equals that of a page with a larger id become ``revisit`` records without payload.

Archives are written by tasks under names that no other attempt uses, and a manifest lists those of successful attempts;
the reader takes only these, so retried or lost tasks leave no doubtful records.

The folder's path is read as Hadoop reads it, so a path without a scheme lies in the cluster's default store; stores that
tasks can't open through pyarrow are refused before any task runs.

Defined cases: null html is an empty payload; payloads under ``min_bytes`` are always responses; null page_id: a response
that nothing refers to; repeated rows give a record each; null url is written as empty; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop, key_filter, new_path, observed, passes, stage

DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMES = ("file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss")  # that pyarrow opens, beside Hadoop
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _split(revisiting, inside: bool):
    """Pages whose id passes the filter, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("page_id").cast(pa.int64())
            some = passes(revisiting, ids.fill_null(0).to_numpy()) & ~ids.is_null().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(some == inside))
            if b.num_rows:
                yield b

    return run


def mark_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest (hex SHA-1), refers_to (null for responses). Only html of pages that may be revisits is
    shuffled."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "utf-8"))
    known = pages.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", digest.alias("digest"))
    known = stage(known, "digests")
    last = known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    last = last.select("digest", "refers_to", F.xxhash64("digest").alias("s"))  # a second key: a digest that many share can be split
    revisits = known.withColumn("s", F.xxhash64("digest")).hint("shuffle_merge").join(last, ["digest", "s"]).where("page_id < refers_to")
    revisits = stage(revisits.select("page_id", "digest", "refers_to").distinct(), "revisits", n="count(1)")
    drop(known)
    some = key_filter(revisits, "page_id", 1 << max(20, (16 * observed(revisits, "n")).bit_length()))
    schema = "page_id long, url string, html string"
    first = pages.mapInArrow(_split(some, False), schema).withColumn("digest", digest).withColumn("refers_to", F.lit(None).cast("long"))
    again = pages.mapInArrow(_split(some, True), schema).withColumn("digest", digest).hint("shuffle_merge").join(revisits, ["page_id", "digest"], "left")
    out = first.unionByName(again)
    out._holds = (revisits,)
    return out


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def build_dictionary(records: list[bytes], size: int, sample_bytes: int) -> bytes:
    """A dictionary from the first records; too few of them to train on serve as its raw content."""
    samples, total = [], 0
    for r in records:
        samples.append(r[: sample_bytes // 4])
        total += len(samples[-1])
        if total >= sample_bytes:
            break
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def archive_bytes(records: list[bytes], dict_size: int = 1 << 16, sample_bytes: int = 1 << 21, level: int = 3) -> bytes:
    content = build_dictionary(records, dict_size, sample_bytes)
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True)
    lead = DICT_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content
    return b"".join([lead, *(c.compress(r) for r in records)])


def read_archive(data: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    if int.from_bytes(data[:4], "little") != DICT_MAGIC:
        raise ValueError("no leading dictionary frame")
    at = 8 + int.from_bytes(data[4:8], "little")
    view = memoryview(data)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:at]))
    while at < len(data):
        frame, parts = d.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the last record is cut short")
            fed = view[at : at + piece]
            parts.append(frame.decompress(fed))
            at += len(fed) - len(frame.unused_data)
        yield b"".join(parts)


def _sink(uri: str):
    """(filesystem, path): local and mounted folders, or any store that pyarrow opens (s3a:// as s3://)."""
    from pyarrow import fs

    uri = re.sub("^s3[an]://", "s3://", uri)
    return (fs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Hadoop reads it; one that the tasks can't open through pyarrow is refused here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.partition(":")[0] not in SCHEMES:
        raise ValueError(f"archives can't be written to {full}: use one of {', '.join(SCHEMES)}")
    return full


def _writer(folder: str, archive_size: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _sink(folder)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive_bytes(held)
            with store.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})
            held.clear()
            return row

        for b in batches:
            html = b.column("html").cast(pa.large_binary())
            for i in range(b.num_rows):
                page, url, digest, to = (b.column(c)[i].as_py() for c in ("page_id", "url", "digest", "refers_to"))
                url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                held.append(record_bytes(page, url, html[i].as_py(), digest, to, date))
                size += len(held[-1])
                if size >= archive_size:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 1000, archive_size: int = 16 << 20, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write the archives into ``folder``; the manifest (name, records, bytes) of those that count."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = mark_revisits(pages, min_bytes)
    manifest = stage(rows.mapInArrow(_writer(folder, archive_size, date), "name string, records long, bytes long"), "warc-manifest", n="count(1)")
    drop(rows)
    return manifest


def _records(data: bytes) -> pa.RecordBatch:
    number = lambda uri: int(n) if (n := uri.strip("<>").rpartition(":")[2]) else None
    rows = []
    for raw in read_archive(data):
        f, block = parse_record(raw)
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        kind = f["WARC-Type"]
        if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged record {f['WARC-Record-ID']}")
        rows.append((number(f["WARC-Record-ID"]), n, digest, kind, number(f["WARC-Refers-To"]) if kind == "revisit" else None))
    page, n, digest, kind, to = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(to, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _reader(folder: str | None):
    """The records of archives given by content, or by name in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _sink(folder) if folder else (None, None)
        for b in batches:
            for x in b.column(0):
                if store is None:
                    yield _records(x.as_py())
                else:
                    with store.open_input_stream(f"{top}/{x.as_py()}", compression=None) as archive:
                        yield _records(archive.read())

    return run


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None, most_tasks: int = 10_000) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads are checked. With a
    manifest, the archives that it names, a task for each (``most_tasks`` at most): names are dealt out, not contents."""
    if manifest is not None:
        tasks = max(1, min(most_tasks, manifest.count()))
        return manifest.select("name").repartition(tasks, "name").mapInArrow(_reader(qualified(spark, folder)), RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(_reader(None), RECORD)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest = write_warc(pages, folder)
    return read_warc(spark, folder, manifest)
