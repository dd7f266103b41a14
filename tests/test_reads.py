"""FASTQ at any split, compressed files without the name, FASTA faults."""

import gzip
import random

import pytest

from cohortmill.sources import reads
from cohortmill.sources import text_tables as T


def records(r, n):
    out = []
    for i in range(n):
        size = r.randint(1, 40)
        first = r.choice("@+!IA~")
        out.append((f"r{i}", "".join(r.choice("ACGTN") for _ in range(size)), first + "".join(r.choice("@+#I~") for _ in range(size - 1))))
    return out


def text_of(rows, end="\n"):
    return "".join(f"@{n}/1 some text{end}{s}{end}+{n if i % 3 else ''}{end}{q}{end}" for i, (n, s, q) in enumerate(rows))


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_the_borders_of_splits(spark, tmp_path, small_splits, end):
    r = random.Random(len(end))
    want = []
    for name in ("a.fq", "b.fq"):
        rows = records(r, 60)
        rows = [(f"{name}{n}", s, q) for n, s, q in rows] + [(f"{name}long", "ACGT" * 200, "@II+" * 200)]
        want += rows
        (tmp_path / name).write_bytes(text_of(rows, end).encode())
    found = reads.read_fastq(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted(tuple(x) for x in found.collect())
    assert got == sorted((n, s, q, "") for n, s, q in want)


def test_quality_lines_that_begin_with_an_at_sign(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@r1\nACGT\n+\n@III\n@r2\nAC\n+\n@@\n")
    assert sorted(tuple(x) for x in reads.read_fastq(spark, str(tmp_path / "r.fq")).collect()) == [("r1", "ACGT", "@III", ""), ("r2", "AC", "@@", "")]


def test_broken_records_are_told_and_the_rest_is_read(spark, tmp_path):
    (tmp_path / "r.fq").write_text("stray\n@r1\nACGT\n+\nIIII\n@r2\nACGT\nIIII\n@r3\nAC\n+\nII\n@r4\nAX\n+\nII\n\n@r5\n\n+\n\n@r6\nA\n+\n\x7f\n@r7\nACG\n+\n")
    got = {x.name: x.wrong for x in reads.read_fastq(spark, str(tmp_path / "r.fq")).collect()}
    assert got == {"stray": "no header", "r1": "", "r2": "no plus line", "r3": "", "r4": "letters", "r5": "empty", "r6": "quality out of range", "r7": "not four lines"}
    (tmp_path / "none.fq").write_text("")
    assert reads.read_fastq(spark, str(tmp_path / "none.fq")).count() == 0


def test_gzip_of_several_members_by_its_first_bytes(spark, tmp_path):
    rows = records(random.Random(7), 30)
    members = b"".join(gzip.compress(text_of(rows[i : i + 10]).encode()) for i in range(0, 30, 10))
    for name in ("x.fastq", "y.fastq.gz"):
        folder = tmp_path / name
        folder.mkdir()
        (folder / name).write_bytes(members)
        assert sorted(tuple(x)[:3] for x in reads.read_fastq(spark, str(folder)).collect()) == sorted(rows)
    mixed = tmp_path / "x.fastq"
    (mixed / "plain.fastq").write_text(text_of([("p", "ACGT", "IIII")]))
    assert reads.read_fastq(spark, str(mixed)).where("wrong = ''").count() == 31
    (tmp_path / "f.fa").write_bytes(gzip.compress(b">a one\nAC\nGT\n") + gzip.compress(b">b\nGG\n"))
    assert sorted(tuple(x) for x in reads.read_fasta(spark, str(tmp_path / "f.fa")).collect()) == [("a", "a one", "ACGT"), ("b", "b", "GG")]


def test_fasta_faults(spark, tmp_path):
    (tmp_path / "f.fa").write_text(">a one\nACGT\n>b\n\n>c\nACGJ\n>a two\nnn\n>\nAC\n")
    got = sorted((x.id or "", x.fault) for x in reads.fasta_faults(reads.read_fasta(spark, str(tmp_path / "f.fa"))).collect())
    assert got == [("", "no id"), ("a", "duplicate"), ("b", "empty"), ("c", "letters")]


def test_pairs_that_are_not_in_step(spark):
    first = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "name string")
    second = spark.createDataFrame([("a",), ("c",), ("d",)], "name string")
    assert sorted(tuple(x) for x in reads.unsynchronised(first, second).collect()) == [("b", 1, 0), ("c", 2, 1), ("d", 0, 1)]


def test_sam_lines_that_are_not_whole(spark, tmp_path):
    (tmp_path / "a.sam").write_text("q1\t0\tr\t5\t60\t4M\t=\t9\t8\tACGT\tIIII\tNM:i:1\tX\nq2\t0\tr\nq3\tx\tr\t5\t60\t4M\t=\t9\t8\tACGT\tIIII\nq4\t0\tr\t5\t60\t4M\t=\t9\t8\tACGT\tIII\n")
    assert {x.qname: x.wrong for x in T.read_sam(spark, str(tmp_path / "a.sam")).collect()} == {"q1": "", "q2": "fields", "q3": "numbers", "q4": "lengths differ"}
