"""Text readers on files of a few records."""

import pytest
from pyspark.sql import functions as F

from cohortmill.sources import text_tables as T


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def test_table_is_strict(spark, tmp_path):
    good = put(tmp_path, "a.tsv", "id\tn\nx\t1\ny\t\n")
    assert sorted(map(tuple, T.read_table(spark, good, "id string, n int").collect()), key=str) == [("x", 1), ("y", None)]
    for text in ("id\tn\nx\tone\n", "id\tm\nx\t1\n", "id\tn\nx\t1\t2\n"):
        with pytest.raises(Exception):
            T.read_table(spark, put(tmp_path, "b.tsv", text), "id string, n int").collect()


def test_typed_rows_and_rejects(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", "3"), ("", "y")], "a string, b string")
    good, bad = T.typed(df, {"a": "int", "b": "double"})
    assert good.collect() == [(1, 2.5)] and sorted(r.wrong for r in bad.collect()) == ["a", "b"]


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">one first record\nACGT\nAC\n>two\r\nGG\r\n>empty\n")
    rows = {r.id: (r.header, r.seq) for r in T.read_fasta(spark, path).collect()}
    assert rows == {"one": ("one first record", "ACGTAC"), "two": ("two", "GG"), "empty": ("empty", "")}
    df = spark.createDataFrame([("h", "A" * 165)], "header string, seq string")
    assert T.fasta_text(df).first().value == ">h\n" + "A" * 80 + "\n" + "A" * 80 + "\n" + "A" * 5


def test_sam(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@HD\tVN:1\nq1\t65\tr\t5\t60\t4M\t=\t9\t8\tACGT\tIIII\tNM:i:1\tAS:i:3\nq1\t129\tr\t9\t60\t4M\t=\t5\t-8\tACGT\tIIII\n")
    a, b = T.read_sam(spark, path).orderBy("pos").collect()
    assert (a.qname, a.pos, a.mate, a.tags) == ("q1", 4, 1, {"NM": "1", "AS": "3"}) and (b.pos, b.mate, b.tags) == (8, 2, {})


def test_list_cells(spark):
    df = spark.createDataFrame([(1, "a;b", "1;2")], "id int, u string, m string")
    assert sorted(map(tuple, T.zip_lists(df, ["id"], {"url": "u", "md5": "m"}).collect())) == [(1, "a", "1"), (1, "b", "2")]
    with pytest.raises(Exception):
        T.zip_lists(spark.createDataFrame([(1, "a;b", "1")], "id int, u string, m string"), ["id"], {"url": "u", "md5": "m"}).collect()
    cell = spark.createDataFrame([("ID=x;Parent=y",)], "a string").select(T.attribute_map(F.col("a"))).first()[0]
    assert cell == {"ID": "x", "Parent": "y"}


def test_fastq_bed_and_blast(spark, tmp_path):
    from cohortmill.sources import text_tables as T

    (tmp_path / "r.fq").write_text("@r1/1 x\nACGT\n+\nII@I\n@r2\nAC\n+\nI\n@r3\nAC\nII\n")
    got = {r.name: (r.seq, r.qual, r.wrong) for r in T.read_fastq(spark, str(tmp_path / "r.fq")).collect()}
    assert got["r1"] == ("ACGT", "II@I", "") and got["r2"][2] == "lengths differ" and got["r3"][2] == "no plus line"
    (tmp_path / "m.bed").write_text("# c\nctg\t0\t5\tname\n")
    assert [tuple(r) for r in T.read_bed(spark, str(tmp_path / "m.bed")).collect()] == [("ctg", 0, 5)]
    (tmp_path / "bad.bed").write_text("ctg\t5\t5\n")
    with pytest.raises(Exception):
        T.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "b.tsv").write_text("a\tb\t99.0\t10\t0\t0\t1\t10\t11\t2\t0.0\t50\na\tz\t99.0\t10\t0\t0\t1\t10\t1\t10\t0.0\t50\na\tb\t99.0\t10\t0\t0\t1\t30\t1\t10\t0.0\t50\n")
    lengths = spark.createDataFrame([("a", 20), ("b", 20)], "id string, length long")
    assert sorted(r.wrong for r in T.read_blast(spark, str(tmp_path / "b.tsv"), lengths).collect()) == ["", "outside", "unknown subject"]


def test_units_and_sinks(spark, tmp_path):
    from cohortmill.sources import text_tables as T

    df = spark.createDataFrame([(2, None, "x"), (1, "b", "y")], "id long, name string, extra string")
    for u in ("u1", "u2"):
        T.write_table(df, f"{tmp_path}/in/{u}/t.tsv", ["id", "name"], ["id"])
    with pytest.raises(Exception):
        T.write_table(df, f"{tmp_path}/in/u1/t.tsv", ["id"], ["id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "in/u1/t.tsv").glob("part-*")))
    assert text.replace("id\tname\n", "") == "1\tb\n2\tNA\n"
    for u in ("u1", "u2"):
        (tmp_path / "flat" / u).mkdir(parents=True)
        (tmp_path / "flat" / u / "t.tsv").write_text("id\tname\n1\tb\n")
    units = spark.createDataFrame([("u1",), ("u2",)], "unit_id string")
    assert T.gather_units(spark, f"{tmp_path}/flat", "t.tsv", "id long, name string", units).count() == 2
    with pytest.raises(ValueError, match="u2"):
        T.gather_units(spark, f"{tmp_path}/flat", "t.tsv", "id long, name string", units.where("unit_id = 'u1'"))
    assert T.write_once(df, f"{tmp_path}/once", "v1") and not T.write_once(df, f"{tmp_path}/once", "v1")
    with pytest.raises(ValueError):
        T.write_once(df, f"{tmp_path}/once", "v2")


def test_tool_tables(spark, tmp_path):
    from cohortmill.sources import text_tables as T

    (tmp_path / "a.tsv").write_text("# made by a tool\nname\tn\tscore\nx\t1\t0.5\ny\tNA\thigh\r\n\nz\t3\n")
    out = {x.name: (x.n, x.score, x.wrong) for x in T.read_tool_table(spark, f"{tmp_path}/a.tsv", {"name": "string", "n": "long", "score": "double"}).collect()}
    assert out == {"x": (1, 0.5, ""), "y": (None, None, "score"), "z": (3, None, "cells")}
    (tmp_path / "b.txt").write_text("# target  query\ng1   PF1  1e-5  a long name\ng2   PF2  0.1  -\n")
    rows = T.read_tool_table(spark, f"{tmp_path}/b.txt", {"target": "string", "e": "double", "about": "string"}, ["target", "query", "e", "about"], sep=" +").collect()
    assert [(x.target, x.e, x.about, x.wrong) for x in rows] == [("g1", 1e-5, "a long name", ""), ("g2", 0.1, None, "")]
    with pytest.raises(ValueError, match="nothing"):
        T.read_tool_table(spark, f"{tmp_path}/a.tsv", {"nothing": "string"})


def test_a_killed_write_can_be_repeated(spark, tmp_path):
    df = spark.range(5)
    broken = df.selectExpr("if(id = 3, raise_error('killed'), id) as id")
    with pytest.raises(Exception):
        T.write_once(broken, f"{tmp_path}/once", "v1")
    assert list(tmp_path.iterdir()) == []  # nothing half made
    assert T.write_once(df, f"{tmp_path}/once", "v1") and spark.read.parquet(f"{tmp_path}/once/rows").count() == 5


def test_of_two_runs_one_publishes(spark, tmp_path):
    class Late:
        """A table whose writing takes so long that another run publishes first."""

        def __init__(self, df, meanwhile):
            self.df, self.meanwhile, self.sparkSession = df, meanwhile, df.sparkSession

        @property
        def write(self):
            self.meanwhile()
            return self.df.write

    same = Late(spark.range(5), lambda: T.write_once(spark.range(7), f"{tmp_path}/a", "v1"))
    assert not T.write_once(same, f"{tmp_path}/a", "v1") and spark.read.parquet(f"{tmp_path}/a/rows").count() == 7
    other = Late(spark.range(5), lambda: T.write_once(spark.range(7), f"{tmp_path}/b", "v2"))
    with pytest.raises(ValueError):
        T.write_once(other, f"{tmp_path}/b", "v1")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"] and not list((tmp_path / "b").glob("_*"))


def test_alignments_against_their_sequences(spark, tmp_path):
    from cohortmill.sources import alignments as A

    sequences = spark.createDataFrame([("a", "ACGTRACGTT"), ("b", "ttacgtyaaa")], "id string, seq string")
    std = lambda q, s, *at: f"{q}\t{s}\t99.5\t4\t0\t0\t" + "\t".join(map(str, at)) + "\t1e-5\t50"
    rows = {
        "": std("a", "b", 1, 4, 3, 6) + "\t10\t10\tACG-T\tacg-t\r", "back": std("a", "b", 1, 5, 7, 3) + "\t10\t10\tACGTR\tRACGT", "letters": std("a", "b", 1, 4, 3, 6) + "\t10\t10\tACGT\tACGA",
        "length": std("a", "b", 1, 4, 3, 6) + "\t11\t10\tACGT\tACGT", "outside": std("a", "b", 8, 11, 3, 6) + "\t10\t10\tGTT\tACGT", "low": std("a", "b", 0, 4, 3, 6) + "\t10\t10\tACGT\tACGT",
        "query": std("z", "b", 1, 4, 3, 6) + "\t10\t10\tACGT\tACGT", "subject": std("a", "z", 1, 4, 3, 6) + "\t10\t10\tACGT\tACGT", "number": std("a", "b", 1, "x", 3, 6) + "\t10\t10\tACGT\tACGT", "columns": std("a", "b", 1, 4, 3, 6),
    }
    (tmp_path / "x.tsv").write_text("# note\n\n" + "\n".join(rows.values()) + "\n")
    got = sorted(r.wrong for r in A.read_alignments(spark, str(tmp_path / "x.tsv"), sequences, A.ALIGNED).collect())
    assert got == sorted(["" if k == "back" else "outside" if k == "low" else k for k in rows])
    (tmp_path / "y.tsv").write_text("\n".join([std("a", "b", 1, 4, 6, 3), std("a", "b", 1, 4, 7, 11), std("a", "b", 1, 4, 3, 6) + "\tmore", std("a", "b", 1, 4, 3, 6).replace("99.5", "nan")]) + "\n")
    twelve = A.read_alignments(spark, str(tmp_path / "y.tsv"), sequences)
    assert sorted(r.wrong for r in twelve.collect()) == ["", "columns", "number", "outside"]
    lengths = sequences.selectExpr("id", "length(seq) AS length")
    assert [tuple(r) for r in A.placed(twelve, lengths, 3).collect()] == [("a", "b", 99.5, 0, 4, 2, 6, "-", True)]
    (tmp_path / "z.tsv").write_text("a\tb\t90\t4\t1\t4\t3\t6\n")
    assert [(r.send, r.wrong) for r in A.read_alignments(spark, str(tmp_path / "z.tsv"), sequences, A.SHORT).collect()] == [(6, "")]
    (tmp_path / "none.tsv").write_text("")
    assert A.read_alignments(spark, str(tmp_path / "none.tsv"), sequences, A.ALIGNED).count() == 0


def test_a_feature_line_is_cut_once(spark):
    """Fields are cut in a projection of their own: a cut written into every column is done for every column."""
    from cohortmill.sources import gff

    lines = spark.createDataFrame([("s1\tx\tCDS\t11\t40\t.\t-\t0\tID=c%3B1;Parent=m1,m%2C2;Note=a",), ("s1\tx\tgene\t5\t4\t.\t+\t.\tID=g",), ("s1\tx\tgene\t1\t4\t.\t+\t.\tID=g;ID=h",), ("# x",), ("",)], "value string")
    out = gff.records(lines)
    assert [(r.id, r.parents, r.start0, r.end0, r.wrong) for r in out.collect()] == [("c;1", ["m1", "m,2"], 10, 40, ""), ("g", [], 4, 4, "interval"), (None, [], 0, 4, "attributes")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1


def test_stage_leaves_no_shuffle_files(spark):
    """However large the driver's heap and whoever still holds the table's plan; the session's own setting comes back."""
    import time
    from pathlib import Path

    from pyspark.sql import functions as F

    from cohortmill.sources.shared import stage

    def files():
        return {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}

    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    own = spark.conf.get(key)
    rows = spark.range(20_000).withColumn("x", F.xxhash64("id")).repartition(4, "x").groupBy("x").count()
    out = stage(rows, "rows", n="count(1)")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key) == own and out.count() == 20_000
    rows.write.format("noop").mode("overwrite").save()
    assert rows.count() == 20_000
