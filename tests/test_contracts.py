"""Strict readers on small files."""

import pytest
from pyspark.sql import functions as F

from cohortmill.sources import contracts, gff


def test_json_faults():
    f = contracts.json_faults
    assert f('{"a": 1, "b": [{"c": null}]}') == [] and f("1e999") == [("$", "not finite")] and f("") == [("$", "not json")]
    assert f('{"a": {"k": 1, "k": {"x": NaN}}, "a": 2}') == [("$.a", "duplicate key"), ("$.a.k", "duplicate key"), ("$.a.k.x", "not finite")]
    assert f("[" * 100_000) == [("$", "not json")]


def test_contract_files(spark, tmp_path):
    kinds = {"id": "integer", "ok": "boolean", "x": "number", "note": "string"}
    (tmp_path / "a.tsv").write_text("ok\tid\tnote\tx\r\ntrue\t1\tn\t-0.5e2\r\n\t2\t\t\r\nyes\t03\tn\tNaN\r\n")
    (tmp_path / "b.tsv").write_text("ok\tid\tnote\tx\nfalse\t9007199254740993\tm\t1\n1\t2\n")
    good, bad = contracts.read_contract(spark, str(tmp_path), kinds, required=["id"])
    assert sorted((r.id, r.ok, r.x, r.note) for r in good.collect()) == [(1, True, -50.0, "n"), (2, None, None, None), (9007199254740993, False, 1.0, "m")]
    assert sorted((r.column, r.reason) for r in bad.collect()) == [("", "ragged"), ("id", "not integer"), ("ok", "not boolean"), ("x", "not number")]
    (tmp_path / "b.tsv").write_text("ok\tid\tnote\ty\n")
    with pytest.raises(ValueError, match="several headers"):
        contracts.read_contract(spark, str(tmp_path), kinds)
    for header in ("ok\tid\tnote", "ok\tid\tnote\tx\tx", "ok\tid\tnote\ty"):
        (tmp_path / "c").mkdir(exist_ok=True)
        (tmp_path / "c" / "c.tsv").write_text(header + "\n")
        with pytest.raises(ValueError, match="exactly"):
            contracts.read_contract(spark, str(tmp_path / "c"), kinds)


def test_last_report_counts(spark):
    body = lambda *rs: '{"reports": [' + ", ".join(rs) + "]}"
    pages = spark.createDataFrame([("p1", body('{"accession": "a", "n": 1}', '{"accession": "b", "n": 2}', '{"accession": "a", "n": 3}')), ("p2", body('{"accession": "b", "n": 4}', '{"n": 5}')), ("p3", "{}"), ("p4", None)], "page string, body string")
    got = {r.accession: (r.report.n, r.page, r.place, r.n_seen) for r in contracts.latest_reports(pages, "page", "body", "accession string, n long").collect()}
    assert got == {"a": (3, "p1", 2, 2), "b": (4, "p2", 0, 2)}
    cell = spark.sql("select array(named_struct('name', 'Host', 'value', 'x'), named_struct('name', 'host', 'value', 'y'), named_struct('name', null, 'value', 'z')) as a")
    assert cell.select(contracts.attributes("a")).first()[0] == {"host": "y"}


def test_gff_lines(spark, tmp_path):
    text = """##gff-version 3
s1\tx\tgene\t1\t900\t.\t+\t.\tID=g1;Name=a%3Bb%25
s1\tx\tmRNA\t1\t900\t.\t+\t.\tID=m1;Parent=g1
s1\tx\tCDS\t11\t20\t1.5\t+\t0\tID=c1;Parent=m1
s1\tx\tCDS\t31\t50\t.\t+\t2\tID=c1;Parent=m1
s1\tx\tCDS\t101\t110\t.\t-\t2\tID=c2;Parent=m2
s1\tx\tCDS\t121\t130\t.\t-\t0\tID=c2;Parent=m2
s1\tx\tCDS\t1\t9\t.\t+\t.\tID=c3
s1\tx\tCDS\t9\t1\t.\t+\t0\tID=c4
s1\tx\tgene\t1\t9\t.\tx\t.\tID=c5
s1\tx\tgene\t1\t9\t.\t+\t.\tID=c6;ID=c7
s1\tx\texon\t1\t9\t.\t+\t.\tParent=m1,m9
s1\tx\tnode\t1\t9\t.\t+\t.\tID=l1;Parent=l2
s1\tx\tnode\t1\t9\t.\t+\t.\tID=l2;Parent=l1
only two\tfields
"""
    (tmp_path / "a.gff").write_text(text)
    rows = gff.read_gff(spark, str(tmp_path / "a.gff")).cache()
    assert sorted(r.wrong for r in rows.collect() if r.wrong) == ["attributes", "fields", "interval", "phase", "strand"]
    g = rows.where("id = 'g1'").first()
    assert (g.attributes["Name"], g.start0, g.end0, g.parents) == ("a%3Bb%25", 0, 900, []) and rows.where("type = 'exon'").first().parents == ["m1", "m9"]
    found = {r.id: (r.n_parts, r.length, [tuple(p) for p in r.parts], r.fault) for r in gff.coding_sequences(rows).collect()}
    assert found == {"c1": (2, 30, [(10, 20), (30, 50)], ""), "c2": (2, 20, [(120, 130), (100, 110)], "length")}
    up = {r.id: (r.root, r.depth, r.status) for r in gff.ancestors(rows.where("wrong = '' and id <> 'c3'")).collect()}
    assert up == {"g1": ("g1", 0, "root"), "m1": ("g1", 1, "child"), "c1": ("g1", 2, "child"), "c2": ("c2", 0, "orphan"), "l1": (None, None, "cycle"), "l2": (None, None, "cycle")}


def test_ancestors_of_a_long_chain(spark):
    rows = spark.createDataFrame([(f"n{i}", [f"n{i - 1}"] if i else []) for i in range(100)], "id string, parents array<string>")
    got = {r.id: (r.root, r.depth) for r in gff.ancestors(rows).collect()}
    assert got == {f"n{i}": ("n0", i) for i in range(100)}


def test_later_parts_have_the_phase_that_the_first_ones_leave(spark):
    line = lambda i, a, b, p, strand="+": ("\t".join(["s", "x", "CDS", str(a), str(b), ".", strand, str(p), f"ID={i}"]),)
    lines = [line("ok", 1, 10, 0), line("ok", 20, 30, 2), line("ok", 40, 48, 0), line("odd", 1, 10, 0), line("odd", 20, 30, 1), line("part", 1, 10, 1), line("over", 1, 10, 0), line("over", 5, 9, 0), line("far", 1, 9, 0), line("far", 20, 28, 0, "-")]
    rows = gff.records(spark.createDataFrame(lines, "value string"))
    assert {r.id: r.fault for r in gff.coding_sequences(rows).select("id", F.col("fault")).collect()} == {"ok": "", "odd": "phase", "part": "partial", "over": "overlap", "far": "places"}


def test_rejects_read_each_cell_once(spark):
    """Small tables are dealt to all tasks before their cells are read, and no filter reads the cells on the way."""
    from cohortmill.plans import contracts as plans

    out = plans.contract_rejects(spark, "/root/testdata/sf0.001")
    text = out._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("Repartition"):]
    assert "RLIKE" in text[:text.index("Repartition")] and "RLIKE" not in below


def test_alignment_programs_are_read_once(spark):
    from cohortmill.plans import coverage as plans

    out = plans.fragment_positions(spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("nm_contradicts_cigar") == 0  # no fault is worked out again
