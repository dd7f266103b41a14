"""Small hand-checkable cases and properties of the operators."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortmill.functions import sequences as S
from cohortmill.functions import values as V
from cohortmill.operators import checks, clustering, elements, evidence, execution, graph, intervals, loci, ranking, selection, shape, stats


def test_published_statistics(spark):
    assert abs(stats.fisher_p(5, 0, 0, 5) - 2 / 252) < 1e-12
    df = spark.createDataFrame([(i, 2 / 252 if i < 130 else 1.0) for i in range(815)], "id int, p double").withColumn("all", F.lit(1))
    q = stats.bh_adjust(df, ["all"], "p").where("id < 130").select("q").distinct().collect()
    assert len(q) == 1 and abs(q[0].q - 0.0497558) < 1e-7


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join_is_the_nested_loop(spark, seed):
    r = random.Random(seed)
    make = lambda n: [(r.randint(0, 2), i, s := r.randint(0, 3000), s + r.choice([0, 1, 5, 300, 2000])) for i in range(n)]
    a, b = make(60), make(60)
    schema = "k int, id int, start0 int, end0 int"
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], width=128).select("l.id", F.col("r.id").alias("id2"), "overlap").collect()
    want = sorted((x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[3] > x[2] and y[3] > y[2])
    assert sorted(map(tuple, got)) == want


def test_depth_does_not_depend_on_blocks(spark):
    rows = [(1, i * 7 % 500, i * 7 % 500 + 40) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, start0 int, end0 int")
    depth = [0] * 600
    for _, a, b in rows:
        for x in range(a, b):
            depth[x] += 1
    for block in (16, 1 << 16):
        out = [0] * 600
        for s in intervals.depth_segments(df, ["k"], block).collect():
            for x in range(s.start0, s.end0):
                out[x] += s.depth
        assert out == depth


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 500), (None, 1), (201, 200)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {500: 500, 200: 200, 201: 200}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_three_valued_evidence(spark):
    df = spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    got = {(r.a, r.b): r.x for r in df.withColumn("x", V.both_sides("a", "b")).collect()}
    assert got == {(a, b): (True if a and b else False if a is False and b is False else None) for a in (True, False, None) for b in (True, False, None)}
    rows = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, False)], "k int, e boolean")
    assert dict(rows.groupBy("k").agg(V.tri_or("e")).collect()) == {1: True, 2: None, 3: False}


def test_sequences(spark):
    row = spark.createDataFrame([("acgtt", "")], "s string, e string").select(S.reverse_complement("s"), S.canonical("s"), S.entropy("e"), S.translate_codons("e", S.standard_code()), F.size(S.kmers("e", 3))).first()
    assert tuple(row) == ("aacgt", "aacgt", None, "", 0)


def test_round_robin_takes_one_of_each_stratum(spark):
    rows = [("u", "a", i, False) for i in range(5)] + [("u", "b", 10 + i, False) for i in range(2)] + [("u", "a", 99, True)]
    out = ranking.round_robin(spark.createDataFrame(rows, "u string, s string, q int, t boolean"), ["u"], "s", F.col("t"), [F.desc("q")], 5)
    assert [r.q for r in out.orderBy("pick").collect()] == [99, 4, 11, 3, 10]


def test_checks_on_clean_and_dirty_tables(spark):
    clean = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    dirty = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert checks.duplicate_keys(clean, ["k"]).count() == 0 and checks.duplicate_keys(dirty, ["k"]).count() == 2
    assert checks.dependency_conflicts(clean, ["k"], "v").count() == 0 and checks.dependency_conflicts(dirty, ["k"], "v").count() == 1
    assert checks.missing_references(dirty, "k", clean, "k").count() == 0 and checks.missing_references(dirty, "k", clean, "k", required=True).count() == 1
    assert checks.fingerprint(clean).first() == checks.fingerprint(clean.orderBy(F.desc("k"))).first() != checks.fingerprint(dirty).first()


def test_upsert_refuses_changed_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, v string")
    assert {r.k: (r.v, r.action) for r in shape.upsert(old, new, "k").collect()} == {1: ("a", "kept"), 2: ("b", "refused"), 3: (None, "kept"), 4: ("d", "added")}


def test_unions_need_equal_schemas(spark):
    with pytest.raises(ValueError):
        shape.union_strict(spark.range(1), spark.range(1).selectExpr("cast(id as int) id"))


@pytest.mark.parametrize("seed", range(2))
def test_greedy_rounds_are_the_greedy_walk(spark, seed):
    from cohortmill.operators import clustering

    r = random.Random(seed)
    nodes = list(range(40))
    edges = [(r.randrange(35), r.randrange(35)) for _ in range(60)]
    rank = {n: x for n, x in zip(nodes, r.sample(range(1000), 40))}
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in nodes}
    reps = []
    for n in sorted(nodes, key=rank.get):
        if not near[n] & set(reps):
            reps.append(n)
    df = spark.createDataFrame(list(rank.items()), "node int, rank int")
    e = spark.createDataFrame(edges, "a int, b int")
    out = clustering.greedy_representatives(df, e).cache()
    assert {x.node for x in out.where("is_representative").collect()} == set(reps)
    found = {x.node: (x.status, x.representatives) for x in clustering.memberships(out, e).collect()}
    for n in nodes:
        mine = sorted(map(str, near[n] & set(reps)))
        assert found[n] == (("representative", str(n)) if n in reps else ("member" if len(mine) == 1 else "ambiguous", ";".join(mine)))


def test_cigar_blocks(spark):
    from cohortmill.functions import cigar

    row = spark.createDataFrame([("3S4M2D5=1I6X7N2M1H",)], "c string").select(cigar.blocks("c", F.lit(100)).alias("b"), cigar.length_of(cigar.operations("c"), cigar.QUERY).alias("n")).first()
    assert [(b.query0, b.ref0, b.n) for b in row.b] == [(3, 100, 4), (7, 106, 5), (13, 111, 6), (19, 124, 2)] and row.n == 21


def test_fisher_by_logarithms_equals_integers():
    from cohortmill.operators import stats

    r = np.random.default_rng(1)
    for _ in range(60):
        a, b, c, d = (int(x) for x in r.integers(0, 480, 4))
        exact = stats.fisher_p(a, b, c, d)
        old, stats.EXACT_TOTAL = stats.EXACT_TOTAL, -1
        try:
            assert abs(stats.fisher_p(a, b, c, d) - exact) < 1e-7
        finally:
            stats.EXACT_TOTAL = old
    assert 0 < stats.fisher_p(30_000, 31_000, 30_500, 31_500) <= 1


def test_rank_sum_p_equals_all_assignments():
    from itertools import combinations

    from cohortmill.operators import stats

    r = np.random.default_rng(2)
    for n, n1 in ((10, 5), (9, 3), (11, 6), (6, 1)):
        ranks = np.sort(r.integers(1, 8, n) * 2)
        seen, total = int(ranks[:n1].sum()), int(ranks.sum())
        far = [abs(sum(x) * n - total * n1) >= abs(seen * n - total * n1) for x in combinations(ranks.tolist(), n1)]
        assert abs(stats.rank_sum_p(ranks, n1, seen) - np.mean(far)) < 1e-12
    assert abs(stats.rank_sum_p(np.arange(2, 22, 2), 5, 30) - 2 / 252) < 1e-12


def test_no_feature_is_lost(spark):
    """Features of two, eleven, forty and sixty units, some without values in a group."""
    from cohortmill.operators import stats

    rows = [(f, i, i % 2 == 0, i % 3 == 0, float(i)) for f, n in (("two", 2), ("eleven", 11), ("forty", 40), ("sixty", 60)) for i in range(n)]
    rows += [("none", i, i % 2 == 0, None, None) for i in range(8)]
    df = spark.createDataFrame(rows, "feature string, unit long, one boolean, hit boolean, v double")
    got = {r.feature: r for r in stats.compare_groups(df, "feature", "one", "hit", "v").collect()}
    assert set(got) == {"two", "eleven", "forty", "sixty", "none"}
    assert got["two"].perm_p is None and got["two"].value_status == "not_tested_few_units" and got["none"].detection_status == "not_tested_few_units" and got["none"].fisher_p is None
    assert got["forty"].perm_p is not None and got["forty"].perm_q_both is not None and got["sixty"].value_status == "not_tested_many_units"


def test_representatives_walk_with_deferred_bridges(spark):
    import itertools

    from cohortmill.operators import clustering

    r = random.Random(5)
    nodes = [(f"n{i:02}", r.randrange(10, 30), r.choice(["high", "low", "other"])) for i in range(36)]
    edges = [tuple(r.sample([n[0] for n in nodes[:33]], 2)) for _ in range(90)]
    near = {n[0]: {b for a, b in edges if a == n[0]} | {a for a, b in edges if b == n[0]} for n in nodes}
    size = {n[0]: n[1] for n in nodes}
    bridge = {n for n in near if any(b not in near[a] for a, b in itertools.combinations([m for m in near[n] if size[m] > size[n]], 2))}
    place = {"high": 1, "low": 2, "other": 3}
    order = sorted(nodes, key=lambda n: (n[0] in bridge, -n[1] if n[0] in bridge else 0, place[n[2]], -n[1], n[0]))
    reps = []
    for n, _, _ in order:
        if not near[n] & set(reps):
            reps.append(n)
    df = spark.createDataFrame(nodes, "node string, length int, quality string")
    e = spark.createDataFrame(edges, "a string, b string")
    rank = clustering.quality_rank(F.col("quality"), F.lit("x"), F.col("length"), F.col("node"), ["high", "low"], [])
    found = {x.node for x in clustering.bridges(df, e).where("is_bridge").collect()}
    assert found == bridge and bridge
    out, matches = clustering.representatives(df, e, rank)
    got = {x.node: (x.status, x.n_representatives, x.representative) for x in out.collect()}
    pairs = {(x.node, x.representative) for x in matches.collect()}
    for n in near:
        mine = {n} if n in reps else near[n] & set(reps)
        assert got[n] == ("representative" if n in reps else "member" if len(mine) == 1 else "ambiguous", len(mine), next(iter(mine)) if len(mine) == 1 else None)
        assert {b for a, b in pairs if a == n} == mine


def plain_union(hsps, evalue_max):
    """Letter by letter, with sets."""
    out = {}
    for h in sorted(hsps, key=lambda h: (h["q"], h["s"], -h["bitscore"], -h["pident"], -h["length"], h["qstart"], h["qend"], h["sstart"], h["send"], h["qseq"], h["sseq"])):
        t = out.setdefault((h["q"], h["s"]), dict(q=set(), s=set(), columns=0, same=0, n=(h["qlen"], h["slen"])))
        if h["evalue"] > evalue_max:
            continue
        i, j = h["qstart"], h["sstart"]
        for a, b in zip(h["qseq"], h["sseq"]):
            if (a == "-" or i not in t["q"]) and (b == "-" or j not in t["s"]):
                t["columns"] += 1
                t["same"] += a == b and a in "ACGT"
                t["q"] |= {i} if a != "-" else set()
                t["s"] |= {j} if b != "-" else set()
            i += 0 if a == "-" else 1 if h["qend"] >= h["qstart"] else -1
            j += 0 if b == "-" else 1 if h["send"] >= h["sstart"] else -1
    done = {}
    for k, t in out.items():
        fq, fs = len(t["q"]) / t["n"][0], len(t["s"]) / t["n"][1]
        part = min(fq, fs) if t["n"][0] == t["n"][1] else fq if t["n"][0] < t["n"][1] else fs
        done[k] = (t["columns"], t["same"], round(100 * part, 6), len(t["q"]), len(t["s"]))
    return done


def test_alignment_union_is_the_walk_by_letters(spark):
    from cohortmill.operators import clustering

    r = random.Random(3)
    hsps = []
    for _ in range(160):
        n = r.randrange(8, 30)
        pairs = [(r.choice("ACGTN"), r.choice("ACGT")) for _ in range(n)]
        pairs = [("-", b) if r.random() < 0.1 else (a, "-") if r.random() < 0.1 else (a, a if r.random() < 0.8 else b) for a, b in pairs]
        qseq, sseq = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
        nq, ns = (len(x.replace("-", "")) for x in (qseq, sseq))
        if not nq or not ns:
            continue
        q0, s0 = r.randrange(1, 60), r.randrange(1, 60)
        s1, s2 = (s0, s0 + ns - 1) if r.random() < 0.5 else (s0 + ns - 1, s0)
        s = r.choice("xyz")
        hsps.append(dict(q=r.choice("ab"), s=s, qstart=q0, qend=q0 + nq - 1, sstart=s1, send=s2, qlen=100, slen={"x": 100, "y": 95, "z": 130}[s], qseq=qseq, sseq=sseq, pident=float(r.randrange(80, 100)), length=n, evalue=r.choice([1e-9, 1e-3]), bitscore=float(r.randrange(20, 25))))
    out = clustering.alignment_union(spark.createDataFrame(hsps))
    got = {(x.q, x.s): (x.columns, x.identical, round(x.aligned_fraction, 6), x.q_covered, x.s_covered) for x in out.collect()}
    assert got == plain_union(hsps, 1e-5)
    assert clustering.alignment_union(spark.createDataFrame(hsps).where("false")).count() == 0


def test_fragments_against_a_second_run(spark):
    from cohortmill.operators import fragments

    cols = "qname string, mate int, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long"
    pair = lambda q, f1=2, f2=18: [(q, 1, f1, "r", 100, 40, "50M", "=", 300, 250), (q, 2, f2, "r", 300, 40, "50M", "=", 100, -250)]
    rows = [*pair("good"), *pair("moved"), *pair("low"), *pair("none"), *pair("back", 18, 2), pair("single")[0], *pair("twice"), pair("twice")[0], *pair("many"), ("many", 1, 256, "s", 5, 0, "50M", "=", 1, 1)]
    df = spark.createDataFrame(rows, cols)
    other = [("good", 1, 2, "r", 100, "50M", 50), ("good", 2, 18, "r", 300, "50M", 50), ("moved", 1, 2, "r", 101, "50M", 50), ("moved", 2, 18, "r", 300, "50M", 50), ("low", 1, 2, "r", 100, "50M", 3), ("low", 2, 18, "r", 300, "50M", 50),
             ("none", 1, 2, "r", 100, "50M", 255), ("none", 2, 18, "r", 300, "50M", 50), ("back", 1, 18, "r", 100, "50M", 50), ("back", 2, 2, "r", 300, "50M", 50)]
    ordinary = spark.createDataFrame(other, "qname string, mate int, flag int, rname string, pos long, cigar string, mapq int")
    out = fragments.outcomes(df, F.lit(True), 10, 5, 200, 600, "fr", True, ordinary)
    got = {x.qname: (x.outcome, x.reference) for x in out.collect()}
    assert got == {"good": ("assigned", "r"), "moved": ("primary_alignment_not_reconciled", None), "low": ("mapq_filter", None), "none": ("mapq_unavailable", None), "back": ("discordant_pair", None), "single": ("malformed", None),
                   "twice": ("malformed", None), "many": ("ambiguous_or_reporting_saturated", None)}
    assert {(x.qname, x.rname) for x in fragments.ambiguous_targets(df, F.lit(True), out).collect()} == {("many", "r"), ("many", "s")}
    assert {x.outcome for x in fragments.outcomes(df, F.lit(True), 10, 1, 200, 600).where("qname = 'good'").collect()} == {"ambiguous_or_reporting_saturated"}
    assert {x.outcome for x in fragments.outcomes(df.where("mate = 1 and qname = 'good'").withColumn("mate", F.lit(0)), F.lit(True), 10, 5, 200, 600, paired=False).collect()} == {"assigned"}


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_runs_do_not_depend_on_blocks(spark, block):
    r = random.Random(block)
    rows = [(r.choice("ab"), x, x + r.choice([0, 1, 3, 40])) for x in (r.randrange(-5, 900) for _ in range(150))]
    got = sorted((x.c, x.start0, x.end0) for x in intervals.merged(spark.createDataFrame(rows, "c string, start0 long, end0 long"), ["c"], block).collect())
    want = []
    for c, s, e in sorted(x for x in rows if x[2] > x[1]):
        if want and want[-1][0] == c and s <= want[-1][2]:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([c, s, e])
    assert got == [tuple(x) for x in want]


def test_units_are_merged_only_where_they_agree(spark):
    units = spark.createDataFrame([(i, "lib" if i < 5 else None, "PE" if i != 3 else "SE") for i in range(1, 10)], "readset long, library string, layout string")
    rows = [("good", 1), ("good", 2), ("mixed", 3), ("mixed", 4), ("lost", 5), ("lost", 99), ("7", 6), ("twice", 8), ("other", 8), ("nulls", 7), ("nulls", 9)]
    out, refused = shape.merged_units(units, spark.createDataFrame(rows, "merge_id string, readset long"), "readset", ["library", "layout"])
    assert {(x.unit_id, x.readset) for x in out.collect()} == {("good", 1), ("good", 2), ("3", 3), ("4", 4), ("5", 5), ("6", 6), ("8", 8), ("nulls", 7), ("nulls", 9)}
    assert {(x.merge_id, x.why) for x in refused.collect()} == {("mixed", "not_compatible"), ("lost", "unknown_unit"), ("7", "name_taken"), ("twice", "unit_twice"), ("other", "unit_twice")}


def test_families_of_any_shape_are_dealt_over_many_tasks(spark):
    """p-values in [0, 1e-6] and a third of the rows at p = 1: even buckets, and the plain answer."""
    import numpy as np

    r = np.random.default_rng(6)
    p = np.concatenate([r.random(20_000) * 1e-6, np.ones(10_000), r.choice([0.01, 0.02], 500)])
    rows = [(i, "a" if i % 50 else "b", float(x)) for i, x in enumerate(p)] + [(len(p), "a", None), (len(p) + 1, None, 0.5)]
    df = spark.createDataFrame(rows, "id long, family string, p double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        dealt = stats._dealt(df, ["family"], "p")
        sizes = [x["count"] for x in dealt.groupBy("_bucket").count().collect()]
        assert len(sizes) >= 12 and max(sizes) < 4 * sum(sizes) / len(sizes)
        q = {x.id: x.q for x in stats.bh_adjust(df, ["family"], "p").collect()}
        h = {x.id: x.holm for x in stats.holm_adjust(df, ["family"], "p").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for family in "ab":
        ids = [i for i, f, x in rows if f == family and x is not None]
        x = np.array([rows[i][2] for i in ids])
        order = np.argsort(x, kind="stable")
        rank = np.arange(1, len(x) + 1)
        want_q, want_h = np.empty(len(x)), np.empty(len(x))
        want_q[order] = np.minimum(1, np.minimum.accumulate((x[order] * len(x) / rank)[::-1])[::-1])
        want_h[order] = np.minimum(1, np.maximum.accumulate((len(x) - rank + 1) * x[order]))
        assert np.allclose([q[i] for i in ids], want_q) and np.allclose([h[i] for i in ids], want_h)
    assert q[len(p)] is None and h[len(p)] is None and q[len(p) + 1] is None


def test_matrix_has_a_column_for_every_name(spark):
    from cohortmill.operators import shape

    df = spark.createDataFrame([(1, f"f{i}", i) for i in range(30)] + [(2, "f0", 5), (2, None, 7)], "unit long, name string, v long")
    wide = shape.matrix(df, ["unit"], "name", "v")
    assert wide.columns == ["unit", *sorted(f"f{i}" for i in range(30))] and [x.f29 for x in wide.orderBy("unit").collect()] == [29, None]
    assert shape.matrix(df.limit(0), ["unit"], "name", "v").columns == ["unit"]
    with pytest.raises(ValueError):
        shape.matrix(df, ["unit"], "name", "v", most=10)


def test_alignments_that_contradict_themselves_are_refused(spark):
    from cohortmill.operators import clustering

    good = dict(q="a", s="b", qstart=1, qend=3, sstart=1, send=3, qlen=9, slen=9, qseq="ACG", sseq="ACG", pident=100.0, length=3, evalue=0.0, bitscore=9.0)
    assert clustering.alignment_union(spark.createDataFrame([good])).first().ani == 100.0
    faults = [dict(qseq="AC-G", sseq="AC-G", length=4), dict(length=4), dict(qstart=0, qend=2), dict(sstart=8, send=10), dict(qseq="AC", length=2), dict(qstart=3, qend=1, qlen=2)]
    for fault in faults:
        with pytest.raises(Exception, match="gaps on both|unequal length|outside|length"):
            clustering.alignment_union(spark.createDataFrame([good | fault])).collect()


def test_rules_as_data(spark):
    from cohortmill.operators import selection

    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 50.0), (4, 95.0)], "id long, x double")
    low = selection.outside(F.col("x"), low=10, high=90)
    status, reason = selection.decide([(F.col("x") > 90, "excluded", "above"), (low, "review", "odd"), (F.col("x").isNull() & F.lit(None), "review", "never")])
    assert [(r.s, r.r) for r in df.select("id", status.alias("s"), reason.alias("r")).orderBy("id").collect()] == [("eligible", ""), ("review", "odd"), ("eligible", ""), ("excluded", "above")]


def test_a_genus_entry_comes_before_a_longer_name(spark):
    from cohortmill.operators import selection

    records = spark.createDataFrame([(1, "Alpha beta gamma", ""), (2, "Alpha beta", ""), (3, "x delta y", "old")], "id long, name string, label string")
    scope = spark.createDataFrame([("g", "Alpha", True), ("s", "Alpha beta", False), ("d", "delta", False)], "key string, query string, broad boolean")
    queried = spark.createDataFrame([(1, "g"), (1, "s"), (2, "g"), (2, "s")], "id long, key string")
    got = {r.id: (r.key, r.how) for r in selection.scope_keys(records, queried, scope, "id", "name", "label").collect()}
    assert got == {1: ("g", "specific"), 2: ("s", "exact"), 3: ("d", "legacy")}


def test_states_of_a_trace(spark):
    stages = {"CALL": "call", "CHECK": "check"}
    rows = [
        (1, "flow:CALL (a)", "COMPLETED", "0"), (2, "flow:CHECK (a)", "CACHED", "7"), (3, "CALL (b)", "FAILED", "1"), (4, "CALL (b)", "COMPLETED", "0"), (5, "CHECK (b)", "COMPLETED", "0"),
        (6, "CALL (c)", None, "-"), (7, "CALL (z)", "COMPLETED", "0"), (8, "OTHER (a)", "FAILED", "1"), (9, "summary", "FAILED", "1"), (10, None, "FAILED", "1"), (11, "flow:CALL (e)", "COMPLETED", ""), (12, "CHECK (e)", "completed", None),
    ]
    units = spark.createDataFrame([(x,) for x in "aabcde"], "u string")
    met = execution.tasks(spark.createDataFrame(rows, "task_id long, name string, status string, exit string"), stages)
    published = spark.createDataFrame([("a", 4), ("b", 2), ("c", 0), ("e", 0)], "u string, n long")
    got = {r.u: (r.call_status, r.check_status, r.failed_tasks, r.execution_status, r.n_published) for r in execution.unit_states(units, met, "u", stages, "check", "call", published).collect()}
    assert got == {
        "a": ("completed", "cached", "", "completed", 4), "b": ("completed", "completed", "CALL", "failed", 2), "c": ("unfinished", "not_run", "", "incomplete", None), "d": ("not_run", "not_run", "", "not_run", None),
        "e": ("completed", "completed", "", "completed_zero", 0),
    }
    assert [tuple(r) for r in execution.strangers(units, met, "u").collect()] == [("z", 1)]
    assert {r.execution_status for r in execution.unit_states(units, met.limit(0), "u", stages, "check", traced=False).collect()} == {"unknown"}


def test_classes_need_searches_and_support(spark):
    rows = [(1, 5, 1, "done"), (2, 5, 0, "done"), (3, 0, 0, "done"), (4, 5, 1, None), (5, None, None, "done"), (6, 9, 0, "done")]
    df = spark.createDataFrame(rows, "id int, n int, head int, state string")
    out = elements.classify(df, [(F.col("n") > 8, "large", F.concat(F.lit("n="), "n"))], ("plain", "default"), F.col("n") > 0, ["state"], ["done"], {"plain": F.col("head") > 0})
    got = {r.id: (r.preliminary_class, r.element_class, r.evidence, r.classification_status) for r in out.collect()}
    assert got == {
        1: ("plain", "plain", "default", "assessed"), 2: ("plain", "unclassified", "no_positive_evidence", "assessed"), 3: ("plain", "not_assessed", "incomplete;preliminary=plain", "not_assessed"),
        4: ("plain", "not_assessed", "incomplete;preliminary=plain", "not_assessed"), 5: ("plain", "not_assessed", "incomplete;preliminary=plain", "not_assessed"), 6: ("large", "large", "n=9", "assessed"),
    }


def test_context_keeps_what_is_not_measured_apart_from_zero(spark):
    measured = spark.createDataFrame([("s", "v", True), ("t", "v", False), ("s", "w", True), (None, "v", True)], "unit string, key string, detected boolean")
    links = spark.createDataFrame([("v", "A"), ("v", "A"), ("v", "B"), ("v", None), (None, "A"), ("x", "A")], "key string, taxon string")
    labels = spark.createDataFrame([("A", "a", "species")], "taxon string, label string, resolution string")
    abundance = spark.createDataFrame([("s", "a", 0.0)], "unit string, label string, abundance double")
    context = evidence.linked_context(measured, links, labels, abundance, "unit", "key")
    got = sorted((str(r.unit), r.key, r.taxon, r.n_taxa, r.abundance, r.context_status) for r in context.collect())
    assert got == [
        ("None", "v", "A", 2, None, "unmeasured"), ("None", "v", "B", 2, None, "no_label"), ("s", "v", "A", 2, 0.0, "measured"), ("s", "v", "B", 2, None, "no_label"), ("t", "v", "A", 2, None, "unmeasured"), ("t", "v", "B", 2, None, "no_label")]
    found = {r.taxon: (r.n_keys, r.n_detected, r.n_units, r.n_positive) for r in evidence.context_summary(context.where("unit is not null"), "unit", "key", F.col("detected")).collect()}
    assert found == {"A": (1, 1, 2, None), "B": (1, 1, 2, None)}


def test_linked_summary_is_the_summary_of_the_context(spark):
    """The same rows without the context's own rows: a unit's equal lists of taxa are one before they are opened."""
    r = random.Random(5)
    measured = spark.createDataFrame([(r.choice([None, *range(9)]), r.choice([None, *"vwxyz"]), r.random() < 0.4) for _ in range(80)], "unit int, key string, detected boolean")
    links = spark.createDataFrame([(k, t) for k in "vwxq" for t in "ABC"] + [("y", "A"), ("y", "A"), ("y", None), (None, "A"), ("y", "D")], "key string, taxon string")
    labels = spark.createDataFrame([("A", "a", "species"), ("B", "b", "species"), ("C", "b", "genus")], "taxon string, label string, resolution string")
    abundance = spark.createDataFrame([(u, x, None if u == 8 and x == "b" else float(u % 2)) for u in range(9) for x in "ab"], "unit int, label string, abundance double")
    for known in (measured, measured.where("unit is not null")):
        whole = evidence.context_summary(evidence.linked_context(known, links, labels, abundance, "unit", "key"), "unit", "key", F.col("detected"))
        ours = evidence.linked_summary(known, links, labels, abundance, "unit", "key", F.col("detected"))
        assert sorted(map(tuple, ours.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str) and ours.dtypes == whole.dtypes
        assert ours.count() == 4


def test_levels_are_dealt_by_their_rows(spark):
    """Tasks grow in number with the rows, and each level is shuffled once, whatever the number of its columns."""
    rows = [(1, 10, "a", 1.0), (1, 10, None, 1.0), (2, 10, "a", 2.0), (2, 20, None, None), (None, 30, "b", 3.0), (3, 30, "b", None)]
    sheet = spark.createDataFrame(rows, "sample int, library int, layout string, size double")
    levels = [("sample", "sample", ["layout"]), ("library", "library", ["layout", "size"])]
    tables, wrong = shape.entity_levels(sheet, levels, rows=9 << 18)
    plan = wrong._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count(", 9)") == 2
    assert sorted(map(tuple, wrong.collect())) == [
        ("library", "10", "layout", 2), ("library", "10", "sample", 2), ("library", "10", "size", 2), ("library", "30", "sample", 2), ("library", "30", "size", 2), ("sample", "1", "layout", 2), ("sample", "2", "layout", 2)]
    assert sorted(map(tuple, tables["library"].collect())) == [(10, 1, "a", 1.0), (20, 2, None, None), (30, 3, "b", 3.0)]


def test_depth_profile_reads_its_segments_once(spark):
    segs = spark.createDataFrame([("c", 0, 4, 2), ("c", 6, 9, 5), ("d", 0, 9, 1)], "contig string, start0 int, end0 int, depth int")
    regions = spark.createDataFrame([("c", "p", 1, 2, 8), ("c", "q", None, 20, 25), ("c", "p", 1, 8, 9), ("c", "p", 2, 6, 6)], "contig string, kind string, id int, start0 int, end0 int")
    got = intervals.depth_profile(segs, regions, ["contig"], ["kind", "id"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3  # segments once, regions for their own bases too
    found = {(r.kind, r.id): (r.bp, r.median, r["mean"], r.breadth) for r in got.collect()}
    assert found == {("p", 1): (7, 2.0, 19 / 7, 5 / 7), ("q", None): (5, 0.0, 0.0, 0.0)}


def test_elevation_leaves_out_contigs_without_loci(spark):
    segs = spark.createDataFrame([("c", 0, 9000, 2), ("c", 3000, 5000, 9), ("d", 0, 9000, 3)], "contig string, start0 int, end0 int, depth int")
    loci = spark.createDataFrame([("c", 7, 3000, 5000), ("e", 8, 0, 5000)], "contig string, locus_id int, start0 int, end0 int")
    sizes = spark.createDataFrame([("c", 10000), ("d", 10000)], "contig string, length int")
    out = intervals.elevation(segs, segs, loci, sizes, ["contig"], "locus_id")
    assert [(r.locus_id, r.status, r.call) for r in out.collect()] == [(7, "evaluable", "raised")]
    assert out._holds[0].where("_kind = 'h'").count() == 1  # the rest of d is no row


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_required_members_shuffle_once_by_system(spark):
    rows = [(1, 1, "f", "mandatory"), (1, 1, "g", "accessory"), (1, 2, "f", "accessory"), (1, None, None, "mandatory"), (2, 1, "f", "mandatory"), (2, 2, "f", None), (3, 1, "f", "accessory"), (3, 2, "g", "accessory"), (4, 1, "f", "other")]
    members = spark.createDataFrame(rows, "system int, member int, family string, role string")
    needs = spark.createDataFrame([(1, 1, 3), (2, 1, 1), (3, 0, 2), (4, 0, 0)], "system int, min_mandatory int, min_genes int")
    out = evidence.required_members(members, needs, rows=9 << 18)[0]
    assert "Expand" not in plan(out) and plan(out).count("Exchange") == 2 and ", 9)" in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, "mandatory_and_needed_accessory", 2), (2, "unresolved_role_or_mandatory", 1), (3, "mandatory_and_needed_accessory", 2), (4, "unresolved_role_or_mandatory", 0)]


def test_aligned_columns_of_dealt_cells_are_not_shuffled_again(spark):
    cells = spark.createDataFrame([("x", 1, "A"), ("y", 1, "A"), ("x", 2, "A"), ("y", 2, "C"), ("x", 3, None), ("y", 3, "A"), ("x", 4, None), ("x", 2, "A")], "name string, place int, letter string")
    out = loci.aligned_columns(cells.repartition(3, "place"), "name", "place", "letter", cells.select("name"))
    assert "Expand" not in plan(out) and plan(out).count("hashpartitioning(place") == 1
    assert [tuple(r) for r in out.collect()] == [(2, 4, 2, 1)]


def test_members_are_counted_without_copies_of_their_rows(spark):
    met = spark.createDataFrame([(1, "g", True, "c", True), (1, "g", True, "d", False), (1, "h", True, "c", None), (1, None, True, "c", True), (1, "i", False, "e", True)], "k int, gene string, inside boolean, cat string, marker boolean")
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    out = evidence.member_counts(keys, met, "k", "cat", "marker")
    assert sorted(map(tuple, out.collect())) == [(1, 2, 2, 1, 0.5), (2, 0, 0, 0, None)] and "Expand" not in plan(out)
    out = elements.category_measures(keys, met, "k", "gene", "cat", {"first": ["c"], "other": ["d", "e"]})
    assert sorted(map(tuple, out.collect())) == [(1, 3, 2, 2), (2, 0, 0, 0)] and "Expand" not in plan(out)


def test_reciprocal_pairs_are_dealt_by_their_rows(spark):
    pairs = spark.createDataFrame([(1, 2, 5.0), (2, 1, 3.0), (4, 3, 1.0), (4, 3, 2.0), (5, 5, 1.0), (None, 1, 1.0)], "a int, b int, s double")
    out = clustering.reciprocal_pairs(pairs, "s", rows=9 << 18)
    assert plan(out).count("Exchange") == 1 and ", 9)" in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 2, 3.0, "broad"), (3, 4, 1.0, "partial")]


def test_a_text_is_lowered_and_searched_once(spark):
    cells = spark.createDataFrame([("Homo sapiens", "stool of a patient", None), (None, "Mouse gut", "colon"), ("missing", "saliva", "x"), ("strain", None, "blood"), ("Homo", "", "na"), (None, None, " skin ")], "host string, src string, site string")
    got = selection.said(cells, *(F.col(c) for c in ("host", "src", "site"))).select(selection.source_group().alias("g"), selection.body_site().alias("b"))
    assert [tuple(r) for r in got.collect()] == [("human_gut", "gut"), ("nonhuman_or_environmental", "gut"), ("unknown", "oral"), ("unresolved_host", "blood"), ("human_other", "unknown"), ("unknown", "skin")]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("lower(concat_ws(") == 1 and text.count(selection.WORDS["gut"]) == 1


def test_boundary_repeat_works_where_its_rows_are(spark):
    """Windows full of one short unit open no pairs of seeds in a shuffle, and two loci of one name stay apart."""
    unit, r = "ACGTTGCA", random.Random(2)
    other = "".join(r.choice("ACGT") for _ in range(60))
    rows = [(1, unit * 60, 100, 380), (2, other + "N" * 280 + other, 30, 370), (2, other[:40] + "N" * 300 + other[20:], 20, 350), (3, "ACGT" * 10, 5, 30), (4, "AC" * 300, 120, 480)]
    got = loci.boundary_repeat(spark.createDataFrame(rows, "id long, s string, start0 long, end0 long"), "id", "s", reach=100)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = sorted((x.id, x.status, x.length, x.left0, x.right0, x.repeat) for x in got.collect())
    assert found[0] == (1, "direct_repeat_candidate", 60, 96, 320, (unit * 9)[:60])
    assert found[1] == (2, "direct_repeat_candidate", 20, 20, 340, other[20:40]) and found[2] == (2, "direct_repeat_candidate", 60, 0, 340, other)
    assert [x[1:3] for x in found[3:]] == [("not_assessed_overlapping_windows", None), ("no_repeat", None)]


def test_alignment_union_goes_on_over_batches(spark):
    """A pair that is longer than a batch keeps its marks, and pairs of one alignment are walked side by side."""
    from cohortmill.operators import clustering

    r = random.Random(4)
    hsps = []
    for k in range(90):
        q0, s0, text = r.randrange(1, 80), r.randrange(1, 60), "".join(r.choice("ACGT") for _ in range(12))
        hsps.append(dict(q="a" if k < 50 else f"b{k}", s="x", qstart=q0, qend=q0 + 11, sstart=s0, send=s0 + 11, qlen=100, slen=95, qseq=text, sseq=text[:6] + "".join(r.choice("ACGT") for _ in range(6)), pident=90.0, length=12, evalue=r.choice([1e-9, 1e-9, 1e-3]), bitscore=float(k)))
    df, size = spark.createDataFrame(hsps), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = clustering.alignment_union(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {(x.q, x.s): (x.columns, x.identical, round(x.aligned_fraction, 6), x.q_covered, x.s_covered) for x in out} == plain_union(hsps, 1e-5)
    rows = pa.RecordBatch.from_pylist([dict(qlen=5, slen=5, length=5)] * 4 + [dict(qlen=90, slen=5, length=5)])
    assert [p.num_rows for p in clustering._pieces(rows, 30)] == [2, 2, 1]


def test_bridges_make_no_row_of_two_unlinked_neighbours(spark):
    """Against all pairs of longer neighbours; lists of neighbours meet instead of pairs."""
    from cohortmill.operators import clustering

    r = random.Random(6)
    length = {i: r.randrange(9) for i in range(45)}
    pairs = {(a, b) for a in length for b in length if a < b and (r.random() < 0.25 or a in (3, 40))} | {(a, b) for a in range(45, 49) for b in range(45, 53) if a < b}
    length |= {i: i for i in range(45, 53)}
    linked = pairs | {(b, a) for a, b in pairs}
    df = clustering.bridges(spark.createDataFrame(list(length.items()), "node long, length long"), spark.createDataFrame(list(pairs), "a long, b long"))
    assert "array_intersect" in df._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for n in length:
        longer = [b for a, b in linked if a == n and length[b] > length[n]]
        k = sum((a, b) in linked for a in longer for b in longer if a < b)
        want[n] = (len(longer), k, 2 * k < len(longer) * (len(longer) - 1))
    assert {x.node: (x.n_longer, x.n_linked, x.is_bridge) for x in df.collect()} == want


def test_codons_are_cut_in_one_pass(spark):
    """Not by position, which walks to each codon from the first letter; newlines, other letters and rests included."""
    df = spark.createDataFrame([(0, "atgtaac"), (1, "at\nnnngcc"), (2, "at"), (3, ""), (4, None)], "i int, s string").select("i", S.translate_codons("s", S.standard_code()).alias("p"))
    assert "substr" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.i: r.p for r in df.collect()} == {0: "M*", 1: "XXA", 2: "", 3: "", 4: ""}


def test_greedy_rounds_carry_two_names_and_each_edge_once(spark, monkeypatch):
    """Ranks may be wide (a struct of several fields), so no table between rounds holds them, nor an edge in both directions."""
    from cohortmill.operators import clustering

    kept, whole = [], clustering.stage
    monkeypatch.setattr(clustering, "stage", lambda df, name, *a, **k: kept.append((name, whole(df, name, *a, **k))) or kept[-1][1])
    nodes = spark.createDataFrame([(i, f"r{i:03}" * 20) for i in range(30)], "node long, rank string")
    e = spark.createDataFrame([(i, (i * 7 + 1) % 30) for i in range(30)] + [((i * 7 + 1) % 30, i) for i in range(30)] + [(4, None), (5, 5), (99, 1)], "a long, b long")
    out = {r.node for r in clustering.greedy_representatives(nodes, e).where("is_representative").collect()}
    reps = set()
    near = {i: {j for j in range(30) if (i * 7 + 1) % 30 == j or (j * 7 + 1) % 30 == i} - {i} for i in range(30)}
    for i in range(30):
        if not near[i] & reps:
            reps.add(i)
    assert out == reps and kept
    assert all(t == "bigint" for _, df in kept for _, t in df.dtypes)
    assert kept[0][1]._observed["n"] == sum(map(len, near.values())) // 2


def test_link_faults_of_a_plain_walk_without_leaves_in_the_rounds(spark, monkeypatch):
    """Members of a single link join nothing, so the rounds of components never see them; duplicates and chains are found all the same."""
    from cohortmill.operators import feature_graph

    r = random.Random(8)
    genome = {f"c{i}": f"G{i // 6}" for i in range(40)} | {f"g{i}": f"G{r.randrange(40) // 6}" if i % 9 == 0 else f"G{i % 40 // 6}" for i in range(200)} | {f"L{i}": None for i in range(12)}
    unit = {k: {"c": "candidate", "g": "gene", "L": "locus"}[k[0]] for k in genome}
    rows = [(f"c{i % 40}", f"g{i}", "candidate_gene") for i in range(200)] + [(f"L{i // 4}", f"c{i}", "locus_candidate") for i in range(30)] + [("c1", "g1", "candidate_gene"), ("c39", "gone", "candidate_gene"), ("c38", "g38", "made_up"), ("L9", "c39", "locus_candidate"), ("L9", "c39", "locus_candidate"), (None, "g3", "candidate_gene")]
    feats = spark.createDataFrame([(k, unit[k], g) for k, g in genome.items()], "feature_id string, feature_unit string, genome_id string")
    links = feature_graph.links(*((spark.createDataFrame([x for x in rows if x[2] == k], "p string, m string, k string"), k, F.col("p"), F.col("m")) for k in {x[2] for x in rows}))
    met, whole = [], feature_graph.components
    monkeypatch.setattr(feature_graph, "components", lambda e: met.extend(map(tuple, e.collect())) or whole(e))
    got = {(x.link_id, x.fault) for x in feature_graph.link_faults(feats, links, spark.createDataFrame(feature_graph.RELATIONS, feature_graph.RELATION)).collect()}
    ids = {(x.parent, x.member, x.relation): x.link_id for x in links.collect()}
    kinds = {k: (p, m, physical) for k, p, m, physical in feature_graph.RELATIONS}
    tied = [x for x in rows if x[2] in kinds and kinds[x[2]][2] and x[0] in unit and x[1] in unit]
    home = {}
    top = lambda n: n if home.setdefault(n, n) == n else top(home[n])
    for p, m, _ in tied:
        home[top(p)] = top(m)
    of = {}
    for n in list(home):
        of.setdefault(top(n), set()).add(genome[n])
    want = set()
    for x in rows:
        p, m, k = x
        want |= {(ids[x], "relation")} if k not in kinds else set()
        want |= {(ids[x], e) for e, n in (("parent", p), ("member", m)) if n not in unit}
        want |= {(ids[x], "duplicate")} if rows.count(x) > 1 else set()
        if x in tied:
            differ = genome[p] and genome[m] and genome[p] != genome[m]
            want |= {(ids[x], "genomes")} if differ else {(ids[x], "chain")} if len(of[top(p)] - {None}) > 1 else set()
    assert got == want and {f for _, f in want} >= {"chain", "genomes", "duplicate", "relation", "parent", "member"}
    assert not {m for _, m in met} & {f"g{i}" for i in range(4, 200) if i != 38}
