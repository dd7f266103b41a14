"""Queries over donors, junctions, entities, graphs and run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar
from ..functions import values as V
from ..operators import evidence, intervals, shape
from .core import r6
from .further import CIGAR
from .registry import query
from .views import table, view, with_views


@query("SELECT p_partkey, round(1 - exp(-p_retailprice / 1000), 6) AS highest FROM part WHERE p_size / 50.0 >= 1 - exp(-p_retailprice / 1000)")
def depth_feasible(spark, d):
    top = 1 - F.exp(-F.col("p_retailprice") / 1000)
    return table(spark, d, "part").where(F.col("p_size") / 50.0 >= top).select("p_partkey", r6(top, "highest"))


@query(with_views("""WITH m AS (SELECT contig, start0, end0, max(end0) OVER (PARTITION BY contig ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv WHERE end0 > start0)
 SELECT contig, CAST(sum(greatest(0, end0 - greatest(start0, coalesce(b, start0)))) AS BIGINT) AS covered, count(*) AS n FROM m GROUP BY 1""", "iv"))
def depth_donor(spark, d):
    iv = view(spark, d, "iv").where("end0 > start0")
    return intervals.union_length(iv, ["contig"]).hint("shuffle_merge").join(iv.groupBy("contig").agg(F.count("*").alias("n")), "contig")


@query(with_views("""WITH ev AS (SELECT contig, pos, sum(x) AS x FROM (SELECT contig, start0 AS pos, 1 AS x FROM iv WHERE end0 > start0 UNION ALL SELECT contig, end0, -1 FROM iv WHERE end0 > start0) GROUP BY 1, 2),
 seg AS (SELECT * FROM (SELECT contig, pos AS start0, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS end0, sum(x) OVER (PARTITION BY contig ORDER BY pos) AS depth FROM ev) WHERE depth > 0),
 bg AS (SELECT contig, sum((end0 - start0) * depth) * 1.0 / 100000 AS mean FROM seg GROUP BY 1),
 s AS (SELECT l.locus_id, l.contig, sum((least(l.end0, g.end0) - greatest(l.start0, g.start0)) * depth) * 1.0 / max(l.end0 - l.start0) AS m FROM loci l JOIN seg g ON l.contig = g.contig AND l.start0 < g.end0 AND g.start0 < l.end0 WHERE l.end0 > l.start0 GROUP BY 1, 2)
 SELECT locus_id, round(m / mean, 6) AS ratio, CASE WHEN m / mean >= 1.1 THEN 'raised' ELSE 'level' END AS call FROM s JOIN bg ON s.contig = bg.contig""", "iv", "loci"))
def ratio_call(spark, d):
    segs = intervals.depth_segments(view(spark, d, "iv"), ["contig"])
    bg = segs.groupBy("contig").agg((F.sum((F.col("end0") - F.col("start0")) * F.col("depth")) / 100000).alias("background"))
    loci = view(spark, d, "loci")
    inside = intervals.breadth_in(segs, loci, ["contig"], "locus_id").where("covered > 0").hint("shuffle_merge").join(loci.select("locus_id", "contig"), "locus_id").hint("shuffle_merge").join(bg, "contig")
    ratio = F.col("mean_depth") / F.col("background")
    return inside.select("locus_id", r6(ratio, "ratio"), F.when(ratio >= 1.1, "raised").otherwise("level").alias("call"))


@query("SELECT p_partkey, w AS scope FROM (SELECT p_partkey, w, row_number() OVER (PARTITION BY p_partkey ORDER BY length(w) DESC, w) AS r FROM part JOIN (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM part) s ON contains(p_name, w)) WHERE r = 1")
def scope_best(spark, d):
    part = table(spark, d, "part")
    words = part.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    scope = part.select(F.split("p_name", " ")[0].alias("w")).distinct()
    found = words.hint("shuffle_merge").join(scope, "w", "left_semi")
    return found.groupBy("p_partkey").agg(F.min(F.struct((-F.length("w")).alias("l"), "w")).getField("w").alias("scope"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 AND l_returnflag = 'N' THEN 'zero_without_run' ELSE 'run_without_value' END AS violation FROM lineitem WHERE (l_tax = 0 AND l_returnflag = 'N') OR (l_quantity IS NULL AND l_returnflag <> 'N')")
def dq_state(spark, d):
    none, zero = F.col("l_returnflag") == "N", F.col("l_tax") == 0
    bad = table(spark, d, "lineitem").where((zero & none) | (F.col("l_quantity").isNull() & ~none))
    return bad.select("l_orderkey", "l_linenumber", F.when(zero & none, "zero_without_run").otherwise("run_without_value").alias("violation"))


@query("SELECT l_orderkey, l_suppkey, c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey")
def dq_links(spark, d):
    line = table(spark, d, "lineitem")
    o, c, s = (table(spark, d, t) for t in ("orders", "customer", "supplier"))
    both = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.where("c_nationkey <> s_nationkey").select("l_orderkey", "l_suppkey", "c_nationkey", "s_nationkey")


@query("SELECT DISTINCT 'conversation' AS entity, CAST(conv_id AS VARCHAR) AS id, NULL AS parent FROM conversations UNION ALL SELECT DISTINCT 'role', concat(CAST(conv_id AS VARCHAR), '/', role), CAST(conv_id AS VARCHAR) FROM conversations")
def normalize_sheet(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("c"), "role")
    top = c.select(F.lit("conversation").alias("entity"), F.col("c").alias("id"), F.lit(None).cast("string").alias("parent")).distinct()
    return top.unionByName(c.select(F.lit("role").alias("entity"), F.concat("c", F.lit("/"), "role").alias("id"), F.col("c").alias("parent")).distinct())


@query("""SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS source, CAST(o_custkey AS VARCHAR) AS target FROM orders UNION SELECT 'line', concat(CAST(l_orderkey AS VARCHAR), '.', CAST(l_linenumber AS VARCHAR)), CAST(l_partkey AS VARCHAR) FROM lineitem
 UNION SELECT 'brand', CAST(p_partkey AS VARCHAR), p_brand FROM part""")
def feature_graph(spark, d):
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("source"), F.col("o_custkey").cast("string").alias("target"))
    line = table(spark, d, "lineitem").select(F.lit("line").alias("kind"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("source"), F.col("l_partkey").cast("string").alias("target"))
    p = table(spark, d, "part").select(F.lit("brand").alias("kind"), F.col("p_partkey").cast("string").alias("source"), F.col("p_brand").alias("target"))
    return o.unionByName(line).unionByName(p).dropDuplicates()


@query(with_views("""SELECT d.donor, d.grp, f.feature, CASE WHEN m.donor IS NULL THEN 'not_assessed' WHEN m.n_assigned < 2 THEN 'ineligible' ELSE 'assessed' END AS status, CASE WHEN m.n_assigned >= 2 THEN m.value END AS exposure, CASE WHEN d.grp = 'case' THEN 1 ELSE 0 END AS outcome
 FROM (SELECT DISTINCT donor, grp FROM meas) d CROSS JOIN (SELECT DISTINCT feature FROM meas) f LEFT JOIN meas m ON m.donor = d.donor AND m.feature = f.feature""", "meas"))
def model_input(spark, d):
    m = view(spark, d, "meas").select("donor", "grp", "feature", "value", "n_assigned")
    full = shape.rectangle(m, ["donor", "grp"], ["feature"], "seen")
    status = F.when(F.col("seen") == "not_assessed", "not_assessed").when(F.col("n_assigned") < 2, "ineligible").otherwise("assessed")
    return full.select("donor", "grp", "feature", status.alias("status"), F.when(F.col("n_assigned") >= 2, F.col("value")).alias("exposure"), F.when(F.col("grp") == "case", 1).otherwise(0).alias("outcome"))


@query(with_views("SELECT contig, count(DISTINCT CASE WHEN category = 'PROMO' THEN family END) AS mandatory, count(DISTINCT CASE WHEN category <> 'PROMO' THEN family END) AS accessory, CASE WHEN count(DISTINCT CASE WHEN category = 'PROMO' THEN family END) >= 2 THEN 'mandatory' WHEN count(DISTINCT family) = 3 THEN 'all_needed' ELSE 'unresolved' END AS required FROM gene GROUP BY 1", "gene"))
def required_set(spark, d):
    promo = F.col("category") == "PROMO"
    m, a, n = F.count_distinct(F.when(promo, F.col("family"))), F.count_distinct(F.when(~promo, F.col("family"))), F.count_distinct("family")
    g = view(spark, d, "gene").groupBy("contig").agg(m.alias("mandatory"), a.alias("accessory"), n.alias("n"))
    return g.select("contig", "mandatory", "accessory", V.ladder([(F.col("mandatory") >= 2, "mandatory"), (F.col("n") == 3, "all_needed")], "unresolved").alias("required"))


@query("SELECT k, what, count(DISTINCT v) AS n FROM (SELECT l_partkey AS k, 'supplier' AS what, l_suppkey AS v FROM lineitem UNION ALL SELECT l_partkey, 'customer', o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2")
def evidence_sets(spark, d):
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    a = line.select(F.col("l_partkey").alias("k"), F.lit("supplier").alias("what"), F.col("l_suppkey").alias("v"))
    b = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("k"), F.lit("customer").alias("what"), F.col("o_custkey").alias("v"))
    return a.unionByName(b).groupBy("k", "what").agg(F.count_distinct("v").alias("n"))


SPAN = """b AS (SELECT qname, ref, pos AS r, 20 + mapq AS n FROM aln WHERE flag & 4 = 0 UNION ALL SELECT qname, ref, pos + 20 + mapq + pos % 3 + 1, 10 FROM aln WHERE flag & 4 = 0 UNION ALL SELECT qname, ref, pos + 20 + mapq + pos % 3 + 11, 5 FROM aln WHERE flag & 4 = 0),
 s AS (SELECT qname, ref, unnest(range(CAST(ceil((r + 5) / 100.0) AS BIGINT), CAST(floor((r + n - 5) / 100.0) AS BIGINT) + 1)) * 100 AS boundary FROM b)"""


def spanned(spark, d):
    """Fragments with an unbroken block over 5 bases on both sides of a boundary (every 100 bases)."""
    aln = view(spark, d, "aln").where(F.col("flag").bitwiseAND(4) == 0).withColumn("cigar", F.expr(CIGAR))
    b = aln.select("qname", "ref", F.explode(cigar.blocks("cigar", "pos")).alias("b"))
    first, last = F.ceil((F.col("b.ref0") + 5) / 100), F.floor((F.col("b.ref0") + F.col("b.n") - 5) / 100)
    return b.where(first <= last).select("qname", "ref", F.explode(F.sequence(first, last)).alias("at")).select("qname", "ref", (F.col("at") * 100).alias("boundary"))


@query(with_views(f"WITH {SPAN} SELECT DISTINCT qname, ref, boundary FROM s", "aln"))
def spanning(spark, d):
    return spanned(spark, d).distinct()


@query(with_views(f"WITH {SPAN} SELECT ref, boundary, count(DISTINCT qname) AS n_fragments FROM s GROUP BY 1, 2", "aln"))
def junction_support(spark, d):
    return spanned(spark, d).groupBy("ref", "boundary").agg(F.count_distinct("qname").alias("n_fragments"))


@query("SELECT user_id, sum(user_id % 24 * 3600 + event_id % 60 * 60 + event_id % 7) AS seconds, count(*) FILTER (WHERE event_type = 'error') AS failed, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'failed' ELSE 'completed' END AS state FROM events GROUP BY 1")
def trace_states(spark, d):
    e = table(spark, d, "events")
    text = F.concat((F.col("user_id") % 24).cast("string"), F.lit("h "), (F.col("event_id") % 60).cast("string"), F.lit("m "), (F.col("event_id") % 7).cast("string"), F.lit("s"))
    part = lambda unit: F.coalesce(F.regexp_extract("duration", rf"(\d+){unit}\b", 1).try_cast("long"), F.lit(0))
    e = e.withColumn("duration", text).withColumn("seconds", part("h") * 3600 + part("m") * 60 + part("s"))
    bad = evidence.count_if(F.col("event_type") == "error")
    return e.groupBy("user_id").agg(F.sum("seconds").alias("seconds"), bad.alias("failed"), F.when(bad > 0, "failed").otherwise("completed").alias("state"))


@query("SELECT p_partkey, word, n_parts FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) w JOIN (SELECT word AS x, count(DISTINCT p_partkey) AS n_parts FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1) c ON w.word = c.x")
def context_join(spark, d):
    w = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return w.hint("shuffle_merge").join(w.groupBy("word").agg(F.count_distinct("p_partkey").alias("n_parts")), "word").select("p_partkey", "word", "n_parts")


@query("""WITH p AS (SELECT l_suppkey AS a, l_partkey AS b, max(l_discount) AS s FROM lineitem GROUP BY 1, 2),
 r AS (SELECT x.a, x.b FROM p x JOIN p y ON x.a = y.b AND x.b = y.a AND x.a <> x.b), c AS (SELECT a, count(*) AS k, min(b) AS b FROM r GROUP BY 1)
 SELECT q.a AS query_id, CASE WHEN k IS NULL THEN 'none' WHEN k = 1 THEN 'reciprocal' ELSE 'ambiguous' END AS link, CASE WHEN k = 1 THEN c.b END AS anchor FROM (SELECT DISTINCT a FROM p) q LEFT JOIN c ON q.a = c.a""")
def anchor_links(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    back = p.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = p.intersect(back).where("a <> b").groupBy("a").agg(F.count("*").alias("k"), F.min("b").alias("b"))
    out = p.select("a").distinct().join(both, "a", "left")
    link = F.when(F.col("k").isNull(), "none").when(F.col("k") == 1, "reciprocal").otherwise("ambiguous")
    return out.select(F.col("a").alias("query_id"), link.alias("link"), F.when(F.col("k") == 1, F.col("b")).alias("anchor"))
