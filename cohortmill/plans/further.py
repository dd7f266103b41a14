"""Queries over clusters, crosswalks, alignments and further row rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions import sequences as S
from ..functions import values as V
from ..operators import kmers, clustering, evidence, intervals, stats
from ..sources import text_tables as T
from .core import r6
from ..sources.shared import dealt, drop, stage
from .registry import query
from .views import table, view, with_views


@query()
def greedy_cluster(spark, d):
    e = view(spark, d, "edge")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("rank", F.col("node"))
    return clustering.memberships(clustering.greedy_representatives(nodes, e), e)


@query("""SELECT least(a, b) AS a, greatest(a, b) AS b, min(s) AS s, CASE WHEN count(DISTINCT a < b) = 2 THEN 'broad' ELSE 'partial' END AS status FROM
 (SELECT l_suppkey AS a, l_partkey AS b, max(l_discount) AS s FROM lineitem GROUP BY 1, 2) WHERE a <> b GROUP BY 1, 2""")
def reciprocal_pairs(spark, d):
    line = table(spark, d, "lineitem")
    rows = line.count()
    p = dealt(line.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_discount"), rows, "a", "b").groupBy("a", "b").agg(F.max("l_discount").alias("s"))
    return clustering.reciprocal_pairs(p, "s", rows)


@query(with_views("""WITH p AS (SELECT DISTINCT l.locus_id, i.iv_id FROM loci l JOIN iv i ON l.contig = i.contig AND l.start0 < i.end0 AND i.start0 < l.end0 AND l.end0 > l.start0 AND i.end0 > i.start0 WHERE least(l.end0, i.end0) - greatest(l.start0, i.start0) > 600),
 c AS (SELECT *, count(*) OVER (PARTITION BY locus_id) AS nn, count(*) OVER (PARTITION BY iv_id) AS no FROM p), m AS (SELECT *, max(no) OVER (PARTITION BY locus_id) AS mo, max(nn) OVER (PARTITION BY iv_id) AS mn FROM c)
 SELECT locus_id, iv_id, CASE WHEN mo = 1 AND mn = 1 THEN 'exact' WHEN mo = 1 THEN 'split' WHEN mn = 1 THEN 'merge' ELSE 'complex' END AS kind FROM m""", "iv", "loci"))
def map_degree(spark, d):
    met = intervals.overlap_join(view(spark, d, "loci"), view(spark, d, "iv"), ["contig"]).where("overlap > 600")
    return clustering.mapping_degrees(met.select(F.col("l.locus_id").alias("locus_id"), F.col("r.iv_id").alias("iv_id")), "locus_id", "iv_id")


@query(with_views("""SELECT l.locus_id, i.iv_id, CASE WHEN l.strand = '+' THEN i.start0 - l.start0 ELSE l.end0 - i.end0 END AS start, CASE WHEN l.strand = '+' THEN i.end0 - l.start0 ELSE l.end0 - i.start0 END AS stop, CASE WHEN l.strand = i.strand THEN '+' ELSE '-' END AS strand
 FROM loci l JOIN iv i ON l.contig = i.contig AND i.start0 >= l.start0 AND i.end0 <= l.end0 AND l.end0 > l.start0 AND i.end0 > i.start0""", "iv", "loci"))
def liftover(spark, d):
    out = intervals.lift(view(spark, d, "iv"), view(spark, d, "loci"), ["contig"])
    return out.select(F.col("l.locus_id").alias("locus_id"), F.col("r.iv_id").alias("iv_id"), "start", "stop", "strand")


@query(with_views("SELECT l.locus_id, i.iv_id, least(i.start0 - l.start0, l.end0 - i.end0) AS distance FROM loci l JOIN iv i ON l.contig = i.contig AND i.start0 >= l.start0 AND i.end0 <= l.end0 AND l.end0 > l.start0 AND i.end0 > i.start0", "iv", "loci"))
def boundary_dist(spark, d):
    met = intervals.overlap_join(view(spark, d, "loci"), view(spark, d, "iv"), ["contig"]).where("r.start0 >= l.start0 and r.end0 <= l.end0")
    dist = S.boundary_distance(F.col("r.start0"), F.col("r.end0"), F.col("l.start0"), F.col("l.end0"))
    return met.select(F.col("l.locus_id").alias("locus_id"), F.col("r.iv_id").alias("iv_id"), dist.alias("distance"))


@query(with_views("""WITH ev AS (SELECT contig, pos, sum(x) AS x FROM (SELECT contig, start0 AS pos, 1 AS x FROM iv WHERE end0 > start0 UNION ALL SELECT contig, end0, -1 FROM iv WHERE end0 > start0) GROUP BY 1, 2),
 seg AS (SELECT contig, pos AS start0, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS end0, sum(x) OVER (PARTITION BY contig ORDER BY pos) AS depth FROM ev),
 s AS (SELECT l.locus_id, sum(o * depth) AS s, sum(o * depth * depth) AS s2 FROM (SELECT l.locus_id, least(l.end0, g.end0) - greatest(l.start0, g.start0) AS o, g.depth FROM loci l JOIN seg g ON l.contig = g.contig AND l.start0 < g.end0 AND g.start0 < l.end0 WHERE g.depth > 0) l GROUP BY 1)
 SELECT l.locus_id, round(coalesce(s, 0) * 1.0 / (end0 - start0), 9) AS mean, round(sqrt(greatest(0, coalesce(s2, 0) * 1.0 / (end0 - start0) - (coalesce(s, 0) * 1.0 / (end0 - start0)) ^ 2)), 9) AS sd FROM loci l LEFT JOIN s ON s.locus_id = l.locus_id WHERE end0 > start0""", "iv", "loci"))
def masked_stats(spark, d):
    segs = intervals.depth_segments(view(spark, d, "iv"), ["contig"])
    out = intervals.depth_statistics(segs, view(spark, d, "loci"), ["contig"], "locus_id")
    return out.select("locus_id", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


CIGAR = "concat(CAST(mapq % 5 + 1 AS VARCHAR(9)), 'S', CAST(20 + mapq AS VARCHAR(9)), 'M', CAST(pos % 3 + 1 AS VARCHAR(9)), 'D', '10=', CAST(pos % 4 + 1 AS VARCHAR(9)), 'I5X')"


@query(with_views(f"""SELECT qname, mate, b.q AS query0, CAST(pos + b.r AS BIGINT) AS ref0, b.n AS n FROM (SELECT qname, mate, pos, unnest([{{'q': mapq % 5 + 1, 'r': 0, 'n': 20 + mapq}}, {{'q': mapq % 5 + 1 + 20 + mapq, 'r': 20 + mapq + pos % 3 + 1, 'n': 10}},
 {{'q': mapq % 5 + 1 + 20 + mapq + 10 + pos % 4 + 1, 'r': 20 + mapq + pos % 3 + 1 + 10, 'n': 5}}]) AS b FROM aln)""", "aln"))
def cigar_blocks(spark, d):
    aln = view(spark, d, "aln").withColumn("cigar", F.expr(CIGAR))
    out = aln.select("qname", "mate", F.explode(cigar.blocks("cigar", "pos")).alias("b"))
    return out.select("qname", "mate", F.col("b.query0").alias("query0"), F.col("b.ref0").alias("ref0"), F.col("b.n").alias("n"))


@query(with_views("SELECT qname, mate, mapq % 5 + 1 + 20 + mapq + 10 + pos % 4 + 1 + 5 AS query_length, 35 + mapq AS aligned, (35 + mapq) * 1.0 / (mapq % 5 + 1 + 20 + mapq + 10 + pos % 4 + 1 + 5) >= 0.9 AND mapq >= 10 AS accepted FROM aln", "aln"))
def align_accept(spark, d):
    aln = view(spark, d, "aln").withColumn("ops", cigar.operations(F.expr(CIGAR)))
    n, m = cigar.length_of(F.col("ops"), cigar.QUERY), cigar.length_of(F.col("ops"), cigar.ALIGNED)
    return aln.select("qname", "mate", n.alias("query_length"), m.alias("aligned"), ((m / n >= 0.9) & (F.col("mapq") >= 10)).alias("accepted"))


RUNS = r"regexp_extract_all(text, '[a-z]+|[^a-z]+')"


@query(rf"""SELECT doc_id, start0, start0 + n AS end0 FROM (SELECT doc_id, s, length(s) AS n, CAST(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s) AS BIGINT) AS start0 FROM
 (SELECT doc_id, unnest({RUNS}) AS s, unnest(range(len({RUNS}))) AS i FROM documents)) WHERE regexp_matches(s, '^[a-z]') AND n >= 8""")
def valid_runs(spark, d):
    docs = table(spark, d, "documents")
    parts = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]+|[^a-z]+"), F.lit(0))).alias("i", "s"))
    at = F.sum(F.length("s")).over(W.partitionBy("doc_id").orderBy("i")) - F.length("s")
    runs = parts.select("doc_id", "s", at.alias("start0"), F.length("s").alias("n")).where("s rlike '^[a-z]' and n >= 8")
    return runs.select("doc_id", "start0", (F.col("start0") + F.col("n")).alias("end0"))


@query(with_views("SELECT doc_id, md5(regexp_replace(seq, '(.{80})', '\\1' || chr(10), 'g')) AS wrapped FROM seq", "seq"))
def fasta_wrap(spark, d):
    return view(spark, d, "seq").select("doc_id", F.md5(F.regexp_replace("seq", "(.{80})", "$1\n")).alias("wrapped"))


@query(with_views("SELECT doc_id, substr(seq, greatest(1, 41 - 30), 40 - greatest(0, 10)) AS left_flank, CASE WHEN length(seq) >= 60 + 30 THEN 'full' WHEN length(seq) > 60 THEN 'truncated' ELSE 'none' END AS right_status, substr(seq, 61, 30) AS right_flank FROM seq", "seq"))
def flanks(spark, d):
    n = F.length("seq")
    return view(spark, d, "seq").select("doc_id", F.substring("seq", 11, 30).alias("left_flank"), F.when(n >= 90, "full").when(n > 60, "truncated").otherwise("none").alias("right_status"), F.substring("seq", 61, 30).alias("right_flank"))


WINDOWS = "WITH k AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(0, length(seq) - 15), lambda i: seq[i + 1:i + 16]))) AS ts FROM seq WHERE length(seq) >= 16)"


@query(with_views(WINDOWS + """,
c AS (SELECT ts, min(doc_id) AS rep FROM k GROUP BY ts), t AS (SELECT rep, len(ts) AS n, unnest(ts) AS t FROM c)
SELECT x.rep AS a, y.rep AS b, count(*) AS n_shared FROM t x JOIN t y ON x.t = y.t AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 2 * count(*) >= greatest(x.n, y.n)""", "seq"))
def kmer_pairs(spark, d):
    seq = stage(view(spark, d, "seq"), "seq")
    pairs, members = kmers.similar_windows(seq, "doc_id", "seq", k=16, share=0.5)
    drop(seq, members)
    out = pairs.select("a", "b", "n_shared")
    out._holds = pairs._holds
    return out


@query(with_views(WINDOWS + " SELECT doc_id, min(doc_id) OVER (PARTITION BY ts) AS rep FROM k", "seq"))
def kmer_set_members(spark, d):
    """Which set of ``kmer_pairs`` stands for each document."""
    return kmers.same_windows(stage(view(spark, d, "seq"), "seq"), "doc_id", "seq", k=16)


@query("SELECT lang, count(*) AS n, CASE WHEN count(*) = count(q) THEN sum(q) END AS total FROM (SELECT concat(lang, CAST(d.doc_id % 40 AS VARCHAR)) AS lang, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1")
def module_sum(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.concat("lang", (F.col("doc_id") % 40).cast("string")).alias("lang"), F.col("quality").alias("q"))
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.when(F.count("*") == F.count("q"), F.sum("q")).alias("total"))


@query("SELECT lang, source, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2, 3")
def support_counts(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("lang", "source", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, CASE WHEN count(*) = count(s) THEN min(s) END AS low, max(p_retailprice) AS high, CASE WHEN count(DISTINCT p_type) = 1 THEN max(p_type) ELSE 'conflict' END AS type FROM (SELECT *, CASE WHEN p_partkey % 97 <> 0 THEN p_size END AS s FROM part) GROUP BY 1")
def merge_occ(spark, d):
    part = table(spark, d, "part").withColumn("s", F.when(F.col("p_partkey") % 97 != 0, F.col("p_size")))
    return part.groupBy("p_brand").agg(F.when(F.count("*") == F.count("s"), F.min("s")).alias("low"), F.max("p_retailprice").alias("high"), F.when(F.count_distinct("p_type") == 1, F.max("p_type")).otherwise("conflict").alias("type"))


@query("""WITH w AS (SELECT p.p_partkey AS id, p_type AS family, CASE WHEN p_size > 2 THEN coalesce((p_partkey % 101) / 101.0, 1.0) END AS p FROM part p),
 f AS (SELECT id, family, coalesce(p, 1.0) AS p, p IS NULL AS failed FROM w), r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, count(*) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM f)
 SELECT id, family, failed, round(least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def family_agg(spark, d):
    w = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("family"), F.when(F.col("p_size") > 2, (F.col("p_partkey") % 101) / 101.0).alias("p"))
    w = w.withColumn("failed", F.col("p").isNull()).withColumn("p", F.coalesce("p", F.lit(1.0)))
    return stats.bh_adjust(w, ["family"], "p").select("id", "family", "failed", r6(F.col("q"), "q"))


@query("SELECT c_custkey, CASE WHEN a > b THEN 'first' WHEN b > a THEN 'second' ELSE 'unknown' END AS label FROM (SELECT c_custkey, c_custkey % 10 AS a, c_nationkey % 10 AS b FROM customer)")
def two_prob_label(spark, d):
    a, b = F.col("c_custkey") % 10, F.col("c_nationkey") % 10
    return table(spark, d, "customer").select("c_custkey", V.ladder([(a > b, "first"), (b > a, "second")], "unknown").alias("label"))


@query("SELECT dimension, source, count(*) FILTER (WHERE v > 0) AS positive, count(*) FILTER (WHERE v IS NOT NULL) AS known, count(*) FILTER (WHERE v IS NULL) AS unknown FROM (SELECT source, 'quality' AS dimension, quality AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT source, 'toxic', toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1, 2")
def dim_matrix(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").unpivot(["source"], ["quality", "toxic"], "dimension", "v")
    v = F.col("v")
    return x.groupBy("dimension", "source").agg(evidence.count_if(v > 0).alias("positive"), evidence.count_if(v.isNotNull()).alias("known"), evidence.count_if(v.isNull()).alias("unknown"))


@query("SELECT c_custkey, CASE WHEN n_f > 0 THEN 'present' WHEN n = 0 THEN 'unknown' WHEN n_open > 0 THEN 'unknown' ELSE 'absent' END AS call, concat_ws(';', CASE WHEN n = 0 THEN 'no_orders' END, CASE WHEN n_open > 0 THEN 'open_orders' END) AS reasons FROM (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def callability(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    s = F.col("o_orderstatus")
    g = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), evidence.count_if(s == "F").alias("f"), evidence.count_if(s == "O").alias("open"))
    none, still = F.col("n") == 0, F.col("open") > 0
    return g.select("c_custkey", V.ladder([(F.col("f") > 0, "present"), (none, "unknown"), (still, "unknown")], "absent").alias("call"), V.reasons([(none, "no_orders"), (still, "open_orders")]).alias("reasons"))


@query("SELECT c_custkey, c_name, o_orderkey, l_linenumber FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def link_expand(spark, d):
    c = table(spark, d, "customer")
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).select("c_custkey", "c_name", "o_orderkey", "l_linenumber")


@query("SELECT CAST(p_partkey AS VARCHAR) AS raw, 'size' AS wrong FROM part WHERE p_partkey % 11 = 0")
def typed_reject(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("raw"), F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("x"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")).alias("size"))
    _, bad = T.typed(raw, {"raw": "long", "size": "int"})
    return bad.select("raw", "wrong")
