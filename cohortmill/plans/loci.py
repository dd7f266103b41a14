"""Queries over loci, flanks, masks, columns, repeats and group comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import kmers, loci, stats
from ..sources.shared import drop, stage
from .core import r6
from .registry import query
from .views import table, view, with_views

MASKS = "SELECT p_partkey % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, p_size * 7 AS start0, p_size * 7 + p_partkey % 60 AS end0 FROM part"


@query(with_views(f"""WITH iv AS (SELECT doc_id, list({{'s': start0, 'e': end0}}) AS l FROM ({MASKS}) GROUP BY 1),
m AS (SELECT seq.doc_id, list_transform(range(0, length(seq)), lambda i: CASE WHEN l IS NOT NULL AND len(list_filter(l, lambda v: v.s <= i AND v.e > i)) > 0 THEN 'n' ELSE seq[i + 1] END) AS t FROM seq LEFT JOIN iv ON seq.doc_id = iv.doc_id)
SELECT doc_id, md5(coalesce(array_to_string(t, ''), '')) AS masked, len(list_filter(t, lambda x: x = 'n')) AS n_masked FROM m""", "seq"))
def mask_seq(spark, d):
    ids = table(spark, d, "documents").agg(F.max("doc_id") + 1).first()[0]
    iv = table(spark, d, "part").select((F.col("p_partkey") % ids).alias("doc_id"), (F.col("p_size") * 7).alias("start0"), (F.col("p_size") * 7 + F.col("p_partkey") % 60).alias("end0"))
    return loci.mask_sequences(view(spark, d, "seq"), "doc_id", "seq", iv, "n").select("doc_id", F.md5("seq").alias("masked"), "n_masked")


FLANKS = "SELECT l_partkey AS locus, l_suppkey % 7 AS genome, CASE WHEN l_linenumber % 2 = 1 THEN 'left' ELSE 'right' END AS side, l_returnflag AS contig, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_orderkey % 5000 AS start0, l_orderkey % 5000 + CAST(l_quantity AS BIGINT) AS end0 FROM lineitem"


@query(f"""WITH h AS ({FLANKS}), g AS (SELECT locus, genome, count(*) FILTER (WHERE side = 'left') AS nl, count(*) FILTER (WHERE side = 'right') AS nr, max(CASE WHEN side = 'left' THEN contig END) AS lc, max(CASE WHEN side = 'right' THEN contig END) AS rc,
 max(CASE WHEN side = 'left' THEN strand END) AS ls, max(CASE WHEN side = 'right' THEN strand END) AS rs, max(CASE WHEN side = 'left' THEN start0 END) AS l0, max(CASE WHEN side = 'left' THEN end0 END) AS l1, max(CASE WHEN side = 'right' THEN start0 END) AS r0, max(CASE WHEN side = 'right' THEN end0 END) AS r1 FROM h GROUP BY 1, 2),
w AS (SELECT locus, genome, CASE WHEN nl = 1 AND nr = 1 AND lc = rc AND ls = rs THEN CASE WHEN ls = '+' THEN r0 - l1 ELSE l0 - r1 END END AS gap FROM g)
SELECT locus, genome, CASE WHEN gap >= 0 THEN gap END AS gap, CASE WHEN gap >= 0 THEN CASE WHEN gap <= 1000 THEN 'empty' ELSE 'occupied' END ELSE 'unassessable' END AS state FROM w""")
def flank_locus(spark, d):
    return loci.anchored_loci(spark.sql(FLANKS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem")), ["locus", "genome"], 1000)


SCORES = "l_discount AS host, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS virus, l_linenumber * 0.01 AS other"
GENES = f"SELECT l_suppkey AS contig, l_orderkey * 10 + l_linenumber AS gene, (l_partkey * 37 + l_linenumber * 101) % 100000 AS start0, (l_partkey * 37 + l_linenumber * 101) % 100000 + CAST(l_quantity AS BIGINT) * 20 AS end0, {SCORES} FROM lineitem"


@query(with_views(f"""WITH g AS ({GENES}), f AS (SELECT contig, locus_id, start0 - 2000 AS s, start0 AS e FROM loci UNION ALL SELECT contig, locus_id, end0, end0 + 2000 FROM loci)
SELECT locus_id, gene, CASE WHEN host IS NULL OR virus IS NULL OR other IS NULL THEN 'unknown' WHEN host > virus AND host > other THEN 'host' ELSE 'none' END AS marker FROM f JOIN g ON f.contig = g.contig AND g.start0 >= s AND g.end0 <= e AND g.end0 > g.start0""", "loci"))
def flank_markers(spark, d):
    genes = spark.sql(GENES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))
    return loci.flank_markers(view(spark, d, "loci"), genes, ["contig"], "locus_id", "gene", ("host", "virus", "other"), 2000)


@query("""WITH k AS (SELECT DISTINCT l_suppkey AS alignment, l_partkey % 400 AS place FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY alignment ORDER BY place) AS i FROM k)
SELECT alignment, min(place) AS start0, max(place) + 1 AS end0, min(i) - 1 AS new_start0 FROM r GROUP BY alignment, place - i""")
def column_map(spark, d):
    kept = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("alignment"), (F.col("l_partkey") % 400).alias("place")).distinct()
    return loci.column_runs(kept, ["alignment"], "place")


@query(with_views("""SELECT i.iv_id, b.locus_id * 1000 + CASE WHEN b.strand <> '-' THEN greatest(i.start0, b.start0) - b.start0 ELSE b.end0 - least(i.end0, b.end0) END AS column0,
 b.locus_id * 1000 + CASE WHEN b.strand <> '-' THEN greatest(i.start0, b.start0) - b.start0 ELSE b.end0 - least(i.end0, b.end0) END + least(i.end0, b.end0) - greatest(i.start0, b.start0) AS column_end0
 FROM iv i JOIN loci b ON i.contig = b.contig AND i.start0 < b.end0 AND b.start0 < i.end0 AND i.end0 > i.start0 AND b.end0 > b.start0""", "iv", "loci"))
def project_mask(spark, d):
    blocks = view(spark, d, "loci").withColumn("column0", F.col("locus_id") * 1000)
    return loci.project_intervals(view(spark, d, "iv"), blocks, ["contig"], "iv_id")


@query(with_views("""WITH w AS (SELECT doc_id, seq[1:100] AS x, right(seq, 100) AS y, length(seq) AS n FROM seq WHERE length(seq) >= 200),
a AS (SELECT doc_id, unnest(range(0, 90)) AS i, x FROM w), b AS (SELECT doc_id, unnest(range(0, 90)) AS j, y FROM w),
m AS (SELECT a.doc_id, i, j, list_max(list_filter(range(11, 41), lambda k: i + k <= 100 AND j + k <= 100 AND x[i + 1:i + k] = y[j + 1:j + k])) AS l FROM a JOIN b ON a.doc_id = b.doc_id AND x[i + 1:i + 11] = y[j + 1:j + 11]),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, i + 100 - j - l, i, j) AS o FROM m)
SELECT r.doc_id, i AS left0, n - 100 + j AS right0, l AS length FROM r JOIN w ON r.doc_id = w.doc_id WHERE o = 1""", "seq"))
def repeat_pair(spark, d):
    return loci.longest_repeat(view(spark, d, "seq"), "doc_id", "seq", 100, 11, 40)


@query("""WITH c AS (SELECT p_brand AS name, p_partkey % 1000 AS place, CASE WHEN min(p_size) % 5 <> 0 THEN min(p_type)[1:1] END AS letter FROM part GROUP BY 1, 2)
SELECT x.name AS a, y.name AS b, count(*) AS n_sites, count(*) FILTER (WHERE x.letter <> y.letter) AS n_different, CASE WHEN count(*) >= 3 THEN round(count(*) FILTER (WHERE x.letter <> y.letter) * 1.0 / count(*), 6) END AS distance
FROM c x JOIN c y ON x.place = y.place AND x.name < y.name AND x.letter IS NOT NULL AND y.letter IS NOT NULL GROUP BY 1, 2""")
def pair_dist(spark, d):
    cells = table(spark, d, "part").groupBy(F.col("p_brand").alias("name"), (F.col("p_partkey") % 1000).alias("place")).agg(F.when(F.min("p_size") % 5 != 0, F.substring(F.min("p_type"), 1, 1)).alias("letter"))
    return loci.pair_distances(cells, "name", "place", "letter", 3).withColumn("distance", F.round("distance", 6))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def first_distinct(spark, d):
    return loci.first_by_group(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 40).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, CASE WHEN b.v IS NULL THEN 'retired' WHEN a.v IS NULL THEN 'new' WHEN a.v = b.v THEN 'kept' ELSE 'renamed' END AS state
FROM (SELECT o_orderkey AS k, concat('v', CAST(o_custkey AS VARCHAR)) AS v FROM orders WHERE o_orderkey % 11 <> 0) a FULL OUTER JOIN (SELECT o_orderkey AS k, concat('v', CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR)) AS v FROM orders WHERE o_orderkey % 13 <> 0) b ON a.k = b.k""")
def version_crosswalk(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    name = lambda c: F.concat(F.lit("v"), c.cast("string")).alias("v")
    old = o.where("k % 11 <> 0").select("k", name(F.col("o_custkey")))
    return loci.version_crosswalk(old, o.where("k % 13 <> 0").select("k", name(F.when(F.col("k") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))), "k", "v")


@query("""WITH p AS (SELECT DISTINCT s_suppkey AS node FROM supplier), s AS (SELECT DISTINCT l_partkey + 1000000 AS node FROM lineitem), m AS (SELECT l_partkey + 1000000 AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R')
SELECT node, node AS anchor, 'primary' AS tier FROM p UNION ALL SELECT s.node, coalesce(min(m.b), s.node), CASE WHEN min(m.b) IS NULL THEN 'supplemental' ELSE 'matched' END FROM s LEFT JOIN m ON m.a = s.node AND m.b IN (SELECT node FROM p) GROUP BY s.node""")
def two_tier(spark, d):
    line = table(spark, d, "lineitem")
    matches = line.where("l_returnflag = 'R'").select((F.col("l_partkey") + 1000000).alias("a"), F.col("l_suppkey").alias("b"))
    return loci.two_tier(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), line.select((F.col("l_partkey") + 1000000).alias("node")), matches, "node")


@query(with_views("""WITH c AS (SELECT feature, donor, grp = 'case' AS one, CASE WHEN n_assigned % 3 <> 0 THEN breadth >= 0.5 END AS hit, CASE WHEN n_assigned % 4 <> 0 THEN value END AS v FROM meas),
g AS (SELECT feature, count(hit) FILTER (WHERE one) AS n1, count(hit) FILTER (WHERE NOT one) AS n0, count(*) FILTER (WHERE one AND hit) AS d1, count(*) FILTER (WHERE NOT one AND hit) AS d0, count(v) FILTER (WHERE one) AS v1, count(v) FILTER (WHERE NOT one) AS v0,
 median(v) FILTER (WHERE one) AS m1, median(v) FILTER (WHERE NOT one) AS m0, count(DISTINCT v) AS nv FROM c GROUP BY 1),
xs AS (SELECT feature, x, d1, (factorial(CAST(n1 AS INTEGER)) / (factorial(CAST(x AS INTEGER)) * factorial(CAST(n1 - x AS INTEGER)))) * (factorial(CAST(n0 AS INTEGER)) / (factorial(CAST(d1 + d0 - x AS INTEGER)) * factorial(CAST(n0 - d1 - d0 + x AS INTEGER)))) AS w
 FROM g, range(0, 21) r(x) WHERE least(n1, n0) >= 3 AND x <= n1 AND x <= d1 + d0 AND d1 + d0 - x <= n0),
fish AS (SELECT feature, sum(CASE WHEN w <= w0 THEN w END) / sum(w) AS p FROM (SELECT *, max(CASE WHEN x = d1 THEN w END) OVER (PARTITION BY feature) AS w0 FROM xs) GROUP BY 1),
rk AS (SELECT *, 2 * rank() OVER (PARTITION BY feature ORDER BY v) + count(*) OVER (PARTITION BY feature, v) - 1 AS r2 FROM c WHERE v IS NOT NULL),
arr AS (SELECT feature, list(r2 ORDER BY donor) AS r, list(CASE WHEN one THEN 1 ELSE 0 END ORDER BY donor) AS o FROM rk GROUP BY 1),
masks AS (SELECT feature, r, len(r) AS n, list_sum(o) AS k, list_sum(r) AS total, list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i] * o[i])) AS seen, m FROM arr, range(0, 1024) t(m)),
picked AS (SELECT *, coalesce(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN r[i] ELSE 0 END)), 0) AS s FROM masks WHERE m < (1 << n) AND bit_count(m) = k),
perm AS (SELECT feature, max(seen) AS rs, avg(CASE WHEN abs(s * n - total * k) >= abs(seen * n - total * k) THEN 1.0 ELSE 0.0 END) AS p FROM picked GROUP BY 1),
al AS (SELECT g.*, f.p AS fp, CASE WHEN least(v1, v0) >= 3 THEN perm.p END AS pp, (perm.rs - v1 * (v1 + 1)) * 1.0 / nullif(v1 * v0, 0) - 1 AS delta FROM g LEFT JOIN fish f USING (feature) LEFT JOIN perm USING (feature)),
t AS (SELECT feature, 'd' AS e, fp AS p FROM al WHERE fp IS NOT NULL UNION ALL SELECT feature, 'v', pp FROM al WHERE pp IS NOT NULL),
q AS (SELECT feature, e, least(1.0, min(p * n / k) OVER (PARTITION BY e ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, least(1.0, min(p * na / ka) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS qb
 FROM (SELECT *, count(*) OVER (PARTITION BY e) AS n, count(*) OVER (PARTITION BY e ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, count(*) OVER () AS na, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ka FROM t))
SELECT al.feature, n1 AS case_detection_n, n0 AS control_detection_n, d1 AS case_detected, d0 AS control_detected, v1 AS case_value_n, v0 AS control_value_n, round(d1 * 1.0 / nullif(n1, 0) - d0 * 1.0 / nullif(n0, 0), 6) AS fraction_difference, round(m1 - m0, 6) AS median_difference, round(delta, 6) AS delta,
 round(fp, 6) AS fisher_p, round(pp, 6) AS perm_p, CASE WHEN least(n1, n0) >= 3 THEN 'tested' ELSE 'not_tested_few_units' END AS detection_status, CASE WHEN least(v1, v0) < 3 THEN 'not_tested_few_units' WHEN nv = 1 THEN 'tested_all_equal' ELSE 'tested' END AS value_status,
 round(a.q, 6) AS fisher_q, round(a.qb, 6) AS fisher_q_both, round(b.q, 6) AS perm_q, round(b.qb, 6) AS perm_q_both FROM al LEFT JOIN q a ON a.feature = al.feature AND a.e = 'd' LEFT JOIN q b ON b.feature = al.feature AND b.e = 'v'""", "meas"))
def compare_groups(spark, d):
    m = view(spark, d, "meas").select("feature", (F.col("grp") == "case").alias("one"), F.when(F.col("n_assigned") % 3 != 0, F.col("breadth") >= 0.5).alias("hit"), F.when(F.col("n_assigned") % 4 != 0, F.col("value")).alias("v"))
    out = stats.compare_groups(stage(m, "units"), "feature", "one", "hit", "v")
    rounded = ("fraction_difference", "median_difference", "delta", "fisher_p", "perm_p", "fisher_q", "fisher_q_both", "perm_q", "perm_q_both")
    return out.select(*(r6(F.col(c), c) if c in rounded else F.col(c) for c in out.columns if c not in ("case_median", "control_median")))


@query(with_views("""WITH x AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM seq), c AS (SELECT doc_id, (doc_id * 7) % greatest(1, length(seq)) AS s, seq FROM x),
o AS (SELECT doc_id, seq, s, least(length(seq), s + 40) AS e, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, doc_id % 10 = 9 AS off FROM c)
SELECT doc_id, CASE WHEN off THEN seq[s + 2:e] ELSE seq[s + 1:e] END = seq[s + 1:e] AS same FROM o""", "seq"))
def slice_verify(spark, d):
    parents = view(spark, d, "seq")
    n = F.greatest(F.lit(1), F.length("seq"))
    occ = parents.select("doc_id", ((F.col("doc_id") * 7) % n).alias("start0"), F.col("seq").alias("whole"))
    occ = occ.withColumn("end0", F.least(F.length("whole"), F.col("start0") + 40)).withColumn("strand", F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"))
    first = F.col("start0") + F.when(F.col("doc_id") % 10 == 9, 2).otherwise(1)  # one in ten was cut a letter late
    stored = F.col("whole").substr(first.cast("int"), F.greatest(F.lit(0), (F.col("end0") - first + 1).cast("int")))
    occ = occ.select("doc_id", "start0", "end0", "strand", F.sha2(F.when(F.col("strand") == "-", S.reverse_complement(stored)).otherwise(stored), 256).alias("slice_hash"))
    return S.verify_slices(occ, parents, "doc_id", "seq", "slice_hash").select("doc_id", "same")


ANY = "SELECT doc_id, least(t, reverse(translate(t, 'acgt', 'tgca'))) AS t, p FROM (SELECT doc_id, unnest(list_transform(range(0, length(seq) - {k} + 1), lambda i: seq[i + 1:i + {k}])) AS t, unnest(range(0, length(seq) - {k} + 1)) AS p FROM seq WHERE length(seq) >= {k})"


@query(with_views(f"""WITH a AS ({ANY.format(k=12)}), n AS (SELECT t, count(*) AS n FROM a GROUP BY 1)
 SELECT a.doc_id, count(*) AS n_tiles, count(*) FILTER (WHERE n.n = 1) AS n_unique FROM a JOIN n ON n.t = a.t WHERE a.p % 12 = 0 GROUP BY 1""", "seq"))
def unique_tiles(spark, d):
    return kmers.unique_tiles(stage(view(spark, d, "seq"), "seq"), "doc_id", "seq", k=12, stride=12)


@query(with_views(f"""WITH c AS (SELECT seq, min(doc_id) AS doc_id FROM seq GROUP BY 1), k AS (SELECT DISTINCT doc_id, t FROM ({ANY.format(k=16).replace('FROM seq', 'FROM c')})), z AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1),
 m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_shared FROM k x JOIN k y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2)
 SELECT a, b, n_shared, x.n AS n_a, y.n AS n_b FROM m JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 2 * n_shared >= greatest(x.n, y.n)""", "seq"))
def similar_sequences(spark, d):
    seq = stage(view(spark, d, "seq"), "seq")
    pairs, members = kmers.similar_sequences(seq, "doc_id", "seq", k=16, share=0.5)
    drop(seq, members)
    return pairs


@query(with_views("SELECT doc_id, min(doc_id) OVER (PARTITION BY seq) AS rep FROM seq", "seq"))
def sequence_members(spark, d):
    """Which sequence of ``similar_sequences`` stands for each document."""
    return kmers.same_sequences(stage(view(spark, d, "seq"), "seq"), "doc_id", "seq")


@query(with_views("""WITH k AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(0, length(seq) - 15, 16), lambda i: seq[i + 1:i + 16]))) AS ts FROM seq WHERE length(seq) >= 16)
 SELECT doc_id, min(doc_id) OVER (PARTITION BY ts) AS rep FROM k""", "seq"))
def kmer_members(spark, d):
    """Which set of windows, cut side by side from the first letter on, stands for each document."""
    k = stage(view(spark, d, "seq").select("doc_id", F.array_distinct(S.kmers("seq", 16, 16)).alias("ts")), "kmers")
    return kmers.members(k, "doc_id", "ts")
