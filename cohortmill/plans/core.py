"""Queries over the role views: values, tests, shapes and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import checks, graph, ranking, shape, stats
from ..sources.shared import stage
from .registry import query
from .views import table, view, with_views


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(with_views("""SELECT unit_id, CASE WHEN detection_status = 'detected' AND truth = '1' THEN 'TP' WHEN detection_status = 'detected' AND truth = '0' THEN 'FP' WHEN truth = 'unknown' THEN 'unknown_truth'
 WHEN detection_status = 'not_resolvable' THEN 'unassessable' WHEN truth = '1' THEN 'FN' ELSE 'TN' END AS label FROM truth""", "truth"))
def ladder_first(spark: SparkSession, d: str) -> DataFrame:
    t, hit = F.col("truth"), F.col("detection_status") == "detected"
    label = V.ladder([(hit & (t == "1"), "TP"), (hit & (t == "0"), "FP"), (t == "unknown", "unknown_truth"), (F.col("detection_status") == "not_resolvable", "unassessable"), (t == "1", "FN")], "TN")
    return view(spark, d, "truth").select("unit_id", label.alias("label"))


@query("""SELECT p_partkey, concat_ws(';', CASE WHEN p_size < 5 THEN 'small' END, CASE WHEN p_retailprice < 950 THEN 'cheap' END, CASE WHEN p_type = 'ECONOMY' THEN 'economy' END) AS reasons,
 NOT (p_size < 5 OR p_retailprice < 950 OR p_type = 'ECONOMY') AS eligible FROM part""")
def reasons_all(spark, d):
    rules = [(F.col("p_size") < 5, "small"), (F.col("p_retailprice") < 950, "cheap"), (F.col("p_type") == "ECONOMY", "economy")]
    why = V.reasons(rules)
    return table(spark, d, "part").select("p_partkey", why.alias("reasons"), (why == "").alias("eligible"))


@query("""SELECT o_orderkey, CASE WHEN lower(trim(s)) IN ('', 'unknown', 'na', 'nan', 'none', 'null') THEN NULL ELSE trim(s) END AS cleaned,
 CASE WHEN lower(trim(s)) IN ('', 'unknown', 'na', 'nan', 'none', 'null') THEN NULL ELSE try_cast(trim(s) AS DOUBLE) END AS value
 FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' NA ' WHEN 1 THEN '' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'x' ELSE concat(' ', CAST(o_custkey AS VARCHAR)) END AS s FROM orders)""")
def nullify(spark, d):
    m = F.col("o_orderkey") % 6
    s = F.when(m == 0, " NA ").when(m == 1, "").when(m == 2, "Unknown").when(m == 3, "x").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    t = table(spark, d, "orders").select("o_orderkey", s.alias("s"))
    return t.select("o_orderkey", V.nullify("s").alias("cleaned"), V.number("s").alias("value"))


@query("SELECT c_custkey, coalesce(c_acctbal BETWEEN 0 AND 5000, FALSE) AS ok FROM customer")
def range_guard(spark, d):
    return table(spark, d, "customer").select("c_custkey", V.in_range("c_acctbal", 0, 5000).alias("ok"))


DETECT = """CASE WHEN breadth IS NULL THEN 'not_assessed' WHEN breadth >= {b} AND n_assigned >= 1 AND n_ambiguous * 2 <= n_assigned THEN 'detected'
 WHEN breadth >= {b} AND n_ambiguous * 2 > n_assigned THEN 'not_resolvable' ELSE 'not_detected' END"""


def detected(breadth_min):
    return V.detection_state(F.col("breadth"), F.col("value"), F.col("n_assigned"), F.col("n_ambiguous"), breadth_min)


@query(with_views(f"SELECT donor, feature, {DETECT.format(b='0.5')} AS state FROM meas", "meas"))
def detect_states(spark, d):
    return view(spark, d, "meas").select("donor", "feature", detected(0.5).alias("state"))


@query(with_views(f"SELECT CAST(t AS DOUBLE) AS threshold, grp, {DETECT.format(b='t')} AS state, count(*) AS n FROM meas CROSS JOIN (VALUES (0.45), (0.5), (0.55)) x(t) GROUP BY 1, 2, 3", "meas"))
def threshold_scan(spark, d):
    each = view(spark, d, "meas").withColumn("threshold", F.explode(F.array(F.lit(0.45), F.lit(0.5), F.lit(0.55))))
    return each.groupBy("threshold", "grp", detected(F.col("threshold")).alias("state")).agg(F.count("*").alias("n"))


CELLS = "cell AS (SELECT o_custkey, o_orderpriority, count(*) AS value FROM orders GROUP BY 1, 2)"


def cells(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("value"))


@query(f"""WITH {CELLS} SELECT d.o_custkey, f.o_orderpriority, CASE WHEN m.value IS NULL THEN 'not_assessed' ELSE 'assessed' END AS status, m.value
 FROM (SELECT DISTINCT o_custkey FROM cell) d CROSS JOIN (SELECT DISTINCT o_orderpriority FROM cell) f LEFT JOIN cell m ON m.o_custkey = d.o_custkey AND m.o_orderpriority = f.o_orderpriority""")
def rectangle(spark, d):
    return shape.rectangle(cells(spark, d), ["o_custkey"], ["o_orderpriority"]).select("o_custkey", "o_orderpriority", "status", "value")


@query(with_views("SELECT grp, feature, median(value) AS median_value, round(avg(value), 6) AS mean_value, min(value) AS low, max(value) AS high, count(*) AS n FROM meas GROUP BY 1, 2", "meas"))
def group_median(spark, d):
    return view(spark, d, "meas").groupBy("grp", "feature").agg(F.percentile("value", F.lit(0.5)).alias("median_value"), r6(F.avg("value"), "mean_value"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def fisher_tables(meas):
    hit = F.when(F.col("breadth") >= 0.5, 1).otherwise(0)
    case = F.when(F.col("grp") == "case", 1).otherwise(0)
    return meas.groupBy("feature").agg(F.sum(hit * case).alias("a"), F.sum((1 - hit) * case).alias("b"), F.sum(hit * (1 - case)).alias("c"), F.sum((1 - hit) * (1 - case)).alias("d"))


FISHER = """tab AS (SELECT feature, CAST(sum(CASE WHEN grp = 'case' AND breadth >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN grp = 'case' AND breadth < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS b,
 CAST(sum(CASE WHEN grp <> 'case' AND breadth >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN grp <> 'case' AND breadth < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS d FROM meas GROUP BY feature),
xs AS (SELECT t.*, x, (factorial(CAST(a + b AS INTEGER)) / (factorial(CAST(x AS INTEGER)) * factorial(CAST(a + b - x AS INTEGER)))) * (factorial(CAST(c + d AS INTEGER)) / (factorial(CAST(a + c - x AS INTEGER)) * factorial(CAST(c + d - a - c + x AS INTEGER)))) AS w
 FROM tab t, range(0, 21) r(x) WHERE x <= a + b AND x <= a + c AND a + c - x <= c + d),
fish AS (SELECT feature, a, b, c, d, sum(CASE WHEN w <= w0 THEN w END) / sum(w) AS p
 FROM (SELECT *, max(CASE WHEN x = a THEN w END) OVER (PARTITION BY feature) AS w0 FROM xs) GROUP BY ALL)"""


@query(with_views(f"WITH {FISHER} SELECT feature, a, b, c, d, round(p, 6) AS fisher_p FROM fish", "meas"))
def fisher_exact(spark, d):
    return stats.fisher_exact(fisher_tables(view(spark, d, "meas")), "a", "b", "c", "d").select("feature", "a", "b", "c", "d", r6(F.col("fisher_p"), "fisher_p"))


RANKED = "ranked AS (SELECT *, 2 * rank() OVER (PARTITION BY feature ORDER BY value) + count(*) OVER (PARTITION BY feature, value) - 1 AS rank2 FROM meas)"


def ranked(spark, d):
    return stats.doubled_mid_ranks(view(spark, d, "meas"), ["feature"], "value")


@query(with_views(f"WITH {RANKED} SELECT donor, feature, rank2 FROM ranked", "meas"))
def mid_ranks(spark, d):
    return ranked(spark, d).select("donor", "feature", "rank2")


CLIFF = "cliff AS (SELECT feature, sum(CASE WHEN grp = 'case' THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN grp = 'case' THEN 0 ELSE 1 END) AS n0, sum(CASE WHEN grp = 'case' THEN rank2 ELSE 0 END) AS rs FROM ranked GROUP BY feature)"


@query(with_views(f"WITH {RANKED}, {CLIFF} SELECT feature, n1, n0, round((rs - n1 * (n1 + 1)) * 1.0 / nullif(n1 * n0, 0) - 1, 6) AS delta FROM cliff", "meas"))
def cliffs_delta(spark, d):
    out = stats.cliffs_delta(ranked(spark, d), ["feature"], F.col("grp") == "case")
    return out.select("feature", "n1", "n0", r6(F.col("delta"), "delta"))


PERM = """arr AS (SELECT feature, list(rank2 ORDER BY donor) AS r, list(CASE WHEN grp = 'case' THEN 1 ELSE 0 END ORDER BY donor) AS o FROM ranked GROUP BY feature),
masks AS (SELECT feature, r, o, len(r) AS n, list_sum(o) AS n1, list_sum(r) AS total, list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i] * o[i])) AS seen, m FROM arr, range(0, 1024) t(m)),
picked AS (SELECT *, coalesce(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN r[i] ELSE 0 END)), 0) AS s FROM masks WHERE m < (1 << n) AND bit_count(m) = n1),
perm AS (SELECT feature, avg(CASE WHEN abs(s * n - total * n1) >= abs(seen * n - total * n1) THEN 1.0 ELSE 0.0 END) AS perm_p FROM picked GROUP BY feature)"""


@query(with_views(f"WITH {RANKED}, {PERM} SELECT feature, round(perm_p, 6) AS perm_p FROM perm", "meas"))
def rank_perm(spark, d):
    return stats.rank_permutation(ranked(spark, d), ["feature"], F.col("grp") == "case").select("feature", r6(F.col("perm_p"), "perm_p"))


P_VALUES = "pv AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS family, CASE WHEN l_linenumber <> 7 THEN (l_extendedprice % 1000) / 1000 END AS p FROM lineitem)"


def p_values(spark, d):
    p = F.when(F.col("l_linenumber") != 7, (F.col("l_extendedprice") % 1000) / 1000)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("family"), p.alias("p"))


@query(f"""WITH {P_VALUES}, rk AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, count(p) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM pv WHERE p IS NOT NULL),
q AS (SELECT *, least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM rk)
SELECT id, family, round(q, 6) AS q FROM q UNION ALL SELECT id, family, NULL FROM pv WHERE p IS NULL""")
def bh_fdr(spark, d):
    return stats.bh_adjust(p_values(spark, d), ["family"], "p").select("id", "family", r6(F.col("q"), "q"))


@query(f"""WITH {P_VALUES}, rk AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, rank() OVER (PARTITION BY family ORDER BY p) AS k FROM pv WHERE p IS NOT NULL),
h AS (SELECT *, least(1.0, max((m - k + 1) * p) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h FROM rk)
SELECT id, family, round(h, 6) AS holm FROM h UNION ALL SELECT id, family, NULL FROM pv WHERE p IS NULL""")
def holm(spark, d):
    return stats.holm_adjust(p_values(spark, d), ["family"], "p").select("id", "family", r6(F.col("holm"), "holm"))


@query(with_views(f"""WITH {FISHER}, {RANKED}, {CLIFF}, {PERM},
med AS (SELECT feature, median(CASE WHEN grp = 'case' THEN value END) AS m1, median(CASE WHEN grp = 'control' THEN value END) AS m0 FROM meas GROUP BY feature),
al AS (SELECT f.feature, f.a + f.b AS n_case, f.c + f.d AS n_control, f.a AS detected_case, f.c AS detected_control, f.p AS fp, pm.perm_p AS pp, (c.rs - c.n1 * (c.n1 + 1)) * 1.0 / nullif(c.n1 * c.n0, 0) - 1 AS delta, m.m1 - m.m0 AS dm
 FROM fish f JOIN cliff c USING (feature) JOIN perm pm USING (feature) JOIN med m USING (feature)),
q AS (SELECT *, least(1.0, min(fp * n / k) OVER (ORDER BY fp RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fq
 FROM (SELECT *, count(fp) OVER () AS n, count(fp) OVER (ORDER BY fp RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM al)),
q2 AS (SELECT *, least(1.0, min(pp * n / k2) OVER (ORDER BY pp RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pq
 FROM (SELECT *, count(pp) OVER (ORDER BY pp RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k2 FROM q))
SELECT feature, n_case, n_control, detected_case, detected_control, round(dm, 6) AS median_difference, round(delta, 6) AS delta, round(fp, 6) AS fisher_p, round(fq, 6) AS fisher_q, round(pp, 6) AS perm_p, round(pq, 6) AS perm_q FROM q2""", "meas"))
def diff_table(spark, d):
    out = stats.group_tests(view(spark, d, "meas"), "feature", F.col("grp") == "case", F.col("breadth") >= 0.5, "value")
    named = out.select("feature", "n_case", "n_control", "detected_case", "detected_control", *(r6(F.col(c), c) for c in ("median_difference", "delta", "fisher_p", "fisher_q", "perm_p", "perm_q")))
    named._holds = out._holds
    return named


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(with_views("SELECT donor, " + ", ".join(f"max(CASE WHEN feature = '{b}' THEN value END) AS \"{b}\"" for b in BRANDS) + " FROM meas GROUP BY donor", "meas"))
def pivot_matrix(spark, d):
    """Units by features: a column for each feature that occurs, found first."""
    return shape.matrix(view(spark, d, "meas"), ["donor"], "feature", "value")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_equi(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'not_labelled' ELSE 'labelled' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_default(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit("labelled").alias("status"))
    return shape.left_with_default(table(spark, d, "documents").select("doc_id"), labels, ["doc_id"], {"quality": F.lit(-1), "status": F.lit("not_labelled")})


@query("""SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'equal' ELSE 'differs' END AS finding
 FROM (SELECT doc_id AS k, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS v FROM documents) a FULL OUTER JOIN (SELECT doc_id AS k, quality AS v FROM labels) b ON a.k = b.k""")
def reconcile(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("v"))
    return shape.reconcile(a, table(spark, d, "labels").select(F.col("doc_id").alias("k"), F.col("quality").alias("v")), "k", "v")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def semi_evidence(spark, d):
    ev = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    c = table(spark, d, "customer")
    return c.join(ev, c.c_custkey == ev.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_missing(spark, d):
    return checks.missing_references(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_custkey").select("c_custkey")


@query("SELECT n AS n_lines, count(*) AS n_orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def count_hist(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines")).groupBy("n_lines").agg(F.count("*").alias("n_orders"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_pivot(spark, d):
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS ratio FROM lineitem GROUP BY 1")
def ratio_of_sums(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice"), "ratio"))


@query("""SELECT k, CASE WHEN max(CASE WHEN e THEN 1 ELSE 0 END) = 1 THEN TRUE WHEN max(CASE WHEN e IS NULL THEN 1 ELSE 0 END) = 0 THEN FALSE END AS evidence
 FROM (SELECT d.n_chars % 50 AS k, CASE WHEN l.quality IS NULL THEN NULL ELSE l.toxic = 1 END AS e FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY k""")
def tri_or(spark, d):
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 50).alias("k")).join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("k").agg(V.tri_or(F.when(F.col("quality").isNotNull(), F.col("toxic") == 1)).alias("evidence"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS k, round((p + z2 / 2 / n_ - h) / (1 + z2 / n_), 6) AS low, round((p + z2 / 2 / n_ + h) / (1 + z2 / n_), 6) AS high FROM (SELECT *, 1.959963984540054 * sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_)) AS h FROM (SELECT lang, n_chars, count(*) OVER (PARTITION BY lang) AS n_, count(*) FILTER (WHERE n_chars > 1000) OVER (PARTITION BY lang) * 1.0 / count(*) OVER (PARTITION BY lang) AS p, 1.959963984540054 * 1.959963984540054 AS z2 FROM documents)) GROUP BY lang, p, z2, n_, h")
def wilson(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.when(F.col("n_chars") > 1000, 1).otherwise(0)).alias("k"))
    low, high = V.wilson("k", "n")
    return g.select("lang", "n", "k", r6(low, "low"), r6(high, "high"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity, round(l_quantity * 1e9 / nullif(l_partkey * l_extendedprice, 0), 3) AS rpkm FROM lineitem")
def rpkm(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", F.round(V.rpkm("l_quantity", "l_partkey", "l_extendedprice"), 3).alias("rpkm"))


@query("SELECT a.l_suppkey, round(CASE WHEN sqrt((a.s * a.s + b.s * b.s) / 2) > 0 THEN (a.m - b.m) / sqrt((a.s * a.s + b.s * b.s) / 2) WHEN a.m = b.m THEN 0.0 END, 6) AS d FROM (SELECT l_suppkey, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a JOIN (SELECT l_suppkey, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1) b ON a.l_suppkey = b.l_suppkey")
def cohen_d(spark, d):
    open_ = F.col("l_linestatus") == "O"
    q = lambda c: F.when(c, F.col("l_quantity"))
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg(q(open_)).alias("m1"), F.stddev_pop(q(open_)).alias("s1"), F.avg(q(~open_)).alias("m2"), F.stddev_pop(q(~open_)).alias("s2"))
    return g.where("m1 is not null and m2 is not null").select("l_suppkey", r6(V.cohen_d("m1", "s1", "m2", "s2"), "d"))


@query("SELECT p_brand, count(DISTINCT p_type) AS n_members, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS members FROM part GROUP BY 1")
def distinct_members(spark, d):
    return shape.distinct_members(table(spark, d, "part"), ["p_brand"], "p_type")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(concat(p_name, ';', p_brand, ',', p_type, ' ', p_name), '[;,\\s]+'), lambda x: x <> ''))), ';') AS joined FROM part")
def set_join(spark, d):
    text = F.concat("p_name", F.lit(";"), "p_brand", F.lit(","), "p_type", F.lit(" "), "p_name")
    return table(spark, d, "part").select("p_partkey", V.set_join(text).alias("joined"))


@query(with_views("""WITH RECURSIVE und AS (SELECT a AS x, b AS y FROM edge UNION ALL SELECT b, a FROM edge),
 reach AS (SELECT x AS n, x AS m FROM und UNION SELECT r.n, u.y FROM reach r JOIN und u ON r.m = u.x) SELECT n AS node, min(m) AS component FROM reach GROUP BY n""", "edge"))
def components(spark, d):
    return graph.components(view(spark, d, "edge"))


@query(with_views("SELECT iv_id, count(*) AS n FROM iv GROUP BY 1 HAVING count(*) > 1 OR iv_id IS NULL", "iv"))
def dq_unique(spark, d):
    return checks.duplicate_keys(view(spark, d, "iv"), ["iv_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)")
def dq_fk(spark, d):
    lost = checks.missing_references(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size > 2"), "p_partkey")
    return lost.select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def dq_keyset(spark, d):
    return checks.unequal_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT p_brand, p_type, count(DISTINCT p_size) AS n_values FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1")
def dq_fd(spark, d):
    return checks.dependency_conflicts(table(spark, d, "part"), ["p_brand", "p_type"], "p_size")


@query(f"WITH {CELLS} SELECT r AS n_rows, c AS n_columns, n AS n_cells, r * c AS n_expected FROM (SELECT count(DISTINCT o_custkey) AS r, count(DISTINCT o_orderpriority) AS c, count(DISTINCT (o_custkey, o_orderpriority)) AS n FROM cell) WHERE n <> r * c")
def dq_cardinality(spark, d):
    return checks.incomplete_rectangle(cells(spark, d), ["o_custkey"], ["o_orderpriority"])


@query("SELECT doc_id, n_chars, length(text) AS recomputed FROM documents WHERE abs(n_chars - length(text)) > 0 OR (n_chars IS NULL) <> (text IS NULL)")
def dq_recompute(spark, d):
    return checks.recomputed_differs(table(spark, d, "documents"), "n_chars", F.char_length("text").cast("long")).select("doc_id", "n_chars", "recomputed")


@query("""WITH l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1)
 SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS stated, cents AS recomputed FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE abs(CAST(round(o_totalprice * 100) AS BIGINT) - cents) > 0 OR cents IS NULL""")
def dq_recompute_total(spark, d):
    """Orders whose stated total is not what their lines come to; those without lines too."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("_cents"))
    orders = table(spark, d, "orders").select("o_orderkey", cents("o_totalprice").alias("stated")).hint("shuffle_merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return checks.recomputed_differs(orders, "stated", F.col("_cents")).select("o_orderkey", "stated", "recomputed")


@query("SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def dq_leak(spark, d):
    return checks.split_leaks(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "A", "R")


@query("SELECT l_returnflag, count(*) AS total, sum(CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN l_tax < 0 THEN 1 ELSE 0 END) AS parts FROM lineitem GROUP BY 1 HAVING count(*) <> sum(CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN l_tax < 0 THEN 1 ELSE 0 END)")
def dq_balance(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", F.lit(1).alias("one"), F.when(F.col("l_tax") > 0, 1).otherwise(0).alias("more"), F.when(F.col("l_tax") < 0, 1).otherwise(0).alias("less"))
    return checks.unbalanced(x, ["l_returnflag"], "one", ["more", "less"])


@query(with_views("""SELECT 'duplicate_interval' AS code, count(*) AS n_violations FROM (SELECT iv_id FROM iv GROUP BY 1 HAVING count(*) > 1) UNION ALL
 SELECT 'part_without_lines', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL
 SELECT 'brand_type_size', count(*) FROM (SELECT 1 FROM part GROUP BY p_brand, p_type HAVING count(DISTINCT p_size) > 1)""", "iv"))
def dq_report(spark, d):
    part = table(spark, d, "part")
    return checks.report({"duplicate_interval": checks.duplicate_keys(view(spark, d, "iv"), ["iv_id"]), "part_without_lines": checks.missing_references(part, "p_partkey", table(spark, d, "lineitem"), "l_partkey"), "brand_type_size": checks.dependency_conflicts(part, ["p_brand", "p_type"], "p_size")})


@query()
def fingerprint(spark, d):
    return checks.fingerprint(table(spark, d, "lineitem"))
