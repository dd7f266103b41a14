"""Queries over fragments, evidence, selections, shapes and file-like sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import checks, evidence, fragments, ranking, shape
from ..sources import text_tables as T
from .core import r6
from .registry import query
from .views import table, view, with_views

FRAG = """SELECT qname, count(*) AS n_records, CASE WHEN min(flag & 4) = 4 THEN 'unmapped' WHEN count(*) <> 2 THEN 'unpaired' WHEN max(flag & 4) = 4 THEN 'one_mate' WHEN min(mapq) < 10 THEN 'low_quality'
 WHEN count(DISTINCT ref) > 1 THEN 'ambiguous' WHEN max(pos) - min(pos) > 1000 THEN 'far_apart' ELSE 'assigned' END AS class FROM aln GROUP BY 1"""


@query(with_views(FRAG, "aln"))
def fragment_class(spark, d):
    return fragments.classify(view(spark, d, "aln"), mapq_min=10, span_max=1000).select("qname", "n_records", "class")


@query(with_views("SELECT a.qname, a.flag & 4 = 0 AND b.flag & 4 = 0 AND a.ref = b.ref AND abs(a.pos - b.pos) BETWEEN 50 AND 1000 AS valid FROM aln a JOIN aln b ON a.qname = b.qname AND a.mate = 1 AND b.mate = 2", "aln"))
def pair_valid(spark, d):
    return fragments.valid_pairs(view(spark, d, "aln"), 50, 1000)


@query(with_views("SELECT qname, mate, ref FROM aln WHERE qname NOT IN (SELECT qname FROM aln WHERE flag & 4 = 4)", "aln"))
def any_mate_drop(spark, d):
    aln = view(spark, d, "aln")
    return fragments.drop_hit_fragments(aln, aln.where(F.col("flag").bitwiseAND(4) == 4)).select("qname", "mate", "ref")


@query(with_views("SELECT coalesce(a.qname, b.qname) AS qname, a.qname IS NULL AS no_first, b.qname IS NULL AS no_second FROM (SELECT DISTINCT qname FROM aln WHERE mate = 1 AND flag & 4 = 0) a FULL OUTER JOIN (SELECT DISTINCT qname FROM aln WHERE mate = 2 AND flag & 4 = 0) b ON a.qname = b.qname WHERE a.qname IS NULL OR b.qname IS NULL", "aln"))
def cogroup_check(spark, d):
    """Fragments of which one mate is mapped and the other is not, or is missing."""
    aln = view(spark, d, "aln").where(~fragments.unmapped())
    out = checks.unequal_keys(aln.where("mate = 1"), aln.where("mate = 2"), "qname")
    return out.select("qname", (F.col("side") == "right").alias("no_first"), (F.col("side") == "left").alias("no_second"))


@query(with_views("SELECT ref, count(*) AS n_records, count(DISTINCT qname) AS n_fragments, sum(CASE WHEN flag & 4 = 0 THEN 1 ELSE 0 END) AS n_mapped, round(sum(score), 4) AS score FROM aln GROUP BY 1", "aln"))
def read_counts(spark, d):
    mapped = F.sum(F.when(F.col("flag").bitwiseAND(4) == 0, 1).otherwise(0))
    return view(spark, d, "aln").groupBy("ref").agg(F.count("*").alias("n_records"), F.count_distinct("qname").alias("n_fragments"), mapped.alias("n_mapped"), F.round(F.sum("score"), 4).alias("score"))


@query(with_views("SELECT x.ref AS a, y.ref AS b, count(*) AS n FROM (SELECT DISTINCT qname, ref FROM aln) x JOIN (SELECT DISTINCT qname, ref FROM aln) y ON x.qname = y.qname AND x.ref < y.ref GROUP BY 1, 2", "aln"))
def ambig_pairs(spark, d):
    return fragments.target_pairs(view(spark, d, "aln"))


@query(with_views("""SELECT profile, count(*) FILTER (WHERE truth = '1' AND detection_status = 'detected') AS tp, count(*) FILTER (WHERE truth = '0' AND detection_status = 'detected') AS fp, count(*) FILTER (WHERE truth = '1' AND detection_status = 'not_detected') AS fn,
 count(*) FILTER (WHERE truth = '0' AND detection_status = 'not_detected') AS tn, count(*) FILTER (WHERE truth <> 'unknown' AND detection_status = 'not_resolvable') AS unassessable, count(*) FILTER (WHERE truth = 'unknown') AS unknown_truth FROM truth GROUP BY 1""", "truth"))
def confusion(spark, d):
    return evidence.confusion(view(spark, d, "truth"), ["profile"])


@query("""SELECT n_nationkey % 5 AS k, count(*) AS n, CASE WHEN bool_and(a) THEN TRUE WHEN bool_and(NOT a) THEN FALSE END AS same FROM (SELECT n_nationkey, n_regionkey >= 1 AS a FROM nation) GROUP BY 1""")
def evidence_rollup(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") % 5).alias("k"), (F.col("n_regionkey") >= 1).alias("a"))
    g = n.groupBy("k").agg(F.count("*").alias("n"), V.tri_or("a").alias("any"), V.tri_or(~F.col("a")).alias("any_not"))
    return g.select("k", "n", V.both_sides("any", ~F.col("any_not")).alias("same"))


@query("SELECT p_brand, p_type, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS of_brand, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY p_type), 6) AS of_type FROM part GROUP BY 1, 2")
def multi_axis(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return counts.select("p_brand", "p_type", r6(F.col("n") / F.sum("n").over(ranking.W.partitionBy("p_brand")), "of_brand"), r6(F.col("n") / F.sum("n").over(ranking.W.partitionBy("p_type")), "of_type"))


@query("""SELECT b.p_brand, t.p_type, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'absent' ELSE 'present' END AS state FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) t
 LEFT JOIN (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1, 2) c ON c.p_brand = b.p_brand AND c.p_type = t.p_type""")
def feature_props(spark, d):
    part = table(spark, d, "part")
    counts = part.where("p_size > 40").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return evidence.presence(counts, part.select("p_brand").distinct(), part.select("p_type").distinct(), ["p_brand"], ["p_type"])


@query(with_views("SELECT family, count(DISTINCT contig) AS n_contigs, max(c) AS most_copies FROM (SELECT family, contig, count(*) AS c FROM gene GROUP BY 1, 2) GROUP BY 1 HAVING max(c) <= 6", "gene"))
def core_groups(spark, d):
    return evidence.core_groups(view(spark, d, "gene"), "family", "contig", most_copies=6)


@query(with_views("SELECT contig FROM gene GROUP BY 1 HAVING count(DISTINCT CASE WHEN category IN ('ECONOMY', 'PROMO') THEN category END) = 2 AND count(*) FILTER (WHERE family = 'Brand#1') = 0", "gene"))
def quorum(spark, d):
    return evidence.quorum(view(spark, d, "gene"), ["contig"], "category", ["ECONOMY", "PROMO"], F.col("family") == "Brand#1")


@query(with_views("SELECT contig, count(*) FILTER (WHERE category = 'ECONOMY') AS economy, count(*) FILTER (WHERE category = 'PROMO') AS promo, count(DISTINCT family) AS n_families, max(gene_order) AS last FROM gene GROUP BY 1", "gene"))
def category_counts(spark, d):
    one = lambda x: F.sum(F.when(F.col("category") == x, 1).otherwise(0))
    return view(spark, d, "gene").groupBy("contig").agg(one("ECONOMY").alias("economy"), one("PROMO").alias("promo"), F.count_distinct("family").alias("n_families"), F.max("gene_order").alias("last"))


@query(with_views("SELECT contig, CASE WHEN e = 0 AND p = 0 THEN 'bare' WHEN e >= 2 AND p >= 1 THEN 'complete' WHEN e >= 1 AND p >= 1 THEN 'partial' ELSE 'single' END AS element FROM (SELECT contig, count(*) FILTER (WHERE category = 'ECONOMY') AS e, count(*) FILTER (WHERE category = 'PROMO') AS p FROM gene GROUP BY 1)", "gene"))
def element_class(spark, d):
    one = lambda x: F.sum(F.when(F.col("category") == x, 1).otherwise(0))
    g = view(spark, d, "gene").groupBy("contig").agg(one("ECONOMY").alias("e"), one("PROMO").alias("p"))
    e, p = F.col("e"), F.col("p")
    return g.select("contig", V.ladder([((e == 0) & (p == 0), "bare"), ((e >= 2) & (p >= 1), "complete"), ((e >= 1) & (p >= 1), "partial")], "single").alias("element"))


@query(with_views("SELECT gene_id, CASE WHEN count(DISTINCT model_id) FILTER (WHERE score > 30000) = 0 THEN 'none' WHEN count(DISTINCT model_id) FILTER (WHERE score > 30000) = 1 THEN 'one' ELSE 'several' END AS decision, arg_max(model_id, (score, -model_id)) FILTER (WHERE score > 30000) AS best FROM hit GROUP BY 1", "hit"))
def best_ref(spark, d):
    return evidence.best_reference(view(spark, d, "hit"), "gene_id", "model_id", "score", 30000)


@query("""WITH need AS (SELECT DISTINCT p_brand, p_size FROM part), own AS (SELECT DISTINCT l_suppkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT l_suppkey, n.p_brand FROM own JOIN need n ON own.p_size = n.p_size GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM need m WHERE m.p_brand = n.p_brand)""")
def rel_division(spark, d):
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    owned = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_size")
    return shape.divides(owned, part, "l_suppkey", "p_size", "p_brand")


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_explode(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT event_id, json_keys(props) = ['k'] AS ok FROM events")
def json_covars(spark, d):
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return table(spark, d, "events").select("event_id", (F.array_sort(keys) == F.array(F.lit("k"))).alias("ok"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '/(de|fr|es)/') THEN 'other_language' WHEN regexp_matches(lower(url), '\.(org|net)/') THEN 'organisation' WHEN regexp_matches(url, '\?.*page=') THEN 'listing' ELSE 'plain' END AS class FROM pages""")
def regex_classify(spark, d):
    u = F.col("url")
    rules = [(u.rlike("/(de|fr|es)/"), "other_language"), (F.lower(u).rlike(r"\.(org|net)/"), "organisation"), (u.rlike(r"\?.*page="), "listing")]
    return table(spark, d, "pages").select("page_id", V.ladder(rules, "plain").alias("class"))


@query(r"""SELECT page_id, map_extract(m, 'page')[1] AS page, map_extract(m, 'ref')[1] AS ref FROM (SELECT page_id, CASE WHEN contains(url, '?') THEN map_from_entries(list_transform(string_split(string_split(url, '?')[2], '&'), lambda x: struct_pack(k := string_split(x, '=')[1], v := string_split(x, '=')[2]))) END AS m FROM pages)""")
def attr_map(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.when(F.instr("url", "?") > 0, T.attribute_map(F.split("url", r"\?").getItem(1), "&")).alias("m"))
    return pages.select("page_id", F.col("m")["page"].alias("page"), F.col("m")["ref"].alias("ref"))


@query("SELECT conv_id, CASE WHEN count(DISTINCT role) <= 1 THEN max(role) END AS role, CASE WHEN count(DISTINCT role) > 1 THEN 'role' ELSE '' END AS conflict, array_to_string(list_sort(list(DISTINCT CAST(turn AS VARCHAR))), ';') AS members, count(*) AS n FROM conversations GROUP BY 1")
def merge_guarded(spark, d):
    return shape.merge_guarded(table(spark, d, "conversations"), "conv_id", ["role"], "turn")


@query("""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.seg, n.seg) AS seg, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL OR o.seg IS NOT DISTINCT FROM n.seg THEN 'kept' ELSE 'refused' END AS action
 FROM (SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_mktsegment <> 'BUILDING') o FULL OUTER JOIN (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'NEW' ELSE c_mktsegment END AS seg FROM customer WHERE c_acctbal > 0) n ON o.c_custkey = n.c_custkey""")
def upsert_guard(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    new = c.where("c_acctbal > 0").select("c_custkey", F.when(F.col("c_acctbal") > 5000, "NEW").otherwise(F.col("c_mktsegment")).alias("seg"))
    return shape.upsert(old, new, "c_custkey")


@query("SELECT n_nationkey AS key, n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def union_strict(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    return shape.union_strict(n, r)


@query("SELECT p_type FROM part WHERE p_size < 10 INTERSECT SELECT p_type FROM part WHERE p_size > 40")
def set_ops(spark, d):
    part = table(spark, d, "part")
    return part.where("p_size < 10").select("p_type").intersect(part.where("p_size > 40").select("p_type"))


@query("SELECT p_partkey, 'p_size' AS dimension, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melt(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return part.unpivot("p_partkey", ["p_size", "p_retailprice"], "dimension", "value")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_list(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(string_split(reverse(p_name), ' ')) AS mirrored FROM part")
def zip_unnest(spark, d):
    return T.zip_lists(table(spark, d, "part").select("p_partkey", "p_name", F.reverse("p_name").alias("r")), ["p_partkey"], {"word": "p_name", "mirrored": "r"}, " ")


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS alias, count(*) OVER (PARTITION BY regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g')) AS n FROM customer")
def alias_flag(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.regexp_replace(F.lower("c_name"), "[^a-z0-9]", "").alias("alias"))
    return a.withColumn("n", F.count("*").over(ranking.W.partitionBy("alias")))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'excluded' WHEN c_mktsegment = 'BUILDING' THEN 'review' WHEN c_acctbal > 8000 THEN 'preselected' ELSE 'reserve' END AS status,
 concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END) AS pending FROM customer""")
def status_cascade(spark, d):
    low, seg = F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING"
    return table(spark, d, "customer").select("c_custkey", V.ladder([(low, "excluded"), (seg, "review"), (F.col("c_acctbal") > 8000, "preselected")], "reserve").alias("status"), V.reasons([(low, "negative_balance"), (seg, "segment")]).alias("pending"))


@query("SELECT doc_id, strpos(text, 'the ') AS first_at, CASE WHEN strpos(text, 'the ') = 0 THEN 'absent' WHEN strpos(substr(text, strpos(text, 'the ') + 1), 'the ') > 0 THEN 'ambiguous' ELSE 'unique' END AS place FROM documents")
def locate_unique(spark, d):
    first = F.locate("the ", F.col("text"))
    again = F.expr("locate('the ', text, locate('the ', text) + 1)")
    return table(spark, d, "documents").select("doc_id", first.alias("first_at"), F.when(first == 0, "absent").when(again > 0, "ambiguous").otherwise("unique").alias("place"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice = 0 THEN 'zero_needs_value' WHEN o_orderstatus <> 'F' AND o_totalprice > 400000 THEN 'value_before_end' END AS violation FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice = 0) OR (o_orderstatus <> 'F' AND o_totalprice > 400000)")
def value_rules(spark, d):
    done, x = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    o = table(spark, d, "orders").withColumn("violation", F.when(done & (x == 0), "zero_needs_value").when(~done & (x > 400000), "value_before_end"))
    return o.where("violation is not null").select("o_orderkey", "o_orderstatus", "violation")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45 AND l_quantity > 45")
def any_in_scope(spark, d):
    scope = table(spark, d, "part").where("p_size > 45")
    line = table(spark, d, "lineitem").where("l_quantity > 45")
    return line.join(scope, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")
