"""Queries over detection profiles and the typed feature graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection, feature_graph
from ..sources.shared import stage
from .registry import query
from .views import table, view, with_views

PROFILES = [
    ("full", "breadth_full", 0.3, 2, 0.5, False, 0.0, None), ("strict", "breadth_assessable", 0.6, 5, 1.0, True, 0.4, None),
    ("informative", "breadth_informative", 0.4, 1, 0.6, False, 0.2, 400), ("plain", "breadth_full", 0.75, 1, 0.0, False, 0.0, None),
]
IN_SQL = ", ".join(f"('{i}', '{f}', {b}, {n}, {m}, {str(r).upper()}, {u}, {'NULL' if k is None else k})" for i, f, b, n, m, r, u, k in PROFILES)


@query(with_views(f"""WITH p(profile_id, field, b, n, m, need, u, k) AS (VALUES {IN_SQL}),
 x AS (SELECT *, coalesce(mappability_status = 'applicable' AND unique_mappability < u, FALSE) AS few, CASE field WHEN 'breadth_full' THEN breadth_full WHEN 'breadth_assessable' THEN breadth_assessable ELSE breadth_informative END AS breadth, CASE WHEN field = 'breadth_informative' THEN mean_depth_informative ELSE mean_depth_full END AS depth FROM measure CROSS JOIN p),
 y AS (SELECT *, CASE WHEN measurement_status <> 'assessed' OR assessable_length = 0 THEN 'a' WHEN need AND (few OR mappability_status <> 'applicable' OR unique_mappability IS NULL) THEN 'b' WHEN field = 'breadth_informative' AND NOT (informative_status = 'applicable' AND informative_length >= k) THEN 'c'
  WHEN coalesce(breadth >= b AND assigned_fragment_count >= n AND depth >= m, FALSE) THEN 'd' WHEN ambiguous_fragment_count > 0 AND assigned_fragment_count = 0 THEN 'e' WHEN ambiguous_fragment_count > 0 THEN 'f' ELSE 'g' END AS s FROM x),
 z AS (SELECT *, CASE s WHEN 'a' THEN CASE WHEN reason <> '' THEN reason ELSE 'zero_assessable_length' END WHEN 'b' THEN 'mappability_requirement' WHEN 'c' THEN 'informative_domain_or_length_requirement' WHEN 'd' THEN 'provisional_threshold_met' WHEN 'e' THEN 'ambiguous_only_not_detected_at_resolved_signal'
  WHEN 'f' THEN 'shared_signal_excluded_below_resolved_detection_threshold' ELSE 'provisional_threshold_not_met' END AS why FROM y)
 SELECT reference_id, profile_id, CASE s WHEN 'd' THEN 'detected' WHEN 'e' THEN 'not_resolvable' WHEN 'f' THEN 'not_detected_at_resolved_signal' WHEN 'g' THEN 'not_detected' ELSE 'unassessable' END AS detection_status, CASE s WHEN 'd' THEN 1 WHEN 'f' THEN 0 WHEN 'g' THEN 0 END AS value, why AS reason,
 CASE WHEN s IN ('d', 'g') AND NOT few THEN 'assessed' ELSE 'unknown' END AS inference_status, CASE WHEN few THEN 'insufficient_unique_mappability_for_b2' WHEN s IN ('d', 'g') THEN 'provisional_detection_profile' ELSE why END AS inference_reason FROM z""", "measure"))
def detection_profiles(spark, d):
    profiles = spark.createDataFrame(PROFILES, detection.PROFILE)
    return detection.detect(view(spark, d, "measure"), profiles, ["reference_id"])


@query("""WITH s(catalogue) AS (VALUES ('virome'), ('host_resolved'), ('combined')), o AS (SELECT l_partkey, l_returnflag = 'R' AND l_quantity > 48 AS virome, l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 40 AS host FROM lineitem)
 SELECT p_partkey, catalogue FROM part CROSS JOIN s WHERE EXISTS (SELECT 1 FROM o WHERE l_partkey = p_partkey AND CASE catalogue WHEN 'virome' THEN virome WHEN 'host_resolved' THEN host ELSE virome OR host END)""")
def catalogue_scopes(spark, d):
    line = table(spark, d, "lineitem")
    kind = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48), "virome").when(F.col("l_returnflag") == "A", "genome")
    seen = line.select(F.col("l_partkey").alias("p_partkey"), kind.alias("kind"), ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)).alias("resolved"))
    part = table(spark, d, "part").select("p_partkey")
    every = [detection.in_scope(part, seen, "p_partkey", detection.catalogue_scope(n, F.col("kind"), F.col("resolved"))).withColumn("catalogue", F.lit(n)) for n in ("virome", "host_resolved", "combined")]
    return every[0].unionByName(every[1]).unionByName(every[2])


GENOME = "concat('G', CAST(CAST(floor(({k} + CASE WHEN {k} % 50 = 1 THEN 2 ELSE 0 END) / 2) AS BIGINT) % 97 AS {text}))"
CAND, GENE = "concat('cand_', CAST({k} AS {text}))", "concat('gene_', CAST(l_orderkey AS {text}), '_', CAST(l_linenumber AS {text}), '_', CAST(l_partkey AS {text}))"
FEATURES = """f AS (SELECT {cand} AS feature_id, 'candidate' AS feature_unit, {genome} AS genome_id, CASE WHEN p_partkey % 43 <> 0 THEN 's1' END AS contig_id, CAST(p_size AS BIGINT) AS start0, CASE WHEN p_partkey % 47 <> 0 THEN CAST(p_size + 100 AS BIGINT) END AS end0, '+' AS strand, 'part' AS source FROM part
 UNION SELECT {gene}, 'gene', CASE WHEN l_orderkey % 1009 = 0 THEN 'G_other' ELSE {ggenome} END, 's1', CAST(l_linenumber AS BIGINT), CAST(l_linenumber + 9 AS BIGINT), CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END, 'lineitem' FROM lineitem
 UNION SELECT p_brand, 'votu', NULL, NULL, NULL, NULL, NULL, 'part' FROM part UNION SELECT concat('locus_', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS {text})), 'locus', NULL, NULL, NULL, NULL, NULL, 'part' FROM part WHERE CAST(floor(p_partkey / 2) AS BIGINT) % 61 <> 0)"""
LINKS = """l AS (SELECT p_brand AS parent, {cand} AS member, CASE WHEN p_partkey % 53 = 0 THEN 'made_up' ELSE 'votu_member' END AS relation FROM part UNION ALL SELECT {candl}, {gene}, CASE WHEN l_orderkey % 71 = 0 THEN 'system_gene' ELSE 'candidate_gene' END FROM lineitem
 UNION ALL SELECT concat('locus_', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS {text})), CASE WHEN p_partkey % 59 = 0 THEN 'cand_none' ELSE {cand} END, 'locus_candidate' FROM part)"""


def in_engine(sql: str, text: str) -> str:
    fill = {"cand": CAND.format(k="p_partkey", text=text), "candl": CAND.format(k="l_partkey", text=text), "gene": GENE.format(text=text), "genome": GENOME.format(k="p_partkey", text=text), "ggenome": GENOME.format(k="l_partkey", text=text), "text": text}
    return sql.format(**fill)


KINDS = "r(relation, pu, mu, physical) AS (VALUES ('votu_member', 'votu', 'candidate', FALSE), ('candidate_gene', 'candidate', 'gene', TRUE), ('system_gene', 'system', 'gene', TRUE), ('quant_group_member', 'quantification_group', 'votu', FALSE), ('locus_candidate', 'locus', 'candidate', TRUE))"


def built(spark, d, once=True):
    """(features, links) of the tables, by the operators; the SQL builds the same rows by itself."""
    part, line, c = table(spark, d, "part"), table(spark, d, "lineitem"), F.col
    cand = lambda k: F.concat(F.lit("cand_"), c(k).cast("string"))
    genome = lambda k: F.concat(F.lit("G"), (F.floor((c(k) + F.when(c(k) % 50 == 1, 2).otherwise(0)) / 2) % 97).cast("string"))
    gene = F.concat(F.lit("gene_"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey"))
    locus = F.concat(F.lit("locus_"), F.floor(c("p_partkey") / 2).cast("string"))
    feats = feature_graph.features(
        (part, "candidate", {"feature_id": cand("p_partkey"), "genome_id": genome("p_partkey"), "contig_id": F.when(c("p_partkey") % 43 != 0, "s1"), "start0": c("p_size"), "end0": F.when(c("p_partkey") % 47 != 0, c("p_size") + 100), "strand": F.lit("+"), "source": F.lit("part")}),
        (line, "gene", {"feature_id": gene, "genome_id": F.when(c("l_orderkey") % 1009 == 0, "G_other").otherwise(genome("l_partkey")), "contig_id": F.lit("s1"), "start0": c("l_linenumber"), "end0": c("l_linenumber") + 9, "strand": F.when(c("l_linestatus") == "O", "+").otherwise("-"), "source": F.lit("lineitem")}),
        (part, "votu", {"feature_id": c("p_brand"), "source": F.lit("part")}), (part.where("CAST(floor(p_partkey / 2) AS BIGINT) % 61 <> 0"), "locus", {"feature_id": locus, "source": F.lit("part")}), once=once)
    odd, other = c("p_partkey") % 53 == 0, c("l_orderkey") % 71 == 0
    rows = feature_graph.links(
        (part.where(~odd), "votu_member", c("p_brand"), cand("p_partkey")), (part.where(odd), "made_up", c("p_brand"), cand("p_partkey")), (line.where(~other), "candidate_gene", cand("l_partkey"), gene), (line.where(other), "system_gene", cand("l_partkey"), gene),
        (part, "locus_candidate", locus, F.when(c("p_partkey") % 59 == 0, "cand_none").otherwise(cand("p_partkey"))))
    return (stage(feats, "features") if once else feats), rows


@query(in_engine(f"WITH {FEATURES}", "VARCHAR") + """ SELECT feature_id, 'collision' AS fault FROM f GROUP BY 1 HAVING count(*) > 1 UNION SELECT feature_id, 'genome' FROM f WHERE genome_id = 'G_other'
 UNION SELECT feature_id, 'coordinates' FROM f WHERE start0 IS NOT NULL AND (end0 IS NULL OR contig_id IS NULL)""")
def feature_faults(spark, d):
    feats, _ = built(spark, d)
    genomes = feats.select("genome_id").where("genome_id <> 'G_other'")
    return feature_graph.feature_faults(feats, genomes)


@query(in_engine(f"WITH {FEATURES}, {LINKS}", "VARCHAR") + f""", {KINDS}, k AS (SELECT feature_id, min(feature_unit) AS unit, min(genome_id) AS genome FROM f GROUP BY 1),
 m AS (SELECT l.*, a.unit AS ua, b.unit AS ub, a.genome AS ga, b.genome AS gb, pu, mu, coalesce(physical, FALSE) AS physical FROM l LEFT JOIN k a ON a.feature_id = l.parent LEFT JOIN k b ON b.feature_id = l.member LEFT JOIN r ON r.relation = l.relation),
 t AS (SELECT *, coalesce(ga <> gb, FALSE) AS differ FROM m WHERE physical AND ua IS NOT NULL AND ub IS NOT NULL),
 top AS (SELECT member AS cand, parent AS root FROM t WHERE relation = 'locus_candidate'),
 home AS (SELECT t.*, CASE WHEN t.relation = 'locus_candidate' THEN t.parent ELSE coalesce(top.root, t.parent) END AS root FROM t LEFT JOIN top ON top.cand = t.parent),
 g AS (SELECT root, ga AS g FROM home UNION SELECT root, gb FROM home), mixed AS (SELECT root FROM g WHERE g IS NOT NULL GROUP BY 1 HAVING count(DISTINCT g) > 1)
 SELECT concat('link_', left(sha256('["' || parent || '","' || member || '","' || relation || '"]'), 24)) AS link_id, fault FROM (
 SELECT parent, member, relation, 'relation' AS fault FROM m WHERE pu IS NULL UNION SELECT parent, member, relation, 'parent' FROM m WHERE ua IS NULL UNION SELECT parent, member, relation, 'member' FROM m WHERE ub IS NULL
 UNION SELECT parent, member, relation, 'units' FROM m WHERE pu IS NOT NULL AND (ua <> pu OR ub <> mu) UNION SELECT parent, member, relation, 'genomes' FROM t WHERE differ
 UNION SELECT parent, member, relation, 'duplicate' FROM l GROUP BY ALL HAVING count(*) > 1 UNION SELECT parent, member, relation, 'chain' FROM home WHERE NOT differ AND root IN (SELECT root FROM mixed))""")
def link_faults(spark, d):
    feats, rows = built(spark, d, once=False)  # only the least unit and genome of an id are asked for
    return feature_graph.link_faults(feats, rows, spark.createDataFrame(feature_graph.RELATIONS, feature_graph.RELATION))


@query(with_views("""WITH o AS (SELECT CAST(donor AS VARCHAR) AS entity_id, feature AS feature_id, unnest(['value', 'n_assigned', 'breadth']) AS field, n_ambiguous FROM meas)
 SELECT concat('obs_', left(sha256('["v1","' || entity_id || '","' || feature_id || '","' || field || '"]'), 24)) AS observation_id, entity_id, feature_id, field, concat('proof_', left(sha256(concat('obs_', left(sha256('["v1","' || entity_id || '","' || feature_id || '","' || field || '"]'), 24)) || ':counts'), 24)) AS evidence_id,
 CASE WHEN field = 'value' THEN 'B' ELSE 'U' END AS level, CASE WHEN field = 'value' THEN 'accepted' ELSE 'pending' END AS review_state FROM o""", "meas"))
def observation_evidence(spark, d):
    m = view(spark, d, "meas")
    seen = stage(feature_graph.observations(m, F.col("donor").cast("string"), F.col("feature"), "v1", ["value", "n_assigned", "breadth"]), "observations")
    proof = feature_graph.evidence(seen, "counts", F.col("field") == "value")
    out = seen.select("observation_id", "entity_id", "feature_id", "field").hint("shuffle_merge").join(proof.drop("source"), "observation_id")
    out._holds = (seen,)
    return out
