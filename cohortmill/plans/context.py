"""Queries over a workflow's trace, element classes with their gate, and measurements in the context of linked taxa."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elements, evidence, execution
from ..sources.shared import dealt, observed, stage
from .core import r6
from .registry import query
from .views import table, view, with_views

STAGES = {"PREPARE": "prepare", "CALL_ALL": "call", "QUALITY": "quality", "NORMALIZE": "normalize"}
TRACE = """SELECT event_id AS task_id, concat('flow:', CASE event_type WHEN 'view' THEN 'PREPARE' WHEN 'click' THEN 'CALL_ALL' WHEN 'signup' THEN 'QUALITY' WHEN 'purchase' THEN 'NORMALIZE' ELSE 'report' END, ' (', user_id * 16 + event_id % 16, ')') AS name,
 CASE WHEN event_id % 17 = 0 THEN 'FAILED' WHEN event_id % 5 = 0 THEN 'cached' WHEN event_id % 7 = 0 THEN 'RUNNING' WHEN event_id % 53 <> 0 THEN 'COMPLETED' END AS status, CASE WHEN event_id % 19 = 0 THEN '137' WHEN event_id % 3 = 0 THEN '-' WHEN event_id % 11 <> 0 THEN '0' END AS "exit" FROM {events}"""
# written from the description of the operator: a task's row is met by its own text, not by the operator's expressions
TASKS_SQL = f"""t AS ({TRACE.replace("{events}", "events")}), k AS (SELECT task_id, upper(coalesce(status, 'unknown')) AS s, coalesce("exit", '') AS x, substr(name, 6, strpos(name, ' ') - 6) AS process, string_split(string_split(name, '(')[2], ')')[1] AS unit FROM t WHERE name NOT LIKE '%report%'),
 w AS (SELECT *, CASE WHEN s = 'FAILED' OR (s <> 'CACHED' AND x = '137') THEN 'failed' WHEN s = 'CACHED' THEN 'cached' WHEN s = 'COMPLETED' THEN 'completed' ELSE 'unfinished' END AS state FROM k)"""
LATEST = ", ".join(f"coalesce(arg_max(state, task_id) FILTER (WHERE process = '{p}'), 'not_run') AS {s}_status" for p, s in STAGES.items())


def _tasks(spark, d):
    return execution.tasks(spark.sql(TRACE.replace('"exit"', "exit"), events=table(spark, d, "events")), STAGES)


@query(f"""WITH {TASKS_SQL}, g AS (SELECT c_custkey AS u, any_value(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 END) AS n, count(w.unit) AS n_tasks, coalesce(string_agg(DISTINCT process, ';' ORDER BY process) FILTER (WHERE state = 'failed'), '') AS failed_tasks, {LATEST} FROM customer LEFT JOIN w ON w.unit = CAST(c_custkey AS VARCHAR) GROUP BY 1),
 p AS (SELECT *, CASE WHEN normalize_status IN ('completed', 'cached') THEN n END AS n_published FROM g)
 SELECT CAST(u AS VARCHAR) AS c_custkey, prepare_status, call_status, quality_status, normalize_status, failed_tasks, n_tasks, n_published, CASE WHEN n_tasks = 0 THEN 'not_run' WHEN failed_tasks <> '' THEN 'failed' WHEN quality_status NOT IN ('completed', 'cached') THEN 'incomplete' WHEN n_published = 0 THEN 'completed_zero' ELSE 'completed' END AS execution_status FROM p""")
def unit_states(spark, d):
    units = table(spark, d, "customer")
    published = units.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 3).alias("n"))
    return execution.unit_states(units, _tasks(spark, d), "c_custkey", STAGES, last="quality", counted="normalize", published=published)


@query(f"""WITH {TASKS_SQL} SELECT unit AS c_custkey, count(*) AS n_tasks FROM w WHERE CAST(unit AS BIGINT) NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def task_strangers(spark, d):
    return execution.strangers(table(spark, d, "customer"), _tasks(spark, d), "c_custkey")


ENDED = ("completed_with_hits", "completed_zero_hits")


@query(with_views("""WITH x AS (SELECT contig, gene_id, category, gene_order, family FROM gene WHERE gene_order <= 5), n AS (SELECT contig, count(DISTINCT gene_id) AS n_members, count(DISTINCT gene_id) FILTER (WHERE category = 'ECONOMY') AS n_head, count(DISTINCT gene_id) FILTER (WHERE category = 'PROMO') AS n_tail, count(DISTINCT gene_id) FILTER (WHERE category IN ('SMALL', 'MEDIUM')) AS n_int, count(DISTINCT gene_id) FILTER (WHERE family LIKE '%1') / count(DISTINCT gene_id) AS share FROM x GROUP BY 1),
 s AS (SELECT contig, max(o) AS o FROM (SELECT contig, gene_order % 2 AS sys, count(DISTINCT gene_id) FILTER (WHERE gene_order <= 5 AND category = 'STANDARD') / count(DISTINCT gene_id) AS o FROM gene GROUP BY 1, 2) GROUP BY 1),
 m AS (SELECT o_orderkey AS contig, coalesce(n_members, 0) AS n, coalesce(n_head, 0) AS h, coalesce(n_tail, 0) AS t, coalesce(n_int, 0) AS i, share, coalesce(s.o, 0.0) AS o, o_orderkey % 9 <> 0 AND o_orderkey % 11 <> 0 AS done FROM orders LEFT JOIN n ON n.contig = o_orderkey LEFT JOIN s ON s.contig = o_orderkey),
 p AS (SELECT *, CASE WHEN o >= 0.8 THEN 'mobile' WHEN o >= 0.5 AND n >= 3 THEN 'ambiguous' WHEN n < 4 AND i > 0 AND h > 0 AND t = 0 THEN 'satellite' WHEN share >= 0.5 AND h = 0 AND t = 0 THEN 'cluster' WHEN n >= 4 AND h = 0 AND t = 0 THEN 'incomplete' ELSE 'phage' END AS c FROM m)
 SELECT contig, n AS n_members, round(o, 6) AS best_overlap, c AS preliminary_class, CASE WHEN NOT done OR n = 0 THEN 'not_assessed' WHEN c = 'phage' AND (h = 0 OR t = 0) THEN 'unclassified' ELSE c END AS element_class, CASE WHEN NOT done OR n = 0 THEN 'incomplete;preliminary=' || c WHEN c = 'phage' AND (h = 0 OR t = 0) THEN 'no_positive_evidence'
 WHEN c IN ('mobile', 'ambiguous') THEN 'overlap' WHEN c = 'satellite' THEN 'short' WHEN c = 'cluster' THEN 'markers' WHEN c = 'incomplete' THEN 'no_structure' ELSE 'default' END AS evidence, CASE WHEN NOT done OR n = 0 THEN 'not_assessed' ELSE 'assessed' END AS classification_status FROM p""", "gene"))
def element_classes(spark, d):
    """Orders as elements, their first five lines as members; systems are the odd and the even lines, met by lines of one type."""
    gene, orders = stage(view(spark, d, "gene").withColumnRenamed("gene_id", "gene"), "genes", n="count(1)"), table(spark, d, "orders").withColumnRenamed("o_orderkey", "contig")
    gene = dealt(gene, observed(gene, "n"), "contig")
    inside = gene.where("gene_order <= 5")
    met = inside.select("contig", "gene", F.lit(True).alias("inside"), "category", F.col("family").endswith("1").alias("marker"))
    counts = elements.category_measures(orders, inside, "contig", "gene", "category", {"head": ["ECONOMY"], "tail": ["PROMO"], "int": ["SMALL", "MEDIUM"]})
    shares = evidence.member_counts(orders, met, "contig", "category", "marker").select("contig", "marker_share")
    systems = gene.select("contig", (F.col("gene_order") % 2).alias("system"), "gene")
    overlap = evidence.best_overlap(systems, met.where("category = 'STANDARD'"), "contig")
    state = orders.select("contig", F.when(F.col("contig") % 9 != 0, F.when(F.col("contig") % 2 == 0, ENDED[0]).otherwise(ENDED[1])).alias("families"), F.when(F.col("contig") % 11 == 0, "failed").otherwise(ENDED[0]).alias("markers"))
    rows = counts
    for more, how in ((shares, "inner"), (overlap, "left"), (state, "inner")):
        rows = rows.hint("shuffle_merge").join(more, "contig", how)
    rows = rows.na.fill(0.0, ["best_overlap"])
    n, head, tail, own, o = (F.col(x) for x in ("n_members", "head", "tail", "int", "best_overlap"))
    rules = [
        (o >= 0.8, "mobile", "overlap"), ((o >= 0.5) & (n >= 3), "ambiguous", "overlap"), ((n < 4) & (own > 0) & (head > 0) & (tail == 0), "satellite", "short"),
        ((F.col("marker_share") >= 0.5) & (head == 0) & (tail == 0), "cluster", "markers"), ((n >= 4) & (head == 0) & (tail == 0), "incomplete", "no_structure"),
    ]
    out = elements.classify(rows, rules, ("phage", "default"), n > 0, ["families", "markers"], ENDED, {"phage": (head > 0) & (tail > 0)})
    return out.select("contig", "n_members", r6(o, "best_overlap"), "preliminary_class", "element_class", "evidence", "classification_status")


LINKED = """l AS (SELECT *, count(*) OVER (PARTITION BY key) AS n_taxa FROM (SELECT DISTINCT l_suppkey AS key, p_type AS taxon FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40)), a AS (SELECT l_orderkey AS unit, lower(p_type) AS label, CASE WHEN l_orderkey % 13 <> 0 THEN sum(CASE WHEN l_linenumber > 1 THEN l_quantity ELSE 0 END) END AS abundance FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3 AND lower(p_type) NOT IN ('economy', 'small') GROUP BY 1, 2
 UNION ALL SELECT l_orderkey, x, sum(CASE WHEN lower(p_type) = x THEN l_quantity ELSE 0 END) FROM lineitem JOIN part ON l_partkey = p_partkey CROSS JOIN (SELECT unnest(['economy', 'small']) AS x) GROUP BY 1, 2),
 c AS (SELECT m.l_orderkey AS unit, m.l_linenumber AS line, l.key, l.taxon, m.l_returnflag = 'R' AS detected, l.n_taxa, CASE WHEN l.taxon <> 'PROMO' THEN lower(l.taxon) END AS label, a.abundance FROM lineitem m JOIN l ON l.key = m.l_suppkey LEFT JOIN a ON a.unit = m.l_orderkey AND a.label = lower(l.taxon) AND l.taxon <> 'PROMO')"""


PROFILED = ("economy", "small")


def _tables(spark, d):
    """Lines as measurements of suppliers in orders; types of large parts as linked taxa; quantities of an order's first lines as abundance."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    sold = line.hint("shuffle_merge").join(part, F.col("l_partkey") == F.col("p_partkey"))
    links = sold.select(F.col("l_suppkey").alias("key"), F.when(F.col("p_size") > 40, F.col("p_type")).alias("taxon"))
    labels = part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("taxon"), F.lower("p_type").alias("label"), F.lit("label_available").alias("resolution")).distinct()
    amount = F.when(F.col("unit") % 13 != 0, F.sum(F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(0)))
    abundance = sold.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("unit"), F.lower("p_type").alias("label")).agg(amount.alias("abundance")).where(~F.col("label").isin(*PROFILED))
    # two types have a number in every order, a zero where none was sold
    each = [F.sum(F.when(F.lower("p_type") == x, F.col("l_quantity")).otherwise(0)).alias(x) for x in PROFILED]
    profile = sold.groupBy(F.col("l_orderkey").alias("unit")).agg(*each).unpivot("unit", list(PROFILED), "label", "abundance")
    abundance = abundance.unionByName(profile)
    measured = line.select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("detected"))
    return measured, links, labels, abundance


@query(f"""WITH {LINKED} SELECT unit, line, key, taxon, n_taxa, label, round(CAST(abundance AS DOUBLE), 6) AS abundance, CASE WHEN label IS NULL THEN 'no_label' WHEN abundance IS NULL THEN 'unmeasured' ELSE 'measured' END AS context_status FROM c""")
def linked_context(spark, d):
    return evidence.linked_context(*_tables(spark, d), "unit", "key").select("unit", "line", "key", "taxon", "n_taxa", "label", r6(F.col("abundance").cast("double"), "abundance"), "context_status")


@query(f"""WITH {LINKED}, u AS (SELECT taxon, unit, max(abundance) AS abundance FROM c GROUP BY 1, 2), p AS (SELECT taxon, count(*) AS n_units, CASE WHEN bool_and(abundance IS NOT NULL) THEN count(*) FILTER (WHERE abundance > 0) END AS n_positive FROM u GROUP BY 1)
 SELECT p.taxon, count(DISTINCT key) AS n_keys, count(DISTINCT (unit, key)) FILTER (WHERE detected) AS n_detected, any_value(n_units) AS n_units, any_value(n_positive) AS n_positive FROM c JOIN p ON p.taxon = c.taxon GROUP BY 1""")
def context_summary(spark, d):
    return evidence.linked_summary(*_tables(spark, d), "unit", "key", F.col("detected"))
