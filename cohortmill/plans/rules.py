"""Queries over coding sequences, slices, cells with rules, declared families, merged occurrences and content digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import values as V
from ..operators import checks, shape, stats
from ..sources.shared import stage
from .core import r6
from .registry import query
from .views import table, view, with_views

CODE = S.standard_code()
IN_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CODE.items()) + "}"
CODONS = f"array_to_string(list_transform(range(0, CAST(length(s) // 3 AS BIGINT)), lambda i: map_extract({IN_SQL}, s[3 * i + 1:3 * i + 3])[1]), '')"


@query(with_views(f"""WITH c AS (SELECT doc_id, doc_id % 4 = 0 AS edge, substr(seq, 1, CASE WHEN doc_id % 5 = 0 THEN 61 ELSE 60 END) AS s FROM seq), p AS (SELECT *, coalesce({CODONS}, '') AS p FROM c), q AS (SELECT *, CASE WHEN edge OR p = '' THEN p ELSE 'M' || substr(p, 2) END AS r FROM p)
 SELECT doc_id, CASE WHEN length(s) = 0 THEN 'empty' WHEN length(s) % 3 <> 0 THEN 'length' WHEN contains(regexp_replace(p, '\\*$', ''), '*') THEN 'inner_stop' ELSE '' END AS fault, regexp_replace(r, '\\*$', '') AS protein FROM q""", "seq"))
def coding_check(spark, d):
    s = F.substring("seq", 1, 60), F.substring("seq", 1, 61)
    seqs = stage(view(spark, d, "seq").select("doc_id", F.when(F.col("doc_id") % 5 == 0, s[1]).otherwise(s[0]).alias("s")), "coding")
    return seqs.select("doc_id", S.coding_fault("s", CODE).alias("fault"), S.coding_protein("s", F.col("doc_id") % 4 == 0, CODE).alias("protein"))


@query("""WITH p AS (SELECT d.doc_id, d.text AS parent, CASE WHEN d.doc_id % 7 = 0 THEN b.text ELSE substr(d.text, CAST(1 + d.doc_id % 50 AS INT), CAST(d.doc_id % 13 AS INT)) END AS part FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40)
 SELECT doc_id, CASE WHEN part IS NULL OR parent IS NULL OR part = '' THEN 'unknown' WHEN instr(parent, part) = 0 THEN 'absent' WHEN instr(substr(parent, instr(parent, part) + 1), part) > 0 THEN 'ambiguous' ELSE 'unique' END AS status,
 CASE WHEN part <> '' AND instr(parent, part) > 0 AND instr(substr(parent, instr(parent, part) + 1), part) = 0 THEN instr(parent, part) - 1 END AS start0 FROM p""")
def locate_slice(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    met = docs.hint("shuffle_merge").join(items, F.col("doc_id") % 40 == F.col("item_id"), "left")
    part = F.when(F.col("doc_id") % 7 == 0, F.col("item")).otherwise(F.expr("substring(text, cast(1 + doc_id % 50 as int), cast(doc_id % 13 as int))"))
    start, status = S.locate_in("part", "text")
    return met.withColumn("part", part).select("doc_id", status.alias("status"), start.cast("long").alias("start0"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'keys' WHEN 1 THEN '' WHEN 2 THEN 'age' WHEN 3 THEN 'not an object' ELSE '' END AS fault,
 CASE event_id % 5 WHEN 0 THEN '{"age":"' || (props ->> '$.k') || '"}' WHEN 1 THEN '{"age":"' || (props ->> '$.k') || '","site":"' || event_type || '"}' WHEN 2 THEN '{"age":"old","site":"x"}' WHEN 4 THEN '{"age":"1.5","site":"y"}' END AS canonical FROM events""")
def covariate_cells(spark, d):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    cell = F.when(kind == 0, F.concat(F.lit('{"age": '), k, F.lit("}"))).when(kind == 1, F.concat(F.lit('{"site": "'), "event_type", F.lit('", "age": '), k, F.lit("}"))).when(kind == 2, '{"site": "x", "age": "old"}').when(kind == 3, "[1, 2]").otherwise('{"site": "y", "age": 1.5}')
    out = table(spark, d, "events").select("event_id", cell.alias("cell"))
    fault = V.covariate_fault("cell", {"age": "number", "site": "text"})
    return out.select("event_id", fault.alias("fault"), F.when(fault != "not an object", V.canonical_json(F.from_json("cell", "map<string, string>"))).alias("canonical"))


UNITS = """x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'not_assessed' ELSE 'assessed' END AS status, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 50 ELSE 2 END END AS value, CASE p_partkey % 5 WHEN 0 THEN 'count' WHEN 1 THEN 'fraction' WHEN 2 THEN 'binary' WHEN 3 THEN 'fraction' ELSE 'percent' END AS unit FROM {part})"""


@query(f"""WITH {UNITS.format(part='part')} SELECT p_partkey, f AS fault FROM (SELECT p_partkey, CASE WHEN value IS NOT NULL AND status <> 'assessed' THEN 'value_without_assessment' WHEN value IS NULL AND status = 'assessed' THEN 'assessed_without_value' WHEN value IS NULL THEN '' WHEN unit = 'binary' AND value NOT IN (0, 1) THEN 'not_binary'
 WHEN unit = 'count' AND value <> floor(value) THEN 'not_a_count' WHEN unit = 'fraction' AND NOT (value BETWEEN 0 AND 1) THEN 'not_a_fraction' WHEN unit = 'percent' THEN 'unknown_unit' ELSE '' END AS f FROM x) WHERE f <> ''""")
def value_violations(spark, d):
    x = spark.sql(f"WITH {UNITS} SELECT * FROM x", part=table(spark, d, "part"))
    return x.select("p_partkey", V.value_fault(F.col("status"), F.col("value"), F.col("unit")).alias("fault")).where("fault <> ''")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 BETWEEN 0 AND 1 AND l_tax * 10 BETWEEN 0 AND 1 AND l_discount * 10 - l_tax * 10 > 0.05 THEN 'virulent' WHEN l_discount * 10 BETWEEN 0 AND 1 AND l_tax * 10 BETWEEN 0 AND 1 AND l_tax * 10 - l_discount * 10 > 0.05 THEN 'temperate' ELSE 'unknown' END AS label,
 '{"family":"' || l_returnflag || '"' || CASE WHEN l_linenumber % 2 = 0 THEN ',"genus":"' || l_linestatus || '"' ELSE '' END || '}' AS taxonomy FROM lineitem""")
def lifestyle(spark, d):
    line = table(spark, d, "lineitem").withColumn("family_name", F.col("l_returnflag")).withColumn("genus_name", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")))
    label = V.better_label(F.col("l_discount") * 10, F.col("l_tax") * 10, "virulent", "temperate", margin=0.05)
    return line.select("l_orderkey", "l_linenumber", "l_partkey", label.alias("label"), V.packed(["family_name", "genus_name"], "_name").alias("taxonomy"))


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN NULL WHEN 2 THEN 'running' ELSE 'completed' END AS s, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN p_size END AS v FROM part)
 SELECT p_partkey, 'zero_without_completed_run' AS rule FROM x WHERE v = 0 AND coalesce(s, '') <> 'completed' UNION ALL SELECT p_partkey, 'value_without_completed_run' FROM x WHERE v <> 0 AND coalesce(s, '') <> 'completed' UNION ALL SELECT p_partkey, 'completed_without_value' FROM x WHERE v IS NULL AND s = 'completed' UNION ALL SELECT p_partkey, 'unknown_state' FROM x WHERE s = 'running'""")
def run_states(spark, d):
    kind = F.col("p_partkey") % 5
    status = F.when(kind == 0, "failed").when(kind == 2, "running").when(kind > 2, "completed")
    value = F.when(F.col("p_partkey") % 3 == 0, 0).when(F.col("p_partkey") % 3 == 1, F.col("p_size"))
    return checks.run_states(table(spark, d, "part").select("p_partkey", status.alias("status"), value.alias("value")), "p_partkey", "status", "value")


@query("""WITH w AS (SELECT DISTINCT p_brand AS family, p_partkey AS id FROM part), r AS (SELECT p_brand AS family, p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN (p_partkey % 101 + 1) / 102.0 END AS p FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_brand, p_partkey + 100000000, 0.5 FROM part WHERE p_brand LIKE '%1' AND p_partkey % 3 = 0),
 odd AS (SELECT DISTINCT family FROM r WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.family = r.family AND w.id = r.id)), m AS (SELECT w.family, w.id, coalesce(r.p, 1.0) AS p, r.p IS NULL AS failed FROM w LEFT JOIN r ON r.family = w.family AND r.id = w.id),
 k AS (SELECT *, count(*) OVER (PARTITION BY family) AS n, count(*) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM m), q AS (SELECT *, least(1.0, min(p * n / c) OVER (PARTITION BY family ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k)
 SELECT family, id, round(p, 6) AS p, CASE WHEN failed THEN 'failed' ELSE 'tested' END AS status, CASE WHEN family NOT IN (SELECT family FROM odd) THEN round(q, 6) END AS q, CASE WHEN family IN (SELECT family FROM odd) THEN 'not_declared' ELSE 'complete' END AS family_status FROM q""")
def family_tests(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_brand", "family").withColumn("id", F.col("p_partkey"))
    got = part.where("p_partkey % 7 <> 0").select("family", "id", F.when(F.col("p_size") % 5 != 0, (F.col("p_partkey") % 101 + 1) / 102.0).alias("p"))
    more = part.where("family like '%1' and p_partkey % 3 = 0").select("family", (F.col("id") + 100000000).alias("id"), F.lit(0.5).alias("p"))
    out = stats.family_tests(part, got.unionByName(more), ["family"], "id")
    return out.select("family", "id", r6(F.col("p"), "p"), "status", r6(F.col("q"), "q"), "family_status")


@query("""SELECT l_partkey, CASE WHEN count(*) = count(t) THEN min(t) END AS least_tax, CASE WHEN count(*) = count(q) THEN max(q) END AS most_quantity, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'conflict' ELSE max(l_linestatus) END AS l_linestatus, count(*) AS n_occurrences
 FROM (SELECT *, CASE WHEN l_orderkey % 97 <> 0 THEN l_tax END AS t, CASE WHEN l_orderkey % 89 <> 0 THEN l_quantity END AS q FROM lineitem) GROUP BY 1""")
def merged_occurrences(spark, d):
    line = table(spark, d, "lineitem").withColumn("least_tax", F.when(F.col("l_orderkey") % 97 != 0, F.col("l_tax"))).withColumn("most_quantity", F.when(F.col("l_orderkey") % 89 != 0, F.col("l_quantity")))
    return shape.merge_occurrences(line, "l_partkey", least=["least_tax"], most=["most_quantity"], single=["l_linestatus"])


@query("""WITH u AS (SELECT CAST(l_partkey AS VARCHAR) AS key, concat('supplier:', l_suppkey) AS f, 'lines' AS s FROM lineitem UNION SELECT CAST(p_partkey AS VARCHAR), concat('type:', p_type), 'parts' FROM part UNION SELECT CAST(l_partkey AS VARCHAR), concat(CASE WHEN o_orderpriority = '1-URGENT' THEN 'supplier' ELSE 'order' END, ':', o_orderpriority), 'orders' FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT key, string_split(f, ':')[1] AS category, count(DISTINCT f) AS n_features, array_to_string(list_sort(list(DISTINCT s)), ';') AS sources FROM u GROUP BY 1, 2""")
def evidence_counts(spark, d):
    line, part, orders = (table(spark, d, t) for t in ("lineitem", "part", "orders"))
    both = line.hint("shuffle_merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "supplier").otherwise("order"), F.lit(":"), "o_orderpriority")
    return shape.evidence_counts({"lines": (line, F.col("l_partkey"), F.concat(F.lit("supplier:"), "l_suppkey")), "parts": (part, F.col("p_partkey"), F.concat(F.lit("type:"), "p_type")), "orders": (both, F.col("l_partkey"), name)})


@query("""WITH r AS (SELECT md5(concat('v', CAST(l_linenumber AS VARCHAR), chr(31), 'v', l_linestatus, chr(31), 'v', CAST(l_orderkey AS VARCHAR), chr(31), 'v', CAST(l_partkey AS VARCHAR), chr(31), 'v', l_returnflag, chr(31), CASE WHEN l_suppkey % 9 = 0 THEN 'n' ELSE concat('v', CAST(l_suppkey AS VARCHAR)) END)) AS h FROM lineitem)
 SELECT count(*) AS n_rows, CAST(sum(CAST(concat('0x', left(h, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM r""")
def content_digest(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey")).alias("l_suppkey"), "l_linenumber", "l_returnflag", "l_linestatus")
    return checks.content_digest(line)


@query("""WITH x AS (SELECT event_id, event_id % 90 AS m, event_id % 60 AS s, event_id % 4 AS kind, event_id % 1000 AS mb FROM events)
 SELECT event_id, CASE kind WHEN 0 THEN m * 60000 + s * 1000 WHEN 1 THEN s * 1000 + 500 WHEN 2 THEN mb END AS duration_ms, CASE kind WHEN 0 THEN mb * 1048576 WHEN 1 THEN CAST((mb + 0.5) * 1073741824 AS BIGINT) WHEN 2 THEN mb END AS size_bytes FROM x""")
def trace_units(spark, d):
    """Trace cells as run records write them: durations of several parts, sizes with units, and cells that are none."""
    sql = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(event_id % 90, 'm ', event_id % 60, 's') WHEN 1 THEN concat(event_id % 60, '.5s') WHEN 2 THEN concat(event_id % 1000, 'ms') ELSE '-' END AS realtime,
     CASE event_id % 4 WHEN 0 THEN concat(event_id % 1000, ' MB') WHEN 1 THEN concat(event_id % 1000, '.5 GB') WHEN 2 THEN concat(event_id % 1000, ' B') ELSE '5 parsecs' END AS peak FROM {events}"""
    cells = spark.sql(sql, events=table(spark, d, "events"))
    return cells.select("event_id", V.milliseconds("realtime").alias("duration_ms"), V.bytes_of("peak").alias("size_bytes"))
