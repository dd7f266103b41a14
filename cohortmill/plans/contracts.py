"""Queries over strict JSON, contract tables, paged responses and feature records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import contracts, gff
from ..sources.shared import dealt, stage
from .registry import query
from .views import table

JSON_CELL = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('{"k": 1, ', substring(props, 2)) WHEN 2 THEN concat('{"a": [', props, ', {"b": NaN}]}') WHEN 3 THEN concat('{"a": {"k": -Infinity, ', substring(props, 2), '}')
 WHEN 4 THEN concat(props, ' x') ELSE '[{"k": 1e999}, {"c": {"d": 1, "d": 2, "e": 3}}]' END"""


@query("""SELECT event_id, CASE event_id % 6 WHEN 1 THEN '$.k' WHEN 2 THEN '$.a[1].b' WHEN 3 THEN '$.a.k' WHEN 4 THEN '$' ELSE '$[0].k' END AS path, CASE event_id % 6 WHEN 1 THEN 'duplicate key' WHEN 4 THEN 'not json' ELSE 'not finite' END AS reason FROM events WHERE event_id % 6 <> 0
 UNION ALL SELECT event_id, CASE event_id % 6 WHEN 3 THEN '$.a.k' ELSE '$[1].c.d' END, 'duplicate key' FROM events WHERE event_id % 6 IN (3, 5)""")
def strict_json(spark, d):
    return contracts.strict_json(table(spark, d, "events").select("event_id", F.expr(JSON_CELL).alias("cell")), "event_id", "cell")


KINDS = {"id": "integer", "name": "string", "size": "integer", "price": "number", "kept": "boolean"}
HEADER = ["name", "id", "kept", "price", "size"]
LINE = """concat_ws('|', p_name, CASE WHEN p_partkey % 31 = 0 THEN '07' ELSE CAST(p_partkey AS {text}) END, CASE p_partkey % 7 WHEN 0 THEN 'True' WHEN 1 THEN '' WHEN 2 THEN 'false' ELSE 'true' END,
 CASE p_partkey % 11 WHEN 0 THEN 'NaN' WHEN 1 THEN '1e3' WHEN 2 THEN '+1.5' WHEN 3 THEN '.5' ELSE CAST(p_size AS {text}) END, CASE p_partkey % 13 WHEN 0 THEN '1.0' WHEN 1 THEN '' ELSE CAST(p_size AS {text}) END)"""
RAGGED = "CASE WHEN p_partkey % 37 = 0 THEN '|extra' ELSE '' END"
BAD = """r AS (SELECT p_partkey AS line, p_partkey % 37 = 0 AS ragged, p_partkey % 31 = 0 AS bad_id, p_partkey % 7 = 0 AS bad_kept, p_partkey % 11 IN (0, 2, 3) AS bad_price, p_partkey % 13 = 0 AS bad_size, p_partkey % 13 = 1 AS no_size, * FROM part)"""


def lines(spark, d):
    part = table(spark, d, "part")
    part = dealt(part, part.count())  # a small file is one task's, and cells cost more than reading them
    return part.select(F.col("p_partkey").alias("line"), F.expr(f"concat({LINE.format(text='STRING')}, {RAGGED})").alias("value"))


@query(f"""WITH {BAD} SELECT line, p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size, CASE p_partkey % 11 WHEN 1 THEN 1000.0 ELSE CAST(p_size AS DOUBLE) END AS price, CASE p_partkey % 7 WHEN 1 THEN NULL WHEN 2 THEN FALSE ELSE TRUE END AS kept
 FROM r WHERE NOT (ragged OR bad_id OR bad_kept OR bad_price OR bad_size OR no_size)""")
def contract_rows(spark, d):
    return contracts.contract_rows(lines(spark, d), HEADER, KINDS, required=["id", "size"], sep=r"\|")[0]


@query(f"""WITH {BAD} SELECT line, '' AS "column", 'ragged' AS reason FROM r WHERE ragged UNION ALL SELECT line, 'id', 'not integer' FROM r WHERE bad_id AND NOT ragged UNION ALL SELECT line, 'kept', 'not boolean' FROM r WHERE bad_kept AND NOT ragged
 UNION ALL SELECT line, 'price', 'not number' FROM r WHERE bad_price AND NOT ragged UNION ALL SELECT line, 'size', 'not integer' FROM r WHERE bad_size AND NOT ragged UNION ALL SELECT line, 'size', 'empty' FROM r WHERE no_size AND NOT ragged""")
def contract_rejects(spark, d):
    return contracts.contract_rows(lines(spark, d), HEADER, KINDS, required=["id", "size"], sep=r"\|")[1]


@query("""WITH e AS (SELECT *, CAST(floor(event_id / 40) AS BIGINT) AS page, event_id % 40 AS place, concat('A', CAST(user_id AS VARCHAR)) AS accession FROM events),
 l AS (SELECT accession, arg_max(event_id, page * 1000 + place) AS last, count(*) AS n_seen FROM e GROUP BY 1)
 SELECT l.accession, e.page, CAST(e.place AS INTEGER) AS place, e.event_type AS type, CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE CAST(e.props ->> '$.k' AS VARCHAR) END AS k, l.n_seen FROM l JOIN e ON e.event_id = l.last""")
def latest_reports(spark, d):
    """Pages of forty reports each, as a service would send them; the last report of an accession counts."""
    named = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    k = F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k"))
    report = F.struct(F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("accession"), F.array(named("Type", F.lit("old")), named("K", k), named("type", F.col("event_type"))).alias("attributes"))
    pages = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 40).alias("page")).agg(F.array_sort(F.collect_list(F.struct("event_id", report.alias("r")))).alias("rs"))
    pages = pages.select("page", F.to_json(F.struct(F.col("rs.r").alias("reports"))).alias("body"))
    found = contracts.latest_reports(pages, "page", "body", "accession string, attributes array<struct<name: string, value: string>>")
    of = contracts.attributes("report.attributes")
    return found.select("accession", "page", "place", of["type"].alias("type"), of["k"].alias("k"), "n_seen")


# An order is a gene, its lines' flags are transcripts, its lines parts of a coding sequence; some orders' genes are missing.
PARTS = """parts AS (SELECT *, concat('m', CAST(l_orderkey AS VARCHAR), l_returnflag) AS tx, concat('c', CAST(l_orderkey AS VARCHAR), l_returnflag) AS id, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
 l_linenumber * 1000 AS start0, l_linenumber * 1000 + CASE WHEN l_orderkey % 3 = 0 THEN 30 + 3 * (l_partkey % 20) WHEN l_orderkey % 17 = 0 THEN 1200 ELSE 30 + l_partkey % 50 END AS end0 FROM lineitem),
 cum AS (SELECT *, coalesce(sum(end0 - start0) OVER (PARTITION BY id ORDER BY CASE WHEN strand = '+' THEN start0 ELSE -start0 END, CASE WHEN strand = '+' THEN end0 ELSE -end0 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts),
 ph AS (SELECT *, CASE WHEN l_orderkey % 19 = 0 AND before > 0 THEN 1 WHEN l_orderkey % 23 = 0 AND before = 0 THEN 2 ELSE (3 - before % 3) % 3 END AS phase FROM cum)"""


def gff_lines(spark, d):
    """The same as text lines of nine fields, in no order."""
    sql = f"""WITH {PARTS.replace('VARCHAR', 'STRING')} SELECT concat_ws('\t', concat('s', CAST(l_orderkey % 50 AS STRING)), 'x', 'CDS', CAST(start0 + 1 AS STRING), CAST(end0 AS STRING), '.', strand, CAST(phase AS STRING), concat('ID=', id, ';Parent=', tx, ';Note=a%3Bb')) AS value FROM ph
     UNION ALL SELECT DISTINCT concat_ws('\t', concat('s', CAST(l_orderkey % 50 AS STRING)), 'x', 'mRNA', '1', '9999', '.', strand, '.', concat('ID=', tx, ';Parent=g', CAST(l_orderkey AS STRING))) FROM parts
     UNION ALL SELECT concat_ws('\t', concat('s', CAST(o_orderkey % 50 AS STRING)), 'x', 'gene', '1', '9999', '.', '+', '.', concat('ID=g', CAST(o_orderkey AS STRING))) FROM orders WHERE o_orderkey % 29 <> 0 UNION ALL SELECT '##gff-version 3'"""
    for t in ("lineitem", "orders"):
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return stage(spark.sql(sql, lineitem=table(spark, d, "lineitem"), orders=table(spark, d, "orders")), "gff")


@query(f"""WITH {PARTS}, g AS (SELECT id, min(tx) AS parent, min(strand) AS strand, min(start0) AS start0, max(end0) AS end0, count(*) AS n_parts, sum(end0 - start0) AS length, bool_or(before = 0 AND phase <> 0) AS partial, min(l_orderkey) AS o, array_to_string(list(concat(start0, '-', end0) ORDER BY CASE WHEN strand = '+' THEN start0 ELSE -start0 END, CASE WHEN strand = '+' THEN end0 ELSE -end0 END), ',') AS parts,
  bool_or(before > 0 AND (phase - CASE WHEN l_orderkey % 23 = 0 THEN (3 - (before - 2) % 3) % 3 ELSE (3 - before % 3) % 3 END) % 3 <> 0) AS odd FROM ph GROUP BY 1),
 ov AS (SELECT DISTINCT id FROM (SELECT id, start0 < max(end0) OVER (PARTITION BY id ORDER BY start0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM ph) WHERE x),
 kids AS (SELECT g.*, CASE WHEN ov.id IS NOT NULL THEN 'overlap' WHEN partial THEN 'partial' WHEN odd THEN 'phase' WHEN length % 3 <> 0 THEN 'length' ELSE '' END AS fault FROM g LEFT JOIN ov ON ov.id = g.id)
 SELECT id, concat('s', o % 50) AS seqid, strand, parent, start0, end0, n_parts, CAST(length AS BIGINT) AS length, parts, fault, CASE WHEN o % 29 = 0 THEN parent ELSE concat('g', o) END AS root, CAST(CASE WHEN o % 29 = 0 THEN 1 ELSE 2 END AS BIGINT) AS depth, CASE WHEN o % 29 = 0 THEN 'orphan' ELSE 'child' END AS status FROM kids""")
def gff_cds(spark, d):
    rows = stage(gff.records(gff_lines(spark, d)).select("type", "seqid", "start0", "end0", "strand", "phase", "id", "parents", "wrong"), "records")  # parsed once
    found, up = gff.coding_sequences(rows), gff.ancestors(rows)
    parts = F.array_join(F.transform("parts", lambda x: F.concat_ws("-", x["start0"].cast("string"), x["end0"].cast("string"))), ",")
    out = found.hint("shuffle_merge").join(up, "id")
    return out.select("id", "seqid", "strand", "parent", "start0", "end0", "n_parts", "length", parts.alias("parts"), "fault", "root", "depth", "status")
