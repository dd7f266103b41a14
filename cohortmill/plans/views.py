"""Role views over the test tables: one SQL text for both engines, with {table} for the tables it reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "iv": """SELECT l_suppkey AS contig, l_orderkey * 10 + l_linenumber AS iv_id,
       (l_partkey * 37 + l_linenumber * 101) % 100000 AS start0,
       (l_partkey * 37 + l_linenumber * 101) % 100000 + CAST(l_quantity AS BIGINT) * 20 AS end0,
       CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand
FROM {lineitem}""",
    "loci": """SELECT p_partkey % 1000 AS contig, p_partkey AS locus_id, (p_partkey * 53) % 100000 AS start0,
       (p_partkey * 53) % 100000 + p_size * 40 AS end0,
       CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS caller
FROM {part}""",
    "meas": """SELECT o_custkey % 10 AS donor, CASE WHEN o_custkey % 10 < 5 THEN 'case' ELSE 'control' END AS grp,
       p_brand AS feature, SUM(l_quantity) AS value, COUNT(*) AS n_assigned,
       SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ambiguous, round(AVG(l_discount) * 10, 6) AS breadth
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
GROUP BY o_custkey % 10, CASE WHEN o_custkey % 10 < 5 THEN 'case' ELSE 'control' END, p_brand""",
    "aln": """SELECT CAST(floor(event_id / 2) AS BIGINT) AS qname, event_id % 2 + 1 AS mate, user_id % 20 AS ref,
       (event_id * 97) % 5000 AS pos, event_id % 50 AS mapq,
       CASE WHEN event_type = 'error' THEN 4 ELSE 0 END AS flag, value AS score
FROM {events}""",
    "sam": """SELECT q AS qname, mate, CASE WHEN sec = 1 THEN 256 ELSE 0 END + CASE WHEN q % 13 = 0 THEN 0 ELSE 2 END + CASE WHEN mate = 2 AND q % 11 <> 0 THEN 16 ELSE 0 END
       + CASE WHEN kind = 'error' AND sec = 0 AND e % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN e % 29 = 0 THEN 512 ELSE 0 END AS flag,
       CAST(q % 20 AS VARCHAR(9)) AS rname, (q * 97) % 5000 + (mate - 1) * (100 + q % 600) + CASE WHEN sec = 1 AND e % 14 <> 0 THEN 5 ELSE 0 END AS pos,
       CASE WHEN q % 23 = 0 THEN 255 ELSE 5 + e % 50 END AS mapq, concat(CAST(5 + e % 9 AS VARCHAR(9)), 'S80M', CAST(e % 3 + 1 AS VARCHAR(9)), 'D15M') AS cigar, '=' AS rnext,
       (q * 97) % 5000 + (2 - mate) * (100 + q % 600) + CASE WHEN q % 17 = 0 THEN 1 ELSE 0 END AS pnext, CASE WHEN mate = 1 THEN 1 ELSE -1 END * (150 + q % 600) AS tlen, e % 17 AS nm, '*' AS seq
FROM (SELECT CAST(floor(event_id / 2) AS BIGINT) AS q, event_id % 2 + 1 AS mate, event_id AS e, event_type AS kind, 0 AS sec FROM {events}
 UNION ALL SELECT CAST(floor(event_id / 2) AS BIGINT), event_id % 2 + 1, event_id, event_type, 1 FROM {events} WHERE event_id % 7 = 0) base""",
    "edge": """SELECT concat('o', CAST(o_orderkey AS VARCHAR(20))) AS a, concat('c', CAST(o_custkey AS VARCHAR(20))) AS b FROM {orders}""",
    "truth": """SELECT d.doc_id AS unit_id, d.lang AS profile, CASE WHEN b.quality IS NULL THEN 'unknown' ELSE CAST(b.quality AS VARCHAR(9)) END AS truth,
       CASE WHEN d.n_chars >= 600 THEN 'detected' WHEN d.n_chars < 60 THEN 'not_resolvable' ELSE 'not_detected' END AS detection_status
FROM {documents} d LEFT JOIN {labels} b ON d.doc_id = b.doc_id""",
    "gene": """SELECT l_orderkey AS contig, l_linenumber AS gene_order, l_orderkey * 10 + l_linenumber AS gene_id, p_brand AS family, p_type AS category
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "hit": """SELECT l_orderkey AS gene_id, l_partkey AS model_id, l_discount AS evalue, l_extendedprice AS score, l_tax AS dom_evalue, l_linenumber AS hit_no
FROM {lineitem}""",
    "measure": """SELECT p_partkey AS reference_id, CASE WHEN p_partkey % 11 = 0 THEN 'not_run' ELSE 'assessed' END AS measurement_status, CASE WHEN p_partkey % 22 = 0 THEN 'no_reads' ELSE '' END AS reason,
       CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size * 100 END AS assessable_length, CASE WHEN p_partkey % 7 = 0 THEN 'not_assessed' ELSE 'applicable' END AS mappability_status,
       CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey * 37 % 101 AS DOUBLE) / 100 END AS unique_mappability, CASE WHEN p_partkey % 5 = 0 THEN 'too_few' ELSE 'applicable' END AS informative_status, p_size * 20 AS informative_length,
       CASE WHEN p_partkey % 41 <> 0 THEN CAST(p_partkey * 53 % 101 AS DOUBLE) / 100 END AS breadth_full, CAST(p_partkey * 59 % 101 AS DOUBLE) / 100 AS breadth_assessable, CAST(p_partkey * 61 % 101 AS DOUBLE) / 100 AS breadth_informative,
       (p_partkey % 4) * (p_partkey % 9) AS assigned_fragment_count, CAST(p_partkey % 30 AS DOUBLE) / 10 AS mean_depth_full, CAST(p_partkey % 23 AS DOUBLE) / 10 AS mean_depth_informative, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 ELSE 0 END AS ambiguous_fragment_count
FROM {part}""",
    "cand": """SELECT p_partkey AS accession, p_brand AS unit_key, p_type AS stratum, p_size > 45 AS type_material, p_retailprice AS quality_rank, p_size AS contig_count
FROM {part}""",
}
READ = "CAST(100 + e % 9 AS INT)"
# the same records with their letters and qualities: a stretch of low quality, and an N in every ten letters
VIEWS["samq"] = VIEWS["sam"].replace("'*' AS seq", f"rpad('ACGTACGTAN', {READ}, 'ACGTACGTAN') AS seq, rpad(concat(repeat('I', CAST(30 + e % 40 AS INT)), repeat('#', CAST(e % 12 AS INT))), {READ}, 'I') AS qual")
LETTERS = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')"
SEQ = {"spark": f"SELECT doc_id, regexp_replace({LETTERS}, '[^acgt]', '') AS seq FROM {{documents}}", "sql": f"SELECT doc_id, regexp_replace({LETTERS}, '[^acgt]', '', 'g') AS seq FROM {{documents}}"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SEQ["spark"] if name == "seq" else VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def with_views(sql: str, *names: str) -> str:
    """The SQL with the views it needs in front; a leading WITH goes on after them."""
    parts = [f"{n} AS ({(SEQ['sql'] if n == 'seq' else VIEWS[n]).replace('{', '').replace('}', '')})" for n in names]
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + sql[15:]
    return "WITH " + ",\n".join(parts) + (",\n" + sql[5:] if sql.upper().startswith("WITH ") else "\n" + sql)
