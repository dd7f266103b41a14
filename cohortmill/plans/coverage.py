"""Queries over fragments' coverage: depth counted once a fragment, sums over readsets, fragment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, fragments, intervals
from ..sources.shared import dealt, drop, stage
from .core import r6
from .registry import query
from .study import CLASSES
from .views import VIEWS, table, with_views

LENGTH, ENDS, QUALITY = 6000, 50, 20
# every base by itself: the records are <clip>S80M<gap>D15M
BASES = f"""sam AS (SELECT * FROM samq), {CLASSES},
 base AS (SELECT s.qname, s.rname, s.mate, s.pos + k + CASE WHEN k >= 80 THEN s.e3 ELSE 0 END AS p, substr(s.seq, CAST(s.clip + k + 1 AS INT), 1) AS letter, ascii(substr(s.qual, CAST(s.clip + k + 1 AS INT), 1)) - 33 AS q
  FROM o s JOIN c ON s.qname = c.qname AND c.outcome = 'assigned' AND s.prim, (SELECT unnest(range(95)) AS k) ks),
 px AS (SELECT DISTINCT qname, rname, p FROM base WHERE letter IN ('A', 'C', 'G', 'T') AND q >= {QUALITY} AND p >= {ENDS} AND p < {LENGTH - ENDS})"""


def references(spark, d):
    return table(spark, d, "events").select((F.floor(F.col("event_id") / 2) % 20).cast("string").alias("rname")).distinct().withColumn("length", F.lit(LENGTH).cast("long"))


def assigned(spark, d):
    """(records, whether a record passes, classes) of the alignment view with qualities. Programs are read once, by all tasks."""
    events = table(spark, d, "events")
    records = fragments.alignment(spark.sql(VIEWS["samq"], events=dealt(events, events.count())))
    records, ok = stage(records.withColumn("passes", fragments.passes(0.9, 0.9)), "records"), F.col("passes")
    return records, ok, fragments.outcomes(records, ok, mapq_min=10, report_k=10, insert_min=200, insert_max=600)


@query(with_views(f"""WITH {BASES}, dep AS (SELECT rname, p, count(*) AS depth FROM px GROUP BY 1, 2)
 SELECT rname, min(p) AS start0, max(p) + 1 AS end0, depth FROM (SELECT *, p - row_number() OVER (PARTITION BY rname, depth ORDER BY p) AS k FROM dep) GROUP BY rname, depth, k""", "samq"))
def fragment_depth(spark, d):
    records, _, classes = assigned(spark, d)
    out = coverage.fragment_depth(coverage.fragment_cover(records, classes, references(spark, d), QUALITY, ENDS))
    out._holds = (records,)
    return out


@query(with_views(f"""WITH {BASES}, n AS (SELECT qname, count(*) AS n FROM px GROUP BY 1),
 a AS (SELECT o.qname, string_agg(DISTINCT o.rname, ',' ORDER BY o.rname) AS t, count(DISTINCT o.rname) AS k FROM o JOIN c ON o.qname = c.qname AND c.outcome = 'ambiguous_or_reporting_saturated' WHERE o.ok AND o.flag & 4 = 0 GROUP BY 1)
 SELECT c.qname, c.outcome, CASE WHEN c.outcome = 'assigned' THEN c.rname END AS reference, c.n_records, coalesce(n.n, 0) AS n_covered, 'amb_' || left(sha256(a.t), 20) AS ambiguity_group, coalesce(a.k, 0) AS n_alternatives FROM c LEFT JOIN n ON n.qname = c.qname LEFT JOIN a ON a.qname = c.qname""".replace("concat('amb_', left(sha256(a.t), 20)) AS ambiguity_group_or_amb", "'amb_' || left(sha256(a.t), 20) AS ambiguity_group"), "samq"))
def fragment_positions(spark, d):
    records, ok, classes = assigned(spark, d)
    cover = coverage.fragment_cover(records, classes, references(spark, d), QUALITY, ENDS)
    out = coverage.fragment_table(records, ok, classes, cover)
    out._holds = (records,)
    return out


@query(with_views(f"""WITH {BASES}, dep AS (SELECT rname, p, count(*) AS depth FROM px GROUP BY 1, 2),
 r AS (SELECT DISTINCT CAST(CAST(floor(event_id / 2) AS BIGINT) % 20 AS VARCHAR) AS rname FROM events)
 SELECT r.rname, CAST({LENGTH} AS BIGINT) AS length, count(*) FILTER (WHERE depth >= 2) AS covered, round(count(*) FILTER (WHERE depth >= 2) * 1.0 / {LENGTH}, 6) AS breadth, round(coalesce(sum(depth), 0) * 1.0 / {LENGTH}, 6) AS mean_depth FROM r LEFT JOIN dep ON dep.rname = r.rname GROUP BY 1""", "samq"))
def readset_union(spark, d):
    """Four readsets are added one after the other, each to the sum of those before; breadth comes from the sum."""
    records, _, classes = assigned(spark, d)
    cover = stage(coverage.fragment_cover(records, classes, references(spark, d), QUALITY, ENDS), "cover")
    drop(records)
    total = None
    for readset in range(4):
        new = intervals.depth_events(cover.where(F.col("qname") % 4 == readset), ["rname"])
        before, total = total, stage(intervals.sum_events(*([new] if total is None else [total, new]), keys=["rname"]), "depth-sum")
        drop(before)
    drop(cover)
    out = coverage.breadth(intervals.segments_of(total, ["rname"]), references(spark, d), min_depth=2)
    out = out.select("rname", "length", "covered", r6(F.col("breadth"), "breadth"), r6(F.col("mean_depth"), "mean_depth"))
    out._holds = (total,)
    return out
