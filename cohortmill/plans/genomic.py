"""Queries over intervals, orders, selections and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import kmers, intervals, ranking, shape
from .core import r6
from ..sources.shared import stage
from .registry import query
from .views import table, view, with_views

REL = """CASE WHEN {a}.start0 = {b}.start0 AND {a}.end0 = {b}.end0 THEN 'identical' WHEN ({a}.start0 <= {b}.start0 AND {a}.end0 >= {b}.end0) OR ({b}.start0 <= {a}.start0 AND {b}.end0 >= {a}.end0) THEN 'nested'
 WHEN {a}.start0 < {b}.end0 AND {b}.start0 < {a}.end0 THEN 'overlap' WHEN {a}.end0 = {b}.start0 OR {b}.end0 = {a}.start0 THEN 'adjacent' ELSE 'disjoint' END"""


@query(with_views("""SELECT l.contig, l.locus_id, i.iv_id, least(l.end0, i.end0) - greatest(l.start0, i.start0) AS overlap, i.start0 >= l.start0 AND i.end0 <= l.end0 AS inside
 FROM loci l JOIN iv i ON l.contig = i.contig AND l.start0 < i.end0 AND i.start0 < l.end0 AND l.end0 > l.start0 AND i.end0 > i.start0""", "iv", "loci"))
def interval_join(spark, d):
    met = intervals.overlap_join(view(spark, d, "loci"), view(spark, d, "iv"), ["contig"])
    inside = (F.col("r.start0") >= F.col("l.start0")) & (F.col("r.end0") <= F.col("l.end0"))
    return met.select("contig", F.col("l.locus_id").alias("locus_id"), F.col("r.iv_id").alias("iv_id"), "overlap", inside.alias("inside"))


@query(with_views("""SELECT l.locus_id, max(CASE WHEN i.start0 < l.start0 OR i.end0 > l.end0 THEN 1 ELSE 0 END) AS any_spanning, count(*) AS n_members,
 CASE WHEN max(CASE WHEN i.start0 < l.start0 OR i.end0 > l.end0 THEN 1 ELSE 0 END) = 0 THEN 'inside' WHEN min(CASE WHEN i.start0 < l.start0 OR i.end0 > l.end0 THEN 1 ELSE 0 END) = 1 THEN 'outside' ELSE 'spanning' END AS relation
 FROM loci l JOIN iv i ON l.contig = i.contig AND l.start0 < i.end0 AND i.start0 < l.end0 AND l.end0 > l.start0 AND i.end0 > i.start0 GROUP BY 1""", "iv", "loci"))
def group_relation(spark, d):
    met = intervals.overlap_join(view(spark, d, "loci"), view(spark, d, "iv"), ["contig"])
    out = F.when((F.col("r.start0") < F.col("l.start0")) | (F.col("r.end0") > F.col("l.end0")), 1).otherwise(0)
    g = met.groupBy(F.col("l.locus_id").alias("locus_id")).agg(F.max(out).alias("any_spanning"), F.min(out).alias("all_out"), F.count("*").alias("n_members"))
    label = F.when(F.col("any_spanning") == 0, "inside").when(F.col("all_out") == 1, "outside").otherwise("spanning")
    return g.select("locus_id", "any_spanning", "n_members", label.alias("relation"))


@query(with_views("""SELECT locus_id, iv_id, place FROM (SELECT l.locus_id, i.iv_id, i.start0, i.end0, row_number() OVER (PARTITION BY l.locus_id ORDER BY i.start0, i.end0, i.iv_id, i.strand) AS place
 FROM loci l JOIN iv i ON l.contig = i.contig AND l.start0 - 500 < i.end0 AND i.start0 < l.end0 + 500 AND l.end0 > l.start0 AND i.end0 > i.start0) WHERE place <= 20""", "iv", "loci"))
def neighborhood_topk(spark, d):
    met = intervals.overlap_join(view(spark, d, "loci"), view(spark, d, "iv"), ["contig"], slack=500)
    flat = met.select(F.col("l.locus_id").alias("locus_id"), "r.*")
    top = ranking.top_per_group(flat, ["locus_id"], [F.col("start0"), F.col("end0"), F.col("iv_id"), F.col("strand")], 20)
    return top.select("locus_id", "iv_id", F.col("rank").alias("place"))


@query(with_views(f"SELECT x.locus_id AS a, y.locus_id AS b, {REL.format(a='x', b='y')} AS relation FROM loci x JOIN loci y ON x.contig = y.contig AND x.locus_id < y.locus_id AND x.caller <> y.caller", "loci"))
def caller_pairs(spark, d):
    loci = view(spark, d, "loci")
    x, y = loci.alias("x"), loci.alias("y")
    both = x.hint("shuffle_merge").join(y, (F.col("x.contig") == F.col("y.contig")) & (F.col("x.locus_id") < F.col("y.locus_id")) & (F.col("x.caller") != F.col("y.caller")))
    rel = S.relation(F.col("x.start0"), F.col("x.end0"), F.col("y.start0"), F.col("y.end0"))
    return both.select(F.col("x.locus_id").alias("a"), F.col("y.locus_id").alias("b"), rel.alias("relation"))


@query(with_views(f"SELECT l.locus_id, i.iv_id, {REL.format(a='l', b='i')} AS relation FROM loci l JOIN iv i ON l.contig = i.contig AND l.start0 < i.end0 AND i.start0 < l.end0 AND l.end0 > l.start0 AND i.end0 > i.start0", "iv", "loci"))
def interval_relation(spark, d):
    met = intervals.overlap_join(view(spark, d, "loci"), view(spark, d, "iv"), ["contig"])
    rel = S.relation(F.col("l.start0"), F.col("l.end0"), F.col("r.start0"), F.col("r.end0"))
    return met.select(F.col("l.locus_id").alias("locus_id"), F.col("r.iv_id").alias("iv_id"), rel.alias("relation"))


UNION = """run AS (SELECT *, CASE WHEN start0 <= max(end0) OVER (PARTITION BY contig, strand ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv WHERE end0 > start0),
 isl AS (SELECT *, sum(fresh) OVER (PARTITION BY contig, strand ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM run),
 merged AS (SELECT contig, strand, min(start0) AS start0, max(end0) AS end0 FROM isl GROUP BY contig, strand, k)"""


@query(with_views(f"WITH {UNION} SELECT contig, strand, CAST(sum(end0 - start0) AS BIGINT) AS covered FROM merged GROUP BY 1, 2", "iv"))
def union_len(spark, d):
    return intervals.union_length(view(spark, d, "iv"), ["contig", "strand"])


DEPTH = """ev AS (SELECT contig, pos, sum(x) AS x FROM (SELECT contig, start0 AS pos, 1 AS x FROM iv WHERE end0 > start0 UNION ALL SELECT contig, end0, -1 FROM iv WHERE end0 > start0) GROUP BY 1, 2),
 seg AS (SELECT contig, pos AS start0, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS end0, sum(x) OVER (PARTITION BY contig ORDER BY pos) AS depth FROM ev),
 segs AS (SELECT * FROM seg WHERE depth > 0 AND end0 IS NOT NULL)"""


@query(with_views(f"WITH {DEPTH} SELECT contig, start0, end0, CAST(depth AS BIGINT) AS depth FROM segs", "iv"))
def depth_segments(spark, d):
    return intervals.depth_segments(view(spark, d, "iv"), ["contig"])


@query(with_views(f"""WITH {DEPTH}, s AS (SELECT l.locus_id, sum(least(l.end0, g.end0) - greatest(l.start0, g.start0)) AS c, sum((least(l.end0, g.end0) - greatest(l.start0, g.start0)) * g.depth) AS b
 FROM loci l JOIN segs g ON l.contig = g.contig AND l.start0 < g.end0 AND g.start0 < l.end0 AND l.end0 > l.start0 GROUP BY 1)
 SELECT l.locus_id, CAST(coalesce(c, 0) AS BIGINT) AS covered, round(coalesce(c, 0) * 1.0 / nullif(end0 - start0, 0), 6) AS breadth, round(coalesce(b, 0) * 1.0 / nullif(end0 - start0, 0), 6) AS mean_depth FROM loci l LEFT JOIN s ON l.locus_id = s.locus_id""", "iv", "loci"))
def breadth_in(spark, d):
    segs = intervals.depth_segments(view(spark, d, "iv"), ["contig"])
    out = intervals.breadth_in(segs, view(spark, d, "loci"), ["contig"], "locus_id")
    return out.select("locus_id", "covered", r6(F.col("breadth"), "breadth"), r6(F.col("mean_depth"), "mean_depth"))


@query(with_views(f"""WITH {DEPTH}, x AS (SELECT contig, unnest(range(start0 // 1000, (end0 - 1) // 1000 + 1)) AS bin, start0, end0, depth FROM segs)
 SELECT contig, bin, CAST(sum((least(end0, (bin + 1) * 1000) - greatest(start0, bin * 1000)) * depth) AS BIGINT) AS bases FROM x GROUP BY 1, 2""", "iv"))
def depth_bins(spark, d):
    return intervals.depth_bins(intervals.depth_segments(view(spark, d, "iv"), ["contig"]), ["contig"], 1000)


@query(with_views("SELECT iv_id, least(end0, start0) - 1 AS start0, greatest(end0, start0) AS end0 FROM iv", "iv"))
def coord_norm(spark, d):
    a, b = S.closed_to_half_open(F.col("end0"), F.col("start0"))
    return view(spark, d, "iv").select("iv_id", a.alias("start0"), b.alias("end0"))


@query(with_views("SELECT contig, gene_id, family, row_number() OVER (PARTITION BY contig ORDER BY gene_order, gene_id, family, category) AS order_index FROM gene", "gene"))
def order_index(spark, d):
    g = view(spark, d, "gene").select("contig", "gene_id", "family", "gene_order", "category")
    return ranking.order_index(g, ["contig"], [F.col(c) for c in ("gene_order", "gene_id", "family", "category")]).select("contig", "gene_id", "family", "order_index")


@query(with_views("""SELECT contig, gene_id, CAST(sum(fresh) OVER (PARTITION BY contig ORDER BY gene_order RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cluster FROM
 (SELECT *, CASE WHEN gene_order - lag(gene_order) OVER (PARTITION BY contig ORDER BY gene_order) <= 1 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT contig, gene_order, gene_id FROM gene WHERE category <> 'ECONOMY'))""", "gene"))
def gap_islands(spark, d):
    g = view(spark, d, "gene").where("category <> 'ECONOMY'").select("contig", "gene_order", "gene_id").distinct()
    return ranking.gap_clusters(g, ["contig"], "gene_order", 1).select("contig", "gene_id", "cluster")


@query(with_views("""SELECT contig, gene_id, family, CAST(sum(CASE WHEN category = 'PROMO' THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY gene_order RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)
 - CASE WHEN category = 'PROMO' THEN 1 ELSE 0 END AS BIGINT) AS neighbours FROM gene""", "gene"))
def neighbors5(spark, d):
    out = ranking.marked_neighbours(view(spark, d, "gene"), ["contig"], "gene_order", F.col("category") == "PROMO", 2)
    return out.select("contig", "gene_id", "family", F.col("neighbours").cast("long").alias("neighbours"))


@query(with_views("""SELECT gene_id, hit_no, model_id, row_number() OVER (PARTITION BY gene_id ORDER BY evalue, score DESC, dom_evalue, hit_no, model_id) = 1 AS is_best FROM hit""", "hit"))
def best_hit(spark, d):
    order = [F.asc("evalue"), F.desc("score"), F.asc("dom_evalue"), F.asc("hit_no"), F.asc("model_id")]
    return ranking.flag_best(view(spark, d, "hit"), ["gene_id"], order).select("gene_id", "hit_no", "model_id", "is_best")


@query(with_views("SELECT gene_id, model_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY score DESC, hit_no, model_id) AS rank FROM hit) WHERE rank <= 2", "hit"))
def topk_group(spark, d):
    return ranking.top_per_group(view(spark, d, "hit"), ["gene_id"], [F.desc("score"), F.asc("hit_no"), F.asc("model_id")], 2).select("gene_id", "model_id", "score", "rank")


@query(with_views("SELECT feature, n FROM (SELECT feature, sum(n_assigned) AS n FROM meas GROUP BY 1) ORDER BY n DESC, feature LIMIT 5", "meas"))
def topk_blind(spark, d):
    return view(spark, d, "meas").groupBy("feature").agg(F.sum("n_assigned").alias("n")).orderBy(F.desc("n"), "feature").limit(5)


@query(with_views("""SELECT unit_key, accession, stratum, pick FROM (SELECT *, row_number() OVER (PARTITION BY unit_key ORDER BY f, pass, stratum, quality_rank DESC, accession) AS pick FROM
 (SELECT *, CASE WHEN type_material THEN 0 ELSE 1 END AS f, row_number() OVER (PARTITION BY unit_key, CASE WHEN type_material THEN 0 ELSE 1 END, CASE WHEN type_material THEN NULL ELSE stratum END ORDER BY quality_rank DESC, accession) AS pass FROM cand)) WHERE pick <= 10""", "cand"))
def round_robin(spark, d):
    out = ranking.round_robin(view(spark, d, "cand"), ["unit_key"], "stratum", F.col("type_material"), [F.desc("quality_rank"), F.asc("accession")], 10)
    return out.select("unit_key", "accession", "stratum", "pick")


@query(with_views("SELECT accession, first_value(accession) OVER (PARTITION BY unit_key, stratum ORDER BY quality_rank DESC, contig_count, accession) AS best FROM cand", "cand"))
def best_member(spark, d):
    w = ranking.W.partitionBy("unit_key", "stratum").orderBy(F.desc("quality_rank"), "contig_count", "accession")
    return view(spark, d, "cand").select("accession", F.first("accession").over(w).alias("best"))


@query(with_views("""SELECT unit_key, accession, CASE WHEN contig_count > 30 THEN 'excluded' WHEN r = 1 THEN 'selected' ELSE 'reserve' END AS status FROM
 (SELECT *, row_number() OVER (PARTITION BY unit_key ORDER BY quality_rank DESC, accession) AS r FROM cand)""", "cand"))
def first_no_replace(spark, d):
    out = ranking.order_index(view(spark, d, "cand"), ["unit_key"], [F.desc("quality_rank"), F.asc("accession")], "r")
    return out.select("unit_key", "accession", F.when(F.col("contig_count") > 30, "excluded").when(F.col("r") == 1, "selected").otherwise("reserve").alias("status"))


@query(with_views("SELECT lang, max(n) AS n50 FROM (SELECT d.lang, length(s.seq) AS n, sum(length(s.seq)) OVER (PARTITION BY lang ORDER BY length(s.seq) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(length(s.seq)) OVER (PARTITION BY lang) AS t FROM seq s JOIN documents d ON s.doc_id = d.doc_id) WHERE 2 * c >= t GROUP BY 1", "seq"))
def n50(spark, d):
    x = view(spark, d, "seq").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.length("seq").alias("n"))
    return ranking.n50(x, ["lang"], "n")


@query(with_views("SELECT doc_id, md5(reverse(translate(seq, 'acgt', 'tgca'))) AS rc FROM seq", "seq"))
def revcomp(spark, d):
    return view(spark, d, "seq").select("doc_id", F.md5(S.reverse_complement("seq")).alias("rc"))


@query(with_views("SELECT doc_id, md5(least(seq, reverse(translate(seq, 'acgt', 'tgca')))) AS canonical, seq > reverse(translate(seq, 'acgt', 'tgca')) AS reversed FROM seq", "seq"))
def canonical_strand(spark, d):
    return view(spark, d, "seq").select("doc_id", F.md5(S.canonical("seq")).alias("canonical"), (F.col("seq") > S.reverse_complement("seq")).alias("reversed"))


@query(with_views("SELECT doc_id, concat('seq_', left(sha256(concat_ws('~', CAST(doc_id AS VARCHAR), seq)), 16)) AS id FROM seq", "seq"))
def hash_id(spark, d):
    return view(spark, d, "seq").select("doc_id", S.hash_id("seq_", "doc_id", "seq").alias("id"))


@query(with_views("SELECT doc_id, length(seq) AS n, length(seq) - length(replace(seq, 'g', '')) AS n_g, round((2 * length(seq) - length(replace(seq, 'g', '')) - length(replace(seq, 'c', ''))) * 1.0 / nullif(length(seq), 0), 6) AS gc FROM seq", "seq"))
def composition(spark, d):
    return view(spark, d, "seq").select("doc_id", F.length("seq").alias("n"), S.letters("seq", "g").alias("n_g"), r6(S.gc_fraction("seq"), "gc"))


@query(with_views("SELECT doc_id, round(list_sum(list_transform(['a', 'c', 'g', 't'], lambda x: CASE WHEN contains(seq, x) THEN -((length(seq) - length(replace(seq, x, ''))) * 1.0 / length(seq)) * log2((length(seq) - length(replace(seq, x, ''))) * 1.0 / length(seq)) WHEN length(seq) > 0 THEN 0.0 END)), 6) AS entropy FROM seq", "seq"))
def entropy(spark, d):
    return view(spark, d, "seq").select("doc_id", r6(S.entropy("seq"), "entropy"))


CODE = S.standard_code()


@query(with_views("SELECT doc_id, md5(coalesce(array_to_string(list_transform(range(0, CAST(floor(length(seq) / 3) AS BIGINT)), lambda i: map_extract(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CODE.items()) + "}, seq[3 * i + 1:3 * i + 3])[1]), ''), '')) AS protein FROM seq", "seq"))
def translate_cds(spark, d):
    return view(spark, d, "seq").select("doc_id", F.md5(S.translate_codons("seq", CODE)).alias("protein"))


@query(with_views("SELECT doc_id, seq_hash, row_number() OVER (PARTITION BY seq_hash ORDER BY doc_id) = 1 AS kept FROM (SELECT doc_id, md5(seq) AS seq_hash FROM seq)", "seq"))
def exact_dups(spark, d):
    x = view(spark, d, "seq").select("doc_id", F.md5("seq").alias("seq_hash"))
    return ranking.flag_first(x, "seq_hash", "doc_id", "kept")


@query(with_views("SELECT md5(least(seq, reverse(translate(seq, 'acgt', 'tgca')))) AS grp, count(*) AS n_members, array_to_string(list_sort(list(DISTINCT CAST(doc_id AS VARCHAR))), ';') AS members FROM seq GROUP BY 1", "seq"))
def equiv_groups(spark, d):
    x = view(spark, d, "seq").select(F.md5(S.canonical("seq")).alias("grp"), "doc_id")
    return shape.distinct_members(x, ["grp"], "doc_id")


@query(with_views("SELECT tile, count(*) AS n FROM (SELECT unnest(list_transform(range(0, length(seq) - 11, 12), lambda i: seq[i + 1:i + 12])) AS tile FROM seq WHERE length(seq) >= 12) GROUP BY 1", "seq"))
def tiles(spark, d):
    return view(spark, d, "seq").select(F.explode(S.kmers("seq", 12, 12)).alias("tile")).groupBy("tile").agg(F.count("*").alias("n"))


@query(with_views("""SELECT doc_id, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS unique_fraction FROM (SELECT doc_id, tile, count(*) OVER (PARTITION BY tile) AS n FROM
 (SELECT doc_id, least(t, reverse(translate(t, 'acgt', 'tgca'))) AS tile FROM (SELECT doc_id, unnest(list_transform(range(0, length(seq) - 11, 12), lambda i: seq[i + 1:i + 12])) AS t FROM seq WHERE length(seq) >= 12))) GROUP BY 1""", "seq"))
def tile_unique(spark, d):
    seq = stage(view(spark, d, "seq").where(F.length("seq") >= 12), "seq")  # else its expression is run for each tile
    packed = F.conv(F.translate(S.canonical("t"), "acgt", "0123"), 4, 10).cast("long")  # two bits a letter
    tiles = seq.select("doc_id", F.explode(S.kmers("seq", 12, 12)).alias("t")).select("doc_id", packed.alias("tile"))
    once = kmers.found_once(tiles, "doc_id", "tile")
    out = seq.select("doc_id", F.floor(F.length("seq") / 12).alias("n")).hint("shuffle_merge").join(once, "doc_id", "left")
    return out.select("doc_id", r6(F.coalesce("n_once", F.lit(0)) / F.col("n"), "unique_fraction"))
