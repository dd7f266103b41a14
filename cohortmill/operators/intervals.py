"""Interval operators on half-open coordinates (start0, end0) within keys such as (genome, contig)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.shared import stage


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int = 4096, slack: int = 0) -> DataFrame:
    """Pairs of overlapping intervals with equal keys, as structs ``l`` and ``r`` and the overlap length.

    Each interval is copied to the bins it touches and the bins are joined; a pair that shares several bins comes out
    in the first of them only, so no distinct is needed. ``slack`` widens the left side. Empty intervals overlap nothing.
    """
    keys = list(keys)

    def binned(df: DataFrame, name: str, by: int) -> DataFrame:
        first = F.floor((F.col("start0") - by) / width)
        df = df.where("end0 > start0").select(*keys, F.struct(*df.columns).alias(name), first.alias(f"{name}_bin"), F.explode(F.sequence(first, F.floor((F.col("end0") + by - 1) / width))).alias("_bin"))
        return df

    a, b = binned(left, "l", slack), binned(right, "r", 0)
    met = a.hint("shuffle_merge").join(b, [*keys, "_bin"])
    met = met.where((F.col("_bin") == F.greatest("l_bin", "r_bin")) & (F.col("l.start0") - slack < F.col("r.end0")) & (F.col("r.start0") < F.col("l.end0") + slack))
    common = F.greatest(F.lit(0), F.least("l.end0", "r.end0") - F.greatest("l.start0", "r.start0"))
    return met.select(*keys, "l", "r", common.alias("overlap"))


def merged(df: DataFrame, keys: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """Maximal runs of overlapping or touching intervals: keys, start0, end0.

    In two levels, so that a long reference is no single task: of intervals with one start the longest counts (summed before
    the shuffle), so a window holds at most ``block`` rows however deep a block is; intervals of a block are merged to runs,
    and then only runs are stitched over blocks.
    """
    keys = list(keys)
    tops = df.where("end0 > start0").groupBy(*keys, "start0").agg(F.max("end0").alias("end0")).withColumn("_block", F.floor(F.col("start0") / block))

    def runs(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        inside = W.partitionBy(*by).orderBy("start0")
        new = F.when(F.col("start0") <= F.max("end0").over(inside.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1)
        rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        return rows.groupBy(*by, "_run").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"))

    inner = runs(tops, [*keys, "_block"])
    over = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = inner.groupBy(*keys, "_block").agg(F.max("end0").alias("_top")).select(*keys, "_block", F.max("_top").over(over).alias("_reach"))
    inner = inner.hint("shuffle_merge").join(blocks, [*keys, "_block"])  # runs, of which a block has few beside its rows
    # a run that an earlier block reaches goes on with the last run before it
    inner = inner.withColumn("_new", F.when(F.col("start0") <= F.col("_reach"), 0).otherwise(1))
    count = inner.groupBy(*keys, "_block").agg(F.sum("_new").alias("_n")).select(*keys, "_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_at"))
    at = F.sum("_new").over(W.partitionBy(*keys, "_block").orderBy("start0").rowsBetween(W.unboundedPreceding, 0))
    inner = inner.withColumn("_in", at).hint("shuffle_merge").join(count, [*keys, "_block"])
    return inner.groupBy(*keys, (F.col("_at") + F.col("_in")).alias("_run")).agg(F.min("start0").alias("start0"), F.max("end0").alias("end0")).drop("_run")


def union_length(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bases covered at least once, per key."""
    return merged(df, keys).groupBy(*keys).agg(F.sum(F.col("end0") - F.col("start0")).alias("covered"))


def depth_events(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Depth as a step function: keys, pos, d, by how much depth changes at each position where an interval begins or ends.
    Step functions add up: the events of several tables are the sum of theirs (``sum_events``)."""
    keys = list(keys)
    events = df.where("end0 > start0").select(*keys, F.explode(F.array(F.struct(F.col("start0").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end0").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    return events.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))


def sum_events(first: DataFrame, *more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sum of step functions, without the positions at which it does not change."""
    for x in more:
        first = first.unionByName(x)
    return first.groupBy(*keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0")


def segments_of(events: DataFrame, keys: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """Runs of positive depth between events: keys, start0, end0, depth.

    Prefix sums go in two levels, within blocks of the reference and then over block totals, so that a long reference is no
    single task.
    """
    keys = list(keys)
    events = events.withColumn("_block", F.floor(F.col("pos") / block))
    totals = events.groupBy(*keys, "_block").agg(F.sum("d").alias("t"), F.min("pos").alias("first"))
    over = W.partitionBy(*keys).orderBy("_block")
    carried = totals.select(*keys, "_block", (F.sum("t").over(over) - F.col("t")).alias("carried"), F.lead("first").over(over).alias("following"))
    inside = W.partitionBy(*keys, "_block").orderBy("pos")
    events = events.withColumn("s", F.sum("d").over(inside)).withColumn("following_in", F.lead("pos").over(inside))
    out = events.hint("shuffle_merge").join(carried, [*keys, "_block"])
    out = out.select(*keys, F.col("pos").alias("start0"), F.coalesce("following_in", "following").alias("end0"), (F.col("s") + F.col("carried")).alias("depth"))
    return out.where("depth > 0 and end0 is not null")


def depth_segments(df: DataFrame, keys: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """Runs of equal positive depth: keys, start0, end0, depth. Starts and ends are summed to one event per position."""
    return segments_of(depth_events(df, keys), keys, block)


def breadth_in(segments: DataFrame, loci: DataFrame, keys: Sequence[str], locus: str) -> DataFrame:
    """Covered bases, breadth and mean depth of each locus; loci without coverage get zeros."""
    met = overlap_join(loci, segments, keys)
    sums = met.groupBy(F.col(f"l.{locus}").alias(locus)).agg(F.sum("overlap").alias("covered"), F.sum(F.col("overlap") * F.col("r.depth")).alias("bases"))
    out = loci.hint("shuffle_merge").join(sums, locus, "left")
    size = F.nullif(F.col("end0") - F.col("start0"), F.lit(0))
    covered, bases = F.coalesce("covered", F.lit(0)), F.coalesce("bases", F.lit(0))
    return out.select(locus, covered.alias("covered"), (covered / size).alias("breadth"), (bases / size).alias("mean_depth"))


def depth_bins(segments: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Bases (depth times length) in bins of fixed width; bins without coverage are left out."""
    b = segments.select(*keys, "start0", "end0", "depth", F.explode(F.sequence(F.floor(F.col("start0") / width), F.floor((F.col("end0") - 1) / width))).alias("bin"))
    part = F.least("end0", (F.col("bin") + 1) * width) - F.greatest("start0", F.col("bin") * width)
    return b.groupBy(*keys, "bin").agg(F.sum(part * F.col("depth")).alias("bases"))


def lift(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children inside a parent, in the parent's own coordinates and strand: structs ``l`` (parent) and ``r`` (child), start, stop, strand."""
    met = overlap_join(parents, children, keys).where("r.start0 >= l.start0 and r.end0 <= l.end0")
    plus = F.col("l.strand") == "+"
    start = F.when(plus, F.col("r.start0") - F.col("l.start0")).otherwise(F.col("l.end0") - F.col("r.end0"))
    strand = F.when(F.col("l.strand") == F.col("r.strand"), "+").otherwise("-")
    return met.select("l", "r", start.alias("start"), (start + F.col("r.end0") - F.col("r.start0")).alias("stop"), strand.alias("strand"))


def depth_statistics(segments: DataFrame, loci: DataFrame, keys: Sequence[str], locus: str) -> DataFrame:
    """Mean and population standard deviation of depth over each locus, uncovered bases counted as 0."""
    met = overlap_join(loci, segments, keys)
    part, depth = F.col("overlap"), F.col("r.depth")
    sums = met.groupBy(F.col(f"l.{locus}").alias(locus)).agg(F.sum(part * depth).alias("s"), F.sum(part * depth * depth).alias("s2"))
    out = loci.where("end0 > start0").hint("shuffle_merge").join(sums, locus, "left")
    n = (F.col("end0") - F.col("start0")).cast("double")
    mean = F.coalesce("s", F.lit(0)) / n
    return out.select(locus, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.coalesce("s2", F.lit(0)) / n - mean * mean)).alias("sd"))


def gaps(df: DataFrame, contigs: DataFrame, keys: Sequence[str], length: str = "length", ends: int = 0) -> DataFrame:
    """What the intervals leave free of each contig (keys, length), its ``ends`` left out too: keys, start0, end0."""
    keys = list(keys)
    size = contigs.select(*keys, F.col(length).cast("long").alias("_n"))
    outer = size.select(*keys, F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("start0"), F.lit(ends).cast("long").alias("end0")), F.struct((F.col("_n") - ends).alias("start0"), (F.col("_n") + 1).alias("end0")))).alias("e")).select(*keys, "e.*")
    inner = df.where("end0 > start0").hint("shuffle_merge").join(size, keys, "left_semi").select(*keys, F.col("start0").cast("long").alias("start0"), F.col("end0").cast("long").alias("end0"))
    full = merged(inner.unionByName(outer), keys)
    after = F.lead("start0").over(W.partitionBy(*keys).orderBy("start0"))
    return full.select(*keys, F.col("end0").alias("start0"), after.alias("end0")).where("end0 > start0")


def depth_profile(segments: DataFrame, regions: DataFrame, keys: Sequence[str], region: str | Sequence[str]) -> DataFrame:
    """bp, mean, median, sd (population) and breadth of depth per ``region``, which may have several disjoint intervals.

    ``region``: one column or several. Bases without a segment have depth 0. Pieces are summed per depth first, so the median is
    weighted by bases and only distinct depths meet in one row. Segments and regions are read once.
    """
    names = [region] if isinstance(region, str) else list(region)
    regions = regions.where("end0 > start0").select(*dict.fromkeys([*keys, *names, "start0", "end0"]))
    zero = F.lit(0).cast("long")
    # every base counts at depth 0 until a segment takes it away
    taken = F.explode(F.array(F.struct(F.col("r.depth").cast("long").alias("depth"), F.col("overlap").cast("long").alias("n")), F.struct(zero.alias("depth"), (-F.col("overlap").cast("long")).alias("n"))))
    met = overlap_join(regions, segments, keys).select(*(F.col(f"l.{c}").alias(c) for c in names), taken.alias("_t")).select(*names, "_t.*")
    bare = regions.select(*names, zero.alias("depth"), (F.col("end0") - F.col("start0")).cast("long").alias("n"))
    full = met.unionByName(bare).groupBy(*names, "depth").agg(F.sum("n").alias("n")).where("n > 0")
    d = F.col("depth").cast("double")
    g = full.groupBy(*names).agg(F.sum("n").alias("bp"), F.sum(d * F.col("n")).alias("s"), F.sum(d * d * F.col("n")).alias("s2"), F.percentile("depth", 0.5, F.col("n")).alias("median"), F.sum(F.when(d >= 1, F.col("n")).otherwise(0)).alias("b"))
    mean = F.col("s") / F.col("bp")
    return g.select(*names, "bp", mean.alias("mean"), "median", F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("bp") - mean * mean)).alias("sd"), (F.col("b") / F.col("bp")).alias("breadth"))


def elevation(segments: DataFrame, strict: DataFrame, loci: DataFrame, contigs: DataFrame, keys: Sequence[str], locus: str, ends: int = 150, least: int = 1000, beside: int = 5000, ratio: float = 2.0, effect: float = 0.7) -> DataFrame:
    """Whether each locus is deeper than the rest of its contig: locus, status, reasons, call, ratio, effect, local_ratio, agrees.

    The rest is the contig without all loci and without its ends. Evaluable: locus and rest of at least ``least`` bases, both
    with mean depth 1 and breadth 0.5. raised: ratio and Cohen's d reach their limits. agrees: stricter alignments
    (``strict`` segments) give the same call and the rest within ``beside`` bases the same side of ``ratio``; null where
    either cannot be told. ``keys`` is one contig column.
    """
    key = keys[0]
    contigs = contigs.hint("shuffle_merge").join(loci.select(*keys).distinct(), list(keys), "left_semi")  # others have no locus to hold against
    inside = loci.hint("shuffle_merge").join(contigs.select(*keys, F.col("length").alias("_n")), list(keys))
    inside = inside.select(*keys, locus, F.greatest("start0", F.lit(ends)).alias("start0"), F.least(F.col("end0"), F.col("_n") - ends).alias("end0"), (F.col("end0") - F.col("start0")).alias("_bp"))
    free = gaps(loci, contigs, keys, ends=ends)
    near = overlap_join(inside.select(*keys, locus, "start0", "end0"), free, keys, slack=beside)
    near = near.select(*keys, F.col(f"l.{locus}").alias(locus), F.greatest(F.col("r.start0"), F.col("l.start0") - beside).alias("start0"), F.least(F.col("r.end0"), F.col("l.end0") + beside).alias("end0"))
    # all kinds of regions of one set of segments meet them together: of a locus, of its contig's rest, of what is beside it
    none, whole = F.lit(None).cast(dict(loci.dtypes)[locus]), F.lit(None).cast(dict(contigs.dtypes)[key])
    kind = lambda df, name, at, of: df.select(*keys, F.lit(name).alias("_kind"), at.alias("_locus"), of.alias("_contig"), F.col("start0").cast("long").alias("start0"), F.col("end0").cast("long").alias("end0"))
    both = kind(inside, "p", F.col(locus), whole).unionByName(kind(free, "h", none, F.col(key)))
    each = both.unionByName(kind(near, "l", F.col(locus), whole))
    of = ["_kind", "_locus", "_contig"]
    plain, narrow = (stage(depth_profile(s, r, keys, of), "profile") for s, r in ((segments, each), (strict, both)))
    out = inside.select(*keys, locus, "_bp")
    for name, profile, sort, id_, at in (("p", plain, "p", locus, "_locus"), ("h", plain, "h", key, "_contig"), ("sp", narrow, "p", locus, "_locus"), ("sh", narrow, "h", key, "_contig"), ("l", plain, "l", locus, "_locus")):
        own = profile.where(F.col("_kind") == sort).select(F.col(at).alias(id_), *(F.col(x).alias(f"{name}_{x}") for x in profile.columns if x not in of))
        out = out.hint("shuffle_merge").join(own, id_, "left")
    c = F.col
    short, host = c("_bp") < least, F.coalesce("h_bp", F.lit(0))
    reasons = V.reasons([
        (short, "short_locus"), (~short & (host < least), "short_rest"), (~short & ((F.coalesce("h_mean", F.lit(0.0)) < 1) | (F.coalesce("h_breadth", F.lit(0.0)) < 0.5)), "low_rest"),
        (~short & ((F.coalesce("p_mean", F.lit(0.0)) < 1) | (F.coalesce("p_breadth", F.lit(0.0)) < 0.5)), "low_locus")])
    out = out.withColumn("reasons", reasons).withColumn("ratio", c("p_mean") / F.nullif(c("h_mean"), F.lit(0.0))).withColumn("effect", V.cohen_d("p_mean", "p_sd", "h_mean", "h_sd"))
    out = out.withColumn("local_ratio", c("p_mean") / F.nullif(c("l_mean"), F.lit(0.0)))
    good, up = c("reasons") == "", F.coalesce((c("ratio") >= ratio) & (c("effect") >= effect), F.lit(False))
    also = F.coalesce((c("sp_mean") / F.nullif(c("sh_mean"), F.lit(0.0)) >= ratio) & (F.abs(V.cohen_d("sp_mean", "sp_sd", "sh_mean", "sh_sd")) >= effect) & (c("sp_mean") >= 1) & (c("sp_breadth") >= 0.5), F.lit(False))
    agrees = F.when(good & (c("sh_mean") > 0) & (c("l_bp") >= least) & (c("l_mean") > 0), (up == also) & ((c("local_ratio") >= ratio) == (c("ratio") >= ratio)))
    call = F.when(~good, "not_evaluable").when(up, "raised").otherwise("level")
    out = out.select(locus, F.when(good, "evaluable").otherwise("not_evaluable").alias("status"), "reasons", call.alias("call"), "ratio", "effect", "local_ratio", agrees.alias("agrees"))
    out._holds = (plain, narrow)
    return out


def member_relation(systems: DataFrame, members: DataFrame, places: DataFrame, keys: Sequence[str], system: str, member: str) -> DataFrame:
    """system, n_members, relation of each system's required members (``members``: system, member) to the system's own interval
    (``systems``: system, keys, start0, end0): fully_inside (all), outside (all), boundary_spanning, or unresolved: no member, or
    one without a place (``places``: member, keys, start0, end0)."""
    at = F.struct(*keys)
    own = systems.select(system, at.alias("_where"), F.col("start0").alias("_a"), F.col("end0").alias("_b"))
    found = places.select(member, at.alias("_at"), F.col("start0").alias("_s"), F.col("end0").alias("_e"))
    met = own.hint("shuffle_merge").join(members.select(system, member).distinct(), system, "left").hint("shuffle_merge").join(found, member, "left")
    inside = (F.col("_at") == F.col("_where")) & (F.col("_s") >= F.col("_a")) & (F.col("_e") <= F.col("_b"))
    apart = (F.col("_at") != F.col("_where")) | (F.col("_e") <= F.col("_a")) | (F.col("_s") >= F.col("_b"))
    g = met.groupBy(system).agg(F.count_distinct(member).alias("n_members"), F.min(F.col("_at").isNotNull().cast("int")).alias("_placed"), F.min(inside.cast("int")).alias("_in"), F.min(apart.cast("int")).alias("_out"))
    label = V.ladder([((F.col("n_members") == 0) | (F.col("_placed") == 0), "unresolved"), (F.col("_in") == 1, "fully_inside"), (F.col("_out") == 1, "outside")], "boundary_spanning")
    return g.select(system, "n_members", label.alias("relation"))
