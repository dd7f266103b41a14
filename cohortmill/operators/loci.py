"""Operators on loci and their flanks, masks, column maps, repeats and aligned columns."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import sequences as S
from .intervals import merged, overlap_join


def mask_sequences(seqs: DataFrame, key: str, seq: str, intervals: DataFrame, letter: str = "N") -> DataFrame:
    """The sequences with their intervals (key, start0, end0; clipped to the sequence) replaced by ``letter``, and n_masked.

    Intervals of a key are merged first, so overlaps count once; a null sequence stays null, with n_masked null.
    """
    sized = intervals.select(key, F.greatest(F.lit(0), F.col("start0")).cast("long").alias("start0"), F.col("end0").cast("long").alias("end0"))
    runs = merged(sized, [key]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start0", "end0"))).alias("_iv"))
    both = seqs.hint("shuffle_merge").join(runs.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left")
    n = F.length(seq).cast("long")
    clip = F.filter(F.transform("_iv", lambda x: F.struct(F.least(x.start0, n).alias("s"), F.least(x.end0, n).alias("e"))), lambda x: x.e > x.s)
    clip = F.coalesce(clip, F.array().cast("array<struct<s:bigint,e:bigint>>"))
    kept = F.aggregate(clip, F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")), lambda a, x: F.struct(
        F.concat(a.t, F.col(seq).substr((a.at + 1).cast("int"), (x.s - a.at).cast("int")), F.repeat(F.lit(letter), (x.e - x.s).cast("int"))).alias("t"), x.e.alias("at")))
    out = both.withColumn("_m", kept).withColumn("n_masked", F.when(n.isNotNull(), F.aggregate(clip, F.lit(0).cast("long"), lambda a, x: a + x.e - x.s)))
    return out.withColumn(seq, F.concat(F.col("_m.t"), F.col(seq).substr((F.col("_m.at") + 1).cast("int"), F.length(seq)))).drop("_m", "_iv", "_key")


def anchored_loci(hits: DataFrame, keys: Sequence[str], most_empty: int) -> DataFrame:
    """keys, gap and state of each locus from hits of its flanks (keys, side 'left' or 'right', contig, strand, start0,
    end0): ``unassessable`` unless either flank has one hit, both on one contig and strand and in order; else ``empty`` up to
    a gap of ``most_empty``, ``occupied`` beyond."""
    side = lambda s, what: F.max(F.when(F.col("side") == s, F.col(what)))
    n = lambda s: F.count(F.when(F.col("side") == s, 1))
    flat = hits.groupBy(*keys).agg(n("left").alias("n_left"), n("right").alias("n_right"), *(side(s, c).alias(f"{s}_{c}") for s in ("left", "right") for c in ("contig", "strand", "start0", "end0")))
    same = (F.col("n_left") == 1) & (F.col("n_right") == 1) & (F.col("left_contig") == F.col("right_contig")) & (F.col("left_strand") == F.col("right_strand"))
    gap = F.when(same, F.when(F.col("left_strand") == "+", F.col("right_start0") - F.col("left_end0")).otherwise(F.col("left_start0") - F.col("right_end0")))
    flat = flat.withColumn("gap", F.when(gap >= 0, gap))
    return flat.select(*keys, "gap", F.when(F.col("gap").isNull(), "unassessable").when(F.col("gap") <= most_empty, "empty").otherwise("occupied").alias("state"))


def flank_markers(loci: DataFrame, genes: DataFrame, keys: Sequence[str], locus: str, gene: str, scores: tuple[str, str, str], flank: int) -> DataFrame:
    """locus, gene, marker for each gene that lies whole inside a flank of a locus: ``host`` if the first score beats both
    others, ``unknown`` if one of the three is null, ``none`` else."""
    at = F.explode(F.array(F.struct((F.col("start0") - flank).alias("start0"), F.col("start0").alias("end0")), F.struct(F.col("end0").alias("start0"), (F.col("end0") + flank).alias("end0"))))
    met = overlap_join(loci.select(*keys, locus, at.alias("f")).select(*keys, locus, "f.*"), genes, keys)
    host, virus, other = (F.col(f"r.{s}") for s in scores)
    inside = (F.col("r.start0") >= F.col("l.start0")) & (F.col("r.end0") <= F.col("l.end0"))
    marker = F.when(host.isNull() | virus.isNull() | other.isNull(), "unknown").when((host > virus) & (host > other), "host").otherwise("none")
    return met.where(inside).select(F.col(f"l.{locus}").alias(locus), F.col(f"r.{gene}").alias(gene), marker.alias("marker"))


def column_runs(kept: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Run-length map of kept columns (keys, place; each once): keys, start0, end0 of each run of neighbours, and new_start0,
    where it begins once the other columns are gone."""
    over = W.partitionBy(*keys).orderBy(place)
    rows = kept.select(*keys, place).withColumn("_i", F.row_number().over(over).cast("long"))
    runs = rows.groupBy(*keys, (F.col(place) - F.col("_i")).alias("_run")).agg(F.min(place).alias("start0"), (F.max(place) + 1).alias("end0"), (F.min("_i") - 1).alias("new_start0"))
    return runs.drop("_run")


def project_intervals(intervals: DataFrame, blocks: DataFrame, keys: Sequence[str], name: str, whole: bool = False) -> DataFrame:
    """name, column0, column_end0: source intervals laid on alignment columns through blocks (keys, start0, end0, column0,
    strand). On '-' a block's columns run against the source. With ``whole``, only intervals inside one block."""
    met = overlap_join(intervals, blocks, keys)
    lo, hi = F.greatest("l.start0", "r.start0"), F.least("l.end0", "r.end0")
    if whole:
        met = met.where((F.col("l.start0") >= F.col("r.start0")) & (F.col("l.end0") <= F.col("r.end0")))
    ahead, size = F.col("r.strand") != "-", hi - lo
    column = F.col("r.column0") + F.when(ahead, lo - F.col("r.start0")).otherwise(F.col("r.end0") - hi)
    return met.select(F.col(f"l.{name}").alias(name), column.alias("column0"), (column + size).alias("column_end0"))


def longest_repeat(seqs: DataFrame, key: str, seq: str, window: int, least: int, most: int, entropy: Column | None = None) -> DataFrame:
    """key, left0, right0, length: the longest exact repeat, in one direction, between the first and the last ``window``
    letters of a sequence of two windows or more; of equal ones that nearest to the ends, then the leftmost. Seeds of
    ``least`` letters meet by join; ``entropy`` is a condition on the column ``repeat``."""
    rows = seqs.where(F.length(seq) >= 2 * window).select(key, F.substring(seq, 1, window).alias("x"), F.right(seq, F.lit(window)).alias("y"), F.length(seq).alias("n"))
    tiles = F.sequence(F.lit(0), F.lit(window - least))
    seeds = rows.select(key, F.explode(tiles).alias("i"), "x").select(key, "i", F.col("x").substr(F.col("i") + 1, F.lit(least)).alias("t"))
    others = rows.select(key, F.explode(tiles).alias("j"), "y").select(key, "j", F.col("y").substr(F.col("j") + 1, F.lit(least)).alias("t"))
    met = seeds.hint("shuffle_merge").join(others, [key, "t"]).drop("t").hint("shuffle_merge").join(rows, key)
    a, b = (lambda k: F.col("x").substr(F.col("i") + 1, k)), (lambda k: F.col("y").substr(F.col("j") + 1, k))
    length = F.array_max(F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: (F.col("i") + k <= window) & (F.col("j") + k <= window) & (a(k) == b(k))))
    met = met.withColumn("length", length).withColumn("repeat", a(F.col("length"))).withColumn("_ends", F.col("i") + (window - F.col("j") - F.col("length")))
    met = met.where(entropy) if entropy is not None else met
    best = met.groupBy(key).agg(F.min(F.struct((-F.col("length")).alias("l"), F.col("_ends"), F.col("i"), F.col("j"), "n")).alias("b"))
    return best.select(key, F.col("b.i").alias("left0"), (F.col("b.n") - window + F.col("b.j")).alias("right0"), (-F.col("b.l")).alias("length"))


def pair_distances(cells: DataFrame, name: str, place: str, letter: str, least: int) -> DataFrame:
    """a, b, n_sites, n_different, distance for the pairs of aligned sequences given cell by cell (name, place, letter), by
    columns that both have (null is a gap). Pairs with fewer than ``least`` sites have a null distance. All pairs come out by
    definition; columns are dealt out, and each sends partial counts only."""
    known = cells.where(F.col(letter).isNotNull()).select(place, name, letter)
    x, y = (known.select(place, F.col(name).alias(n), F.col(letter).alias(f"_{n}")) for n in "ab")
    met = x.hint("shuffle_merge").join(y, place).where("a < b")
    out = met.groupBy("a", "b").agg(F.count("*").alias("n_sites"), F.count_if(F.col("_a") != F.col("_b")).alias("n_different"))
    return out.withColumn("distance", F.when(F.col("n_sites") >= least, F.col("n_different") / F.col("n_sites")))


def first_by_group(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first row of each group by ``order``, then the first k of these by the same order."""
    one = df.withColumn("_i", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("_i = 1").drop("_i")
    return one.orderBy(*order).limit(k)


def version_crosswalk(old: DataFrame, new: DataFrame, key: str, name: str) -> DataFrame:
    """key, old, new, state: the name of each key in two versions: kept, renamed, retired or new."""
    a, b = old.select(key, F.col(name).alias("old")), new.select(key, F.col(name).alias("new"))
    both = a.hint("shuffle_merge").join(b, key, "full_outer")
    state = F.when(F.col("new").isNull(), "retired").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("new"), "kept").otherwise("renamed")
    return both.select(key, "old", "new", state.alias("state"))


def two_tier(primary: DataFrame, supplemental: DataFrame, matches: DataFrame, node: str) -> DataFrame:
    """node, anchor, tier: primary nodes are anchors of their own; a supplemental node goes to the smallest primary node it
    matches (a, b; either way), else it is an anchor of the second tier."""
    both = matches.select("a", "b").union(matches.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = primary.select(F.col(node).alias("b")).distinct()
    near = both.hint("shuffle_merge").join(first, "b").groupBy("a").agg(F.min("b").alias("anchor"))
    rest = supplemental.select(node).distinct().hint("shuffle_merge").join(first, F.col(node) == F.col("b"), "left_anti")
    rest = rest.hint("shuffle_merge").join(near, F.col(node) == F.col("a"), "left")
    rest = rest.select(node, F.coalesce("anchor", node).alias("anchor"), F.when(F.col("anchor").isNull(), "supplemental").otherwise("matched").alias("tier"))
    return first.select(F.col("b").alias(node), F.col("b").alias("anchor"), F.lit("primary").alias("tier")).unionByName(rest)


def flanks(loci: DataFrame, contigs: DataFrame, contig: str, seq: str, locus: str, length: int, letters: str = "ACGT") -> DataFrame:
    """locus, side, start0, end0, length, flank, status, reason: ``length`` letters on either side of each locus, in the contig's
    own direction. unassessable: no contig, bounds (the locus does not lie inside its contig), contig_edge_truncated, or
    non_acgt_flank (another letter than ``letters``); else ready."""
    met = loci.select(locus, contig, "start0", "end0").hint("shuffle_merge").join(contigs.select(contig, F.col(seq).alias("_seq")), contig, "left")
    n = F.length("_seq")
    side = lambda name, a, b: F.struct(F.lit(name).alias("side"), a.cast("long").alias("start0"), b.cast("long").alias("end0"))
    both = F.array(side("left", F.greatest(F.lit(0), F.col("start0") - length), F.col("start0")), side("right", F.col("end0"), F.least(n, F.col("end0") + length)))
    lies = (F.col("start0") >= 0) & (F.col("start0") < F.col("end0")) & (F.col("end0") <= n)
    rows = met.select(locus, "_seq", lies.alias("_lies"), F.explode(both).alias("e")).select(locus, "_seq", "_lies", "e.*")
    size = F.greatest(F.lit(0), F.col("end0") - F.col("start0"))
    rows = rows.withColumn("flank", F.when(F.col("_lies"), F.substring("_seq", (F.col("start0") + 1).cast("int"), size.cast("int"))))
    reason = F.when(F.col("_seq").isNull(), "no_contig").when(~F.col("_lies"), "bounds").when(F.length("flank") != length, "contig_edge_truncated").when(F.col("flank").rlike(f"[^{letters}]"), "non_acgt_flank").otherwise("")
    return rows.select(locus, "side", "start0", "end0", F.length("flank").cast("long").alias("length"), "flank", F.when(reason == "", "ready").otherwise("unassessable").alias("status"), reason.alias("reason"))


def spanning_reads(records: DataFrame, boundaries: DataFrame, name: str, boundary: str, anchor: int = 20, quality_min: int = 20, mapq_min: int = 20, width: int = 4096) -> DataFrame:
    """qname, mate, boundary for each primary, well mapped record one unbroken aligned block of which reaches ``anchor`` bases to
    either side of a boundary (``boundaries``: name, boundary), all of these bases of at least ``quality_min``.

    Blocks and boundaries meet by bins of the reference; the quality is looked at in the anchor's stretch of the block only.
    """
    good = ~F.col("flag").bitwiseAND(4 | 256 | 512 | 1024 | 2048).cast("boolean") & (F.col("mapq") >= mapq_min) & (F.col("mapq") != 255) & (F.col("cigar") != "*") & (F.col("qual") != "*")
    b = records.where(good).select("qname", "mate", name, "qual", F.explode(C.blocks("cigar", "pos")).alias("b"))
    b = b.select("qname", "mate", name, "qual", F.col("b.query0").alias("q0"), F.col("b.ref0").cast("long").alias("r0"), (F.col("b.ref0") + F.col("b.n")).cast("long").alias("r1")).where(F.col("r1") - F.col("r0") >= 2 * anchor)
    b = b.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("r0") + anchor) / width), F.floor((F.col("r1") - anchor) / width))))
    at = boundaries.select(name, F.col(boundary).cast("long").alias(boundary)).distinct().withColumn("_bin", F.floor(F.col(boundary) / width))
    met = b.hint("shuffle_merge").join(at, [name, "_bin"]).where((F.col("r0") <= F.col(boundary) - anchor) & (F.col("r1") >= F.col(boundary) + anchor))
    part = F.expr(f"substring(qual, CAST(q0 + `{boundary}` - {anchor} - r0 + 1 AS INT), {2 * anchor})")
    fine = (F.length(part) == 2 * anchor) & ~part.rlike(f"[^{re.escape(chr(33 + quality_min))}-~]")
    return met.where(fine).select("qname", "mate", name, boundary).distinct()


def aligned_columns(cells: DataFrame, name: str, place: str, letter: str, names: DataFrame) -> DataFrame:
    """One row: n_names, n_columns, n_shared (columns in which every one of ``names`` has a letter) and n_variable (columns with
    several letters); a null letter is a gap. Cells that are dealt by place need no shuffle."""
    kinds = dict(cells.dtypes)
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    each = F.explode(F.array(F.struct(F.when(F.col(letter).isNotNull(), F.col(name)).alias(name), none(letter)), F.struct(none(name), F.col(letter).alias(letter)))).alias("_v")
    per = cells.select(place, each).distinct().groupBy(place).agg(F.count(f"_v.{name}").alias("n"), F.count(f"_v.{letter}").alias("k"))
    all_ = names.select(name).distinct().agg(F.count("*").alias("n_names"))
    return per.crossJoin(F.broadcast(all_)).groupBy("n_names").agg(F.count("*").alias("n_columns"), F.count_if(F.col("n") == F.col("n_names")).alias("n_shared"), F.count_if(F.col("k") > 1).alias("n_variable"))


def _longest(x: str, y: str, start: int, end: int, apart: int, least: int, most: int, entropy_min: float) -> tuple[int, int, int] | None:
    """(length, i, j) of the repeat that ``boundary_repeat`` gives for windows x and y; ``start`` and ``end`` are the ends' places in
    them, ``apart`` is how far y begins behind x."""
    a, b = (np.array(["ACGT".find(c) for c in t], np.int64) for t in (x, y))
    if min(len(a), len(b)) < least:
        return None
    seeds = [np.lib.stride_tricks.sliding_window_view(t, least) for t in (a, b)]
    code, other = (np.where((s >= 0).all(1), 0, -1 - n).astype(object if least > 31 else np.int64) for n, s in enumerate(seeds))
    for c, s in ((code, seeds[0]), (other, seeds[1])):
        for column in s.T:
            c[:] = np.where(c < 0, c, c * 4 + column)
    i, j = np.nonzero(code[:, None] == other[None, :])
    room = np.minimum(np.minimum(len(a) - i, len(b) - j), np.minimum(most, apart + j - i))
    i, j, room = i[room >= least], j[room >= least], room[room >= least]
    if not len(i):
        return None
    length, alive = np.full(len(i), least), np.arange(len(i))
    while len(alive := alive[length[alive] < room[alive]]):
        p, q = a[i[alive] + length[alive]], b[j[alive] + length[alive]]
        alive = alive[(p == q) & (p >= 0)]
        length[alive] += 1
    sizes = np.arange(least, most + 1)
    firsts, at = np.unique(i, return_inverse=True)
    ends = np.minimum(firsts[:, None] + sizes, len(a))
    bits = np.zeros(ends.shape)
    for letter in range(4):
        seen = np.concatenate([[0], np.cumsum(a == letter)])
        share = (seen[ends] - seen[firsts][:, None]) / sizes
        bits -= share * np.log2(np.where(share > 0, share, 1))
    fit = np.maximum.accumulate(np.where(bits >= entropy_min, sizes, 0), axis=1)  # the longest of enough bits, up to each length
    length = fit[at, length - least]
    some = length > 0
    if not some.any():
        return None
    i, j, length = i[some], j[some], length[some]
    best = np.lexsort((j, i, np.abs(i - start) + np.abs(j + length - end), -length))[0]
    return int(length[best]), int(i[best]), int(j[best])


def boundary_repeat(loci: DataFrame, locus: str, seq: str, reach: int = 250, least: int = 15, most: int = 60, entropy_min: float = 1.5) -> DataFrame:
    """locus, status, length, left0, right0, repeat: the longest exact repeat in one direction between the windows of ``reach``
    letters around a locus's two ends (``loci``: locus, seq, start0, end0); of equal ones that nearest to the ends, then the
    leftmost. Only a, c, g, t of either case; repeats have ``least`` to ``most`` letters and an entropy of ``entropy_min`` bits.

    not_assessed_overlapping_windows where the windows meet. The two windows of a locus are of fixed size and lie in its own
    row, so rows are worked on where they are, without a shuffle (``_longest``).
    """
    n = F.length(seq)
    x0, x1 = F.greatest(F.lit(0), F.col("start0") - reach), F.least(n, F.col("start0") + reach)
    y0, y1 = F.greatest(F.lit(0), F.col("end0") - reach), F.least(n, F.col("end0") + reach)
    part = lambda a, b: F.upper(F.substring(seq, (F.col(a) + 1).cast("int"), F.greatest(F.lit(0), F.col(b) - F.col(a)).cast("int")))
    rows = loci.select(F.col(locus).alias("_locus"), seq, "start0", "end0", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    places = [F.col(c).cast("long").alias(c) for c in ("start0", "end0", "x0", "y0")]
    rows = rows.select("_locus", (F.col("x1") > F.col("y0")).alias("_meet"), part("x0", "x1").alias("x"), part("y0", "y1").alias("y"), *places)
    kind = dict(rows.dtypes)["_locus"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if r["_meet"] or r["x"] is None or r["y"] is None else _longest(r["x"], r["y"], r["start0"] - r["x0"], r["end0"] - r["y0"], r["y0"] - r["x0"], least, most, entropy_min) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_locus", "_meet", "x", "x0", "y0")), *(pa.array([f and f[c] for f in found], pa.int64()) for c in range(3))], ["_locus", "_meet", "x", "x0", "y0", "length", "i", "j"])

    out = rows.mapInArrow(find, f"_locus {kind}, _meet boolean, x string, x0 long, y0 long, length long, i long, j long")
    status = F.when(F.col("_meet"), "not_assessed_overlapping_windows").when(F.col("length").isNull(), "no_repeat").otherwise("direct_repeat_candidate")
    return out.select(F.col("_locus").alias(locus), status.alias("status"), "length", (F.col("x0") + F.col("i")).alias("left0"), (F.col("y0") + F.col("j")).alias("right0"), F.col("x").substr((F.col("i") + 1).cast("int"), F.col("length").cast("int")).alias("repeat"))
