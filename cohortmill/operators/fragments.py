"""Fragments: all alignment records of one query name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C

# The outcomes of a fragment, in the order in which they are asked.
OUTCOMES = (
    "unmapped_or_incomplete_pair", "sequencing_qc_fail", "sequence_filter", "ambiguous_or_reporting_saturated",
    "primary_alignment_not_reconciled", "mapq_unavailable", "mapq_filter", "discordant_pair", "assigned",
)
# Whether the left and the right mate of a pair lie on the reverse strand.
DIRECTIONS = {"fr": (False, True), "rf": (True, False), "ff": (False, False)}


def has(flag: str | Column, bit: int) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(bit) != 0


def alignment(records: DataFrame) -> DataFrame:
    """Adds identity (columns less NM, over columns), aligned_fraction (of the read, clipped ends counted) and ``fault``: why
    a record contradicts itself, else empty. Unmapped records have nulls. Needs flag, cigar, nm and seq ('*' where left out)."""
    ops = C.operations("cigar")
    n = {k: C.length_of(F.col("_ops"), k) for k in ("M=X", "I", "D", "MIS=X", "H", "NHP")}
    gaps = n["I"] + n["D"]
    df = records.withColumn("_ops", F.when(~has("flag", 4) & (F.col("cigar") != "*"), ops))
    whole = F.array_join(F.transform("_ops", lambda x: F.concat(x["n"].cast("string"), x["op"])), "")
    columns = n["M=X"] + gaps
    fault = (
        F.when(F.col("_ops").isNull(), "").when((whole != F.col("cigar")) | F.exists("_ops", lambda x: x["n"] <= 0), "cigar").when(F.col("nm").isNull(), "no_nm")
        .when((F.col("nm") < gaps) | (F.col("nm") > columns), "nm_contradicts_cigar").when((F.col("seq") != "*") & (F.length("seq") != n["MIS=X"]), "length_contradicts_cigar").otherwise("")
    )
    good = F.col("_ops").isNotNull() & (F.col("fault") == "")
    df = df.withColumn("fault", fault)
    df = df.withColumn("identity", F.when(good, (columns - F.col("nm")) / F.nullif(columns, F.lit(0))))
    return df.withColumn("aligned_fraction", F.when(good, (n["M=X"] + n["I"]) / F.nullif(n["MIS=X"] + n["H"], F.lit(0)))).drop("_ops")


def passes(identity_min: float, fraction_min: float) -> Column:
    """Of ``alignment``: similar and long enough; false for unmapped records and for such as contradict themselves."""
    return F.coalesce((F.col("identity") >= identity_min) & (F.col("aligned_fraction") >= fraction_min), F.lit(False))


def mapq_passes(mapq_min: int) -> Column:
    """255 means that there is no quality, so it passes only where none is asked for."""
    return F.lit(True) if mapq_min == 0 else (F.col("mapq") != 255) & (F.col("mapq") >= mapq_min)


def proper(a: Column, b: Column, insert_min: int, insert_max: int, orientation: str) -> Column:
    """Whether two mates (structs of flag, rname, pos, rnext, pnext, tlen) form a proper pair: both say so, each names the
    other's place, lengths are opposite and within range, strands are as the layout asks."""
    left_first = a["pos"] <= b["pos"]
    back = lambda x: has(x["flag"], 16)
    left, right = F.when(left_first, back(a)).otherwise(back(b)), F.when(left_first, back(b)).otherwise(back(a))
    want = DIRECTIONS[orientation]
    named = lambda x, y: (x["rnext"] == "=") | (x["rnext"] == y["rname"])
    ok = (
        has(a["flag"], 2) & has(b["flag"], 2) & (a["rname"] == b["rname"]) & named(a, b) & named(b, a) & (a["pnext"] == b["pos"]) & (b["pnext"] == a["pos"])
        & (a["tlen"] == -b["tlen"]) & F.abs(a["tlen"]).between(insert_min, insert_max) & (left == want[0]) & (right == want[1])
    )
    return F.coalesce(ok, F.lit(False))


def outcomes(records: DataFrame, ok: Column, mapq_min: int, report_k: int, insert_min: int, insert_max: int, orientation: str = "fr", paired: bool = True, ordinary: DataFrame | None = None) -> DataFrame:
    """qname, outcome (``OUTCOMES``, or malformed where a mate lacks or has several primary records), reference (assigned
    fragments only) and n_records.

    ``ok``: whether a record's sequence passes. A mate is ambiguous if a passing record lies elsewhere than another of its
    passing records, or if ``report_k`` records of it are reported. ``ordinary``: primary records (qname, mate, flag, rname,
    pos, cigar, mapq) of the run that gives mapping qualities; a fragment one of whose primaries is placed otherwise there is
    not reconciled. One aggregate per fragment without any list, so a name with very many records needs no more memory.
    """
    mates = (1, 2) if paired else (0,)
    primary = ~has("flag", 256) & ~has("flag", 2048)
    rows = records.select("qname", "mate", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", primary.alias("prim"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(True).alias("same"))
    if ordinary is not None:
        place = lambda: F.struct("rname", "pos", "cigar", has("flag", 16).alias("back"))
        # of several ordinary primaries of a mate, which are an error there, none reconciles
        other = ordinary.where(~has("flag", 256) & ~has("flag", 2048)).groupBy("qname", "mate").agg(F.min(place()).alias("p"), F.min("mapq").alias("q"), F.count("*").alias("k"))
        met = rows.where("prim").hint("shuffle_merge").join(other, ["qname", "mate"], "left")
        met = met.withColumn("same", F.coalesce((F.col("k") == 1) & (F.col("p") == place()), F.lit(False))).withColumn("mapq", F.coalesce("q", "mapq")).drop("p", "q", "k")
        rows = rows.where("not prim").unionByName(met)
    where = F.struct("rname", "pos", "cigar", has("flag", 16).alias("back"))
    seen, prim = ~has("flag", 4) & ~has("flag", 2048), F.col("prim")
    any_of = lambda cond: F.coalesce(F.max(F.when(cond, 1).otherwise(0)) == 1, F.lit(False))
    agg = [
        F.count("*").alias("n_records"), F.count_if(prim).alias("n_prim"), any_of(prim & has("flag", 4)).alias("un"), any_of(prim & has("flag", 512)).alias("qc"),
        any_of(prim & ~F.col("ok")).alias("low"), any_of(prim & ~F.col("same")).alias("moved"), any_of(prim & (F.col("mapq") == 255)).alias("no_q"), any_of(prim & (F.col("mapq") < mapq_min)).alias("q"),
        F.min(F.when(prim, F.struct("mate", "rname"))).getField("rname").alias("rname"),
    ]
    for m in mates:
        mine = F.col("mate") == m
        agg += [
            F.count_if(prim & mine).alias(f"p{m}"), F.count_if(seen & mine).alias(f"k{m}"), F.min(F.when(seen & mine & F.col("ok"), where)).alias(f"a{m}"), F.max(F.when(seen & mine & F.col("ok"), where)).alias(f"b{m}"),
            F.max(F.when(prim & mine, F.struct("flag", "rname", "pos", "rnext", "pnext", "tlen"))).alias(f"m{m}"),
        ]
    g = rows.groupBy("qname").agg(*agg)
    one = (F.col("n_prim") == len(mates))
    several = F.lit(False)
    for m in mates:
        one = one & (F.col(f"p{m}") == 1)
        several = several | F.coalesce(F.col(f"a{m}") != F.col(f"b{m}"), F.lit(False)) | (F.col(f"k{m}") >= report_k)
    apart = ~proper(F.col("m1"), F.col("m2"), insert_min, insert_max, orientation) if paired else F.lit(False)
    label = F.when(~one, "malformed")
    for cond, name in zip((F.col("un"), F.col("qc"), F.col("low"), several, F.col("moved"), F.col("no_q"), F.col("q"), apart), OUTCOMES):
        label = label.when(cond, name)
    g = g.withColumn("outcome", label.otherwise(OUTCOMES[-1]))
    return g.select("qname", "outcome", F.when(F.col("outcome") == "assigned", F.col("rname")).alias("reference"), "n_records")


def ambiguous_targets(records: DataFrame, ok: Column, classes: DataFrame) -> DataFrame:
    """qname, rname: the references on which an ambiguous fragment of ``outcomes`` has passing records."""
    seen = records.where(ok & ~has("flag", 4) & ~has("flag", 2048)).select("qname", "rname").distinct()
    return seen.hint("shuffle_merge").join(classes.where(F.col("outcome") == OUTCOMES[3]).select("qname"), "qname", "left_semi")


def unmapped(flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(4) == 4


def classify(records: DataFrame, mapq_min: int, span_max: int) -> DataFrame:
    """qname, n_records, class: one ordered outcome per fragment from flags aggregated before the shuffle."""
    none = F.when(unmapped(), 1).otherwise(0)
    g = records.groupBy("qname").agg(
        F.count("*").alias("n_records"), F.min(none).alias("all_un"), F.max(none).alias("any_un"), F.min("mapq").alias("q"),
        F.min("ref").alias("r0"), F.max("ref").alias("r1"), (F.max("pos") - F.min("pos")).alias("span"))
    label = (
        F.when(F.col("all_un") == 1, "unmapped").when(F.col("n_records") != 2, "unpaired").when(F.col("any_un") == 1, "one_mate").when(F.col("q") < mapq_min, "low_quality")
        .when(F.col("r0") != F.col("r1"), "ambiguous").when(F.col("span") > span_max, "far_apart").otherwise("assigned")
    )
    return g.withColumn("class", label)


def valid_pairs(records: DataFrame, low: int, high: int) -> DataFrame:
    """qname, valid for fragments with both mates: both mapped, one reference, distance within [low, high]."""
    side = lambda n, p: records.where(F.col("mate") == n).select("qname", F.struct("ref", "pos", unmapped().alias("un")).alias(p))
    both = side(1, "a").hint("shuffle_merge").join(side(2, "b"), "qname")
    ok = ~F.col("a.un") & ~F.col("b.un") & (F.col("a.ref") == F.col("b.ref")) & F.abs(F.col("a.pos") - F.col("b.pos")).between(low, high)
    return both.select("qname", ok.alias("valid"))


def drop_hit_fragments(records: DataFrame, hits: DataFrame) -> DataFrame:
    """Records of the fragments none of whose mates is among the hits."""
    return records.hint("shuffle_merge").join(hits.select("qname").distinct(), "qname", "left_anti")


def target_pairs(records: DataFrame) -> DataFrame:
    """How many fragments have records on both of two references: a < b, n. A fragment has a handful of records."""
    one = records.select("qname", "ref").distinct()
    other = one.select("qname", F.col("ref").alias("b"))
    return one.withColumnRenamed("ref", "a").hint("shuffle_merge").join(other, "qname").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
