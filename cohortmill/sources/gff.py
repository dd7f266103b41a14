"""Feature records of nine columns (GFF3): parents over several levels, coding sequences of several parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, stage

CODES = {"%09": "\t", "%0A": "\n", "%25": "%", "%2C": ",", "%3B": ";", "%3D": "=", "%26": "&"}  # fixed: what the format escapes


def records(lines: DataFrame, text: str = "value") -> DataFrame:
    """seqid, source, type, start0, end0, score, strand, phase, id, parents (array), attributes (map), wrong: why a line is no
    record (fields, interval, strand, phase, attributes: none or a key twice), else empty. Comments and blank lines go; what
    stands under ``##FASTA`` has no tabs and comes out as wrong."""
    f = F.col("_f")
    at = lambda i: F.get(f, F.lit(i))
    cell = lambda i: F.when(~at(i).isin(".", ""), at(i))
    pairs, keys, good = F.col("_pairs"), F.col("_keys"), F.col("_good")
    k, v = (lambda x: F.trim(F.substring_index(x, "=", 1))), (lambda x: F.expr("substring(x, instr(x, '=') + 1)"))
    sound = F.forall(pairs, lambda x: F.instr(x, "=") > 1) & (F.size(F.array_distinct(keys)) == F.size(keys))
    plain = F.transform(pairs, lambda x: F.struct(k(x).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    start, end = at(3).try_cast("bigint"), at(4).try_cast("bigint")
    phase = cell(7).try_cast("int")
    wrong = (
        F.when(F.size(f) != 9, "fields").when(start.isNull() | end.isNull() | (start < 1) | (end < start), "interval").when(~at(6).isin("+", "-", ".", "?"), "strand")
        .when((at(7) != ".") & ~F.coalesce(phase.isin(0, 1, 2), F.lit(False)) | ((at(2) == "CDS") & phase.isNull()), "phase").when(~good, "attributes").otherwise("")
    )
    # fields, pairs and keys are columns of their own, so that each is cut once a line
    rows = lines.where(~F.startswith(text, F.lit("#")) & (F.trim(text) != "")).select(F.split(text, "\t").alias("_f"))
    rows = rows.select("_f", F.filter(F.split(F.coalesce(cell(8), F.lit("")), ";"), lambda x: F.trim(x) != "").alias("_pairs"))
    rows = rows.select("_f", "_pairs", F.transform("_pairs", k).alias("_keys"))
    rows = rows.select("_f", "_pairs", sound.alias("_good"))
    rows = rows.select(wrong.alias("wrong"), F.when((F.size(f) == 9) & good, F.map_from_entries(plain)).alias("attributes"), at(0).alias("seqid"), cell(1).alias("source"), at(2).alias("type"), (start - 1).alias("start0"), end.alias("end0"), cell(5).try_cast("double").alias("score"), at(6).alias("strand"), phase.alias("phase"))

    def plain_text(c):
        for code, letter in CODES.items():
            c = F.replace(c, F.lit(code), F.lit(letter))
        return c

    parents = F.transform(F.split(F.col("attributes")["Parent"], ","), plain_text)
    return rows.select("seqid", "source", "type", "start0", "end0", "score", "strand", "phase", plain_text(F.col("attributes")["ID"]).alias("id"), F.coalesce(parents, F.array().cast("array<string>")).alias("parents"), "attributes", "wrong")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return records(spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value")))


def ancestors(features: DataFrame, most_rounds: int = 20) -> DataFrame:
    """id, root, depth, status of each feature that has an id: its topmost ancestor over first parents.

    Pointers double each round (an ancestor's ancestor), so a chain of 2^k levels takes k rounds. status: root, child, orphan
    (an ancestor is missing), cycle (no root within 2^``most_rounds`` levels).
    """
    one = stage(features.where("id is not null").groupBy("id").agg(F.min(F.get("parents", F.lit(0))).alias("parent")), "ids")  # read twice
    known = one.select(F.col("id").alias("_known"))
    now = one.hint("shuffle_merge").join(known, F.col("parent") == F.col("_known"), "left")
    now = stage(now.select("id", F.when(F.col("_known").isNotNull(), F.col("parent")).alias("up"), F.when(F.col("_known").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), (F.col("parent").isNotNull() & F.col("_known").isNull()).alias("lost"), F.coalesce("_known", "id").alias("root")), "ancestors", left="count_if(up is not null)")
    drop(one)
    for _ in range(most_rounds):
        if not now._observed["left"]:
            break
        above = now.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("lost").alias("_lost"), F.col("root").alias("_root"))
        met = now.hint("shuffle_merge").join(above, F.col("up") == F.col("_id"), "left")
        before, now = now, stage(met.select("id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("lost") | F.coalesce("_lost", F.lit(False))).alias("lost"), F.coalesce("_root", "root").alias("root")), "ancestors", left="count_if(up is not null)")
        drop(before)
    cycle = F.col("up").isNotNull()
    status = F.when(cycle, "cycle").when(F.col("lost"), "orphan").when(F.col("depth") == 0, "root").otherwise("child")
    out = now.select("id", F.when(~cycle, F.col("root")).alias("root"), F.when(~cycle, F.col("depth")).alias("depth"), status.alias("status"))
    out._holds = (now,)
    return out


def coding_sequences(features: DataFrame) -> DataFrame:
    """id, seqid, strand, parent, start0, end0, n_parts, length, parts (array of start0, end0 in reading order) and fault of each
    coding sequence: the CDS records of one id.

    Parts are read upwards on the plus and downwards on the minus strand. fault: places (parts on several contigs, strands or
    parents), overlap, partial (the first part's phase is not 0), phase (a later part's phase is not what the bases before it
    leave over), length (no multiple of three), else empty. A sequence has a handful of parts.
    """
    part = F.struct("start0", "end0", "phase")
    g = features.where("type = 'CDS' and id is not null and wrong = ''").groupBy("id").agg(
        F.min("seqid").alias("seqid"), F.min("strand").alias("strand"), F.min(F.array_join("parents", ",")).alias("parent"), F.count("*").alias("n_parts"), F.sum(F.col("end0") - F.col("start0")).alias("length"),
        F.min("start0").alias("start0"), F.max("end0").alias("end0"), F.count_distinct("seqid", "strand", F.array_join("parents", ",")).alias("_places"), F.array_sort(F.collect_list(part)).alias("_up"))
    read = F.when(F.col("strand") == "-", F.reverse("_up")).otherwise(F.col("_up"))
    g = g.withColumn("_parts", read)
    size = lambda x: x["end0"] - x["start0"]
    first = F.get("_parts", F.lit(0))["phase"]
    before = lambda i: F.aggregate(F.slice("_parts", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + size(x))
    wanted = F.transform("_parts", lambda x, i: x["phase"] == F.pmod(F.lit(3) - F.pmod(before(i) - first, F.lit(3)), F.lit(3)))
    overlap = F.exists(F.sequence(F.lit(1), F.greatest(F.size("_up") - 1, F.lit(1))), lambda i: F.get("_up", i)["start0"] < F.get("_up", i - 1)["end0"])
    fault = F.when(F.col("_places") > 1, "places").when(F.coalesce(overlap, F.lit(False)), "overlap").when(first != 0, "partial").when(~F.forall(wanted, lambda x: x), "phase").when(F.col("length") % 3 != 0, "length").otherwise("")
    parts = F.transform("_parts", lambda x: F.struct(x["start0"].alias("start0"), x["end0"].alias("end0")))
    return g.select("id", "seqid", "strand", "parent", "start0", "end0", "n_parts", "length", parts.alias("parts"), fault.alias("fault"))
