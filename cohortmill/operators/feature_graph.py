"""A typed graph of features: tables into features, links, observations and evidence; and what contradicts its rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, stage
from .graph import components

FEATURE = "feature_id string, feature_unit string, genome_id string, contig_id string, start0 long, end0 long, strand string, source string"
# What a relation joins, and whether its members lie in their parent's genome.
RELATIONS = [
    ("votu_member", "votu", "candidate", False), ("candidate_gene", "candidate", "gene", True), ("system_gene", "system", "gene", True),
    ("quant_group_member", "quantification_group", "votu", False), ("locus_candidate", "locus", "candidate", True),
]
RELATION = "relation string, parent_unit string, member_unit string, physical boolean"


def features(*tables: tuple[DataFrame, str, dict[str, Column]], once: bool = True) -> DataFrame:
    """Rows of ``FEATURE`` from (table, unit, columns: feature_id and what else is known), equal rows once (``once``: false where
    what follows does not ask how often a row stands). Rows that differ under one id stay, for ``feature_faults``."""
    names = [x.split()[0] for x in FEATURE.split(", ")]
    kinds = dict(x.split() for x in FEATURE.split(", "))
    one = [t.select(*(F.lit(unit).alias(n) if n == "feature_unit" else (columns[n] if n in columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names)) for t, unit, columns in tables]
    every = reduce(DataFrame.unionByName, one)
    return every.dropDuplicates() if once else every


def link_id() -> Column:
    return F.concat(F.lit("link_"), F.left(F.sha2(F.to_json(F.array("parent", "member", "relation")), 256), F.lit(24))).alias("link_id")


def links(*tables: tuple[DataFrame, str, Column, Column]) -> DataFrame:
    """link_id (a hash of the three), parent, member, relation from (table, relation, parent, member); repeated rows stay."""
    one = [t.select(parent.alias("parent"), member.alias("member"), F.lit(relation).alias("relation")) for t, relation, parent, member in tables]
    every = reduce(DataFrame.unionByName, one)
    return every.select(link_id(), "parent", "member", "relation")


def observations(rows: DataFrame, entity: Column, feature: Column, version: str, values: Sequence[str]) -> DataFrame:
    """Measured columns as a long table: observation_id (a hash of version, entity, feature and field), entity_id, feature_id,
    field, value as text; null values are no observation."""
    ids = F.sha2(F.to_json(F.array(F.lit(version), "entity_id", "feature_id", "field")), 256)
    long = rows.select(entity.alias("entity_id"), feature.alias("feature_id"), *(F.col(v).cast("string").alias(v) for v in values)).unpivot(["entity_id", "feature_id"], list(values), "field", "value")
    return long.where("value is not null").select(F.concat(F.lit("obs_"), F.left(ids, F.lit(24))).alias("observation_id"), "entity_id", "feature_id", "field", "value")


def evidence(observed: DataFrame, source: str, accepted: Column) -> DataFrame:
    """A row of evidence for each observation: evidence_id, observation_id, source, level (B if accepted, else U), review_state."""
    ok = F.coalesce(accepted, F.lit(False))
    return observed.select(
        F.concat(F.lit("proof_"), F.left(F.sha2(F.concat_ws(":", "observation_id", F.lit(source)), 256), F.lit(24))).alias("evidence_id"), "observation_id", F.lit(source).alias("source"),
        F.when(ok, "B").otherwise("U").alias("level"), F.when(ok, "accepted").otherwise("pending").alias("review_state"))


def feature_faults(feats: DataFrame, genomes: DataFrame) -> DataFrame:
    """feature_id, fault: collision (an id with different rows), genome (unknown), coordinates (half given, empty or reversed, or
    without genome, contig and strand)."""
    twice = feats.groupBy("feature_id").agg(F.count("*").alias("n")).where("n > 1").select("feature_id", F.lit("collision").alias("fault"))
    lost = feats.where("genome_id is not null").hint("shuffle_merge").join(genomes.select("genome_id").distinct(), "genome_id", "left_anti").select("feature_id", F.lit("genome").alias("fault"))
    half, placed = F.col("start0").isNull() != F.col("end0").isNull(), F.col("genome_id").isNotNull() & F.col("contig_id").isNotNull() & F.col("strand").isNotNull()
    bad = half | (F.col("start0").isNotNull() & (~placed | (F.col("end0") <= F.col("start0")) | (F.col("start0") < 0)))
    return twice.unionByName(lost).unionByName(feats.where(bad).select("feature_id", F.lit("coordinates").alias("fault"))).distinct()


def link_faults(feats: DataFrame, link_rows: DataFrame, relations: DataFrame) -> DataFrame:
    """link_id, fault: relation (not in the catalogue ``relations``), parent or member (missing), units (not those of the
    relation), duplicate, genomes (a physical link between two genomes), chain (the features that physical links join, over any
    number of links and through features without a genome, lie in several genomes, though this link's ends do not differ).
    Ids are made anew as ``links`` makes them, so that no row carries one through the shuffles."""
    kinds = feats.groupBy("feature_id").agg(F.min("feature_unit").alias("unit"), F.min("genome_id").alias("genome"))
    end = lambda p, i: kinds.select(F.col("feature_id").alias(p), F.col("unit").alias(f"unit_{i}"), F.col("genome").alias(f"genome_{i}"))
    ends = link_rows.select("parent", "member", "relation")
    met = ends.hint("shuffle_merge").join(end("parent", "a"), "parent", "left").hint("shuffle_merge").join(end("member", "b"), "member", "left")
    met = met.join(F.broadcast(relations), "relation", "left")  # a catalogue of relations is written by hand
    differ = F.coalesce(F.col("physical") & (F.col("genome_a") != F.col("genome_b")), F.lit(False))
    known = F.col("parent_unit").isNotNull()
    rules = [
        (~known, "relation"), (F.col("unit_a").isNull(), "parent"), (F.col("unit_b").isNull(), "member"),
        (known & ((F.col("unit_a") != F.col("parent_unit")) | (F.col("unit_b") != F.col("member_unit"))), "units"), (differ, "genomes"),
    ]
    faults = F.filter(F.array(*(F.when(c, n) for c, n in rules)), lambda x: x.isNotNull())
    joins = F.col("physical") & F.col("unit_a").isNotNull() & F.col("unit_b").isNotNull()
    met = stage(met.select("parent", "member", "relation", "genome_a", "genome_b", F.coalesce(joins, F.lit(False)).alias("joins"), faults.alias("faults")), "linked")
    own = met.select("parent", "member", "relation", F.explode("faults").alias("fault"))
    tied = met.where("joins")
    # each parent with the genomes at the ends of its links; a component is mixed where those of its parents are
    parents = stage(tied.groupBy("parent").agg(F.least(F.min("genome_a"), F.min("genome_b")).alias("g0"), F.greatest(F.max("genome_a"), F.max("genome_b")).alias("g1")), "parents")
    # a member of one link that is no parent is no duplicate's and joins nothing to anything: it stays out of what follows; equal hashes only keep more in
    h = F.xxhash64("member").alias("h")
    several = met.select(h).union(parents.select(F.xxhash64("parent"))).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    core = stage(met.select("parent", "member", "relation", "joins", h).hint("shuffle_merge").join(several, "h", "left_semi").drop("h"), "core")
    again = core.groupBy("parent", "member", "relation").agg(F.count("*").alias("n")).where("n > 1").select("parent", "member", "relation", F.lit("duplicate").alias("fault"))
    found = components(core.where("joins").select(F.col("parent").alias("a"), F.col("member").alias("b")))
    of = parents.hint("shuffle_merge").join(found, F.col("parent") == F.col("node"), "left").select("parent", "g0", "g1", F.coalesce("component", "parent").alias("component"))
    mixed = of.groupBy("component").agg(F.min("g0").alias("g0"), F.max("g1").alias("g1")).where("g0 <> g1")
    inside = of.hint("shuffle_merge").join(mixed.select("component"), "component", "left_semi").select("parent")
    chain = tied.where(~F.array_contains("faults", "genomes")).select("parent", "member", "relation").hint("shuffle_merge").join(inside, "parent", "left_semi").withColumn("fault", F.lit("chain"))
    out = own.unionByName(again).unionByName(chain).distinct().select(link_id(), "fault")
    out._holds = (met, parents, core, found)
    return out
