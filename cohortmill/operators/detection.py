"""Detection profiles as a table of policies: checked as data, then evaluated for all profiles in one pass over measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import values as V

PROFILE = "profile_id string, breadth_field string, breadth_min double, assigned_fragments_min long, mean_depth_min double, require_mappability boolean, unique_mappability_min double, informative_length_min long"
# The breadths that a profile may ask for, and the depth that goes with each.
DEPTH_OF = {"breadth_full": "mean_depth_full", "breadth_assessable": "mean_depth_full", "breadth_informative": "mean_depth_informative"}
# States, with what each means for inference.
STATES = {"detected": "assessed", "not_detected": "assessed", "unassessable": "unknown", "not_resolvable": "unknown", "not_detected_at_resolved_signal": "unknown"}
MOST_PROFILES = 1000  # a policy table is written by hand


def profile_faults(profiles: DataFrame) -> DataFrame:
    """profile_id, fault of the profiles that can't be used: id (none, or twice), breadth_field, range, informative_length, and
    infeasible (so much breadth is not to be expected at the least depth asked for: breadth_min >= 1 - exp(-mean_depth_min))."""
    share = lambda c: F.col(c).between(0, 1)
    whole = share("breadth_min") & share("unique_mappability_min") & (F.col("assigned_fragments_min") >= 0) & (F.col("mean_depth_min") >= 0)
    rules = [
        (F.coalesce("profile_id", F.lit("")) == "", "id"), (~F.coalesce(F.col("breadth_field").isin(*DEPTH_OF), F.lit(False)), "breadth_field"), (~F.coalesce(whole, F.lit(False)), "range"),
        ((F.col("breadth_field") == "breadth_informative") & ~F.coalesce(F.col("informative_length_min") > 0, F.lit(False)), "informative_length"),
        ((F.col("mean_depth_min") > 0) & (F.col("breadth_min") >= 1 - F.exp(-F.col("mean_depth_min"))), "infeasible"),
    ]
    own = profiles.select("profile_id", F.explode(F.filter(F.array(*(F.when(c, n) for c, n in rules)), lambda x: x.isNotNull())).alias("fault"))
    twice = profiles.groupBy("profile_id").agg(F.count("*").alias("n")).where("n > 1 and profile_id <> ''").select("profile_id", F.lit("id").alias("fault"))
    return own.unionByName(twice)


def state(p: Row) -> Column:
    """detection_status, value, reason, inference_status and inference_reason of a measurement under one profile."""
    c, no = F.col, F.lit(False)
    unfit = (c("measurement_status") != "assessed") | (F.coalesce("assessable_length", F.lit(0)) == 0)
    unique = F.when(c("mappability_status") == "applicable", c("unique_mappability"))
    few = F.coalesce(unique < p.unique_mappability_min, no)
    blind = F.lit(bool(p.require_mappability)) & (unique.isNull() | few)
    informed = F.coalesce((c("informative_status") == "applicable") & (c("informative_length") >= (p.informative_length_min or 0)), no)
    narrow = F.lit(p.breadth_field == "breadth_informative") & ~informed
    met = F.coalesce((c(p.breadth_field) >= p.breadth_min) & (c("assigned_fragment_count") >= p.assigned_fragments_min) & (c(DEPTH_OF[p.breadth_field]) >= p.mean_depth_min), no)
    shared = F.coalesce(c("ambiguous_fragment_count") > 0, no)
    only = shared & (F.coalesce("assigned_fragment_count", F.lit(0)) == 0)
    # States and reasons as they are published, in the order in which they are asked.
    steps = [
        (unfit, "unassessable", F.coalesce(F.nullif(c("reason"), F.lit("")), F.lit("zero_assessable_length"))), (blind, "unassessable", F.lit("mappability_requirement")), (narrow, "unassessable", F.lit("informative_domain_or_length_requirement")),
        (met, "detected", F.lit("provisional_threshold_met")), (only, "not_resolvable", F.lit("ambiguous_only_not_detected_at_resolved_signal")), (shared, "not_detected_at_resolved_signal", F.lit("shared_signal_excluded_below_resolved_detection_threshold")),
        (F.lit(True), "not_detected", F.lit("provisional_threshold_not_met")),
    ]
    status = V.ladder([(when, name) for when, name, _ in steps[:-1]], steps[-1][1])
    reason = F.coalesce(*(F.when(F.coalesce(when, no), why) for when, _, why in steps))
    value = F.when(status == "detected", 1).when(status.isin("not_detected", "not_detected_at_resolved_signal"), 0)
    assessed = status.isin(*(s for s, meaning in STATES.items() if meaning == "assessed"))
    inference = F.when(~few & assessed, "assessed").otherwise("unknown")
    why = F.when(few, "insufficient_unique_mappability_for_b2").when(assessed, "provisional_detection_profile").otherwise(reason)
    return F.struct(F.lit(p.profile_id).alias("profile_id"), status.alias("detection_status"), value.alias("value"), reason.alias("reason"), inference.alias("inference_status"), why.alias("inference_reason"))


def detect(measurements: DataFrame, profiles: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of each measurement with its state under each profile, in one pass: a profile is columns, not a join.

    Measurements: measurement_status, reason, assessable_length, mappability_status, unique_mappability, informative_status,
    informative_length, the three breadths, two depths, assigned and ambiguous fragment counts. Nulls meet no threshold. Profiles
    with a fault are refused; there are at most ``MOST_PROFILES``.
    """
    faults = profile_faults(profiles).limit(5).collect()
    if faults:
        raise ValueError("profiles that can't be used: " + ", ".join(f"{r.profile_id} ({r.fault})" for r in faults))
    rows = profiles.limit(MOST_PROFILES + 1).collect()
    if len(rows) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    if not rows:
        raise ValueError("no profile")
    return measurements.select(*keep, F.explode(F.array(*map(state, rows))).alias("_s")).select(*keep, "_s.*")


def in_scope(rows: DataFrame, occurrences: DataFrame, key: str, scope: Column) -> DataFrame:
    """The rows of which any occurrence (``key`` and what ``scope`` asks for) is in scope."""
    return rows.hint("shuffle_merge").join(occurrences.where(scope).select(key).distinct(), key, "left_semi")


def catalogue_scope(name: str, kind: Column, resolved: Column) -> Column:
    """Whether an occurrence counts in a catalogue: virome (from particles), host_resolved (from a genome whose host is
    resolved), combined (either). Null is not in scope."""
    virome, host = kind == "virome", (kind == "genome") & F.coalesce(resolved, F.lit(False))
    return F.coalesce({"virome": virome, "host_resolved": host, "combined": virome | host}[name], F.lit(False))
