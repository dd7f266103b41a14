"""Aggregated evidence: confusion tables, presence, quorum and best references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.shared import dealt


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def confusion(df: DataFrame, keys: Sequence[str], truth: str = "truth", found: str = "detection_status") -> DataFrame:
    """tp, fp, fn, tn, unassessable (known truth, no call) and unknown_truth per key."""
    t, f = F.col(truth), F.col(found)
    return df.groupBy(*keys).agg(
        count_if((t == "1") & (f == "detected")).alias("tp"), count_if((t == "0") & (f == "detected")).alias("fp"), count_if((t == "1") & (f == "not_detected")).alias("fn"),
        count_if((t == "0") & (f == "not_detected")).alias("tn"), count_if((t != "unknown") & (f == "not_resolvable")).alias("unassessable"), count_if(t == "unknown").alias("unknown_truth"))


def presence(counts: DataFrame, rows: DataFrame, columns: DataFrame, row: Sequence[str], column: Sequence[str]) -> DataFrame:
    """n and state (present, absent) for every row and column of the two key lists."""
    cells = rows.crossJoin(columns).hint("shuffle_merge").join(counts, [*row, *column], "left")
    return cells.select(*row, *column, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "absent").otherwise("present").alias("state"))


def core_groups(df: DataFrame, group: str, unit: str, most_copies: int) -> DataFrame:
    """group, units that have it and the most copies in one unit, for groups within ``most_copies``."""
    copies = df.groupBy(group, unit).agg(F.count("*").alias("c"))
    return copies.groupBy(group).agg(F.count("*").alias(f"n_{unit}s"), F.max("c").alias("most_copies")).where(F.col("most_copies") <= most_copies)


def quorum(df: DataFrame, keys: Sequence[str], role: str, mandatory: Sequence[str], forbidden: Column) -> DataFrame:
    """Keys that have every mandatory role and no forbidden row."""
    have = F.count_distinct(F.when(F.col(role).isin(*mandatory), F.col(role)))
    return df.groupBy(*keys).agg(have.alias("have"), count_if(forbidden).alias("bad")).where((F.col("have") == len(mandatory)) & (F.col("bad") == 0)).select(*keys)


def best_reference(df: DataFrame, key: str, reference: str, score: str, least: float) -> DataFrame:
    """decision (none, one, several references above the threshold) and the best of them, ties to the smaller name."""
    ok = F.col(score) > least
    n = F.count_distinct(F.when(ok, F.col(reference)))
    best = F.max(F.when(ok, F.struct(F.col(score).alias("s"), (-F.col(reference)).alias("r")))).getField("r")
    return df.groupBy(key).agg(F.when(n == 0, "none").when(n == 1, "one").otherwise("several").alias("decision"), (-best).alias("best"))


def systems(hits: DataFrame, parts: DataFrame, needs: DataFrame, unit: str, cluster: str, model: str = "model", family: str = "family") -> DataFrame:
    """model, unit, cluster, n_mandatory, n_genes, n_forbidden, accepted: clusters of hits that fill a model's quorum.

    ``parts``: model, family, role (mandatory, accessory, neutral, forbidden), loner. ``needs``: model, min_mandatory,
    min_genes. A loner's hit anywhere in a unit counts in each of the unit's clusters. Families are counted, not hits, and a
    unit's loner families are made distinct before they meet its clusters. Hits with a null cluster belong to no cluster.
    """
    known = hits.select(model, unit, cluster, family).distinct().hint("shuffle_merge").join(parts.select(model, family, "role", "loner"), [model, family])
    own = known.where(F.col(cluster).isNotNull()).select(model, unit, cluster, family, "role")
    alone = known.where("loner").select(model, unit, family, "role").distinct()
    added = own.select(model, unit, cluster).distinct().hint("shuffle_merge").join(alone, [model, unit])
    of = lambda *roles: F.count_distinct(F.when(F.col("role").isin(*roles), F.col(family)))
    g = own.unionByName(added).groupBy(model, unit, cluster).agg(of("mandatory").alias("n_mandatory"), of("mandatory", "accessory").alias("n_genes"), of("forbidden").alias("n_forbidden"))
    ok = (F.col("n_forbidden") == 0) & (F.col("n_mandatory") >= F.col("min_mandatory")) & (F.col("n_genes") >= F.col("min_genes"))
    return g.hint("shuffle_merge").join(needs.select(model, "min_mandatory", "min_genes"), model).select(model, unit, cluster, "n_mandatory", "n_genes", "n_forbidden", ok.alias("accepted"))


def _apart(df: DataFrame, *columns: str) -> Column:
    """A struct for each of ``columns`` that holds this column only: distinct values of several columns in one grouping."""
    kinds = dict(df.dtypes)
    return F.array(*(F.struct(*((F.col(c) if c == own else F.lit(None).cast(kinds[c])).alias(c) for c in columns)) for own in columns))


def required_members(members: DataFrame, needs: DataFrame, system: str = "system", member: str = "member", family: str = "family", role: str = "role", rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(system, rule, n_required; the members required of each system).

    Mandatory members are required. Accessory ones are only if the system has exactly as many accessory families as its quorum
    lacks: of more, no choice is made. ``needs``: system, min_mandatory, min_genes. A null role leaves the system unresolved.
    Members are shuffled once, by system, over more tasks the more ``rows`` there are.
    """
    mandatory, accessory = F.col(role) == "mandatory", F.col(role) == "accessory"
    flag = lambda c: F.when(c, 1).otherwise(0)
    own = members.select(system, member, family, flag(mandatory).alias("_m"), flag(accessory).alias("_a"))
    own = own.repartition(system) if rows is None else dealt(own, rows, system)
    # families and members of a system are made distinct where its rows lie
    each = own.select(system, "_m", "_a", F.explode(_apart(own, family, member)).alias("_v")).groupBy(system, "_v").agg(F.max("_m").alias("m"), F.max("_a").alias("a"), F.max(F.greatest("_m", "_a")).alias("b"), F.min(F.greatest("_m", "_a")).alias("known"))
    of = lambda c, k: F.sum(F.when(F.col(f"_v.{c}").isNotNull(), F.col(k)).otherwise(0))
    g = each.groupBy(system).agg((F.min("known") == 0).alias("odd"), of(family, "m").alias("m"), of(family, "a").alias("a"), of(member, "m").alias("nm"), of(member, "b").alias("nb"))
    g = g.hint("shuffle_merge").join(needs.select(system, "min_mandatory", "min_genes"), system)
    lack = F.greatest(F.lit(0), F.col("min_genes") - F.col("m"))
    bad = F.col("odd") | (F.col("m") < F.col("min_mandatory"))
    rule = (
        F.when(bad, "unresolved_role_or_mandatory").when((lack > 0) & (F.col("a") != lack), "unresolved_accessory_choice").when(lack > 0, "mandatory_and_needed_accessory")
        .when(F.col("nm") == 0, "unresolved_empty").otherwise("mandatory")
    )
    g = g.withColumn("rule", rule)
    both = F.col("rule") == "mandatory_and_needed_accessory"
    summary = g.select(system, "rule", F.when(both, F.col("nb")).otherwise(F.col("nm")).alias("n_required"))
    named = members.select(system, member, role).hint("shuffle_merge").join(g.select(system, both.alias("_both")), system)
    return summary, named.where(mandatory | (accessory & F.col("_both"))).select(system, member).distinct()


def feature_proportions(members: DataFrame, features: DataFrame, cluster: str = "cluster", member: str = "member", feature: str = "feature") -> DataFrame:
    """cluster, feature, n_members, n_present, n_absent_assessable, n_unknown, of_assessable, of_all for each feature found in a
    cluster. ``members``: cluster, member, assessable (whether a missing feature means that it is absent), one row a member.

    Absent and unknown members are totals less those present, so no member is paired with every feature. A feature not found in
    a cluster has no row: there n_present is 0 and every assessable member absent.
    """
    sure = F.coalesce("assessable", F.lit(False))
    m = members.select(cluster, member, sure.alias("_sure")).where(F.col(cluster).isNotNull())
    total = m.groupBy(cluster).agg(F.count("*").alias("n_members"), count_if(F.col("_sure")).alias("_s"))
    has = m.hint("shuffle_merge").join(features.select(member, feature).distinct(), member)
    g = has.groupBy(cluster, feature).agg(F.count("*").alias("n_present"), count_if(F.col("_sure")).alias("_p"))
    g = g.hint("shuffle_merge").join(total, cluster).withColumn("n_absent_assessable", F.col("_s") - F.col("_p"))
    known = F.col("n_present") + F.col("n_absent_assessable")
    return g.select(cluster, feature, "n_members", "n_present", "n_absent_assessable", (F.col("n_members") - known).alias("n_unknown"), (F.col("n_present") / known).alias("of_assessable"), (F.col("n_present") / F.col("n_members")).alias("of_all"))


def occurrence_rollup(rows: DataFrame, cluster: str, first: Column, second: Column, marker: str, sequence: str, donor: str, labels: tuple[str, str, str, str]) -> DataFrame:
    """Per cluster: how many occurrences of the ``first`` and the ``second`` kind, the three-valued marker over those of the
    second, distinct sequences and donors of the second kind, and a label: second with marker, second, first only, neither."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    m = F.col(marker)
    yes, unknown = count_if(b & m), count_if(b & m.isNull())
    found = F.when(yes > 0, True).when((unknown == 0) & (count_if(b) > 0), False)
    g = rows.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.count("*").alias("n"), count_if(a).alias("n_first"), count_if(b).alias("n_second"), yes.alias("n_marked"), found.alias("marker"), F.count_distinct(sequence).alias("n_sequences"),
        F.count_distinct(F.when(b, F.col(donor))).alias("n_donors"))
    label = F.when(F.coalesce("marker", F.lit(False)), labels[0]).when(F.col("n_second") > 0, labels[1]).when(F.col("n_first") > 0, labels[2]).otherwise(labels[3])
    return g.withColumn("label", label)


def confusion_rates(df: DataFrame, keys: Sequence[str], truth: str = "truth", found: str = "detection_status") -> DataFrame:
    """``confusion`` with sensitivity, specificity and the ends of their 95 % Wilson intervals; null without any case of a kind."""
    c = confusion(df, keys, truth, found)
    share = lambda k, n: F.col(k) / F.nullif(n, F.lit(0))
    positive, negative = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    sense, spec = V.wilson("tp", F.nullif(positive, F.lit(0))), V.wilson("tn", F.nullif(negative, F.lit(0)))
    return c.select("*", share("tp", positive).alias("sensitivity"), sense[0].alias("sensitivity_low"), sense[1].alias("sensitivity_high"), share("tn", negative).alias("specificity"), spec[0].alias("specificity_low"), spec[1].alias("specificity_high"))


def core_selection(genes: DataFrame, group: str, unit: str, units: DataFrame, least: float) -> DataFrame:
    """group, n_units, presence_fraction (of all ``units``), most_copies and status of every group: selected_single_copy,
    paralog_present (a unit has several) or below_presence."""
    copies = genes.groupBy(group, unit).agg(F.count("*").alias("c"))
    g = copies.groupBy(group).agg(F.count("*").alias("n_units"), F.max("c").alias("most_copies"))
    g = g.crossJoin(F.broadcast(units.select(unit).distinct().agg(F.count("*").alias("_all"))))  # one row
    status = V.ladder([(F.col("most_copies") > 1, "paralog_present"), (F.col("n_units") < least * F.col("_all"), "below_presence")], "selected_single_copy")
    return g.select(group, "n_units", (F.col("n_units") / F.col("_all")).alias("presence_fraction"), "most_copies", status.alias("status"))


def carriers(owned: DataFrame, required: DataFrame, members: DataFrame, member: str, item: str, group: str, module: str) -> DataFrame:
    """module, group: the groups every one of whose members (``members``: group, member) owns every required item of the module."""
    need = required.select(module, item).distinct()
    size = need.groupBy(module).agg(F.count("*").alias("_needed"))
    all_members = members.select(group, member).distinct()
    whole = all_members.groupBy(group).agg(F.count("*").alias("_members"))
    have = owned.select(member, item).distinct().hint("shuffle_merge").join(need, item).groupBy(member, module).agg(F.count("*").alias("_have"))
    full = have.hint("shuffle_merge").join(size, module).where("_have = _needed").select(member, module)
    met = full.hint("shuffle_merge").join(all_members, member).groupBy(module, group).agg(F.count("*").alias("_full"))
    return met.hint("shuffle_merge").join(whole, group).where("_full = _members").select(module, group)


def module_signal(signals: DataFrame, carrying: DataFrame, keys: Sequence[str], module: str, group: str, denominators: Sequence[str], exposure: str = "exposure", value: str = "value", status: str = "status") -> DataFrame:
    """keys, module, n_groups, status, reason, value (1 if any carrying group is detected), exposure (their sum).

    unassessable, with value and exposure null, where any carrying group is; a module whose groups do not agree in all
    ``denominators`` (nulls are a value) can't be summed and is unassessable too. Modules without a carrying group give no row.
    """
    met = signals.hint("shuffle_merge").join(carrying.select(module, group).distinct(), group)
    bad = F.max(F.when(F.coalesce(F.col(status) == "assessed", F.lit(False)), 0).otherwise(1)) == 1
    apart = F.count_distinct(F.to_json(F.struct(*denominators), {"ignoreNullFields": "false"})) > 1
    g = met.groupBy(*keys, module).agg(F.count("*").alias("n_groups"), bad.alias("_bad"), apart.alias("_apart"), F.max(F.when(F.col(value) == 1, 1).otherwise(0)).alias("_any"), F.sum(exposure).alias("_sum"))
    reason = V.ladder([(F.col("_apart"), "denominators_differ"), (F.col("_bad"), "one_or_more_carrier_groups_unassessable")], "")
    good = ~F.col("_apart") & ~F.col("_bad")
    return g.select(*keys, module, "n_groups", F.when(good, "assessed").otherwise("unassessable").alias("status"), reason.alias("reason"), F.when(good, F.col("_any")).alias("value"), F.when(good, F.col("_sum")).alias("exposure"))


def proven(rows: DataFrame, evidence: DataFrame, entity: str, kind: str, field: str, value: str, levels: Sequence[str] = ("A", "B")) -> DataFrame:
    """The rows for whose field and value there is accepted evidence (entity_type, entity_id, field, value, level, review_state) of
    one of ``levels``."""
    good = evidence.where((F.col("entity_type") == kind) & (F.col("field") == field) & F.col("level").isin(*levels) & (F.col("review_state") == "accepted"))
    good = good.select(F.col("entity_id").alias("_id"), F.col("value").alias("_value"))
    return rows.hint("shuffle_merge").join(good, (F.col(entity) == F.col("_id")) & (F.col(value) == F.col("_value")), "left_semi")


def member_counts(candidates: DataFrame, met: DataFrame, key: str, category: str, marker: str, systems: DataFrame | None = None, gene: str = "gene") -> DataFrame:
    """Per candidate: n_inside (members of ``met`` that lie fully inside), n_categories, n_markers (inside members with ``marker``),
    marker_share, and of ``systems`` (candidates' key, system, gene) best_overlap: the largest share of a system's genes inside.

    ``met``: key, gene, inside, category, marker. Candidates without members have zeros, and a null share.
    """
    inside = met.where("inside")
    each = inside.select(key, F.when(F.col(marker), 1).otherwise(0).alias("_k"), F.explode(_apart(inside, gene, category)).alias("_v")).groupBy(key, "_v").agg(F.max("_k").alias("_k"))
    g = each.groupBy(key).agg(F.count(f"_v.{gene}").alias("n_inside"), F.count(f"_v.{category}").alias("n_categories"), F.sum(F.when(F.col(f"_v.{gene}").isNotNull(), F.col("_k")).otherwise(0)).alias("n_markers"))
    out = candidates.select(key).distinct().hint("shuffle_merge").join(g, key, "left").na.fill(0, ["n_inside", "n_categories", "n_markers"])
    out = out.withColumn("marker_share", F.col("n_markers") / F.nullif(F.col("n_inside"), F.lit(0)))
    if systems is None:
        return out
    share = best_overlap(systems, inside, key, gene)
    return out.hint("shuffle_merge").join(share, key, "left").withColumn("best_overlap", F.coalesce("best_overlap", F.lit(0.0)))


def best_overlap(systems: DataFrame, inside: DataFrame, key: str, gene: str = "gene") -> DataFrame:
    """key, best_overlap of each key with systems (key, system, gene): the largest share of a system's genes among those of
    ``inside`` (key, gene)."""
    hit = systems.select(key, "system", gene).distinct().hint("shuffle_merge").join(inside.select(key, gene, F.lit(1).alias("_in")).distinct(), [key, gene], "left")
    return hit.groupBy(key, "system").agg((F.count("_in") / F.count("*")).alias("o")).groupBy(key).agg(F.max("o").alias("best_overlap"))


def linked_context(measured: DataFrame, links: DataFrame, labels: DataFrame, abundance: DataFrame, unit: str, key: str, taxon: str = "taxon") -> DataFrame:
    """A row for each measurement (unit, key and any other columns) and each taxon linked with its key, with n_taxa (of the key),
    label, resolution, abundance and context_status.

    ``links``: key, taxon, as often as a pair occurs (a null on either side is no link); ``labels``: taxon, label, resolution, one row a taxon; ``abundance``:
    unit, label, abundance, one row a cell. context_status: measured; unmeasured (the label has no row in this unit, or a null); no_label (the taxon has none). A missing
    abundance stays null and is never zero. Measurements of keys without links have no row: nothing is said of them.
    """
    pairs = links.where(F.col(key).isNotNull() & F.col(taxon).isNotNull()).select(key, taxon).distinct()
    n = pairs.groupBy(key).agg(F.count("*").alias("n_taxa"))
    named = pairs.hint("shuffle_merge").join(n, key).hint("shuffle_merge").join(labels.select(taxon, "label", "resolution"), taxon, "left")
    cells = measured.hint("shuffle_merge").join(named, key).hint("shuffle_merge").join(abundance.select(unit, "label", "abundance"), [unit, "label"], "left")
    status = V.ladder([(F.col("label").isNull(), "no_label"), (F.col("abundance").isNull(), "unmeasured")], "measured")
    return cells.withColumn("context_status", status)


def context_summary(context: DataFrame, unit: str, key: str, detected: Column, taxon: str = "taxon") -> DataFrame:
    """taxon, n_keys, n_detected (cells of unit and key with a detection), n_units, n_positive (units with an abundance above zero; null
    where one of the taxon's units is not measured). Units and cells are made distinct before they are counted."""
    cells = context.groupBy(taxon, unit, key).agg(F.max(F.when(detected, 1).otherwise(0)).alias("_d"), F.max("abundance").alias("_a"))
    by_unit = cells.groupBy(taxon, unit).agg(F.max("_a").alias("_a"))
    units = by_unit.groupBy(taxon).agg(F.count("*").alias("n_units"), F.when(F.count("*") == F.count("_a"), F.sum(F.when(F.col("_a") > 0, 1).otherwise(0))).alias("n_positive"))
    keys = cells.groupBy(taxon, key).agg(F.sum("_d").alias("_d")).groupBy(taxon).agg(F.count("*").alias("n_keys"), F.sum("_d").alias("n_detected"))
    return keys.hint("shuffle_merge").join(units, taxon)


def linked_summary(measured: DataFrame, links: DataFrame, labels: DataFrame, abundance: DataFrame, unit: str, key: str, detected: Column, taxon: str = "taxon") -> DataFrame:
    """``context_summary`` of ``linked_context`` over the same tables, without a row for each measurement and linked taxon.

    Detected cells are counted per key before keys meet their taxa. A key's taxa go with its units as one list, equal lists of a
    unit are one, and only then is a row made for each unit and taxon.
    """
    pairs = links.where(F.col(key).isNotNull() & F.col(taxon).isNotNull()).select(key, taxon).distinct()
    named = pairs.hint("shuffle_merge").join(labels.select(taxon, "label"), taxon, "left")
    lists = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(taxon, "label"))).alias("_taxa"))
    # dealt by key, so that cells are made distinct, counted and joined where they lie
    cells = measured.where(F.col(key).isNotNull()).select(key, unit, F.when(detected, 1).otherwise(0).alias("_d")).repartition(key).groupBy(key, unit).agg(F.max("_d").alias("_d"))
    counts = cells.groupBy(key).agg(F.sum("_d").alias("_d"))
    keys = counts.hint("shuffle_merge").join(pairs, key).groupBy(taxon).agg(F.count("*").alias("n_keys"), F.sum("_d").alias("n_detected"))
    met = cells.select(key, unit).hint("shuffle_merge").join(lists, key).select(unit, "_taxa").repartition(unit).distinct()
    by_unit = met.select(unit, F.explode("_taxa").alias("_t")).select(unit, "_t.*").distinct()
    by_unit = by_unit.hint("shuffle_merge").join(abundance.select(unit, "label", F.col("abundance").alias("_a")), [unit, "label"], "left")
    units = by_unit.groupBy(taxon).agg(F.count("*").alias("n_units"), F.when(F.count("*") == F.count("_a"), F.sum(F.when(F.col("_a") > 0, 1).otherwise(0))).alias("n_positive"))
    return keys.hint("shuffle_merge").join(units, taxon)
