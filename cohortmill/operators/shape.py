"""Relational joins with explicit missing states, set operations and changes of shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt

def rectangle(df: DataFrame, row: Sequence[str], column: Sequence[str], status: str = "status") -> DataFrame:
    """Every row key with every column key; absent cells become rows with status ``not_assessed`` and null values.

    The result is as large as the rectangle by definition; the smaller key list is the broadcast side only if it is small
    by Spark's own size check.
    """
    rows, columns = df.select(*row).distinct(), df.select(*column).distinct()
    cells = rows.crossJoin(columns)
    df = df.withColumn(status, F.lit("assessed"))
    return cells.hint("shuffle_merge").join(df, [*row, *column], "left").withColumn(status, F.coalesce(status, F.lit("not_assessed")))


def left_with_default(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    out = left.join(right, list(on), "left")
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), value))
    return out


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left, right and finding: left_only, right_only, differs or equal (null equals null)."""
    a = left.select(key, F.col(value).alias("left_value"), F.lit(1).alias("_l"))
    b = right.select(key, F.col(value).alias("right_value"), F.lit(1).alias("_r"))
    both = a.hint("shuffle_merge").join(b, key, "full_outer")
    finding = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("left_value").eqNullSafe(F.col("right_value")), "equal").otherwise("differs")
    return both.select(key, "left_value", "right_value", finding.alias("finding"))


def union_strict(*tables: DataFrame) -> DataFrame:
    """Union of tables with the same columns and types; anything else is an error."""
    want = {f.name: f.dataType for f in tables[0].schema}
    for t in tables[1:]:
        if {f.name: f.dataType for f in t.schema} != want:
            raise ValueError(f"schemas differ: {tables[0].schema.simpleString()} and {t.schema.simpleString()}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def merge_guarded(df: DataFrame, key: str, agree: Sequence[str], collect: str) -> DataFrame:
    """One row per key whose rows agree in all of ``agree``: key, agreed values, sorted members, n; conflict names the
    columns that do not agree (their values are then null)."""
    aggs = [F.when(F.count_distinct(c) <= 1, F.max(c)).alias(c) for c in agree]
    conflict = F.concat_ws(";", *(F.when(F.count_distinct(c) > 1, F.lit(c)) for c in agree))
    return df.groupBy(key).agg(*aggs, conflict.alias("conflict"), F.array_join(F.array_sort(F.collect_set(F.col(collect).cast("string"))), ";").alias("members"), F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both with ``action``: kept (old only, or equal in both), added (new only) or refused (both, but different)."""
    values = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*values).alias("o"))
    b = new.select(key, F.struct(*values).alias("n"))
    both = a.hint("shuffle_merge").join(b, key, "full_outer")
    action = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull() | F.col("o").eqNullSafe(F.col("n")), "kept").otherwise("refused")
    return both.select(key, F.coalesce("o", "n").alias("v"), action.alias("action")).select(key, "v.*", "action")


def distinct_members(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """keys, n_members and the sorted members joined by ';'."""
    return df.groupBy(*keys).agg(F.count_distinct(member).alias("n_members"), F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ";").alias("members"))


def divides(owned: DataFrame, required: DataFrame, owner: str, item: str, group: str) -> DataFrame:
    """Relational division: (owner, group) where the owner has every required item of the group."""
    need = required.select(group, item).distinct()
    size = need.groupBy(group).agg(F.count("*").alias("n_required"))
    have = owned.select(owner, item).distinct().hint("shuffle_merge").join(need, item).groupBy(owner, group).agg(F.count("*").alias("n_owned"))
    return have.hint("shuffle_merge").join(size, group).where("n_owned = n_required").select(owner, group)


def entity_levels(sheet: DataFrame, levels: Sequence[tuple[str, str, Sequence[str]]], rows: int | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(one table per level of a flat sheet: id, parent id, attributes; the conflicts: level, id, column, n_values).

    ``levels``: (name, id column, attribute columns) from the outermost inwards, such as sample, library, readset; the id of
    the level before is the parent. An id with several parents or several values of an attribute (null is a value) is a
    conflict, and its smallest value stands in the table. Rows with a null id make no entity; a conflict is a row, so a
    caller may refuse the sheet or set those ids aside. ``rows``: of the sheet, where they are known; a level is then dealt over
    tasks by its id, so that a task holds no more of a larger sheet.
    """
    tables, wrong, parent, nested = {}, None, None, {c for c, t in sheet.dtypes if t.startswith(("array", "map", "struct"))}
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v"))) if c in nested else F.col(c).cast("string")
    for name, key, attributes in levels:
        columns = ([parent] if parent else []) + list(attributes)
        own = sheet.where(F.col(key).isNotNull())
        if rows is not None:
            own = dealt(own.select(key, *columns), rows, key)
        tables[name] = own.groupBy(key).agg(*(F.min(c).alias(c) for c in columns))
        # cells made distinct: a row for each value of an id, null being one
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), text(c).alias("v")) for c in columns)))
        values = own.select(key, cells.alias("_c")).select(key, "_c.*").distinct().groupBy(key, "column").agg(F.count("*").alias("n_values")).where("n_values > 1")
        bad = values.select(F.lit(name).alias("level"), F.col(key).cast("string").alias("id"), "column", "n_values")
        wrong = bad if wrong is None else wrong.unionByName(bad)
        parent = key
    return tables, wrong


def merged_units(units: DataFrame, mapping: DataFrame, unit: str, same: Sequence[str], group: str = "merge_id") -> tuple[DataFrame, DataFrame]:
    """(unit_id, unit for every unit, merged or by itself; the mapping rows refused, with why).

    A group of ``mapping`` (group, unit) is refused whole, and its units stay by themselves, where one of its units is unknown,
    stands in the mapping twice, differs in a column of ``same`` (nulls are equal), or where the group has a unit's name.
    """
    m = mapping.select(F.col(group).cast("string").alias("g"), F.col(unit).alias("u"))
    often = m.groupBy("u").agg(F.count("*").alias("_k"))
    known = units.select(F.col(unit).alias("v"), F.to_json(F.struct(*same)).alias("_same"))
    rows = m.hint("shuffle_merge").join(often, "u").hint("shuffle_merge").join(known, F.col("u") == F.col("v"), "left")
    names = units.select(F.col(unit).cast("string").alias("g")).distinct().withColumn("_name", F.lit(True))
    g = rows.groupBy("g").agg(F.max(F.when(F.col("v").isNull(), 1).otherwise(0)).alias("lost"), F.max("_k").alias("k"), F.count_distinct("_same").alias("n")).hint("shuffle_merge").join(names, "g", "left")
    why = F.when(F.col("_name"), "name_taken").when(F.col("lost") == 1, "unknown_unit").when(F.col("k") > 1, "unit_twice").when(F.col("n") > 1, "not_compatible").otherwise("")
    judged = m.distinct().hint("shuffle_merge").join(g.select("g", why.alias("why")), "g")
    good = judged.where("why = ''").select("g", F.col("u").alias("v"))
    out = units.select(unit).hint("shuffle_merge").join(good, F.col(unit) == F.col("v"), "left")
    return out.select(F.coalesce("g", F.col(unit).cast("string")).alias("unit_id"), unit), judged.where("why <> ''").select(F.col("g").alias(group), F.col("u").alias(unit), "why")


def matrix(df: DataFrame, row: Sequence[str], column: str, value: str, most: int = 10_000) -> DataFrame:
    """A wide table with a column for each value of ``column``, in their order; empty cells are null, null names are left out.

    Names are found first (one row a name reaches the driver) and then passed to the pivot. A table of more than ``most``
    columns is refused: keep such a matrix long (``write_table`` sorts it by row and column).
    """
    names = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    return df.groupBy(*row).pivot(column, sorted(names)).agg(F.max(value)) if names else df.select(*row).distinct()


def merge_occurrences(df: DataFrame, key: str, least: Sequence[str] = (), most: Sequence[str] = (), single: Sequence[str] = (), conflict: str = "conflict") -> DataFrame:
    """One row for each key, as careful as its rows allow: the ``least`` columns' minima and the ``most`` columns' maxima, null where
    any row's is; ``single`` columns' value where all rows that have one agree, else ``conflict``; n_occurrences."""
    whole = lambda c, f: F.when(F.count("*") == F.count(c), f(c)).alias(c)
    one = lambda c: F.when(F.count_distinct(c) > 1, conflict).otherwise(F.max(F.col(c).cast("string"))).alias(c)
    return df.groupBy(key).agg(*(whole(c, F.min) for c in least), *(whole(c, F.max) for c in most), *(one(c) for c in single), F.count("*").alias("n_occurrences"))


def evidence_counts(tables: dict[str, tuple[DataFrame, Column, Column]], key: str = "key", category: str = "category") -> DataFrame:
    """key, category, n_features (distinct) and sources (which tables, in order) of set features from several tables: name to (table,
    key, feature); the category is the feature's text up to a colon."""
    rows = [t.select(k.cast("string").alias(key), f.cast("string").alias("_f"), F.lit(name).alias("_source")).where("_f is not null").distinct() for name, (t, k, f) in tables.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    g = every.groupBy(key, F.substring_index("_f", ":", 1).alias(category)).agg(F.count_distinct("_f").alias("n_features"), F.array_sort(F.collect_set("_source")).alias("_s"))
    return g.select(key, category, "n_features", F.array_join("_s", ";").alias("sources"))
