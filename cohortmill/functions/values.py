"""Row-level expressions on values: missing tokens, ladders, reasons, ranges, states, small statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, by vocabulary.
MISSING = {
    "study": ("", "unknown", "na", "nan", "none", "null"),
    "archive": ("", "missing", "not provided", "not collected", "not applicable", "unknown", "na", "n/a", "not available", "not determined"),
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullify(c: str | Column, vocabulary: str = "study") -> Column:
    """The trimmed text, null where it is a missing token."""
    text = F.trim(col(c))
    return F.when(~F.lower(text).isin(*MISSING[vocabulary]), text)


def number(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """The text as a finite double within [low, high], else null."""
    x = F.expr("try_cast(null as double)") if c is None else nullify(c).try_cast("double")
    ok = ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = ok & (x >= low) if low is not None else ok
    ok = ok & (x <= high) if high is not None else ok
    return F.when(ok, x)


def in_range(c: str | Column, low: float, high: float) -> Column:
    """True for finite values in [low, high]; false for others and for null."""
    x = col(c).cast("double")
    return F.coalesce(~F.isnan(x) & x.between(low, high), F.lit(False))


def ladder(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = reduce(lambda acc, r: acc.when(r[0], r[1]) if acc is not None else F.when(r[0], r[1]), rules, None)
    return out.otherwise(otherwise)


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """Labels of all rules that hold, joined by ';' in their order; empty where none does."""
    return F.concat_ws(";", *(F.when(cond, label) for cond, label in rules))


def tri_or(c: str | Column) -> Column:
    """Aggregate over rows: true if any is true, else null (unknown) if any is null, else false."""
    x = col(c)
    return F.when(F.max(F.when(x, 1).otherwise(0)) == 1, True).when(F.max(F.when(x.isNull(), 1).otherwise(0)) == 0, False)


def both_sides(a: str | Column, b: str | Column) -> Column:
    """Two-sided evidence, stricter than AND: true and false only if both sides say so, else unknown."""
    x, y = col(a), col(b)
    return F.when(x & y, True).when(~x & ~y, False)


def wilson(k: str | Column, n: str | Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null where n is 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    mid, base = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / base, (mid + half) / base


def rpkm(count: str | Column, length: str | Column, total: str | Column) -> Column:
    """Fragments per kilobase and million; null where length or total is 0."""
    return col(count) * 1e9 / F.nullif(col(length).cast("double") * col(total).cast("double"), F.lit(0.0))


def cohen_d(mean1: str | Column, sd1: str | Column, mean2: str | Column, sd2: str | Column) -> Column:
    """Difference of means over the pooled standard deviation; 0 where both are constant and equal, null if they differ."""
    pooled = F.sqrt((col(sd1) * col(sd1) + col(sd2) * col(sd2)) / 2)
    diff = col(mean1) - col(mean2)
    return F.when(pooled > 0, diff / pooled).when(diff == 0, 0.0)


def set_join(c: str | Column, separators: str = r"[;,\s]+") -> Column:
    """A list cell as its sorted distinct members, joined by ';'."""
    parts = F.filter(F.split(col(c), separators), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), ";")


def detection_state(breadth: Column, depth: Column, assigned: Column, ambiguous: Column, breadth_min: Column | float, depth_min: float = 0.0, assigned_min: int = 1) -> Column:
    """detected, not_resolvable (signal there, but shared), not_detected, or not_assessed (nothing measured)."""
    return ladder(
        [(breadth.isNull(), "not_assessed"), ((breadth >= breadth_min) & (depth >= depth_min) & (assigned >= assigned_min) & (ambiguous * 2 <= assigned), "detected"), ((breadth >= breadth_min) & (ambiguous * 2 > assigned), "not_resolvable")],
        "not_detected",
    )


def carriage(qualified: Column, conditions: Sequence[tuple[Column, str]]) -> tuple[Column, Column]:
    """(call, reasons): present where there is a qualified member; absent only where every condition holds; else unknown with
    the conditions that fail or are null."""
    missing = reasons([(~F.coalesce(ok, F.lit(False)), name) for ok, name in conditions])
    there = F.coalesce(qualified, F.lit(False))
    return F.when(there, "present").when(missing == "", "absent_assessable").otherwise("unknown"), F.when(there, "").otherwise(missing)


def canonical_json(m: str | Column) -> Column:
    """A map of text as JSON with its keys in order: equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(m)))))


def covariate_fault(text: str | Column, kinds: dict[str, str]) -> Column:
    """Why a JSON cell does not hold exactly the declared covariates: not an object, keys (missing or more than ``kinds`` names, or
    one twice), or the names of values that are none of their kind (number, text; null is allowed); else empty."""
    c = col(text)
    keys = F.json_object_keys(c)
    m = F.from_json(c, "map<string, string>")
    whole = F.array_sort(keys) == F.array(*(F.lit(k) for k in sorted(kinds)))
    wrong = F.concat_ws(";", *(F.when(m[k].isNotNull() & (m[k] != "null") & m[k].try_cast("double").isNull(), F.lit(k)) for k, kind in sorted(kinds.items()) if kind == "number"))
    return F.when(keys.isNull() | m.isNull(), "not an object").when(~whole, "keys").otherwise(wrong)


def value_fault(status: Column, value: Column, unit: Column) -> Column:
    """Which rule between a value, its status and its unit is broken, else empty: value_without_assessment, assessed_without_value,
    not_binary, not_a_count, not_a_fraction, not_finite, unknown_unit."""
    known = value.isNotNull()
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return ladder([
        (known & (status != "assessed"), "value_without_assessment"), (~known & (status == "assessed"), "assessed_without_value"), (known & ~finite, "not_finite"),
        (known & (unit == "binary") & ~value.isin(0.0, 1.0), "not_binary"), (known & (unit == "count") & ((value < 0) | (value != F.floor(value))), "not_a_count"),
        (known & (unit == "fraction") & ~value.between(0, 1), "not_a_fraction"), (known & ~unit.isin("binary", "count", "fraction", "number"), "unknown_unit")], "")


def better_label(a: Column, b: Column, label_a: str, label_b: str, margin: float = 0.0) -> Column:
    """The label of the greater of two probabilities; unknown where they are no more than ``margin`` apart, or one is no probability."""
    good = F.coalesce(a.between(0, 1) & b.between(0, 1), F.lit(False))
    return ladder([(~good, "unknown"), (a - b > margin, label_a), (b - a > margin, label_b)], "unknown")


def packed(columns: Sequence[str], suffix: str) -> Column:
    """The columns that end in ``suffix`` and are not null, as JSON by their names without it, in order; null where there is none."""
    own = sorted(c for c in columns if c.endswith(suffix))
    m = F.map_filter(F.create_map(*(x for c in own for x in (F.lit(c.removesuffix(suffix)), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
    return F.when(F.size(m) > 0, F.to_json(m)) if own else F.lit(None).cast("string")


# How traces write units of time (milliseconds) and of size (bytes).
TIMES = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
SIZES = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def milliseconds(text: str | Column) -> Column:
    """A duration such as '1h 2m 3.5s' or '250ms' in milliseconds; null where it is none."""
    t = F.trim(col(text))
    parts = F.split(t, r"\s+")
    one = lambda x: F.regexp_extract(x, "^([0-9.]+)", 1).try_cast("double") * _unit(F.regexp_extract(x, "([a-zA-Z]+)$", 1), TIMES)
    return F.when(t.rlike(r"^([0-9]+(\.[0-9]+)?(ms|s|m|h|d))(\s+[0-9]+(\.[0-9]+)?(ms|s|m|h|d))*$"), F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + one(x))).cast("long"))


def bytes_of(text: str | Column) -> Column:
    """A size such as '1.5 GB' in bytes; null where it is none."""
    t = F.trim(col(text))
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)? ?(B|KB|MB|GB|TB)$"), F.round(F.regexp_extract(t, "^([0-9.]+)", 1).try_cast("double") * _unit(F.regexp_extract(t, "([A-Z]+)$", 1), SIZES)).cast("long"))


def _unit(name: Column, table: dict[str, int]) -> Column:
    return reduce(lambda acc, kv: acc.when(name == kv[0], F.lit(float(kv[1]))), list(table.items())[1:], F.when(name == next(iter(table)), F.lit(float(next(iter(table.values()))))))
