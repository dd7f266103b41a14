"""Data-quality checks: each returns the violations as a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or have a null part: keys, n."""
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | missing)


def missing_references(df: DataFrame, column: str, target: DataFrame, key: str, required: bool = False) -> DataFrame:
    """Rows whose reference has no target; with ``required``, null references too."""
    lost = df.hint("shuffle_merge").join(target.select(F.col(key).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_anti")
    return lost if required else lost.where(F.col(column).isNotNull())


def unequal_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: key, side."""
    a = left.select(F.col(key).alias("l")).distinct()
    b = right.select(F.col(key).alias("r")).distinct()
    both = a.hint("shuffle_merge").join(b, F.col("l") == F.col("r"), "full_outer").where("l is null or r is null")
    return both.select(F.coalesce("l", "r").alias(key), F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def dependency_conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with several values: keys, n_values."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def incomplete_rectangle(df: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row (n_rows, n_columns, n_cells, n_expected) if the cells are fewer than rows times columns."""
    r, c = F.struct(*rows), F.struct(*columns)
    out = df.agg(F.count_distinct(r).alias("n_rows"), F.count_distinct(c).alias("n_columns"), F.count_distinct(F.struct(*rows, *columns)).alias("n_cells"))
    return out.withColumn("n_expected", F.col("n_rows") * F.col("n_columns")).where("n_cells <> n_expected")


def recomputed_differs(df: DataFrame, stored: str, computed: Column, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose stored value is not what the formula gives; null equals null only."""
    x, y = F.col(stored), F.col("recomputed")
    return df.withColumn("recomputed", computed).where((x.isNull() != y.isNull()) | (F.abs(x - y) > tolerance))


def split_leaks(df: DataFrame, subject: str, role: str, one: str, other: str) -> DataFrame:
    """Subjects found in both roles."""
    return df.groupBy(subject).agg(F.max(F.when(F.col(role) == one, 1).otherwise(0)).alias("a"), F.max(F.when(F.col(role) == other, 1).otherwise(0)).alias("b")).where("a = 1 and b = 1").select(subject)


def unbalanced(df: DataFrame, keys: Sequence[str], total: str, parts: Sequence[str]) -> DataFrame:
    """Keys at which the sums of the parts are not the sum of the total."""
    whole = sum((F.sum(p) for p in parts[1:]), F.sum(parts[0]))
    return df.groupBy(*keys).agg(F.sum(total).alias("total"), whole.alias("parts")).where("total <> parts")


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, digest): equal for equal rows in any order; sums of row hashes as decimals."""
    h = F.xxhash64(*(F.col(c) for c in sorted(df.columns)))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))


def content_digest(df: DataFrame) -> DataFrame:
    """(n_rows, digest) of a table of text, whole numbers and booleans, as any engine can compute it: the sum of the first 60 bits of
    each row's MD5, over its columns by name as text (null as a letter of its own), joined by a unit separator. Rows may come in
    any order, and a repeated row counts again."""
    row = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in sorted(df.columns)))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.conv(F.left(F.md5(row), F.lit(15)), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def verify_content(df: DataFrame, n_rows: int, digest: str) -> None:
    """Stop where a table is not what was recorded of it."""
    found = content_digest(df).first()
    if (found.n_rows, found.digest) != (n_rows, digest):
        raise ValueError(f"the table has changed: {n_rows} rows with digest {digest} were recorded, {found.n_rows} with {found.digest} are there")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: a row for each named rule that a row breaks; a condition that is null is not broken."""
    broken = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def run_states(df: DataFrame, key: str, status: str, value: str) -> DataFrame:
    """key, rule: values that their run's state does not allow. A failed or missing run has none, and a zero, which says that nothing
    was found, needs a completed run; a completed run has a value."""
    s, v = F.coalesce(F.col(status), F.lit("missing")), F.col(value)
    return violations(df, key, {
        "zero_without_completed_run": (v == 0) & (s != "completed"), "value_without_completed_run": (v != 0) & (s != "completed"), "completed_without_value": v.isNull() & (s == "completed"), "unknown_state": ~s.isin("completed", "failed", "missing")})


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per named check: code, n_violations."""
    parts = [df.agg(F.count("*").alias("n_violations")).select(F.lit(code).alias("code"), "n_violations") for code, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)
