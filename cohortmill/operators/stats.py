"""Exact two-group tests and family corrections over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stage

EXACT_TOTAL = 2000  # up to this many rows a table's weights are integers; above, logarithms of them


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p: the tables with the same margins that are no more probable. Weights are exact integers up to
    ``EXACT_TOTAL`` rows; above they are log-gamma sums, equal ones told by a relative margin of 1e-9."""
    top, left, n = a + b, a + c, a + b + c + d
    low, high = max(0, left - (n - top)), min(top, left)
    if n <= EXACT_TOTAL:
        weight = lambda x: comb(top, x) * comb(n - top, left - x)
        seen = weight(a)
        return sum(w for x in range(low, high + 1) if (w := weight(x)) <= seen) / comb(n, left)
    x = np.arange(low, high + 1)
    logs = -(_log_factorial(x) + _log_factorial(top - x) + _log_factorial(left - x) + _log_factorial(n - top - left + x))
    p = np.exp(logs - logs.max())
    return float(min(1.0, p[logs <= logs[a - low] + 1e-9].sum() / p.sum()))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log n! by Stirling's series, exact sums below 32."""
    small = np.cumsum(np.log(np.maximum(np.arange(32), 1)))
    x = np.maximum(n, 1) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 32, small[np.minimum(n, 31)], series)


def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_p(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str, name: str = "fisher_p") -> DataFrame:
    """Adds the p-value of each 2 x 2 table; each distinct table is computed once."""
    cells = [a, b, c, d]
    tables = df.select(*cells).dropna().distinct()
    p = tables.withColumn(name, F.pandas_udf(_fisher, "double")(*(F.col(x).cast("long") for x in cells)))
    return df.hint("shuffle_merge").join(p, cells, "left")


def doubled_mid_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank2") -> DataFrame:
    """Twice the mid-rank of the value within its key: exact integers under ties."""
    over = W.partitionBy(*keys).orderBy(value)
    ties = W.partitionBy(*keys, value)
    return df.withColumn(name, (2 * F.rank().over(over) + F.count("*").over(ties) - 1).cast("long"))


def cliffs_delta(ranked: DataFrame, keys: Sequence[str], case: Column) -> DataFrame:
    """keys, n1, n0, rank2_case, delta = 2 U / (n1 n0) - 1 from doubled mid-ranks."""
    one = F.when(case, 1).otherwise(0)
    sums = ranked.groupBy(*keys).agg(F.sum(one).alias("n1"), F.sum(1 - one).alias("n0"), F.sum(F.col("rank2") * one).alias("rank2_case"))
    u2 = F.col("rank2_case") - F.col("n1") * (F.col("n1") + 1)
    return sums.withColumn("delta", u2 / F.nullif(F.col("n1") * F.col("n0"), F.lit(0)) - 1)


def rank_sum_p(ranks: np.ndarray, n1: int, seen: int) -> float:
    """Share of all choices of n1 of the doubled mid-ranks whose sum is as far from its mean as ``seen``. The number of
    choices for each sum is counted row by row, so the work grows with n1 * n * sum and not with the choices."""
    n, total = len(ranks), int(ranks.sum())
    ways = np.zeros((n1 + 1, total + 1))
    ways[0, 0] = 1
    for r in ranks:
        r = int(r)
        ways[1:, r:] += ways[:-1, : total + 1 - r].copy()
    sums = np.arange(total + 1)
    far = np.abs(sums * n - total * n1) >= abs(seen * n - total * n1)
    return float(ways[n1, far].sum() / ways[n1].sum())


def _rank_sum(ranks: pd.Series, n1: pd.Series, seen: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else rank_sum_p(np.asarray(r), int(k), int(s)) for r, k, s in zip(ranks, n1, seen)], dtype="float64")


def rank_permutation(ranked: DataFrame, keys: Sequence[str], case: Column, most: int = 50) -> DataFrame:
    """keys and perm_p, the exact two-sided p of the rank sum over all assignments of the labels. Every key comes out; one
    of more than ``most`` rows has a null p (its counts would pass what a double holds exactly), and so has one without
    rows of either label."""
    one = F.when(case, 1).otherwise(0)
    rows = ranked.withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    rows = rows.groupBy(*keys).agg(F.collect_list(F.when(F.col("_n") <= most, F.col("rank2"))).alias("r"), F.sum(one).alias("n1"), F.count("*").alias("n"), F.sum(F.col("rank2") * one).alias("seen"))
    testable = (F.size("r") > 0) & (F.col("n1") > 0) & (F.col("n1") < F.col("n"))
    p = F.pandas_udf(_rank_sum, "double")(F.when(testable, F.col("r")), "n1", "seen")
    return rows.select(*keys, p.alias("perm_p"))


def compare_groups(df: DataFrame, feature: str, case: str, detected: str, value: str, least: int = 3) -> DataFrame:
    """One row for each feature of (feature, unit) rows: valid n, detected and medians of either group, differences, Cliff's
    delta, Fisher and rank-permutation p with a status each, and their q-values within their endpoint and over both.

    ``case`` is a boolean column; null ``detected`` or ``value`` is not assessed and never counts as 0. An endpoint with
    fewer than ``least`` valid units in a group has a null p and counts in no family.
    """
    c, seen, v = F.col(case), F.col(detected), F.col(value)
    n = lambda when: F.count(F.when(when, 1))
    out = df.groupBy(feature).agg(
        n(c & seen.isNotNull()).alias("case_detection_n"), n(~c & seen.isNotNull()).alias("control_detection_n"), n(c & seen).alias("case_detected"), n(~c & seen).alias("control_detected"),
        n(c & v.isNotNull()).alias("case_value_n"), n(~c & v.isNotNull()).alias("control_value_n"), F.percentile(F.when(c, v), F.lit(0.5)).alias("case_median"), F.percentile(F.when(~c, v), F.lit(0.5)).alias("control_median"), F.count_distinct(value).alias("_values"))
    share = lambda g: F.col(f"{g}_detected") / F.nullif(F.col(f"{g}_detection_n"), F.lit(0))
    out = out.withColumn("fraction_difference", share("case") - share("control")).withColumn("median_difference", F.col("case_median") - F.col("control_median"))
    enough = lambda what: F.least(f"case_{what}_n", f"control_{what}_n") >= least
    cells = {"_a": F.col("case_detected"), "_b": F.col("case_detection_n") - F.col("case_detected"), "_c": F.col("control_detected"), "_d": F.col("control_detection_n") - F.col("control_detected")}
    out = fisher_exact(out.withColumns({k: F.when(enough("detection"), x) for k, x in cells.items()}), *cells).drop(*cells)
    ranked = doubled_mid_ranks(df.where(v.isNotNull()), [feature], value)
    delta = cliffs_delta(ranked, [feature], c).select(F.col(feature).alias("_f"), "delta")
    perm = rank_permutation(ranked, [feature], c).select(F.col(feature).alias("_g"), "perm_p")
    out = out.hint("shuffle_merge").join(delta, F.col(feature) == F.col("_f"), "left").hint("shuffle_merge").join(perm, F.col(feature) == F.col("_g"), "left").drop("_f", "_g")
    out = out.withColumn("perm_p", F.when(enough("value"), F.col("perm_p")))
    out = out.withColumn("detection_status", F.when(enough("detection"), "tested").otherwise("not_tested_few_units"))
    out = out.withColumn("value_status", F.when(~enough("value"), "not_tested_few_units").when(F.col("perm_p").isNull(), "not_tested_many_units").when(F.col("_values") == 1, "tested_all_equal").otherwise("tested")).drop("_values")
    tests = out.select(feature, F.explode(F.array(F.struct(F.lit("detection").alias("endpoint"), F.col("fisher_p").alias("p")), F.struct(F.lit("value").alias("endpoint"), F.col("perm_p").alias("p")))).alias("t")).select(feature, "t.*", F.lit(1).alias("all"))
    tests = bh_adjust(bh_adjust(tests, ["endpoint"], "p", "q"), ["all"], "p", "q_both")
    q = lambda e, x: F.max(F.when(F.col("endpoint") == e, F.col(x)))
    qs = tests.groupBy(F.col(feature).alias("_f")).agg(q("detection", "q").alias("fisher_q"), q("detection", "q_both").alias("fisher_q_both"), q("value", "q").alias("perm_q"), q("value", "q_both").alias("perm_q_both"))
    return out.hint("shuffle_merge").join(qs, F.col(feature) == F.col("_f"), "left").drop("_f")


def _dealt(df: DataFrame, family: Sequence[str], p: str) -> DataFrame:
    """The distinct p of each family: family, p, n (rows), before (rows of the family with a smaller p), m (rows of the family),
    _bucket. Written, so that a bucket is the same wherever it is read.

    Equal p are one row, however many there are. The rest is dealt by range: Spark samples the values themselves, so families
    of any size and p of any distribution fall into even buckets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.dropna(subset=[*family, p]).groupBy(*family, p).agg(F.count("*").alias("n"))
    values = stage(values.repartitionByRange(parts, *family, p).withColumn("_bucket", F.spark_partition_id()), "family-values")
    sizes = values.groupBy(*family, "_bucket").agg(F.sum("n").alias("_n"))  # a family has a row for each bucket that it reaches into
    over = W.partitionBy(*family).orderBy("_bucket")
    sizes = sizes.select(*family, "_bucket", (F.sum("_n").over(over) - F.col("_n")).alias("_earlier"), F.sum("_n").over(W.partitionBy(*family)).alias("m"))
    out = values.hint("shuffle_merge").join(sizes, [*family, "_bucket"])
    inside = W.partitionBy(*family, "_bucket").orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("before", F.col("_earlier") + F.sum("n").over(inside) - F.col("n")).drop("_earlier")
    out._holds = (values,)
    return out


def _carried(values: DataFrame, family: Sequence[str], p: str, raw: str, upwards: bool) -> DataFrame:
    """family, p, _v: the running minimum of ``raw`` from the largest p down, or its running maximum from the smallest up, inside
    buckets and then over them."""
    best = F.max if upwards else F.min
    ordered = W.partitionBy(*family, "_bucket").orderBy(F.asc(p) if upwards else F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    tops = values.groupBy(*family, "_bucket").agg(best(raw).alias("_top"))
    beyond = W.partitionBy(*family).orderBy(F.asc("_bucket") if upwards else F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*family, "_bucket", best("_top").over(beyond).alias("_beyond"))
    met = values.withColumn("_in", best(raw).over(ordered)).hint("shuffle_merge").join(tops, [*family, "_bucket"])
    both = F.greatest("_in", "_beyond") if upwards else F.least("_in", "_beyond")
    return met.select(*family, p, F.least(both, F.lit(1.0)).alias("_v"))


def _joined(df: DataFrame, found: DataFrame, family: Sequence[str], p: str, name: str) -> DataFrame:
    """The values of each row's family and p; a hash of both is a second key, so that the rows of one p can be split."""
    keys = [*family, p]
    split = F.pmod(F.xxhash64(*keys), F.lit(1 << 20))
    out = df.withColumn("_s", split).hint("shuffle_merge").join(found.withColumn("_s", split), [*keys, "_s"], "left").drop("_s")
    return out.withColumnRenamed("_v", name)


def bh_adjust(df: DataFrame, family: Sequence[str], p: str, name: str = "q") -> DataFrame:
    """Adds Benjamini-Hochberg q-values within each family; rows with null p, or a null in their family, get null, and null p do
    not count. Ranks and the reverse running minimum go over distinct p, in two levels (``_dealt``)."""
    values = _dealt(df, family, p)
    raw = values.withColumn("_raw", F.col(p) * F.col("m") / (F.col("before") + F.col("n")))
    out = _joined(df, _carried(raw, family, p, "_raw", upwards=False), family, p, name)
    out._holds = (*getattr(df, "_holds", ()), *values._holds)
    return out


def holm_adjust(df: DataFrame, family: Sequence[str], p: str, name: str = "holm") -> DataFrame:
    """Adds Holm step-down p-values, dealt in the same two levels."""
    values = _dealt(df, family, p)
    raw = values.withColumn("_raw", (F.col("m") - F.col("before")) * F.col(p))
    out = _joined(df, _carried(raw, family, p, "_raw", upwards=True), family, p, name)
    out._holds = (*getattr(df, "_holds", ()), *values._holds)
    return out


def group_tests(df: DataFrame, feature: str, case: Column, hit: Column, value: str, most: int = 50) -> DataFrame:
    """One row for each feature of (feature, unit) rows, from one pass over its ranks: n_case, n_control, detected_case,
    detected_control, median_difference, Cliff's delta, Fisher and rank-permutation p (null above ``most`` units), and their
    q-values, each endpoint a family."""
    one, seen = F.when(case, 1).otherwise(0), F.when(hit, 1).otherwise(0)
    rows = doubled_mid_ranks(df, [feature], value).withColumn("_n", F.count("*").over(W.partitionBy(feature)))
    g = rows.groupBy(feature).agg(
        F.sum(one).alias("n_case"), F.sum(1 - one).alias("n_control"), F.sum(seen * one).alias("detected_case"), F.sum(seen * (1 - one)).alias("detected_control"), F.sum(F.col("rank2") * one).alias("_sum"),
        (F.percentile(F.when(case, F.col(value)), F.lit(0.5)) - F.percentile(F.when(~case, F.col(value)), F.lit(0.5))).alias("median_difference"), F.collect_list(F.when(F.col("_n") <= most, F.col("rank2"))).alias("_r"))
    n1, n0 = F.col("n_case"), F.col("n_control")
    g = g.withColumn("delta", (F.col("_sum") - n1 * (n1 + 1)) / F.nullif(n1 * n0, F.lit(0)) - 1)
    cells = [F.col("detected_case"), n1 - F.col("detected_case"), F.col("detected_control"), n0 - F.col("detected_control")]
    testable = (F.size("_r") > 0) & (n1 > 0) & (n0 > 0)
    g = g.withColumn("fisher_p", F.pandas_udf(_fisher, "double")(*(x.cast("long") for x in cells))).withColumn("perm_p", F.pandas_udf(_rank_sum, "double")(F.when(testable, F.col("_r")), n1, "_sum"))
    row = F.struct(*(c for c in g.columns if c not in (feature, "_sum", "_r")))
    tests = g.select(feature, row.alias("_row"), F.explode(F.create_map(F.lit("fisher"), "fisher_p", F.lit("perm"), "perm_p")).alias("_endpoint", "_p"))
    tests = bh_adjust(tests, ["_endpoint"], "_p", "_q")
    q = lambda e: F.max(F.when(F.col("_endpoint") == e, F.col("_q"))).alias(f"{e}_q")
    out = tests.groupBy(feature).agg(F.any_value("_row").alias("_row"), q("fisher"), q("perm")).select(feature, "_row.*", "fisher_q", "perm_q")
    out._holds = tests._holds
    return out


def family_tests(wanted: DataFrame, results: DataFrame, family: Sequence[str], key: str, p: str = "p") -> DataFrame:
    """Each declared test of a family with its result: family, key, p, status (tested, failed), q, family_status.

    A declared test without a result, or with a null p, has failed: it stays in the family with p = 1, so that a family can't
    shrink to what worked. A family with results that were not declared, or with two for one test, is not_declared: no q.
    """
    both = [*family, key]
    w, r = wanted.select(*both).distinct(), results.select(*both, F.col(p).alias("_p"))
    r = r.groupBy(*both).agg(F.count("*").alias("_k"), F.max("_p").alias("_p"))
    met = w.withColumn("_w", F.lit(1)).hint("shuffle_merge").join(r, both, "full_outer")
    odd = met.groupBy(*family).agg(F.max(F.when(F.col("_w").isNull() | (F.col("_k") > 1), 1).otherwise(0)).alias("_odd"))
    met = met.where("_w = 1").hint("shuffle_merge").join(odd, list(family))
    met = met.select(*both, F.coalesce("_p", F.lit(1.0)).alias("_p"), F.when(F.col("_p").isNull(), "failed").otherwise("tested").alias("status"), F.when(F.col("_odd") == 1, "not_declared").otherwise("complete").alias("family_status"))
    out = bh_adjust(met, family, "_p")
    named = out.select(*both, F.col("_p").alias(p), "status", F.when(F.col("family_status") == "complete", F.col("q")).alias("q"), "family_status")
    named._holds = out._holds
    return named
