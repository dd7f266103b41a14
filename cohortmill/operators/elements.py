"""Classes of elements by ordered rules over what they hold, with a preliminary and a final class."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def category_measures(elements: DataFrame, members: DataFrame, key: str, member: str, category: str, named: dict[str, Sequence]) -> DataFrame:
    """key, n_members and, for each name of ``named``, the number of distinct members whose category is one of its list. Elements
    without members have zeros; a member of several rows counts once a category."""
    each = members.where(F.col(member).isNotNull()).groupBy(key, member).agg(*(F.max(F.when(F.col(category).isin(*own), 1).otherwise(0)).alias(n) for n, own in named.items()))
    g = each.groupBy(key).agg(F.count("*").alias("n_members"), *(F.sum(n).alias(n) for n in named))
    return elements.select(key).distinct().hint("shuffle_merge").join(g, key, "left").na.fill(0, ["n_members", *named])


def classify(elements: DataFrame, rules: Sequence[tuple[Column, str, Column | str]], otherwise: tuple[str, Column | str], covered: Column, searches: Sequence[str] = (), ended: Sequence[str] = (), support: dict[str, Column] | None = None) -> DataFrame:
    """The elements with preliminary_class, element_class, evidence and classification_status.

    ``rules``: (condition, class, evidence) in order; the first that holds gives the preliminary class. A condition that is null does
    not hold. The final class is not_assessed where ``covered`` does not hold or a state column of ``searches`` is not one of ``ended``
    (null: not), since what was not searched for cannot speak against a class; else unclassified where ``support`` asks for positive evidence of the class and
    it is not there; else the preliminary one.
    """
    text = lambda e: e if isinstance(e, Column) else F.lit(e)
    pair = lambda c, e: F.struct(F.lit(c).alias("c"), text(e).alias("e"))
    first = F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), pair(c, e)) for cond, c, e in rules), pair(*otherwise))
    whole = reduce(lambda a, s: a & F.coalesce(F.col(s).isin(*ended), F.lit(False)), searches, F.coalesce(covered, F.lit(False)))
    out = elements.withColumn("_first", first).withColumn("_whole", whole)
    early = F.col("_first.c")
    bare = reduce(lambda a, kv: a | ((early == kv[0]) & ~F.coalesce(kv[1], F.lit(False))), (support or {}).items(), F.lit(False))
    out = out.withColumns({
        "preliminary_class": early, "element_class": F.when(~F.col("_whole"), "not_assessed").when(bare, "unclassified").otherwise(early),
        "evidence": F.when(~F.col("_whole"), F.concat(F.lit("incomplete;preliminary="), early)).when(bare, "no_positive_evidence").otherwise(F.col("_first.e")),
        "classification_status": V.ladder([(F.col("_whole"), "assessed")], "not_assessed"),
    })
    return out.drop("_first", "_whole")
