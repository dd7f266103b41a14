"""Soft-membership mixing: domain posteriors from a labelled-table classifier, then document rates that meet token targets.

Everything on the executors is DataFrame functions. The classifier is naive Bayes (presence and
absence) over hashed words, fitted on at most
``max_labelled`` labelled documents (drawn by a hash of doc_id). Buckets count once a document. Only
marks carry weight: buckets in at least ``least_share`` of a domain's documents and clearly (``z``) and strongly (``least``,
in logs) more often there than elsewhere, so that neither copies of a document nor a domain's slight preference for a
language add up over a long text. Domains: ``toxic`` (toxic = 1), ``low`` (quality = 0), ``clean``.

Rates r >= 0 are fitted by projected gradient steps on the least squares of expected domain totals sum(r * tokens *
posterior) against the targets: a step moves each rate against its posterior-weighted gradient, preconditioned by the
domains' Gram matrix over documents with a positive rate, and cuts at 0. A step needs one aggregate of K + K * K numbers.

Defined cases: null, empty and wordless texts have no tokens and the prior as posterior; rows of one doc_id are one
document, whose equal texts count once; each row without a doc_id is a document of its own, so that no group holds them
all; labels without a known document, and null labels, are ignored; without any labels all documents are ``clean``;
a target for a domain without tokens stays unmet; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop, stage

DOMAINS = ("clean", "low", "toxic")
SHARES = {"clean": 0.95, "low": 0.045, "toxic": 0.005}
BUCKETS = 1 << 16
WHOLE = -1  # in place of a bucket: the row that carries a text's tokens
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    """Words by themselves, without final punctuation; words that end in a symbol by that symbol."""
    last = F.right(word, F.lit(1))
    plain = F.rtrim(F.lower(word), F.lit(".,;:!?"))
    return F.pmod(F.xxhash64(F.when(F.instr(F.lit(SYMBOLS), last) > 0, F.concat(F.lit("\n"), last)).otherwise(plain)), F.lit(BUCKETS)).cast("int")


def fit_classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, strength: float = 5.0, z: float = 4.0, least: float = 1.5, least_share: float = 0.015) -> tuple[DataFrame, dict[str, float]]:
    """(bucket, w_<domain>) with a row for each mark, and each domain's score without any mark."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    there = docs.select(F.col("doc_id").alias("_there")).where("_there is not null").distinct()
    known = stage(known.hint("shuffle_merge").join(there, F.col("doc_id") == F.col("_there"), "left_semi"), "known")
    share = min(1.0, 0.9 * max_labelled / max(1, known.count()))
    there = known
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(max_labelled)
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")
    known = stage(known.select(F.col("doc_id").alias("_id"), domain.alias("domain")), "labelled")
    drop(there)
    per = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = {k: float(np.log((per.get(k, 0) + 1e-3) / (sum(per.values()) + 3e-3))) for k in DOMAINS} if per else {"clean": 0.0, "low": -50.0, "toxic": -50.0}
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # at most max_labelled rows
    words = chosen.select("domain", F.explode(F.array_distinct(F.transform(_words(F.col("text")), _bucket))).alias("bucket"))
    counts = stage(words.groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == k, 1).otherwise(0)).alias(k) for k in DOMAINS)), "buckets")
    n = {k: per.get(k, 0) for k in DOMAINS}
    q = (F.col("clean") + F.col("low") + F.col("toxic")) / max(1, sum(n.values()))
    p = {k: F.least((F.col(k) + strength * q) / (n[k] + strength), F.lit(0.999)) for k in DOMAINS}
    marks = [(F.col(k) >= least_share * max(1, n[k])) & (F.col(k) - q * n[k] > z * F.sqrt(q * n[k] + 1)) & (F.log(p[k] / q) >= least) for k in DOMAINS]
    rows = counts.where(marks[0] | marks[1] | marks[2])
    rows = rows.select("bucket", *(F.log(p[k] / (1 - p[k])).alias(f"w_{k}") for k in DOMAINS), *(F.log(1 - p[k]).alias(f"absent_{k}") for k in DOMAINS))
    rows = stage(rows, "weights")
    drop(known, counts)
    absent = rows.agg(*(F.coalesce(F.sum(f"absent_{k}"), F.lit(0.0)) for k in DOMAINS)).first()
    return rows, {k: prior[k] + a for k, a in zip(DOMAINS, absent)}


def posteriors(docs: DataFrame, weights: DataFrame, prior: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens and p_<domain> of each document: one row for each mark that it holds and one for each text of it."""
    words = _words(F.col("text"))
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # tells rows without an id apart
    rows = docs.select("doc_id", own.alias("_own"), F.xxhash64("text").alias("_h"), F.octet_length("text").alias("_size"), F.size(words).cast("long").alias("n"), F.array_distinct(F.transform(words, _bucket)).alias("buckets"))
    rows = rows.select("doc_id", "_own", "_h", "_size", "n", F.explode(F.array_append("buckets", F.lit(WHOLE))).alias("bucket"))
    whole = F.col("bucket") == WHOLE
    rows = rows.join(F.broadcast(weights.withColumnRenamed("bucket", "mark")), F.col("bucket") == F.col("mark"), "left").where(whole | F.col("mark").isNotNull())  # at most BUCKETS rows
    text = F.when(whole, F.struct("_h", "_size"))
    held = rows.groupBy("doc_id", "_own", "bucket", text.alias("_text")).agg(F.max(F.when(whole, F.col("n"))).alias("n"), *(F.max(f"w_{k}").alias(f"w_{k}") for k in DOMAINS))
    sums = held.groupBy("doc_id", "_own").agg(F.sum("n").alias("n_tokens"), *(F.coalesce(F.sum(f"w_{k}"), F.lit(0.0)).alias(f"s_{k}") for k in DOMAINS))
    logs = {k: F.col(f"s_{k}") + prior[k] for k in DOMAINS}
    top = F.greatest(*logs.values())
    parts = {k: F.exp(F.greatest(logs[k] - top, F.lit(-30.0))) for k in DOMAINS}
    every = sum(parts.values(), F.lit(0.0))
    return sums.select("doc_id", "n_tokens", *((parts[k] / every).alias(f"p_{k}") for k in DOMAINS))


def fit_rates(members: DataFrame, targets: dict[str, float], steps: int = 40, tolerance: float = 1e-6, per_stage: int = 8) -> DataFrame:
    """Adds ``rate`` to (n_tokens, p_<domain>) rows so that sum(rate * n_tokens * p) comes near the targets."""
    p = [F.col(f"p_{k}") for k in DOMAINS]
    goal = np.array([targets.get(k, 0.0) for k in DOMAINS])
    size = max(goal.sum(), 1.0)
    now, held = members.withColumn("rate", F.lit(1.0)), 0
    pace, before, staged = 1.0, np.inf, members if hasattr(members, "_staged_at") else None
    for _ in range(steps):
        n = F.col("n_tokens").cast("double")
        live = F.when(F.col("rate") > 0, n).otherwise(0.0)
        row = now.agg(*(F.sum(F.col("rate") * n * x) for x in p), *(F.sum(live * x * y) for x in p for y in p)).first()
        if row[0] is None:
            break
        have = np.array(row[: len(p)], float)
        gram = np.array(row[len(p) :], float).reshape(len(p), len(p))
        error = np.abs(have - goal).sum() / size
        if error < tolerance:
            break
        pace = pace / 2 if error > before else min(1.0, pace * 1.2)
        before = error
        ridge = 1e-9 * np.trace(gram) + 1e-9
        step = pace * np.linalg.solve(gram + ridge * np.eye(len(p)), have - goal)
        move = sum((F.lit(float(s)) * x for s, x in zip(step, p)), F.lit(0.0))
        now, held = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move)), held + 1
        if held == per_stage:
            now, held = stage(now, "rates"), 0
            drop(staged)
            staged = now
    now._holds = (staged,) if staged is not None else ()  # drop(now) drops it
    return now


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float] = SHARES, budget: float = 0.8, max_labelled: int = 20_000) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate: expected domain totals meet ``shares`` of ``budget`` times all tokens."""
    docs = docs.select("doc_id", "text")
    weights, prior = fit_classifier(docs, labels, max_labelled)
    members = stage(posteriors(docs, weights, prior), "members")
    drop(weights)
    total = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return fit_rates(members, {k: s * budget * total for k, s in shares.items()})
