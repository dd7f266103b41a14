"""Quality rules by weak supervision: rules vote good, bad or abstain; expectation-maximisation weighs them.

One pass measures each whole text and turns the measures into votes. Votes form one of 3^R patterns, so the counts of
all patterns (a table that does not grow with the documents) carry everything that EM needs: the class balance and, for
each rule, how often it says good, bad or nothing in either class. The posterior of a document is that of its pattern.

Defined cases: null text has no words; an empty table fits no model and gives no rows; a rule that always abstains has
no weight; equal texts get equal results; other columns pass through in ``keep_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import SPACE, Texts, grams, pieces

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GOOD, BAD, ABSTAIN = 1, 0, 2


def _repeats(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each element, whether its key occurs more than once in its own text; at: each text's first element."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each element, whether an earlier one of its text has its key."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((np.arange(len(key)), key, doc))
    k, d = key[order], doc[order]
    out = np.zeros(len(key), bool)
    out[order[1:][(k[1:] == k[:-1]) & (d[1:] == d[:-1])]] = True
    return out


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of flags in each range of at."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    t = Texts(column)
    t.words()
    size = int(t.doc_at[-1])
    buf = t.buf[:size]
    out = {"n_words": np.diff(t.word_at)}
    out["word_chars"] = _sums(((buf & 0xC0) != 0x80) & ~SPACE[buf], t.doc_at)
    out["n_symbols"] = _sums(SYMBOL[buf], t.doc_at)
    # lines that have a word
    edge = np.zeros(size + 1, bool)
    edge[t.doc_at] = True
    newline = np.flatnonzero(buf == 10)
    begin = np.union1d(np.flatnonzero(edge), newline + 1).astype(np.int64)
    begin = begin[begin < size]
    if size and len(begin):
        stop = np.append(begin[1:], size)
        ends_nl = (t.buf[stop - 1] == 10) & (stop > begin)
        stop = stop - ends_nl
        worded = np.searchsorted(t.start, stop) > np.searchsorted(t.start, begin)
        begin, stop = begin[worded], stop[worded]
    else:
        stop = begin
    line_at = np.searchsorted(begin, t.doc_at)
    out["n_lines"] = np.diff(line_at)
    out["n_dup_lines"] = _sums(_later(t.hashes(begin, stop - begin), line_at), line_at)
    h = t.hashes(t.start, t.size)
    g, gram_at = grams(h, t.word_at, 5)
    twice = _repeats(g, gram_at)
    # a run of five covers the words from its own on
    runs = np.diff(gram_at)
    first = np.arange(len(g)) + np.repeat(t.word_at[:-1] - gram_at[:-1], runs)
    cover = np.zeros(len(h) + 6, np.int32)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + 5, -1)
    out["n_repeat_words"] = _sums(np.cumsum(cover)[: len(h)] > 0, t.word_at)
    long = np.diff(np.concatenate([[0], np.cumsum(t.size > 40)])[t.word_at])
    out["n_long_words"] = long
    last = t.buf[t.start + t.size - 1] if len(t.start) else t.buf[:0]
    out["n_stops"] = _sums(STOP[last], t.word_at)
    single = _repeats(h, t.word_at)
    out["n_unique_words"] = np.diff(t.word_at) - _sums(single, t.word_at)
    return out


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """[rules, documents] of GOOD, BAD and ABSTAIN."""
    words = np.maximum(m["n_words"], 1)
    lines = np.maximum(m["n_lines"], 1)

    def bad(when: np.ndarray) -> np.ndarray:
        return np.where(when, BAD, ABSTAIN)

    stops = m["n_stops"] / words
    return np.stack([
        bad(m["n_words"] < 10),
        bad(m["n_symbols"] >= 0.10 * words),
        bad(m["n_repeat_words"] > 0.20 * words),
        bad((m["n_dup_lines"] >= 0.30 * lines) & (m["n_dup_lines"] >= 2)),
        bad(np.abs(m["word_chars"] / words - 5.5) > 4.0),
        bad(m["n_long_words"] >= 0.05 * words),
        np.where(stops >= 0.03, GOOD, bad(stops < 0.005)),
    ])


N_RULES = 7
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern int"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and the vote pattern (base 3, rule 0 first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            m = measure(b.column("text"))
            failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            pattern = (votes(m) * (3 ** np.arange(N_RULES))[:, None]).sum(0)
            cols = [b.column("doc_id"), *(pa.array(m[c], pa.int64()) for c in MEASURES), pa.array(failed), pa.array(pattern, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *MEASURES, "base_failed", "pattern"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def fit(patterns: np.ndarray, counts: np.ndarray, rules: int = N_RULES, rounds: int = 200, precision: float = 0.9, good: float = 0.85) -> np.ndarray:
    """Posterior probability of good quality for each of the 3^rules patterns.

    Starts from votes that are right with probability ``precision`` and a share ``good`` of good documents; pseudo-counts
    of that belief keep a rule that seldom votes, or always votes alone, from turning round.
    """
    every = np.arange(3**rules)
    vote = (every[:, None] // 3 ** np.arange(rules)) % 3
    n = np.zeros(3**rules)
    np.add.at(n, patterns, counts)
    share = np.array([(n[:, None] * (vote == v)).sum(0) for v in range(3)]).T + 0.5
    share /= share.sum(1, keepdims=True)  # [rule, vote]
    of = np.array([[precision, 1 - precision, 1 - good], [1 - precision, precision, good]])  # [class, vote]
    balance = np.array([1 - good, good])
    prior = share[None] * of[:, None, :] / balance[:, None, None]
    prior /= prior.sum(2, keepdims=True)
    theta, strength = prior.copy(), 0.5 * n.sum() + 10
    start, post = balance.copy(), np.full(3**rules, 0.5)
    for _ in range(rounds):
        logs = np.log(theta)
        score = [logs[c][np.arange(rules), vote].sum(1) + np.log(balance[c]) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        done = np.abs((new - post) * n).sum() < 1e-9 * max(n.sum(), 1)
        post = new
        w = np.stack([n * (1 - post), n * post])
        for c in (0, 1):
            seen = np.array([(w[c][:, None] * (vote == v)).sum(0) for v in range(3)]).T
            theta[c] = (seen + strength * start[c] * prior[c]) / (w[c].sum() + strength * start[c])
        balance = (w.sum(1) + strength * start) / (n.sum() + strength)
        if done:
            break
    return post


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, p_good (posterior) and kept for each document."""
    spark = docs.sparkSession
    rows = measured(docs)
    counted = rows.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 3^R rows at most
    post = fit(np.array([r[0] for r in counted], int), np.array([r[1] for r in counted], float))
    table = spark.createDataFrame([(i, round(float(p), 12)) for i, p in enumerate(post)], "pattern int, p_good double")
    out = rows.join(F.broadcast(table), "pattern")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop("pattern")


def keep_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that the rules keep, unchanged. Each text is judged by itself, so rows need no key."""
    spark = docs.sparkSession
    counted = measured(docs).groupBy("pattern").agg(F.count("*").alias("n")).collect()
    post = fit(np.array([r[0] for r in counted], int), np.array([r[1] for r in counted], float))
    good = spark.sparkContext.broadcast(post >= threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            m = measure(b.column("text"))
            failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            pattern = (votes(m) * (3 ** np.arange(N_RULES))[:, None]).sum(0)
            yield b.filter(pa.array(~failed & good.value[pattern]))

    return docs.mapInArrow(run, docs.schema)
