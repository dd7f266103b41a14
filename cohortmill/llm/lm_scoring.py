"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy on the corpus itself.

Each word is predicted from two words on either side: their embeddings pass a tanh layer, then a softmax over word classes
and a softmax over the words of the class, both conditioned on the two sides. Words are hashed into V buckets, so no word
is outside the vocabulary; V follows the number of words in the corpus (one bucket for ``WORDS_A_BUCKET`` words, a power of
two from 2^12 to 2^16). Classes are runs of buckets of about equal corpus mass, by falling frequency, so a word costs about
C + V / C output units, 2 sqrt(V) where C = sqrt(V). A document's score is the sum over all its words of
log p(word | both sides).

Bucket counts come from all documents. Training is data-parallel: each task runs mini-batches over all its texts, masking
one word in four at a time; every word of every text is a target exactly once in the ``rounds`` rounds. After a round the
parameters of all tasks are averaged, weighted by their masked words. They number 25 V + 600 C or so: 1.6 MB at V = 2^14,
7 MB at 2^16, whatever the corpus, and travel as blocks of 16,384 values that are added up in a tree. Scores depend slightly on how the rows are dealt to tasks, as with any parameter
averaging; a retried task repeats its own result.

Defined cases: null, empty and wordless texts have no tokens, log-likelihood 0 and a null mean; shorter contexts at a
text's ends are padded; repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import Texts, pieces

V, DIM, HIDDEN = 1 << 14, 8, 16
LEAST_V, MOST_V, WORDS_A_BUCKET = 1 << 12, 1 << 16, 1 << 14
OFFSETS = (-2, -1, 1, 2)
BATCH, RATE = 8192, 0.08
ROWS = 1024  # of a batch whose outputs are worked on at once, so that they stay in a core's cache
ONES = np.ones(MOST_V, np.float32)
NAMES = ("E", "W1", "b1", "W2", "b2", "W3", "b3")
BLOCK, TREE = 1 << 14, (4096, 64)
PARTS = "task long, block int, width int, part binary"
SCORES = "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"


def bucket_words(column: pa.Array, v: int = V) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets with two pads around each text, place of each word in them, first word of each text)."""
    t = Texts(column, lower=True)
    t.words()
    b = (t.hashes(t.start, t.size) & np.uint64(v - 1)).astype(np.int64)
    place = np.arange(len(b)) + 2 + 4 * np.repeat(np.arange(t.n), np.diff(t.word_at))
    padded = np.full(len(b) + 4 * t.n + 4, v)
    padded[place] = b
    return padded, place, t.word_at


class Network:
    """rank: each bucket's place by falling frequency; words are held in that order, class c at first[c] to first[c + 1]."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        n = counts + 0.5
        self.v = v = len(counts)
        classes = 1 << ((v.bit_length()) // 2)
        order = np.argsort(-n, kind="stable")
        self.rank = np.empty(v + 1, np.int64)
        self.rank[order], self.rank[v] = np.arange(v), v
        n = n[order]
        mass = np.cumsum(n) / n.sum()
        in_class = np.minimum((mass - n / n.sum() / 2) * classes, classes - 1).astype(np.int64)
        in_class = np.unique(in_class, return_inverse=True)[1]  # a class that one word's mass passes over is none
        c = int(in_class[-1]) + 1
        self.first = np.searchsorted(in_class, np.arange(c + 1))
        self.in_class = in_class
        held = np.bincount(in_class, n, c)
        shapes = {"E": (v + 1, DIM), "W1": (DIM * len(OFFSETS), HIDDEN), "W2": (c, HIDDEN)}
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.standard_normal(s) * (0.1 if k == "E" else 0.2)).astype(np.float32) for k, s in shapes.items()}
        self.p["E"][v] = 0
        self.p["b1"] = np.zeros(HIDDEN, np.float32)
        self.p["b2"] = np.log(held / held.sum()).astype(np.float32)
        self.p["W3"] = np.zeros((v, HIDDEN), np.float32)
        self.p["b3"] = np.log(n / held[in_class]).astype(np.float32)

    @staticmethod
    def large(w: np.ndarray, b: np.ndarray) -> bool:
        """Whether h @ w.T + b may be beyond what exp takes. As no hidden unit is beyond 1, large weights alone can overflow."""
        return bool(np.abs(w).sum(1).max() + np.abs(b).max() > 80)

    @staticmethod
    def exps(h: np.ndarray, w: np.ndarray, b: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray]:
        """(exp of each output, h @ w.T + b, up to a factor a row; one over the sum of each row)."""
        e = h @ w.T
        e += b
        if large:
            e -= e.max(1, keepdims=True)
        np.exp(e, out=e)
        return e, 1 / (e @ ONES[: len(w)])

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ranks, inputs, hidden layer) for contexts of four buckets."""
        rank = self.rank[context]
        x = self.p["E"][rank].reshape(len(context), -1)
        h = x @ self.p["W1"]
        h += self.p["b1"]
        return rank, x, np.tanh(h, out=h)

    def by_class(self, word: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """``word`` (ranks) ordered by class, and of each class of several words that occurs: (first and end in that order,
        first word and end of the class)."""
        c = self.in_class[word].astype(np.int16)  # at most 512 classes; short integers are sorted by radix
        order = np.argsort(c, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(self.first) - 1))])
        found = np.flatnonzero((np.diff(at) > 0) & (np.diff(self.first) > 1))
        return order, list(zip(at[found].tolist(), at[found + 1].tolist(), self.first[found].tolist(), self.first[found + 1].tolist()))

    def log_p(self, padded: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(place))
        w2, b2, w3, b3 = (self.p[k] for k in ("W2", "b2", "W3", "b3"))
        large2, large3 = self.large(w2, b2), self.large(w3, b3)  # asked once for all classes
        for i in range(0, len(place), 1 << 15):
            at = place[i : i + (1 << 15)]
            word = self.rank[padded[at]]
            h = self.hidden(np.stack([padded[at + o] for o in OFFSETS], 1))[2]
            c, p = self.in_class[word], np.empty(len(at))
            for j in range(0, len(at), ROWS):
                e, one_over = self.exps(h[j : j + ROWS], w2, b2, large2)
                p[j : j + ROWS] = e[np.arange(len(e)), c[j : j + ROWS]] * one_over
            order, classes = self.by_class(word)
            h, word, p = h[order], word[order], p[order]
            for a, z, lo, hi in classes:
                e, one_over = self.exps(h[a:z], w3[lo:hi], b3[lo:hi], large3)
                p[a:z] *= e[np.arange(z - a), word[a:z] - lo] * one_over
            out[i + order] = np.log(np.maximum(p, 1e-30))
        return out

    def train(self, context: np.ndarray, word: np.ndarray, seen: dict[str, np.ndarray]) -> None:
        """One Adagrad step; seen: sums of squared gradients, changed in place."""
        n, word = len(word), self.rank[word]
        rank, x, h = self.hidden(context)
        c, dh = self.in_class[word], np.empty_like(h)
        w2, b2, w3, b3 = (self.p[k] for k in ("W2", "b2", "W3", "b3"))
        g = {k: np.zeros_like(self.p[k]) for k in ("W2", "b2", "W3", "b3")}  # sums over the batch, divided by n below
        large2, large3 = self.large(w2, b2), self.large(w3, b3)
        for j in range(0, n, ROWS):
            own = h[j : j + ROWS]
            d, one_over = self.exps(own, w2, b2, large2)
            d *= one_over[:, None]
            d[np.arange(len(d)), c[j : j + ROWS]] -= 1
            np.matmul(d, w2, out=dh[j : j + ROWS])
            g["W2"] += d.T @ own
            g["b2"] += ONES[: len(d)] @ d
        order, classes = self.by_class(word)
        own_h, own_word, own_dh = h[order], word[order], dh[order]
        for a, z, lo, hi in classes:
            e, one_over = self.exps(own_h[a:z], w3[lo:hi], b3[lo:hi], large3)
            e *= one_over[:, None]
            e[np.arange(z - a), own_word[a:z] - lo] -= 1
            own_dh[a:z] += e @ w3[lo:hi]
            np.matmul(e.T, own_h[a:z], out=g["W3"][lo:hi])
            np.matmul(ONES[: z - a], e, out=g["b3"][lo:hi])
        dh[order] = own_dh
        dh *= (1 - h * h) / n
        for k in g:
            g[k] /= n
        dx, flat = (dh @ self.p["W1"].T).reshape(-1, DIM), rank.ravel()
        g["E"] = np.stack([np.bincount(flat, dx[:, i], self.v + 1) for i in range(DIM)], 1).astype(np.float32)
        g["E"][self.v] = 0
        g["W1"], g["b1"] = x.T @ dh, dh.sum(0)
        for k, by in g.items():
            seen[k] += by * by
            by *= RATE
            by /= np.sqrt(seen[k]) + 1e-6
            self.p[k] -= by


def parts_of(values: np.ndarray) -> pa.RecordBatch:
    """A task's array as rows (task, block, size of a value, bytes) of ``BLOCK`` values each."""
    context = TaskContext.get()
    blocks = [values[i : i + BLOCK] for i in range(0, len(values), BLOCK)]
    task = pa.array([context.partitionId() if context else 0] * len(blocks), pa.int64())
    return pa.RecordBatch.from_arrays([task, pa.array(range(len(blocks)), pa.int32()), pa.array([values.itemsize] * len(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], ["task", "block", "width", "part"])


def _added(table: pa.Table) -> pa.Table:
    total = None
    for width, part in zip(table["width"].to_pylist(), table["part"]):
        values = np.frombuffer(part.as_buffer(), np.float32 if width == 4 else np.float64)
        total = values.astype(np.float64) if total is None else total + values
    row = pa.RecordBatch.from_arrays([table["task"].combine_chunks()[:1], table["block"].combine_chunks()[:1], pa.array([8], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "block", "width", "part"])
    return pa.Table.from_batches([row])


def summed(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' arrays. Tasks meet in a tree (their number modulo ``TREE``, then all), so that a group has some
    hundreds of blocks at most for a million tasks; the driver gets one row a block."""
    for groups in (*TREE, 1):
        rows = rows.withColumn("task", F.col("task") % groups).groupBy("task", "block").applyInArrow(_added, PARTS)
    found = sorted(rows.select("block", "part").toArrow().to_pylist(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["part"], np.float64) for r in found]) if found else np.zeros(0)


def bucket_counts(docs: DataFrame, v: int | None = None) -> np.ndarray:
    """Words in each of v buckets; without v, of as many buckets as the corpus asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MOST_V + 1)
        for b in pieces(batches):
            padded, place, _ = bucket_words(b.column("text"), MOST_V)
            total += np.bincount(padded[place], minlength=MOST_V + 1)
        if total.any():
            yield parts_of(total)

    found = summed(docs.select("text").mapInArrow(run, PARTS))
    out = found[:MOST_V] if len(found) else np.zeros(MOST_V)
    if v is None:
        v = min(MOST_V, max(LEAST_V, 1 << max(0, round(float(np.log2(max(out.sum(), 1) / WORDS_A_BUCKET))))))
    return out.reshape(-1, v).sum(0)  # a bucket is the word's hash modulo v


def _train_rows(net, round_: int, stride: int, turns: int | None = None):
    """The number of each task's masked words and its trained parameters times that number, in blocks. The places of
    a text modulo ``stride`` are masked in turn, ``turns`` of them in a round (all unless told otherwise)."""
    turns = turns or stride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network.__new__(Network)
        mine.__dict__ |= net.value.__dict__
        mine.p = {k: v.copy() for k, v in mine.p.items()}
        seen = {k: np.full_like(v, 1e-8) for k, v in mine.p.items()}
        total = 0
        for b in pieces(batches):
            padded, place, at = bucket_words(b.column("text"), mine.v)
            own = np.arange(len(place)) - np.repeat(at[:-1], np.diff(at))
            for turn in range(round_ * turns, round_ * turns + turns):
                masked = place[own % stride == turn % stride]
                total += len(masked)
                for i in range(0, len(masked), BATCH):
                    p = masked[i : i + BATCH]
                    mine.train(np.stack([padded[p + o] for o in OFFSETS], 1), padded[p], seen)
        if total:
            yield parts_of((np.concatenate([[1.0], *(mine.p[k].ravel() for k in NAMES)]) * total).astype(np.float32))

    return run


def fit(docs: DataFrame, rounds: int = 2, stride: int = 4) -> Network:
    """``rounds`` (a divisor of ``stride``) rounds mask stride / rounds places each, so every word once in all."""
    if stride % rounds:
        raise ValueError("rounds must divide stride")
    net = Network(bucket_counts(docs))
    sc = docs.sparkSession.sparkContext
    for r in range(rounds):
        shared = sc.broadcast(net)
        flat = summed(docs.select("text").mapInArrow(_train_rows(shared, r, stride, stride // rounds), PARTS))
        shared.destroy()
        if len(flat):
            flat, at = flat[1:] / flat[0], 0
            for k in NAMES:
                old = net.p[k]
                net.p[k] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
                at += old.size
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            padded, place, at = bucket_words(b.column("text"), shared.value.v)
            sums = np.diff(np.concatenate([[0], np.cumsum(shared.value.log_p(padded, place))])[at])
            n = np.diff(at)
            sums[n == 0] = 0
            mean = pa.array(np.round(sums / np.maximum(n, 1), 6), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(np.round(sums, 4)), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def pseudo_likelihood(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood for each document, by a network fitted to all of them."""
    return score(docs, fit(docs, rounds))
