"""Stretches of consecutive words that repeat with a period, by maximal pairs.

The suffixes of all texts of a batch are sorted by prefix doubling, and the tree of their LCP intervals is walked from
the deepest interval up. A node holds the places of its words' string, sorted, each with its class, the word to its left.
Where two children meet at depth l, two places of different classes are a maximal pair: l words agree, and neither the
words before nor those after do. If their distance q is at most l, the stretch from the first place to the end of the
second string has period q and can't be extended; so pairs with q <= l and q + l >= ``shortest`` are exactly the runs,
once the smallest period is kept of those that give the same stretch.

Two places of a run whose smallest period is q are neighbours among their node's places: a third one between them would
turn the first q words of the run into a rotation of themselves, and q would not be smallest. So a place that comes from
the smaller child is held only against its neighbours of the larger one, and a node's places stay in one sorted list.

A pair needs l >= ``shortest`` / 2. Places whose next so many words occur nowhere else in their text can't be in one and
never enter the tree.

Defined cases: null, empty and wordless texts have no words and no runs; words are ``[^\\x20\\x09-\\x0D]+``; a text of any
length is walked whole, in one task, in memory that follows its length; rows of a doc_id that occurs twice, or is null,
stay rows of their own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textcols import _C3, mix, pieces

Run = tuple[int, int, int]  # start, length, period


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, a number of no other text before each text and at the end; where each text begins)."""
    parts, at, base = [], [], 0
    n = 0
    for words in texts:
        ids: dict[bytes, int] = {}
        parts.append([base])
        parts.append([base + 1 + ids.setdefault(w, len(ids)) for w in words])
        at.append(n + 1)
        n += 1 + len(words)
        base += 1 + len(ids)
    parts.append([base])
    return np.fromiter((x for p in parts for x in p), np.int64, n + 1), np.array(at, np.int64)


def recurring(ids: np.ndarray, k: int) -> np.ndarray:
    """Whether the k numbers from each place on may occur at another place too (never a miss)."""
    h = np.full(len(ids), np.uint64(k))
    for i in range(k):
        h = mix((h ^ np.append(ids[i:], np.arange(-i, 0)).astype(np.uint64)) * _C3)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(ids), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order; by t, ranks that are equal where the 2^t numbers from there on are).

    The last number occurs once and so do the numbers between texts: no string passes the end of its text unnoticed.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)

    def deal(places: np.ndarray, first: np.ndarray, base: np.ndarray) -> None:
        """Ranks of places in order: where a new group begins (first), its position in the order of all (base)."""
        rank[places] = base[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]

    deal(order, np.append(True, ids[order[1:]] != ids[order[:-1]]), np.arange(n))
    levels, h = [rank.copy()], 1
    live = np.arange(n)
    while True:
        sizes = np.bincount(rank[live], minlength=n)
        live = live[sizes[rank[live]] > 1]
        if not len(live):
            break
        a, b = rank[live], rank[np.minimum(live + h, n - 1)]
        by = np.lexsort((b, a))
        live, a, b = live[by], a[by], b[by]
        within = np.arange(len(a)) - np.searchsorted(a, a)  # place inside the old group, whose ranks begin at a
        order[a + within] = live
        deal(live, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])), a + within)
        levels.append(rank.copy())
        h *= 2
    return order, levels


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers agree from the places a and b on."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        same = levels[t][np.minimum(a + out, n - 1)] == levels[t][np.minimum(b + out, n - 1)]
        out[same] += 1 << t
    return out


def maximal_pairs(places: list[int], depths: list[int], left: list[int], shortest: int) -> list[Run]:
    """(start, length, period) of the pairs of all LCP intervals; places: suffixes in order; depths[i]: words common to
    places i - 1 and i, under 0 where a tree begins; left: the class of each place of the text."""
    found: list[Run] = []
    stack: list[tuple[int, list[int]]] = []

    def meet(big: list[int], small: list[int], depth: int) -> list[int]:
        if len(small) > len(big):
            big, small = small, big
        least, n = shortest - depth, len(big)
        for y in small:
            k = bisect_left(big, y)
            if k and least <= y - (x := big[k - 1]) <= depth and left[x] != left[y]:
                found.append((x, depth + y - x, y - x))
            if k < n and least <= (x := big[k]) - y <= depth and left[x] != left[y]:
                found.append((y, depth + x - y, x - y))
        if len(small) < 16:
            for y in small:
                insort(big, y)
        else:
            big += small
            big.sort()
        return big

    last = [places[0]] if places else []
    for place, depth in zip([*places[1:], -1], [*depths[1:], -1]):
        while stack and stack[-1][0] >= depth:
            at, places_there = stack.pop()
            last = meet(places_there, last, at)
        if depth >= 0:
            stack.append((depth, last))
        last = [place]
    return found


def runs_of(texts: list[list[bytes]], shortest: int) -> list[list[Run]]:
    """The runs of each text by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    ids, at = numbered(texts)
    k = -(-shortest // 2)
    ends = np.append(at[1:] - 1, len(ids) - 1)
    again = np.flatnonzero(recurring(ids, k))
    some = np.unique(np.searchsorted(at, again, "right") - 1)  # texts with such a place
    some = some[some >= 0]
    if not len(some):
        return out
    kept = np.zeros(len(ids), bool)
    kept[again] = True
    inside = np.concatenate([np.arange(at[i] - 1, ends[i]) for i in some] + [[len(ids) - 1]])
    ids, kept, owner = ids[inside], kept[inside], np.repeat(some, ends[some] - at[some] + 1)
    first = np.concatenate([[0], np.cumsum(ends[some] - at[some] + 1)])[:-1] + 1
    order, levels = suffix_order(ids)
    order = order[kept[order]]
    depths = np.append(-1, common(levels, order[:-1], order[1:]))
    depths[depths < k] = -1  # there ends a tree
    found = np.array(maximal_pairs(order.tolist(), depths.tolist(), np.append(0, ids[:-1]).tolist(), shortest), np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.append(True, (found[1:, :2] != found[:-1, :2]).any(1)) if len(found) else np.zeros(0, bool)
    found = found[new]  # the smallest period of a stretch
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    begins = dict(zip(some.tolist(), first.tolist()))
    for text, (s, n, p) in zip(owner[found[:, 0]].tolist(), found.tolist()):
        out[text].append((s - begins[text], n, p))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that stay when each run keeps its first period only."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text with its tail turned into a repetition, the choice and the period taken from the checksum of its id."""
    if doc_id is None or not words or (h := crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, shortest: int = 12, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, digest: bool = False) -> DataFrame:
    """Per document: n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start, then period),
    and runs (array of start, length, period) and collapsed (text), or with ``digest`` their SHA-256. ``rewrite`` changes
    the words of a text before."""
    tail = "runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    schema = f"doc_id long, n_runs long, start long, length long, period long, exponent_milli long, {tail if digest else tail.replace('binary', 'string')}"
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", *(["runs_sha256", "collapsed_sha256"] if digest else ["runs", "collapsed"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids = b.column("doc_id").to_pylist()
            texts = [(t or b"").split() for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            if rewrite:
                texts = [rewrite(i, w) for i, w in zip(ids, texts)]
            rows = []
            for doc_id, words, runs in zip(ids, texts, runs_of(texts, shortest)):
                text = b" ".join(collapsed(words, runs))
                best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
                head = (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
                if digest:
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    rows.append((*head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
                else:
                    rows.append((*head, [{"start": s, "length": n, "period": p} for s, n, p in runs], text.decode()))
            kinds = [pa.int64()] * 6 + ([pa.string()] * 2 if digest else [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
