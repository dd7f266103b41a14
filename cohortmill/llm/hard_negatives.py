"""Hard negatives of anchors by exact integer scores: Strassen products of tiles, then top heaps that merge.

Rows are packed into tiles, sorted by label and id; anchors and all rows (candidates) become matrices of whole numbers,
padded with zeros to one width. Tiles are dealt to the cells of a grid, so that every anchor tile meets every candidate
tile in one cell: once for the positives, where the two share a label, and once for the windows, where they don't. Each
meeting is a product by Strassen's recursion on int64. Additions of int64 wrap, so the product is exact whenever the
scores themselves fit. A cell gives the best ``positives`` rows of each anchor, or the best ``negatives`` of each window;
Spark cuts these heaps again in each task before its shuffle and merges them by anchor after it.

The work is anchors times rows by definition. An anchor tile is sent once for every ``DEPTH`` candidate tiles, a candidate
tile once for every anchor tile: a task moves some two bytes for each thousand multiplications.

Defined cases: rows with a null id, label or vector, or a component that is null or not finite, take no part; nor do rows
with a component of 2^18 or more in size, whose scores might not fit. A shorter vector counts as padded with zeros.
A repeated row counts once; rows that share an id but differ take part each on their own, and none is its own partner.
Anchors without a positive, and positives without a negative in their window, give no rows; an empty table gives none.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import observed, stage

ANCHORS, CANDIDATES = 512, 4096  # rows of a tile
DEPTH = 16  # candidate tiles of a cell
LEAF = 32
LOWEST = np.iinfo(np.int64).min
TILE = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("numbers", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices: seven products of halves, padded with zeros to even sides, down to ``leaf``."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def whole_numbers(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, numbers (array<int>) of the rows that take part."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    numbers = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding")).where("vec_id is not null and label is not null and embedding is not null")
    fits = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float(1 << 18)))
    return numbers.where(F.coalesce(fits, F.lit(False))).select("vec_id", "label", F.transform(x, lambda v: v.cast("int")).alias("numbers"))


def tiles(rows: DataFrame, n: int, height: int, name: str) -> DataFrame:
    """n staged rows packed ``height`` at a time, in order of label and id, as written tables; tile: a number for each."""

    def packed(table: pa.Table) -> pa.RecordBatch:
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        numbers = table["numbers"].combine_chunks()
        sizes = np.diff(numbers.offsets.to_numpy())
        x = np.zeros((len(ids), max(1, int(sizes.max()))), np.int32)
        x[np.arange(x.shape[1]) < sizes[:, None]] = numbers.flatten().to_numpy()
        order = np.argsort(ids, kind="stable")  # ties of a score go by id
        values = ids[order].tobytes(), labels[order].tobytes(), x[order].tobytes(), int(labels.min()), int(labels.max())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, TILE)], schema=TILE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= height:
                whole = pa.Table.from_batches(held)
                yield packed(whole.slice(0, height))
                held = whole.slice(height).to_batches()
        if held and sum(x.num_rows for x in held):
            yield packed(pa.Table.from_batches(held))

    dealt = rows.coalesce(max(1, n // (2 * height))).sortWithinPartitions("label", "vec_id")
    schema = "ids binary, labels binary, numbers binary, low int, high int"
    return stage(dealt.mapInArrow(pack, schema).withColumn("tile", F.monotonically_increasing_id()), name, n="count(1)")


def matrix(t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(t["ids"], np.int64), np.frombuffer(t["labels"], np.int32)
    return ids, labels, np.frombuffer(t["numbers"], np.int32).reshape(len(ids), -1).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, the narrower one padded with zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    return strassen(a, np.ascontiguousarray(b.T))


def best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of each row above ``LOWEST``, the leftmost first among equals."""
    n = s.shape[1]
    if k < n:
        least = np.partition(s, n - k, 1)[:, n - k, None]
        at, col = np.nonzero((s >= least) & (s > LOWEST))
    else:
        at, col = np.nonzero(s > LOWEST)
    order = np.lexsort((col, -s[at, col], at))
    at, col = at[order], col[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], col[keep]


class Heaps:
    """The first n entries of each key: highest score first, then smallest id."""

    def __init__(self, n: int):
        self.n, self.parts = n, []

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((key, score, ids))

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, score, ids = (np.concatenate(x) if self.parts else np.empty(0, np.int64) for x in zip(*self.parts or [((),) * 3]))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        keep = np.arange(len(key)) - np.searchsorted(key, key) < self.n
        self.parts = [(key[keep], score[keep], ids[keep])]
        return self.parts[0]


def pairs(anchors: pa.Table, rows: pa.Table, same: bool) -> Iterator[tuple[int, dict, tuple, tuple]]:
    """(number of the anchor tile in its cell, the tile, its matrix, a candidate tile's matrix) of all that may share a
    label (``same``), or that may differ in one."""
    found = [(i, a, matrix(a)) for i, a in enumerate(anchors.to_pylist())]
    for b in (x for part in rows.to_batches(1) for x in part.to_pylist()):
        m = matrix(b)
        for i, a, own in found:
            if (a["low"] <= b["high"] and b["low"] <= a["high"]) if same else not a["low"] == a["high"] == b["low"] == b["high"]:
                yield i, a, own, m


POSITIVE = pa.schema([("tile", pa.int64()), ("row", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVE = pa.schema([("tile", pa.int64()), ("row", pa.int64()), ("place", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def positive_cell(n: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        heaps, tiles_, ids_of = [Heaps(n) for _ in range(anchors.num_rows)], anchors["tile"].to_pylist(), {}
        for i, _, (ids, labels, x), (other, others, y) in pairs(anchors, rows, True):
            s = scores(x, y)
            s[(labels[:, None] != others) | (ids[:, None] == other)] = LOWEST
            at, col = best(s, n)
            heaps[i].add(at, s[at, col], other[col])
            heaps[i].merged()
            ids_of[i] = ids
        out = [pa.table([pa.array(v, pa.int64()) for v in (np.full(len(at), tiles_[i]), at, ids_of[i][at], found, score)], schema=POSITIVE) for i in ids_of for at, score, found in [heaps[i].merged()]]
        return pa.concat_tables(out) if out else POSITIVE.empty_table()

    return cell


def negative_cell(n: int, low: int, high: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        heaps, known = [Heaps(n) for _ in range(anchors.num_rows)], {}
        for i, a, (ids, labels, x), (other, others, y) in pairs(anchors, rows, False):
            if i not in known:
                wanted = np.array([(p["row"], p["place"], p["positive_id"], p["positive_score"]) for p in a["wanted"]], np.int64).reshape(-1, 4)
                known[i] = a["tile"], ids, wanted
            wanted = known[i][2]
            s = scores(x, y)
            s[labels[:, None] == others] = LOWEST
            for place in np.unique(wanted[:, 1]):
                which = np.flatnonzero(wanted[:, 1] == place)
                at, positive = wanted[which, 0], wanted[which, 3]
                tens, ones = positive // 100, positive % 100  # products of a score itself might not fit
                least, most = tens * low - (-ones * low // 100), tens * high + ones * high // 100
                own = s[at]
                own[(own < least[:, None]) | (own > most[:, None])] = LOWEST
                k, col = best(own, n)
                heaps[i].add(which[k], own[k, col], other[col])
            heaps[i].merged()
        out = []
        for i, (tile, ids, wanted) in known.items():
            key, score, found = heaps[i].merged()
            w = wanted[key]
            out.append(pa.table([pa.array(v, pa.int64()) for v in (np.full(len(key), tile), w[:, 0], w[:, 1], ids[w[:, 0]], w[:, 2], w[:, 3], found, score)], schema=NEGATIVE))
        return pa.concat_tables(out) if out else NEGATIVE.empty_table()

    return cell


def grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, cell, schema: str) -> DataFrame:
    """Anchor tiles dealt to the rows of a grid and sent to all its columns, candidate tiles the other way round."""
    across, down = max(1, n_rows // DEPTH), max(1, n_anchors)
    dealt = lambda n: F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int")
    sent = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("g", dealt(down)).withColumn("c", sent(across))
    b = rows.withColumn("c", dealt(across)).withColumn("g", sent(down))
    return a.groupBy("g", "c").cogroup(b.groupBy("g", "c")).applyInArrow(cell, schema)


def top(rows: DataFrame, keys: list[str], score: str, by: str, n: int) -> DataFrame:
    """The first n rows of each key, numbered by ``place``; each task cuts its own before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), by)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of the rows (vec_id, label, embedding) that
    ``is_anchor`` holds for, the ``positives`` best of their label, and for each the ``negatives`` best of other labels
    whose score is ``low`` to ``high`` per cent of the positive's."""
    rows = stage(whole_numbers(vectors, scale).dropDuplicates(), "negatives-rows", n="count(1)")
    wanted = rows.where(is_anchor)
    candidates = tiles(rows, observed(rows, "n"), CANDIDATES, "negatives-tiles")
    anchors = tiles(wanted, wanted.count(), ANCHORS, "negatives-anchors")
    n_anchors, n_rows = observed(anchors, "n"), observed(candidates, "n")
    ddl = lambda s: ", ".join(f"{f.name} long" for f in s)
    found = grid(anchors, candidates, n_anchors, n_rows, positive_cell(positives), ddl(POSITIVE))
    found = stage(top(found, ["tile", "row"], "positive_score", "positive_id", positives), "negatives-positives")
    lists = found.groupBy("tile").agg(F.collect_list(F.struct("row", F.col("place").cast("long").alias("place"), "positive_id", "positive_score")).alias("wanted"))  # a tile's anchors times ``positives``
    asked = anchors.join(lists.hint("shuffle_merge"), "tile")
    out = grid(asked, candidates, n_anchors, n_rows, negative_cell(negatives, low, high), ddl(NEGATIVE))
    out = top(out.withColumnRenamed("place", "positive_place"), ["tile", "row", "positive_place"], "negative_score", "negative_id", negatives)
    out = out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    out._holds = (rows, candidates, anchors, found)
    return out
