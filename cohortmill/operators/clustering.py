"""Greedy representative clustering and pair summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import dealt, drop, observed, stage


def one_way(edges: DataFrame) -> DataFrame:
    """Each edge once, a < b, whichever way and however often it is given; rows with a null or with equal ends are none."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def greedy_representatives(nodes: DataFrame, edges: DataFrame, node: str = "node", rank: str = "rank") -> DataFrame:
    """(node, is_representative): what a walk by rising rank gives that makes a node a representative unless it is next to one.

    Rounds instead of a walk: a node that no undecided neighbour precedes becomes a representative, its neighbours do not, until
    all are decided. Ranks must be distinct. Edges are (a, b), in either direction. Ranks only tell which end of an edge comes
    first; the rounds carry the two names.
    """
    return _greedy(nodes, one_way(edges), node, rank)


def _greedy(nodes: DataFrame, e: DataFrame, node: str, rank: str) -> DataFrame:
    ranked = nodes.select(F.col(node).alias("n"), F.col(rank).alias("r"))
    for i in "ab":
        e = e.hint("shuffle_merge").join(ranked.select(F.col("n").alias(i), F.col("r").alias(f"r{i}")), i)
    before = F.col("ra") < F.col("rb")
    e = stage(e.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("b")), "greedy", n="count(1)")
    done = []
    while observed(e, "n"):
        later = e.select("b").distinct()
        new = e.select("a").distinct().hint("shuffle_merge").join(later, F.col("a") == F.col("b"), "left_anti")
        beside = stage(e.hint("shuffle_merge").join(new, "a").select(F.col("b").alias("x")).distinct(), "greedy")
        left = e.hint("shuffle_merge").join(beside, F.col("b") == F.col("x"), "left_anti").hint("shuffle_merge").join(beside, F.col("a") == F.col("x"), "left_anti")
        old, e = e, stage(left, "greedy", n="count(1)")
        drop(old)
        done.append(beside)
    drop(e)
    if not done:
        return ranked.select(F.col("n").alias(node), F.lit(True).alias("is_representative"))
    # a node is set beside a representative in one round only, and its edges go with it
    out = ranked.hint("shuffle_merge").join(reduce(DataFrame.union, done), F.col("n") == F.col("x"), "left").select(F.col("n").alias(node), F.col("x").isNull().alias("is_representative"))
    out._holds = tuple(done)
    return out


def memberships(representatives: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node, status (representative, member, ambiguous), representatives (sorted, joined by ';'); several stay several."""
    reps = representatives.where("is_representative").select(F.col(node).alias("r"))
    near = both_ways(edges).hint("shuffle_merge").join(reps, F.col("b") == F.col("r")).groupBy("a").agg(F.array_sort(F.collect_list(F.col("r").cast("string"))).alias("rs"))
    out = representatives.hint("shuffle_merge").join(near, F.col(node) == F.col("a"), "left")
    status = F.when(F.col("is_representative"), "representative").when(F.size("rs") == 1, "member").otherwise("ambiguous")
    return out.select(node, status.alias("status"), F.when(F.col("is_representative"), F.col(node).cast("string")).otherwise(F.array_join("rs", ";")).alias("representatives"))


def reciprocal_pairs(pairs: DataFrame, score: str, rows: int | None = None) -> DataFrame:
    """a < b with the smaller of both directions' scores; status broad if both directions exist, else partial. ``rows``: how many
    pairs there are at most, where it is known; they are then dealt over tasks by that."""
    p = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") < F.col("b")).alias("_up"), score)
    p = p if rows is None else dealt(p, rows, "a", "b")
    g = p.groupBy("a", "b").agg((F.min("_up") != F.max("_up")).alias("_both"), F.min(score).alias(score))
    return g.select("a", "b", score, F.when(F.col("_both"), "broad").otherwise("partial").alias("status"))


def mapping_degrees(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Each mapped pair with its class: exact, split (one old, several new), merge (several old, one new) or complex."""
    pairs = pairs.select(old, new).distinct()
    n_new, n_old = F.count("*").over(W.partitionBy(old)), F.count("*").over(W.partitionBy(new))
    pairs = pairs.withColumn("n_new", n_new).withColumn("n_old", n_old)
    both = F.max("n_old").over(W.partitionBy(old))
    pairs = pairs.withColumn("most_old", both).withColumn("most_new", F.max("n_new").over(W.partitionBy(new)))
    kind = F.when((F.col("most_old") == 1) & (F.col("most_new") == 1), "exact").when(F.col("most_old") == 1, "split").when(F.col("most_new") == 1, "merge").otherwise("complex")
    return pairs.select(old, new, kind.alias("kind"))


def both_ways(edges: DataFrame) -> DataFrame:
    return _turned(one_way(edges))


def _turned(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def bridges(nodes: DataFrame, edges: DataFrame, node: str = "node", length: str = "length") -> DataFrame:
    """node, n_longer, n_linked, is_bridge: nodes that have two longer neighbours which are not neighbours themselves.

    Links among a node's longer neighbours are triangles. Each is found once, from its corner of lowest degree, so that a hub
    opens no pairs of all its neighbours: a node has at most sqrt(2 x edges) neighbours of higher degree. A corner sends to each
    of these the ones that come after it, as one list of ids, and the lists meet there: pairs that are not linked are never rows.
    """
    return _bridges(nodes, one_way(edges), node, length)


def _bridges(nodes: DataFrame, e: DataFrame, node: str, length: str) -> DataFrame:
    sized = nodes.select(F.col(node).alias("n"), F.col(length).alias("len"))
    degree = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    known = stage(degree.hint("shuffle_merge").join(sized, F.col("v") == F.col("n")).select("v", "d", "len"), "degrees")
    for side, name in (("a", "x"), ("b", "y")):
        e = e.hint("shuffle_merge").join(known.select(F.col("v").alias(side), F.struct("d", F.col("v").alias("id"), "len").alias(name)), side)
    e = stage(e.select("x", "y"), "bridges")
    low = F.struct("x.d", "x.id") < F.struct("y.d", "y.id")
    pick = lambda c, a, b: F.when(c, F.col(a)).otherwise(F.col(b))
    up = e.groupBy(pick(low, "x.id", "y.id").alias("c")).agg(F.transform(F.sort_array(F.collect_list(F.struct(pick(low, "y.d", "x.d").alias("d"), pick(low, "y.id", "x.id").alias("id")))), lambda y: y.id).alias("up"))
    up = stage(up, "bridges")
    sent = up.select("c", "up", F.posexplode("up").alias("at", "p")).where(F.size("up") > F.col("at") + 1)
    sent = sent.select("c", "p", F.expr("slice(up, at + 2, size(up))").alias("after"))
    met = sent.hint("shuffle_merge").join(up.select(F.col("c").alias("p"), "up"), "p")
    closed = met.select("c", "p", F.explode(F.array_intersect("after", "up")).alias("q"))
    for k in "cpq":
        closed = closed.hint("shuffle_merge").join(sized.select(F.col("n").alias(k), F.col("len").alias(f"len_{k}")), k)
    by_length = F.array_sort(F.array(*(F.struct(F.col(f"len_{k}").alias("len"), F.col(k).alias("id")) for k in "cpq")))
    short = closed.select(by_length.alias("o")).where(F.col("o")[0]["len"] < F.col("o")[1]["len"])
    linked = short.groupBy(F.col("o")[0]["id"].alias("n")).agg(F.count("*").alias("n_linked"))
    longer = e.where("x.len <> y.len").groupBy(pick(F.col("x.len") < F.col("y.len"), "x.id", "y.id").alias("n")).agg(F.count("*").alias("n_longer"))
    out = sized.hint("shuffle_merge").join(longer, "n", "left").hint("shuffle_merge").join(linked, "n", "left")
    k, t = F.coalesce("n_longer", F.lit(0)), F.coalesce("n_linked", F.lit(0))
    out = out.select(F.col("n").alias(node), k.alias("n_longer"), t.alias("n_linked"), (2 * t < k * (k - 1)).alias("is_bridge"))
    out._holds = (known, e, up)
    return out


def quality_rank(quality: Column, boundary: Column, length: Column, node: Column, qualities: list[str], boundaries: list[str]) -> Column:
    """Best first: place in the list of qualities, then of boundaries (others last), longer, smaller id."""
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)), F.lit(len(names) + 1))
    return F.struct(place(quality, qualities).alias("quality"), place(boundary, boundaries).alias("boundary"), (-length).alias("length"), node.alias("id"))


def representatives(nodes: DataFrame, edges: DataFrame, rank: Column, node: str = "node", length: str = "length") -> tuple[DataFrame, DataFrame]:
    """(node, status, n_representatives, representative where there is one; every node with each representative it is next to).

    A greedy walk by rank in which bridges come last, longest first: a short node cannot become the representative of longer
    ones that do not fit each other. Every other node is then met with all representatives: one makes it a member, several
    leave it ambiguous. Representatives of a node are rows, never a list.
    """
    e = stage(one_way(edges), "edges")
    bridge = _bridges(nodes, e, node, length)
    order = stage(nodes.select(node, length, rank.alias("_rank")).hint("shuffle_merge").join(bridge.select(node, "is_bridge"), node), "order")
    drop(bridge)
    late = F.col("is_bridge").cast("int")
    order = order.select(node, F.struct(late.alias("late"), F.when(F.col("is_bridge"), -F.col(length)).otherwise(0).alias("length"), F.col("_rank").alias("rank")).alias("rank"))
    found = _greedy(order, e, node, "rank")
    walked, found = found, stage(found, "representatives")
    drop(walked)
    reps = found.where("is_representative").select(F.col(node).alias("representative"))
    beside = _turned(e).hint("shuffle_merge").join(reps, F.col("b") == F.col("representative")).select(F.col("a").alias(node), "representative")
    matches = stage(reps.select(F.col("representative").alias(node), "representative").union(beside), "matches")
    g = matches.groupBy(node).agg(F.count("*").alias("n_representatives"), F.min("representative").alias("representative"))
    out = found.hint("shuffle_merge").join(g, node)
    status = F.when(F.col("is_representative"), "representative").when(F.col("n_representatives") == 1, "member").otherwise("ambiguous")
    return out.select(node, status.alias("status"), "n_representatives", F.when(F.col("n_representatives") == 1, F.col("representative")).alias("representative")), matches


def mapping_relations(old: DataFrame, new: DataFrame, pairs: DataFrame, old_id: str, new_id: str, same: str = "same", one_to_many: str = "split", many_to_one: str = "merge") -> DataFrame:
    """old, new, relation for each pair, and a row with one side null for every id of either table that has no pair.

    exact (one to one and ``same``), partial (one to one, else), split (an old id with several new ones), merge (a new id with
    several old ones), complex (both), unmatched. Call the two middle classes otherwise where a vocabulary swaps them.
    """
    # a pair given twice is one pair, exact if any copy is
    p = pairs.groupBy(old_id, new_id).agg(F.max(F.coalesce(same, F.lit(False))).alias("_same"))
    p = p.withColumn("_nn", F.count("*").over(W.partitionBy(old_id))).withColumn("_no", F.count("*").over(W.partitionBy(new_id)))
    nn, no = F.col("_nn") > 1, F.col("_no") > 1
    kind = F.when(nn & no, "complex").when(no, many_to_one).when(nn, one_to_many).when(F.col("_same"), "exact").otherwise("partial")
    out = p.select(old_id, new_id, kind.alias("relation"))
    for ids, mine, other in ((old, old_id, new_id), (new, new_id, old_id)):
        alone = ids.select(mine).distinct().hint("shuffle_merge").join(pairs.select(mine), mine, "left_anti")
        out = out.unionByName(alone.withColumn(other, F.lit(None).cast(pairs.schema[other].dataType)).withColumn("relation", F.lit("unmatched")))
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all strings in a row, upper case; bounds of each)."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return np.where((data >= 97) & (data <= 122), data - 32, data), bounds - bounds[0]


def _places(on: np.ndarray, row: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The letter of the sequence that each column of each alignment (``row``; it begins at column ``at``) stands on, or the last one before a gap."""
    seen = np.concatenate([[0], np.cumsum(on)])
    step = np.where(end >= start, 1, -1)
    count = seen[at[1:]] - seen[at[:-1]]
    if (count != np.abs(end - start) + 1).any():
        raise ValueError("aligned strings do not have their coordinates' length")
    if ((np.minimum(start, end) < 1) | (np.maximum(start, end) > size)).any():
        raise ValueError("coordinates outside the sequence")
    return start[row] - 1 + step[row] * (seen[1:] - seen[at[:-1]][row] - 1)


def _walk(b: pa.RecordBatch, pair: np.ndarray, used: list[np.ndarray], base: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(columns, identical) of each alignment of a batch: its columns that use no letter that an earlier one of its pair used.
    ``used``: a mark per letter of either side's sequences, those of a pair from ``base`` on. The first alignments of all pairs are
    taken at once, then the second ones, and so on."""
    (q, at), (t, other) = _flat(b.column("qseq")), _flat(b.column("sseq"))
    get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    if (at != other).any() or (np.diff(at) != get("length")).any():
        raise ValueError("aligned strings of unequal length, or of another than their record's")
    row = np.repeat(np.arange(b.num_rows), np.diff(at))
    on = q != 45, t != 45
    if not (on[0] | on[1]).all():
        raise ValueError("a column with gaps on both sides")
    place = [_places(o, row, at, get(f"{c}start"), get(f"{c}end"), n[pair]) + x[pair][row] for o, c, x, n in zip(on, "qs", base, sizes)]
    alike = (q == t) & np.isin(q, np.frombuffer(b"ACGT", np.uint8))
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    turn = np.arange(b.num_rows) - np.repeat(first, np.diff(np.append(first, b.num_rows)))
    free = np.ones(len(row), bool)
    order = np.argsort(turn, kind="stable")
    for rows in np.split(order, np.cumsum(np.bincount(turn))[:-1]):
        size = at[rows + 1] - at[rows]
        mine = slice(at[rows[0]], at[rows[0] + 1]) if len(rows) == 1 else np.repeat(at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        sides = [(o[mine], p[mine], u) for o, p, u in zip(on, place, used)]
        fresh = ~np.logical_or(*(o & u[np.where(o, p, 0)] for o, p, u in sides))
        free[mine] = fresh
        for o, p, u in sides:
            u[p[fresh & o]] = True
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    return sums(free), sums(free & alike)


UNION = "q string, s string, ani double, aligned_fraction double, columns long, identical long, q_covered long, s_covered long, accepted long"


def alignment_union(hsps: DataFrame, evalue_max: float = 1e-5) -> DataFrame:
    """Identity and aligned fraction of the shorter sequence per pair (q, s), in percent, from local alignments in which every
    letter of either sequence counts once: best score first, later columns that reuse a letter are left out.

    Needs q, s, qstart, qend, sstart, send, qlen, slen, qseq, sseq, pident, length, evalue, bitscore. The walk depends on its
    order, so a pair is one task's; it is streamed there in sorted batches with one mark per letter of the two sequences, many
    pairs side by side (``_walk``).
    """
    order = ["q", "s", F.desc("bitscore"), F.desc("pident"), F.desc("length"), "qstart", "qend", "sstart", "send", "qseq", "sseq"]
    fields = "q s qstart qend sstart send qlen slen qseq sseq length evalue".split()
    rows = hsps.select(*(F.col(c).cast("string").alias(c) if c in "qs" else c for c in [*fields, "pident", "bitscore"])).repartition("q", "s").sortWithinPartitions(*order).select(*fields)
    names = [f.split()[0] for f in UNION.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last pair so far: (q, s), marks of q and s, [columns, identical, accepted]
        for b in (x for batch in batches for x in _pieces(batch)):
            keys = [b.column(c).to_pylist() for c in "qs"]
            ids = list(zip(*keys))
            first = np.array([k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]])
            pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
            sizes = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[first] for c in ("qlen", "slen")]
            if held and held[0] == ids[0]:
                for x, v in zip(sizes, held[1]):
                    x[0] = len(v)
            base = [np.cumsum(x) - x for x in sizes]
            used, sums, ready = [np.zeros(max(1, int(x.sum())), bool) for x in sizes], np.zeros((3, len(first)), np.int64), []
            if held and held[0] == ids[0]:
                for u, v in zip(used, held[1]):
                    u[: len(v)] = v
                sums[:, 0] = held[2]
            elif held:
                ready.append(_result([held[0]], np.array([[len(v)] for v in held[1]]), np.array([[v.sum()] for v in held[1]]), held[2][:, None], names))
            taken = np.flatnonzero(pc.fill_null(pc.less_equal(b.column("evalue"), evalue_max), False).to_numpy(zero_copy_only=False))
            if len(taken):
                mine = pair[taken]
                columns, same = _walk(b.take(pa.array(taken)), mine, used, base, sizes)
                for k, x in enumerate((columns, same, columns > 0)):
                    sums[k] += np.bincount(mine, x, len(first)).astype(np.int64)
            covered = np.array([np.diff(np.concatenate([[0], np.cumsum(u)])[np.append(x, x[-1] + n[-1])]) for u, x, n in zip(used, base, sizes)])
            last = len(first) - 1
            held = ids[-1], [u[x[-1] : x[-1] + n[-1]].copy() for u, x, n in zip(used, base, sizes)], sums[:, last]
            if last:
                ready.append(_result([ids[k] for k in first[:-1]], np.array(sizes)[:, :-1], covered[:, :-1], sums[:, :-1], names))
            yield from ready
        if held:
            yield _result([held[0]], np.array([[len(v)] for v in held[1]]), np.array([[v.sum()] for v in held[1]]), held[2][:, None], names)

    return rows.mapInArrow(walk, UNION)


def _pieces(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose sequences and alignments have about ``most`` letters, one row at least."""
    sizes = sum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("qlen", "slen", "length"))
    before, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _result(ids: list, sizes: np.ndarray, covered: np.ndarray, sums: np.ndarray, names: list[str]) -> pa.RecordBatch:
    (nq, ns), (cq, cs), (columns, same, kept) = sizes, covered, sums
    part = np.where(nq == ns, np.minimum(cq, cs) / nq, np.where(nq < ns, cq / nq, cs / ns))
    ani = np.where(columns > 0, 100.0 * same / np.maximum(columns, 1), 0.0)
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ids], pa.string()), pa.array([x for _, x in ids], pa.string()), pa.array(ani), pa.array(100.0 * part), *(pa.array(x.astype(np.int64)) for x in (columns, same, cq, cs, kept))], names)
