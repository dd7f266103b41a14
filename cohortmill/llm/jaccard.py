"""N-gram Jaccard join with signature trees.

All texts go in; links (Jaccard of distinct word shingles at or above num/den) and their connected components come out.

1. *Classes.* Texts with equal shingle sets are one class, named by its smallest doc_id; only classes go on.
2. *Roots.* A set is cut by hash range into more parts than a linked pair may differ in, so any two linked sets have an
   equal part; (level of size, part, its content) names a root of a tree. Levels bound the size ranges that meet in a
   root. A set with too few non-empty parts for that argument also takes the roots of its prefix tokens. Every pair that
   links is together under some root, so walking all trees loses no link.
3. *Trees.* Under a root, leaf nodes of about ``fan_out`` classes hold the OR of their members' token bitmaps, the range
   of set sizes and the most tokens that share a bit; branch nodes hold the same over their children, in as many levels
   as the root's size needs, so that no node has more than ``fan_out`` children.
4. *Nearest.* The first walk goes to the leaves of each class's first few roots: every member is taken with the member
   its bitmap comes nearest to and with its leaf's centre, and, where a root has several leaves, with the centre of its
   best leaf. Pairs that verify join families at a cost linear in their members.
5. *Walk.* The second walk takes all roots that still hold several components. Pairs of nodes are walked from the top
   down; a pair goes if its largest possible overlap (common bits plus shared-bit tokens, at most the smaller size) is too
   small for its smallest sizes, or if both lie in one component. Pairs of members are bounded by bitmaps whose width
   follows the set size, under the first root that both have among their first ``HEADS``, so a pair seldom comes twice.
6. What is left is verified on whole texts, leaf by leaf, so a text is sent once for a node pair and not for each pair.

Copies are no edges: a document gets its class's component by join. No group is gathered in one task, and nothing but
fixed-size bitmaps is sent to the driver.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; texts of fewer
words than k have one shingle; rows of one doc_id are one document for links; rows with null doc_id are returned with
component null and link with nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .storage import drop, key_filter, observed, passes, stage
from .textcols import Texts, grams, mix, pieces

SIG_LONGS, HEADS, FIRST_ROOTS, MOST_BITS = 16, 24, 4, 1 << 20
N = {"n": "count(1)"}
SIG = [f"s{i}" for i in range(SIG_LONGS)]
_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin (one more entry than texts)."""
    t = Texts(column, lower=True)
    t.words()
    h = t.hashes(t.start, t.size)
    g, at = grams(h, t.word_at, k)
    sets = []
    for i in range(t.n):
        if at[i + 1] > at[i]:
            sets.append(np.unique(g[at[i] : at[i + 1]]))
        elif (n := t.word_at[i + 1] - t.word_at[i]) > 0:
            sets.append(grams(h[t.word_at[i] : t.word_at[i + 1]], np.array([0, n]), int(n))[0])
        else:
            sets.append(g[:0])
    return np.concatenate([*sets, g[:0]]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _reduce(ufunc, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ufunc over each range of at; 0 for empty ones."""
    out = np.zeros(len(at) - 1, x.dtype)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        out[some] = ufunc.reduceat(x, at[some])
    return out


class Scheme:
    """Levels of set sizes and their numbers of parts for one threshold num/den."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.num, self.den = num, den
        low = -(-num // (den - num))  # smaller sets link with equal ones only
        lows = [low]
        while lows[-1] < most:
            lows.append(-(-lows[-1] * 13 // 10))
        self.low = np.array(lows)
        self.differ = (self.low[1:] - 1) * (den - num) // num  # most tokens that a pair of a level differs in
        self.parts = self.differ * 21 // 20 + 2

    def keys(self, u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the set, root key) of every root of every set."""
        size = np.diff(at)
        own = np.searchsorted(self.low, size, "right") - 1
        out_set, out_key = [], []
        poor = np.zeros(len(size), bool)
        lower = (own > 0) & (size * self.num <= (self.low[np.maximum(own, 0)] - 1) * self.den)
        for which, level in ((own >= 0, own), (lower, own - 1)):
            sets = np.flatnonzero(which)
            if not len(sets):
                continue
            n, lv = size[sets], level[sets]
            item = np.arange(n.sum()) + np.repeat(at[sets] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            who = np.repeat(np.arange(len(sets)), n)
            x = u[item]
            part = ((x >> np.uint64(32)) * self.parts[lv][who].astype(np.uint64)) >> np.uint64(32)
            begin = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (who[1:] != who[:-1])]))
            content = np.add.reduceat(mix(x), begin)
            owner = who[begin]
            tag = mix((lv[owner].astype(np.uint64) << np.uint64(40)) + part[begin] + np.uint64(1))
            out_set.append(sets[owner])
            out_key.append(mix((content ^ tag) * _K))
            poor[sets[np.bincount(owner, minlength=len(sets)) <= self.differ[lv]]] = True
        for i in np.flatnonzero(poor):
            prefix = size[i] - (size[i] * self.num + self.den - 1) // self.den + 1
            out_set.append(np.full(prefix, i))
            out_key.append(mix(u[at[i] : at[i] + prefix] ^ _K))
        if not out_set:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(out_set), np.concatenate(out_key)


def _batch(**cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _doc_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            u, at = shingle_sets(b.column("text"), k)
            c1, c2 = _reduce(np.add, mix(u), at), _reduce(np.add, mix(u ^ _K), at)
            yield _batch(doc_id=b.column("doc_id"), n_shingles=pa.array(np.diff(at)), c1=_signed(c1), c2=_signed(c2))

    return run


def _key_rows(k: int, scheme: Scheme, filter_=None):
    """(k, c): each text's root keys and the hash of its set; with a filter, (k, c, id) of those that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            u, at = shingle_sets(b.column("text"), k)
            who, key = scheme.keys(u, at)
            c = _reduce(np.add, mix(u), at)
            if filter_ is not None:
                some = passes(filter_, key.view(np.int64))
                who, key = who[some], key[some]
            for i in range(0, len(key), 100_000):
                w = who[i : i + 100_000]
                more = {} if filter_ is None else {"id": b.column("doc_id").take(pa.array(w))}
                yield _batch(k=_signed(key[i : i + 100_000]), c=_signed(c[w]), **more)

    return run


def _signature_rows(k: int, filter_):
    """id, size, extra, the bitmap of the nodes (SIG) and the bitmap whose width follows the size (wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            b = b.filter(pa.array(passes(filter_, b.column("doc_id").to_numpy())))
            if not b.num_rows:
                continue
            u, at = shingle_sets(b.column("text"), k)
            sig = np.zeros((b.num_rows, SIG_LONGS), np.uint64)
            who = np.repeat(np.arange(b.num_rows), np.diff(at))
            bit = mix(u ^ np.uint64(77))
            np.bitwise_or.at(sig, (who, ((bit >> np.uint64(6)) % np.uint64(SIG_LONGS)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            size = np.diff(at)
            extra = size - np.bitwise_count(sig).sum(1).astype(np.int64)
            wide = []
            for i, n in enumerate(size):
                bits = min(MOST_BITS, 1 << int(8 * n + 63).bit_length())
                on = np.zeros(bits, bool)
                on[(bit[at[i] : at[i + 1]] & np.uint64(bits - 1)).astype(np.int64)] = True
                wide.append(np.packbits(on).tobytes())
            yield _batch(id=b.column("doc_id"), size=pa.array(size), extra=pa.array(extra), wide=pa.array(wide, pa.binary()), **{s: _signed(np.ascontiguousarray(sig[:, i])) for i, s in enumerate(SIG)})

    return run


def _wide_common(x: bytes, y: bytes, n: int, m: int) -> int:
    """The most tokens that two sets of n and m have in common, by their wide bitmaps."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) != len(q):  # a width is a power of two, and a bit's place its hash modulo the width
        p, q = (p[: len(p) // 2] | p[len(p) // 2 :], q) if len(p) > len(q) else (p, q[: len(q) // 2] | q[len(q) // 2 :])
    return min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))


def _text_rows(filter_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            b = b.filter(pa.array(passes(filter_, b.column("doc_id").to_numpy())))
            if b.num_rows:
                yield b

    return run


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches sorted by blk, cut anew so that each block is whole, in parts of about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        blk = b.column("blk").to_numpy()
        edge = np.flatnonzero(blk[1:] != blk[:-1]) + 1
        if held and held[0].column("blk")[0].as_py() != blk[0]:
            yield pa.concat_batches(held)
            held = []
        if not len(edge):
            held.append(b)
            continue
        sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), float))])
        begin = 0
        for x, y in zip(edge, [*edge[1:], None]):
            if y is None or held or sizes[y] - sizes[begin] > most:
                yield pa.concat_batches([*held, b.slice(begin, x - begin)])
                held, begin = [], int(x)
        held = [b.slice(begin)]
    if held:
        yield pa.concat_batches(held)


def _verified(k: int, num: int, den: int):
    """The (a, b) that link, of blocks of (blk, id, others, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            u, at = shingle_sets(b.column("text"), k)
            blk, ids = b.column("blk").to_numpy(), b.column("id").to_numpy()
            rows: dict = {}
            for i in range(b.num_rows):
                rows.setdefault((blk[i], ids[i]), []).append(i)
            left, right = [], []
            for i, others in enumerate(b.column("others").to_pylist()):
                x = u[at[i] : at[i + 1]]
                for o in others:
                    for j in rows.get((blk[i], o), ()):
                        y = u[at[j] : at[j + 1]]
                        if min(len(x), len(y)) * den < num * max(len(x), len(y)):
                            continue
                        both = np.concatenate([x, y])
                        both.sort(kind="stable")
                        both = int((both[1:] == both[:-1]).sum())
                        if both > 0 and den * both >= num * (len(x) + len(y) - both):
                            left.append(ids[i])
                            right.append(o)
            yield _batch(a=pa.array(left, pa.int64()), b=pa.array(right, pa.int64()))

    return run


class JaccardJoin:
    def __init__(self, docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, fan_out: int = 32):
        self.k, self.num, self.den, self.fan_out = k, num, den, fan_out
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.known = self.rows.where("doc_id is not null and text is not null")
        self.scheme = Scheme(num, den)
        self.n_pairs: dict[str, int] = {}  # by walk: pairs that its bounds left, and those that link
        self.n_links: dict[str, int] = {}
        self.spent: list[DataFrame] = []

    def held(self, df: DataFrame, name: str, **seen: str) -> DataFrame:
        """A staged table that goes when its step is done."""
        self.spent.append(stage(df, name, **seen))
        return self.spent[-1]

    def verify(self, pairs: DataFrame, step: str) -> DataFrame:
        """The (a, b) of (blk, a, b) whose texts link. Only texts named there are shuffled, once for each block."""
        pairs = stage(pairs, "pairs", **N)
        ends = pairs.select("blk", F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("blk", F.col("b").alias("id"), F.lit(None).cast("long").alias("other")))
        n = observed(pairs, "n")
        named = key_filter(ends, "id", _bits(2 * n))
        texts = self.known.mapInArrow(_text_rows(named), "doc_id long, text string")
        blocks = ends.groupBy("blk", "id").agg(F.collect_set("other").alias("others"))  # fan_out others at most
        blocks = blocks.hint("shuffle_merge").join(texts, F.col("id") == F.col("doc_id"))
        blocks = blocks.select("blk", "id", "others", "text").repartition("blk").sortWithinPartitions("blk")
        links = stage(blocks.mapInArrow(_verified(self.k, self.num, self.den), "a long, b long").distinct(), "links", **N)
        named.destroy()
        drop(pairs, *self.spent)
        self.spent.clear()
        self.n_pairs[step], self.n_links[step] = n, observed(links, "n")
        return links

    def shared_roots(self) -> DataFrame:
        """(k, id): the classes under each root that several have."""
        keys = self.known.mapInArrow(_key_rows(self.k, self.scheme), "k long, c long")
        shared = keys.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k")
        shared = stage(shared, "roots", **N)
        wanted = key_filter(shared, "k", _bits(16 * observed(shared, "n")))
        keys = self.known.mapInArrow(_key_rows(self.k, self.scheme, wanted), "k long, c long, id long")
        keys = keys.groupBy("k", "c").agg(F.min("id").alias("id")).select("k", "id")  # copies of a set: its smallest doc_id
        members = stage(keys.hint("shuffle_merge").join(shared, "k", "left_semi"), "members")
        wanted.destroy()
        drop(shared)
        return members

    def first_members(self, members: DataFrame) -> DataFrame:
        """(k, id, comp, heads): each class under its first roots only, as its own component."""
        heads = members.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("k")), 1, FIRST_ROOTS).alias("heads"))
        return heads.select(F.explode("heads").alias("k"), "id", F.col("id").alias("comp"), "heads")

    def open_members(self, members: DataFrame, parts: DataFrame) -> DataFrame | None:
        """(k, id, comp, heads) under the roots that hold several components, if any does."""
        named = members.withColumn("s", F.xxhash64("id")).hint("shuffle_merge").join(parts.select(F.col("node").alias("id"), "component", F.xxhash64("node").alias("s")), ["id", "s"], "left")
        named = stage(named.select("k", "id", F.coalesce("component", "id").alias("comp")), "named")
        mixed = named.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("k", F.xxhash64("k").alias("s"))
        held = self.held(named.withColumn("s", F.xxhash64("k")).hint("shuffle_merge").join(mixed, ["k", "s"], "left_semi").select("k", "id", "comp"), "open", **N)
        drop(named)
        if not observed(held, "n"):
            return None
        keys = F.sort_array(F.collect_list("k"))
        heads = held.groupBy("id").agg(F.min("comp").alias("comp"), keys.alias("keys"))
        return heads.select(F.explode("keys").alias("k"), "id", "comp", F.slice("keys", 1, HEADS).alias("heads"))

    def bounded(self, x: str, y: str) -> Column:
        """Whether two nodes may hold a link: overlap >= num/(num + den) of the two sizes, by bitmaps and size ranges."""
        common = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseAND(F.col(f"{y}.{s}"))) for s in SIG), F.lit(0))
        most = F.least(common + F.least(f"{x}.extra", f"{y}.extra"), f"{x}.hi", f"{y}.hi")
        sizes = (F.col(f"{x}.lo") * self.num <= F.col(f"{y}.hi") * self.den) & (F.col(f"{y}.lo") * self.num <= F.col(f"{x}.hi") * self.den)
        apart = (F.col(f"{x}.c_lo") != F.col(f"{x}.c_hi")) | (F.col(f"{y}.c_lo") != F.col(f"{y}.c_hi")) | (F.col(f"{x}.c_lo") != F.col(f"{y}.c_lo"))
        return apart & sizes & (most * (self.num + self.den) >= self.num * (F.col(f"{x}.lo") + F.col(f"{y}.lo")))

    def leaves(self, members: DataFrame) -> DataFrame:
        """The leaf nodes under each root, and how many it has at most. Small components share leaves, dealt anew under
        each root; large ones have leaves of their own. A member's wide bitmap lies only under its first roots."""
        f = self.fan_out
        held = stage(members, "held", **N)
        ids = key_filter(held, "id", _bits(16 * observed(held, "n")))
        docs = self.known.mapInArrow(_signature_rows(self.k, ids), ", ".join(["id long, size long, extra long, wide binary", *(f"{s} long" for s in SIG)]))
        docs = docs.groupBy("id").agg(*(F.max(c).alias(c) for c in ("size", "extra", "wide")), *(F.bit_or(s).alias(s) for s in SIG)) if self.repeated else docs
        per = held.groupBy("k", "comp").agg(F.count("*").alias("n"))
        whole = per.groupBy("k").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("n") <= f // 2, F.col("n"))).alias("n_small"), F.sum(F.when(F.col("n") > f // 2, F.ceil(F.col("n") / f))).alias("n_own"))
        whole = whole.where("n_all > 1").select("k", "n_small", (F.ceil(F.coalesce("n_small", F.lit(0)) / f) + F.coalesce("n_own", F.lit(0))).cast("long").alias("n_leaves"), F.xxhash64("k").alias("s"))
        per = per.withColumn("s", F.xxhash64("k")).hint("shuffle_merge").join(whole, ["k", "s"]).withColumn("s", F.xxhash64("k", "comp"))
        placed = held.withColumn("s", F.xxhash64("k", "comp")).hint("shuffle_merge").join(per, ["k", "comp", "s"])
        pooled = F.pmod(F.xxhash64("comp", "k"), F.ceil(F.col("n_small") / f))
        own = F.xxhash64("comp", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / f)))
        placed = placed.select("k", "id", "comp", "heads", "n_leaves", F.when(F.col("n") <= f // 2, pooled).otherwise(own).alias("leaf"))
        ored = [F.bit_or(s).alias(s) for s in SIG]
        wide = F.when(F.array_contains("heads", F.col("k")), F.col("wide")).alias("wide")
        leaf = placed.hint("shuffle_merge").join(docs, "id").groupBy("k", "leaf").agg(
            F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("extra").alias("extra"), F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi"), F.max("n_leaves").alias("n_leaves"),
            F.collect_list(F.struct("id", "comp", "size", "heads", wide, *SIG)).alias("of"), *ored)
        out = stage(leaf, "leaves", most="max(n_leaves)", **N)
        ids.destroy()
        drop(held)
        return out

    def nearest_pairs(self, leaf: DataFrame) -> DataFrame:
        """(blk, a, b) for each member: the nearest of its leaf, the leaf's centre, the centre of the root's best leaf."""
        rows = leaf.select(F.xxhash64("k", "leaf").alias("blk"), "k", "n_leaves", "of")
        near = self.held(rows.mapInArrow(_nearest(self.num, self.den), "blk long, k long, a long, b long, score double"), "near")
        best = near.where("b is null").groupBy("k").agg(F.max(F.struct("score", "a", "blk")).alias("best"), F.count("*").alias("n")).where("n > 1")
        best = best.select("k", F.col("best.a").alias("centre"), F.xxhash64("k").alias("s"))
        many = leaf.where("n_leaves > 1").select("k", F.xxhash64("k", "leaf").alias("blk"), F.explode("of.id").alias("a"), F.xxhash64("k").alias("s"))
        many = many.hint("shuffle_merge").join(best, ["k", "s"]).where("a <> centre").select("blk", "a", F.col("centre").alias("b"))
        return near.where("b is not null").select("blk", "a", "b").union(many)

    def walk_pairs(self, leaf: DataFrame) -> DataFrame:
        """(blk, a, b): all pairs of different components that dual traversal of the trees leaves. Level j of a tree has
        n_leaves / fan_out^j nodes; the walk begins where no root has more than ``fan_out``."""
        f, top = self.fan_out, 0
        while (observed(leaf, "most") or 0) > f ** (top + 1):
            top += 1
        place = [F.col("leaf")]
        for j in range(1, top + 1):
            place.append(F.pmod(F.xxhash64(place[-1], F.lit(j)), F.ceil(F.col("n_leaves") / f**j)))
        named = leaf.select("k", "lo", "hi", "extra", "c_lo", "c_hi", *SIG, *(p.alias(f"at{j}") for j, p in enumerate(place)))
        ored = [F.bit_or(s).alias(s) for s in SIG]

        def nodes(j: int) -> DataFrame:
            if not j:
                return named
            up = [f"at{j + 1}"] if j < top else []
            return named.groupBy("k", f"at{j}", *up).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("extra").alias("extra"), F.min("c_lo").alias("c_lo"), F.max("c_hi").alias("c_hi"), *ored)

        x, y = nodes(top).alias("x"), nodes(top).alias("y")
        here = f"at{top}"
        both = x.hint("shuffle_merge").join(y, (F.col("x.k") == F.col("y.k")) & (F.col(f"x.{here}") <= F.col(f"y.{here}")) & self.bounded("x", "y"))
        both = both.select(F.col("x.k").alias("root"), F.col(f"x.{here}").alias("px"), F.col(f"y.{here}").alias("py"))
        for j in range(top - 1, -1, -1):
            x, y, here, up = nodes(j).alias("x"), nodes(j).alias("y"), f"at{j}", f"at{j + 1}"
            down = both.hint("shuffle_merge").join(x, (F.col("x.k") == F.col("root")) & (F.col(f"x.{up}") == F.col("px")))
            down = down.hint("shuffle_merge").join(y, (F.col("y.k") == F.col("root")) & (F.col(f"y.{up}") == F.col("py")) & self.bounded("x", "y"))
            down = down.where(f"px < py or x.{here} <= y.{here}")
            both = down.select(F.col("root"), F.col(f"x.{here}").alias("px"), F.col(f"y.{here}").alias("py"))
        both = self.held(both.withColumnRenamed("root", "k"), "node-pairs")
        held = leaf.select("k", "leaf", "of")
        down = both.hint("shuffle_merge").join(held.withColumnRenamed("of", "ox").withColumnRenamed("leaf", "px"), ["k", "px"])
        down = down.hint("shuffle_merge").join(held.withColumnRenamed("of", "oy").withColumnRenamed("leaf", "py"), ["k", "py"])
        return down.select("k", F.xxhash64("k", "px", "py").alias("blk"), "ox", "oy").mapInArrow(_member_pairs(self.num, self.den), "blk long, a long, b long")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row of documents."""
        rows = stage(self.rows.mapInArrow(_doc_rows(self.k), "doc_id long, n_shingles long, c1 long, c2 long"), "sets")
        full = rows.where("n_shingles > 0 and doc_id is not null")
        classes = stage(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "classes")
        again = full.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct("c1", "c2")).alias("c"), F.max(F.struct("c1", "c2")).alias("z")).where("n > 1").select("doc_id", "c", "z")
        again = stage(again, "again", apart="count_if(c <> z)", **N)
        self.repeated = observed(again, "n") > 0
        members = self.shared_roots()
        leaf = self.leaves(self.first_members(members))
        found = self.verify(self.nearest_pairs(leaf), "nearest")
        drop(leaf)
        if observed(again, "apart"):  # one doc_id with several texts joins their classes
            several = full.hint("shuffle_merge").join(again.where("c <> z").select("doc_id"), "doc_id", "left_semi")
            several = several.hint("shuffle_merge").join(classes, ["c1", "c2"]).groupBy("doc_id")
            found = found.union(several.agg(F.collect_set("rep").alias("r")).select(F.array_min("r").alias("a"), F.explode("r").alias("b")))
        parts = components(found)
        drop(found)
        left, more = self.open_members(members, parts), None
        if left is not None:
            leaf = self.leaves(left)
            more = self.verify(self.walk_pairs(leaf), "walk")
            drop(leaf)
        drop(members, again, *self.spent)
        named = classes.hint("shuffle_merge").join(parts, F.col("rep") == F.col("node"), "left").select("c1", "c2", "rep", F.coalesce("component", "rep").alias("component"))
        if more is not None and observed(more, "n"):
            name = parts.select(F.col("node").alias("id"), "component")
            ends = more.hint("shuffle_merge").join(name.withColumnRenamed("component", "ca"), F.col("a") == F.col("id"), "left").drop("id")
            ends = ends.hint("shuffle_merge").join(name.withColumnRenamed("component", "cb"), F.col("b") == F.col("id"), "left")
            last = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
            named = named.hint("shuffle_merge").join(last.select("node", F.col("component").alias("last")), F.col("component") == F.col("node"), "left")
            named = named.select("c1", "c2", "rep", F.coalesce("last", "component").alias("component"))
        else:
            last = None
        named = stage(named.select("c1", "c2", F.col("component").alias("component_id")), "named")
        drop(more, parts, classes, last)
        out = rows.hint("shuffle_merge").join(named, ["c1", "c2"], "left")
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id"))
        out._holds = (rows, named)  # drop(out) drops them
        return out


class _Members:
    """The members of lists of nodes, flat; at: where each list begins (one more entry than lists)."""

    def __init__(self, col: pa.ListArray):
        flat = col.flatten()
        self.at = np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy())]).astype(np.int64)
        field = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        self.id, self.comp, self.size = field("id"), field("comp"), field("size")
        self.wide = flat.field("wide")
        heads = flat.field("heads")
        n = pc.list_value_length(heads).to_numpy()
        self.heads = np.full((len(n), HEADS), np.iinfo(np.int64).max)
        self.heads[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = heads.flatten().to_numpy()
        self.sig = np.stack([field(s) for s in SIG], 1).view(np.uint64)


def _facing(x: _Members, y: _Members, num: int, den: int, most: int = 500_000) -> Iterator[tuple]:
    """(list, member of x, member of y, most common tokens) of the pairs of different components in facing lists whose
    bitmaps allow a link, some lists at a time."""
    pairs = np.concatenate([[0], np.cumsum(np.diff(x.at) * np.diff(y.at))])
    row = 0
    while row < len(x.at) - 1:
        to = max(row + 1, int(np.searchsorted(pairs, pairs[row] + most, "right")) - 1)
        n = np.diff(pairs[row : to + 1])
        who = np.repeat(np.arange(row, to), n)
        at_pair = np.arange(n.sum()) - np.repeat(pairs[row:to] - pairs[row], n)
        across = np.diff(y.at)[who]
        i, j = x.at[who] + at_pair // across, y.at[who] + at_pair % across
        fit = (x.comp[i] != y.comp[j]) & (x.size[i] * num <= y.size[j] * den) & (y.size[j] * num <= x.size[i] * den)
        who, i, j = who[fit], i[fit], j[fit]
        p, q = x.sig[i], y.sig[j]
        common = np.minimum(x.size[i] - np.bitwise_count(p & ~q).sum(1).astype(np.int64), y.size[j] - np.bitwise_count(q & ~p).sum(1).astype(np.int64))
        fit = common * (num + den) >= num * (x.size[i] + y.size[j])
        yield who[fit], i[fit], j[fit], common[fit]
        row = to


def _nearest(num: int, den: int):
    """For each leaf, its members beside their nearest and beside the centre; a row without b names the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _Members(b.column("of"))
            k, blk, several = b.column("k").to_numpy(), b.column("blk").to_numpy(), b.column("n_leaves").to_numpy() > 1
            rows = [[], [], [], []]  # list, a, b, score
            for who, i, j, common in _facing(x, x, num, den):
                alike = common / (x.size[i] + x.size[j])
                order = np.lexsort((j, -alike, i))
                first = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(order) else order
                total = np.bincount(i, alike, len(x.id))
                lists = np.unique(who)
                owner = np.repeat(np.arange(b.num_rows), np.diff(x.at))
                inside = np.flatnonzero(np.isin(owner, lists))
                order = inside[np.lexsort((x.id[inside], -total[inside], owner[inside]))]
                centre = np.full(b.num_rows, -1)
                centre[owner[order][::-1]] = order[::-1]
                to_centre = j == centre[who]
                keep = np.union1d(first, np.flatnonzero(to_centre))
                rows[0].append(who[keep])
                rows[1].append(x.id[i[keep]])
                rows[2].append(x.id[j[keep]])
                rows[3].append(np.zeros(len(keep)))
                lists = lists[several[lists]]
                rows[0].append(lists)
                rows[1].append(x.id[centre[lists]])
                rows[2].append(np.full(len(lists), -1))
                rows[3].append(total[centre[lists]] / np.diff(x.at)[lists])
            who, p, q, score = (np.concatenate(r) if r else np.zeros(0, np.int64) for r in rows)
            lone = score > 0
            p, q = np.where(lone, p, np.minimum(p, q)), np.where(lone, q, np.maximum(p, q))
            one = np.unique(np.stack([who, p, q], 1), axis=0, return_index=True)[1]
            who, p, q, score, lone = who[one], p[one], q[one], score[one], lone[one]
            yield _batch(blk=pa.array(blk[who]), k=pa.array(k[who]), a=pa.array(p), b=pa.array(q, mask=lone), score=pa.array(score.astype(float)))

    return run


def _member_pairs(num: int, den: int):
    """The last level of the walk: pairs of members of two leaves whose own bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _Members(batch.column("ox")), _Members(batch.column("oy"))
            k, blk = batch.column("k").to_numpy(), batch.column("blk").to_numpy()
            for who, i, j, _ in _facing(x, y, num, den):
                keep = np.arange(len(i))
                for n in range(HEADS):  # a pair with an earlier head in common comes under that root
                    p = x.heads[i[keep], n]
                    keep = keep[~((p < k[who[keep]]) & (y.heads[j[keep]] == p[:, None]).any(1))]
                who, i, j = who[keep], i[keep], j[keep]
                ok = np.ones(len(i), bool)
                for n, (p, q) in enumerate(zip(x.wide.take(pa.array(i)).to_pylist(), y.wide.take(pa.array(j)).to_pylist())):
                    if p is not None and q is not None:
                        s, t = int(x.size[i[n]]), int(y.size[j[n]])
                        ok[n] = _wide_common(p, q, s, t) * (num + den) >= num * (s + t)
                a, b = x.id[i[ok]], y.id[j[ok]]
                rows = np.unique(np.stack([blk[who[ok]], np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield _batch(blk=pa.array(np.ascontiguousarray(rows[:, 0])), a=pa.array(np.ascontiguousarray(rows[:, 1])), b=pa.array(np.ascontiguousarray(rows[:, 2])))

    return run


def _bits(n: int) -> int:
    return 1 << max(20, int(n).bit_length() + 1)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: five-word shingles and a similarity of 0.8 unless told otherwise."""
    return JaccardJoin(docs, k, num, den).run()


def drop_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without all but the smallest doc_id of each component, and without repeated rows of a doc_id. Rows
    with null doc_id stay. Other columns are kept."""
    found = near_duplicates(docs, k, num, den)
    losers = stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_lost")).distinct(), "copies")
    drop(found)
    kept = docs.hint("shuffle_merge").join(losers, docs["doc_id"] == losers["_lost"], "left_anti")
    out = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))
    out._holds = (losers,)
    return out
