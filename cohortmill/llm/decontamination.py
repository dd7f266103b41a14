"""Benchmark decontamination by template canonicalisation.

Words are stripped of punctuation and lower-cased; numbers, names and units become typed placeholders. Windows of
``window`` such tokens are hash-joined between the benchmark and the documents, so a question asked again with other
numbers or names still meets its item. A joined window counts only if its slots are consistent: two slots hold equal
values in the document exactly where they do in the item, within a window and over all windows that follow each other as
in the item. (What is gathered for such a run is at most the item's own windows.)

A number is a word with a digit; a unit is a word of ``UNITS`` right after a number; a name is a capitalised word. One that
begins a sentence or a line may be a name or not, so windows with such openers are hashed twice, on both sides: with all
openers as words and with all of them as names. What the second reading adds to a run counts only if the slots of all its
windows are consistent; the first reading counts by itself as well. Windows with fewer than ``min_literal`` ordinary words are compared word for word, and
an item of fewer than ``window`` words is one such window. Windows that are equal word for word count whether or not the
slots of their run are consistent, against all windows of the item; others count against its template windows.

Defined cases: null, empty and wordless texts on either side match nothing; null ids never match; repeated rows of a doc_id or item_id count once; extra columns of documents pass through
in ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, key_filter, observed, passes, stage
from .textcols import _C3, Texts, grams, mix, pieces

UNITS = ("percent mm cm m km inches feet yards miles mg g kg tons ounces pounds ml l liters gallons s seconds minutes h hours days weeks "
         "months years cents dollars euros pounds watts volts degrees km/h mph").split()
NUMBER, NAME, UNIT = np.uint64(0x11), np.uint64(0x22), np.uint64(0x33)
LITERAL = 0
EXACT = np.uint64(0xA0761D6478BD642F)
PUNCT = np.zeros(256, bool)
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


class Template:
    """token: canonical hash; raw: hash of the stripped word; slot: whether it is a placeholder; at: first token of each text."""

    def __init__(self, column: pa.Array):
        t = Texts(column)
        t.words()
        n, size = len(t.start), int(t.doc_at[-1])
        buf = t.buf
        newline = np.searchsorted(np.flatnonzero(buf[:size] == 10), t.start)
        opens = np.zeros(n, bool)
        opens[t.word_at[:-1][t.word_at[:-1] < n]] = True
        if n:
            opens[1:] |= STOP[buf[t.start[:-1] + t.size[:-1] - 1]] | (newline[1:] != newline[:-1])
        start, stop = t.start.copy(), t.start + t.size
        for at, step in ((start, 1), (stop, -1)):
            live = np.arange(n)
            while len(live):
                edge = at[live] if step == 1 else at[live] - 1
                live = live[(start[live] < stop[live]) & PUNCT[buf[edge]]]
                at[live] += step
        digits = np.concatenate([[0], np.cumsum(DIGIT[buf[:size]])])
        some = start < stop
        # a sentence opened by a word of punctuation alone is opened by the next word
        word = np.flatnonzero(some)
        opens = np.add.reduceat(opens, np.concatenate([[0], word[:-1] + 1]))[: len(word)] > 0 if len(word) else opens[:0]
        start, stop = start[word], stop[word]
        first, second = buf[start], buf[np.minimum(start + 1, len(buf) - 1)]
        accent = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        capital = ((first >= 65) & (first <= 90)) | accent
        # lower-case letters: A-Z and the accented capitals of Latin-1
        low = buf.copy()
        low[(buf >= 65) & (buf <= 90)] += 32
        two = np.flatnonzero(buf[:-1] == 0xC3) + 1
        two = two[(buf[two] >= 0x80) & (buf[two] <= 0x9E) & (buf[two] != 0x97)]
        low[two] += 32
        t.buf = low
        self.raw = t.hashes(start, stop - start)
        number = digits[stop] > digits[start]
        unit = np.zeros(len(word), bool)
        at = np.searchsorted(word, t.word_at)
        if len(word):
            unit[1:] = np.isin(self.raw[1:], unit_hashes()) & number[:-1]
            unit[at[:-1][at[:-1] < len(word)]] = False
        self.opener = capital & opens & ~number & ~unit
        name = capital & ~opens & ~number & ~unit
        self.token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, self.raw)))
        self.slot = number | unit | name
        self.at = at.astype(np.int64)

    def windows(self, window: int, min_literal: int) -> tuple[np.ndarray, ...]:
        """(first token, text, hash, place in its text, whether compared word for word, whether openers are names) of every
        window, those with openers twice where enough ordinary words are left."""
        g, gram_at = grams(self.token, self.at, window)
        runs = np.diff(gram_at)
        first = np.arange(len(g)) + np.repeat(self.at[:-1] - gram_at[:-1], runs)
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        exact = window - (slots[first + window] - slots[first]) < min_literal
        g[exact] = self.exact(first[exact], window)
        text = np.searchsorted(gram_at, np.arange(len(g)), "right") - 1
        place = np.arange(len(g)) - gram_at[text]
        named = np.concatenate([[0], np.cumsum(self.opener)])
        n_named = named[first + window] - named[first]
        twice = np.flatnonzero((n_named > 0) & (window - (slots[first + window] - slots[first]) - n_named >= min_literal))
        token, x = np.where(self.opener, NAME, self.token), np.full(len(twice), np.uint64(window))
        for i in range(window):
            x = mix((x ^ token[first[twice] + i]) * _C3)
        both = lambda a: np.concatenate([a, a[twice]])
        opened = np.repeat([False, True], [len(g), len(twice)])
        return both(first), both(text), np.concatenate([g, x]).view(np.int64), both(place), both(exact), opened

    def exact(self, first: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the words themselves in runs of ``size``."""
        x = np.full(len(first), EXACT + np.uint64(size))
        for i in range(size):
            x = mix((x ^ self.raw[first + i]) * EXACT)
        return x

    def short(self, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, text, hash) of every run of ``size`` words, or only of texts that are such a run."""
        count = np.diff(self.at)
        runs = (count == size).astype(np.int64) if whole else np.maximum(count - size + 1, 0)
        text = np.repeat(np.arange(len(count)), runs)
        first = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs) + self.at[text]
        return first, text, self.exact(first, size).view(np.int64)

    def slot_values(self, first: np.ndarray, window: int, exact: np.ndarray, opened: np.ndarray) -> pa.Array:
        """The values in the slots of each window, in order; none in windows compared word for word."""
        item = np.minimum(first[:, None] + np.arange(window), max(len(self.slot) - 1, 0))
        held = (self.slot[item] | (self.opener[item] & opened[:, None])) & ~exact[:, None]
        at = np.concatenate([[0], np.cumsum(held.sum(1))])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(self.raw[item[held]].view(np.int64)))


def unit_hashes() -> np.ndarray:
    t = Texts(pa.array([" ".join(UNITS)]))
    t.words()
    return t.hashes(t.start, t.size)


WINDOWS = "id long, h long, pos long, size int, exact boolean, opened boolean, slots array<long>"


def _window_rows(window: int, min_literal: int, filter_=None, short: list[int] | None = None):
    """Without a filter, an item's windows; with one, those of documents that pass, and runs of the ``short`` sizes, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            t = Template(b.column("text"))
            parts = [(window, *t.windows(window, min_literal))]
            for size in range(1, window) if filter_ is None else short:
                first, text, h = t.short(size, filter_ is None)
                parts.append((size, first, text, h, np.zeros(len(h), np.int64), np.ones(len(h), bool), np.zeros(len(h), bool)))
            for size, first, text, h, pos, exact, opened in parts:
                if filter_ is not None:
                    some = np.flatnonzero(passes(filter_, h))
                    if size < window:
                        some = some[np.unique(np.stack([text[some], h[some]], 1), axis=0, return_index=True)[1]]
                    first, text, h, pos, exact, opened = (x[some] for x in (first, text, h, pos, exact, opened))
                for i in range(0, len(h), 50_000):
                    r = slice(i, i + 50_000)
                    columns = [b.column("id").take(pa.array(text[r])), pa.array(h[r]), pa.array(pos[r]), pa.array(np.full(len(h[r]), size, np.int32)), pa.array(exact[r]), pa.array(opened[r]), t.slot_values(first[r], size, exact[r], opened[r])]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "h", "pos", "size", "exact", "opened", "slots"])

    return run


def leaked_items(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_literal: int = 5, share: float = 0.5, min_windows: int = 6) -> DataFrame:
    """doc_id, item_id, n_windows, n_item_windows for each document that holds an item: windows in step, of the same
    template or equal word for word, that make up ``share`` of the item's or at least ``min_windows``."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    items = stage(rows.mapInArrow(_window_rows(window, min_literal), WINDOWS).dropDuplicates(["id", "pos", "h"]), "items", n="count(1)")
    sizes = items.groupBy("id").agg(F.count_distinct("pos").alias("n_item_windows"), F.count_distinct(F.when(~F.col("exact"), F.col("pos"))).alias("n_templates"))
    short = [r["size"] for r in items.where(F.col("size") < window).select("size").distinct().collect()]  # fewer than window
    wanted = key_filter(items, "h", 1 << max(22, (64 * observed(items, "n")).bit_length()))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    found = rows.mapInArrow(_window_rows(window, min_literal, wanted, short), WINDOWS)
    d, i = found.alias("d"), items.alias("i")
    pattern = lambda c: F.transform(c, lambda x: F.array_position(c, x))
    met = d.hint("shuffle_merge").join(i, ["h", "size", "exact"]).where(pattern(F.col("d.slots")) == pattern(F.col("i.slots")))
    both = F.arrays_zip(F.col("d.slots").alias("d"), F.col("i.slots").alias("i"))
    met = met.withColumn("plain", ~F.col("d.opened") & ~F.col("i.opened"))
    met = met.select(F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id"), (F.col("d.pos") - F.col("i.pos")).alias("shift"), F.col("i.pos").alias("pos"), both.alias("slots"), "exact", "plain", (F.col("d.slots") == F.col("i.slots")).alias("same"))
    places = lambda of: F.size(F.collect_set(F.when(of, F.col("pos"))))
    values = lambda of: F.array_distinct(F.flatten(F.collect_set(F.when(of, F.col("slots")))))
    plain, every = F.col("plain"), F.lit(True)
    run = met.groupBy("doc_id", "item_id", "shift").agg(places(~F.col("exact") & plain).alias("n"), places(~F.col("exact")).alias("n_all"), places(F.col("same")).alias("n_same"), values(plain).alias("slots"), values(every).alias("slots_all"))

    def steady(c: str):  # one value for each value, in both directions
        return (F.size(F.array_distinct(f"{c}.d")) == F.size(c)) & (F.size(F.array_distinct(f"{c}.i")) == F.size(c))

    counted = F.greatest(F.when(steady("slots"), F.col("n")).otherwise(0), F.when(steady("slots_all"), F.col("n_all")).otherwise(0))
    best = run.groupBy("doc_id", "item_id").agg(F.max(counted).alias("n"), F.max("n_same").alias("n_same"))
    out = best.hint("shuffle_merge").join(sizes.withColumnRenamed("id", "item_id"), "item_id")
    enough = lambda n, of: (F.col(n) > 0) & ((F.col(n) >= min_windows) | (F.col(n) >= share * F.col(of)))
    out = out.where(enough("n", "n_templates") | enough("n_same", "n_item_windows"))
    out = out.select("doc_id", "item_id", F.greatest("n", "n_same").alias("n_windows"), "n_item_windows")
    out._holds = (items,)  # drop(out) drops it
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no benchmark item, unchanged."""
    found = leaked_items(docs, benchmark, **how)
    leaks = stage(found.select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    drop(found)
    out = docs.hint("shuffle_merge").join(leaks, docs["doc_id"] == leaks["_leak"], "left_anti")
    out._holds = (leaks,)
    return out
