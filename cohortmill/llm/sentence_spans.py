"""Substring dedup over sliding sentence spans.

With ``lengthen``, from every sentence the shortest run of sentences with at least ``min_words`` words, forwards and
backwards, is hashed (two 64-bit lanes) and joined over all documents: one long sentence alone, or many short ones. So a
repeated run of whole sentences loses each of them, whatever its neighbours are. Without it, runs of exactly ``span``
sentences are hashed and those under ``min_words`` are not compared. A span belongs to the smallest doc_id that has it;
sentences covered by it in other documents, or by its second and later places in one document, are removed. A passage
that is cut or edited inside its sentences, so that no run of ``min_words`` words is whole, is out of reach.

A sentence ends at a word that ends in ``.``, ``!`` or ``?`` or at a line end; words are compared lower-cased (A-Z).

Defined cases: null, empty and wordless texts have no sentences; rows of one doc_id are one document; rows with null
doc_id neither lose nor own a sentence and are not returned; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, key_filter, observed, passes, stage
from .textcols import Texts, mix, pieces

_K, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


class Sentences:
    """begin: first word of each sentence; at: each text's first sentence (one more entry than texts)."""

    def __init__(self, column: pa.Array):
        t = self.texts = Texts(column, lower=True)
        t.words()
        n = len(t.start)
        newline = np.searchsorted(np.flatnonzero(t.buf[: t.doc_at[-1]] == 10), t.start)
        new = np.zeros(n, bool)
        new[t.word_at[:-1][t.word_at[:-1] < n]] = True
        if n:
            new[1:] |= STOP[t.buf[t.start[:-1] + t.size[:-1] - 1]] | (newline[1:] != newline[:-1])
        self.begin = np.flatnonzero(new)
        self.at = np.searchsorted(self.begin, t.word_at)
        self.words = np.diff(np.append(self.begin, n))

    def runs(self, span: int, min_words: int, lengthen: bool) -> tuple[np.ndarray, np.ndarray]:
        """(first sentence, sentence after the last) of every span that stays in a text, by first sentence."""
        count = np.diff(self.at)
        words = np.concatenate([[0], np.cumsum(self.words)])
        if not lengthen:
            runs = np.maximum(count - span + 1, 0)
            first = np.arange(runs.sum()) + np.repeat(self.at[:-1] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs)
            first = first[words[first + span] - words[first] >= min_words]
            return first, first + span
        n = len(self.begin)
        one = np.arange(n)
        to = np.searchsorted(words, words[:-1] + min_words)
        back = np.searchsorted(words, words[1:] - min_words, "right") - 1
        ahead, behind = to <= np.repeat(self.at[1:], count), back >= np.repeat(self.at[:-1], count)
        both = np.unique(np.concatenate([one[ahead] * (n + 1) + to[ahead], back[behind] * (n + 1) + one[behind] + 1]))
        return both // (n + 1), both % (n + 1)

    def spans(self, span: int, min_words: int, lengthen: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, sentence after the last, lane 1, lane 2) of every span."""
        t = self.texts
        h = t.hashes(t.start, t.size)
        place = (np.arange(len(h)) - np.repeat(self.begin, self.words)).astype(np.uint64) + np.uint64(1)
        lanes = [np.add.reduceat(mix((h ^ (place * k)) * k), self.begin) if len(h) else h for k in (_K, _K2)]
        first, end = self.runs(span, min_words, lengthen)
        out = []
        for lane, k in zip(lanes, (_K, _K2)):
            x = np.full(len(first), k)
            live, i = np.arange(len(first)), 0
            while len(live):
                x[live] = mix((x[live] ^ lane[first[live] + i]) * _K)
                i += 1
                live = live[first[live] + i < end[live]]
            out.append(x.view(np.int64))
        return first, end, *out


def _local(first: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each span, whether an earlier span of its text has its hash). Inside one text a single lane tells spans apart:
    the two lanes are for spans of all documents."""
    doc = np.searchsorted(at, first, "right") - 1
    order = np.lexsort((first, h, doc))
    again = np.zeros(len(first), bool)
    again[order[1:][(h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])]] = True
    return doc, again


SPANS = "doc_id long, h1 long, h2 long"


def _span_rows(span: int, min_words: int, lengthen: bool, filter_=None):
    """Each text's distinct spans. With a filter: those that pass, and a row with null hashes for texts that repeat themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = Sentences(b.column("text"))
            first, _, h1, h2 = s.spans(span, min_words, lengthen)
            doc, again = _local(first, h1, s.at)
            keep = ~again
            if filter_ is not None:
                keep &= passes(filter_, h1)
                own = np.unique(doc[again])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(own)), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64())], ["doc_id", "h1", "h2"])
            ids = b.column("doc_id").take(pa.array(doc[keep]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h1[keep]), pa.array(h2[keep])], ["doc_id", "h1", "h2"])

    return run


def _rebuilt(span: int, min_words: int, lengthen: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(iter([whole])):
                s = Sentences(b.column("text"))
                first, end, h1, _ = s.spans(span, min_words, lengthen)
                doc, gone = _local(first, h1, s.at)
                lost = b.column("lost").to_pylist()
                spans_at = np.searchsorted(doc, np.arange(b.num_rows + 1))
                for i in range(b.num_rows):
                    if lost[i]:
                        r = slice(spans_at[i], spans_at[i + 1])
                        gone[r] |= np.isin(h1[r], np.array(lost[i], np.int64))
                cover = np.zeros(len(s.begin) + 1, np.int64)
                np.add.at(cover, first[gone], 1)
                np.add.at(cover, end[gone], -1)
                out = np.cumsum(cover)[: len(s.begin)] > 0
                n_gone, n_words, texts = [], [], []
                start = s.texts.start[s.begin]
                for i, text in enumerate(b.column("text")):
                    r = slice(s.at[i], s.at[i + 1])
                    n_gone.append(int(out[r].sum()))
                    n_words.append(int(s.words[r][out[r]].sum()))
                    raw = (text.as_py() or "").encode()
                    if n_gone[-1]:
                        cuts = np.append(start[r] - s.texts.doc_at[i], len(raw))
                        raw = raw[: cuts[0]] + b"".join(raw[x:y] for x, y, z in zip(cuts, cuts[1:], out[r]) if not z)
                    texts.append(raw.decode())
                keep = [c for c in b.schema.names if c not in ("text", "lost")]
                new = {"text": pa.array(texts, pa.string()), "n_sentences": pa.array(np.diff(s.at)), "n_removed": pa.array(n_gone, pa.int64()), "n_removed_words": pa.array(n_words, pa.int64())}
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + list(new.values()), keep + list(new))

    return run


def _some_rows(filter_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            b = b.filter(pa.array(passes(filter_, b.column("doc_id").to_numpy())))
            if b.num_rows:
                yield b

    return run


def span_dedup(docs: DataFrame, span: int = 2, min_words: int = 12, lengthen: bool = False) -> DataFrame:
    """doc_id, text, first_doc_ids, n_sentences, n_removed, n_removed_words of every document that loses sentences; text is
    what is left, first_doc_ids are the documents that keep the repeated spans. Documents not listed stay as they are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    every = rows.mapInArrow(_span_rows(span, min_words, lengthen), SPANS)
    owners = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    owners = stage(owners, "spans", n="count(1)")
    wanted = key_filter(owners, "h1", 1 << max(20, (16 * observed(owners, "n")).bit_length()))
    found = stage(rows.mapInArrow(_span_rows(span, min_words, lengthen, wanted), SPANS), "found")
    wanted.destroy()
    lost = found.where("h1 is not null").hint("shuffle_merge").join(owners, ["h1", "h2"]).where("owner <> doc_id")
    own = found.where("h1 is null").select("doc_id", "h1", F.lit(None).cast("long").alias("owner"))
    lost = lost.select("doc_id", "h1", "owner").union(own)
    lost = stage(lost.groupBy("doc_id").agg(F.collect_set("h1").alias("lost"), F.sort_array(F.collect_set("owner")).alias("first_doc_ids")), "lost", n="count(1)")
    drop(owners, found)
    ids = key_filter(lost, "doc_id", 1 << max(20, (16 * observed(lost, "n")).bit_length()))
    texts = rows.mapInArrow(_some_rows(ids), "doc_id long, text string").hint("shuffle_merge").join(lost, "doc_id")
    out = "doc_id long, first_doc_ids array<long>, text string, n_sentences long, n_removed long, n_removed_words long"
    return texts.select("doc_id", "first_doc_ids", "text", "lost").mapInArrow(_rebuilt(span, min_words, lengthen), out).where("n_removed > 0")

