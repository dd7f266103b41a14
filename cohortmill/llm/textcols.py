"""Numpy views of Arrow text columns: words, lines and their hashes for many whole texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> _S30)
    x *= _C1
    x ^= x >> _S27
    x *= _C2
    x ^= x >> _S31
    return x


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``most`` bytes of text; a longer text comes alone and whole."""
    for b in batches:
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False), float)))
        at = 0
        while at < b.num_rows:
            base = sizes[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield b.slice(at, to - at)
            at = to


class Texts:
    """buf: the UTF-8 bytes of all texts, padded by 8; doc_at: where each begins (one more entry than texts)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        col = column.cast(pa.large_string()) if column.type != pa.large_string() else column
        raw = b"".join(x or b"" for x in col.cast(pa.large_binary()).to_pylist())
        buf = np.frombuffer(raw + bytes(8), np.uint8)
        self.buf = LOWERED[buf] if lower else buf
        lens = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), float)).astype(np.int64)
        self.doc_at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        self.n = len(col)

    def words(self) -> None:
        """Sets start, size (bytes) of every word and word_at, each text's first word (one more entry than texts)."""
        size = int(self.doc_at[-1])
        solid = ~SPACE[self.buf[:size]]
        first = np.zeros(size + 1, bool)
        first[self.doc_at] = True
        edge = np.empty(size + 1, bool)  # a word cannot go on from i - 1 to i
        edge[0] = edge[size] = True
        edge[1:size] = ~solid[:-1] | first[1:size]
        self.start = np.flatnonzero(solid & edge[:-1])
        stop = np.flatnonzero(solid & (~np.append(solid[1:], False) | edge[1:])) + 1 if size else self.start
        self.size = stop - self.start
        self.word_at = np.searchsorted(self.start, self.doc_at).astype(np.int64)

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, eight bytes a step for all ranges at once."""
        n = len(start)
        h = mix(size.astype(np.uint64) + _C3)
        if not n:
            return h
        eight = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, 0, (1,))
        live, at, left = None, start, size
        while True:
            lane = eight[np.minimum(at, len(eight) - 1)] & _MASK[np.minimum(left, 8)]
            lane[left <= 0] = 0
            if live is None:
                h = mix((h ^ lane) * _C3)
                more = np.flatnonzero(left > 8)
                live = more
            else:
                h[live] = mix((h[live] ^ lane) * _C3)
                more = np.flatnonzero(left > 8)
                live = live[more]
            if not len(more):
                return h
            at, left = at[more] + 8, left[more] - 8


def grams(h: np.ndarray, word_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that stay in a text, and each text's first run (one more entry than texts)."""
    counts = np.diff(word_at)
    runs = np.maximum(counts - k + 1, 0)
    gram_at = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(gram_at[-1]) + np.repeat(word_at[:-1] - gram_at[:-1], runs)
    g = np.full(len(at), np.uint64(k))
    for i in range(k):
        g = mix((g ^ h[at + i]) * _C3)
    return g, gram_at
