"""BPE encoding and decoding with word ends, by tree concatenation.

A text is split where its tokenizer splits it. What stays unsplit is cut into leaves of ``LEAF`` bytes, the leaves of all
texts of a batch are encoded side by side, and neighbours are joined level by level, again all joins of a level at once.
At a join the last w tokens of the left half and the first w of the right one are encoded again as one string. Where the
new first token is the old one (or the window holds the whole left half), and likewise at the right, both sides agree and
the new tokens replace the window; otherwise w doubles. That is exact: byte-pair merges never cross a border between two
tokens just if they don't cross it in the two tokens alone, so a row of tokens is the encoding of its text if every two
neighbours are the encoding of theirs, and each two neighbours after a join were neighbours in one of the three rows.

Defined cases: null counts as the empty text, with no tokens; strings of special tokens inside a text are those tokens, as
the library does by default; texts of any length are encoded whole; rows of a doc_id that occurs twice, or is null, are
encoded row by row; other columns are ignored, whatever their names. Files with another kind of model, normalizer,
splitter or decoder are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textcols import pieces
from .token_counts import Table, byte_letters

# fixed value: the one splitting pattern that is supported, as tokenizer files write it
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
LEAF = 32
NONE = 1 << 40  # a rank that no merge has
REMEMBERED = 300_000


class Encoder:
    """The tokenizer of one file."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splits = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = splits[0] if splits else {}
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or kinds != NORMALIZERS or spec.get("decoder"):
            raise ValueError("only BPE with word ends, NFC, lower case and no decoder is supported")
        if [x["type"] for x in splits] != ["Split", "ByteLevel"] or cut["pattern"].get("Regex") != PATTERN or not cut["invert"] or cut["behavior"] != "Removed" or splits[1]["use_regex"]:
            raise ValueError("only the splitting pattern for words, digits and marks is supported")
        if any(x.get(flag) for x in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens with flags are not supported")
        self.leaf = leaf
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # the library's \s has no information separators, which regex counts as white space
        self.words_of = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}")).findall
        by_byte = {b: x for x, b in byte_letters().items()}
        self.letter = np.array([vocab[by_byte[b]] for b in range(256)], np.int64)
        self.last_letter = np.array([vocab[by_byte[b] + "</w>"] for b in range(256)], np.int64)
        self.text = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in (vocab | self.special).items():
            self.text[i] = t
        self.digits = [str(i) for i in range(len(self.text))]
        self.size = np.array([len(t.removesuffix("</w>")) for t in self.text], np.int64)  # a letter stands for a byte
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = Table(18)
        self.rank.add(keys, np.arange(len(pairs), dtype=np.int32))
        self.rank_of = {int(k): i for i, k in enumerate(keys)}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.passing: list[str] = []  # long units, which the next batch forgets

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.rank.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)).astype(np.int64)
        r[r < 0] = NONE
        return r

    def letters(self, word: str) -> np.ndarray:
        b = np.frombuffer(word.encode(), np.uint8)
        out = self.letter[b]
        out[-1] = self.last_letter[b[-1]]
        return out

    def side_by_side(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The tokens of each row of letters: in all rows at once the pair of lowest rank is merged, leftmost first."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
        sizes = np.array([len(x) for x in rows])
        low = 0
        for width in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64):
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for i in range(0, len(at), 1 << 14):
                part = at[i : i + (1 << 14)]
                ids = np.full((len(part), width), 0xFFFFFFF, np.int64)
                ids[np.arange(width) < sizes[part][:, None]] = np.concatenate([rows[k] for k in part])
                for k, x in zip(part, self._merge(ids, sizes[part])):
                    out[k] = x
        for k in np.flatnonzero(sizes > low):
            out[k] = self._one(rows[k])
        return out

    def _merge(self, ids: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        n, m = ids.shape
        left, whole = left.copy(), ids
        rows = np.arange(n)
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, m - 1)
        while rank.shape[1] and len(rows):
            j = rank.argmin(1)
            here = np.arange(len(rows))
            best = rank[here, j]
            some = best < NONE
            if not some.all():
                gone = ~some
                whole[rows[gone], : ids.shape[1]] = ids[gone]
                rows, ids, rank, j, best = rows[some], ids[some], rank[some], j[some], best[some]
                here = np.arange(len(rows))
            if not len(rows):
                break
            left[rows] -= 1
            width = ids.shape[1]
            ids[here, j] = self.merged[best]
            after = np.arange(width - 1)
            ids = np.take_along_axis(ids, after + (after > j[:, None]), 1)
            rank = np.take_along_axis(rank, after[:-1] + (after[:-1] >= j[:, None]), 1)
            for at, ok in ((j - 1, j > 0), (j, j < width - 2)):
                r = here[ok]
                rank[r, at[ok]] = self.pair_ranks(ids[r, at[ok]], ids[r, at[ok] + 1])
        if len(rows):
            whole[rows, : ids.shape[1]] = ids
        return [x[:k] for x, k in zip(whole, left)]

    def _one(self, letters: np.ndarray) -> np.ndarray:
        """The same for one long window, with a heap of pairs by rank and place."""
        ids, n = letters.tolist(), len(letters)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, merged = self.rank_of, self.merged
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_of.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(merged[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank_of.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (x := rank_of.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (x, h, ids[h], ids[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def tree(self, whole: list[np.ndarray]) -> list[np.ndarray]:
        """The tokens of each row of letters, of any length, by leaves and joins."""
        cuts = [range(0, len(x), self.leaf) for x in whole]
        flat = iter(self.side_by_side([x[i : i + self.leaf] for x, c in zip(whole, cuts) for i in c]))
        nodes = [[next(flat) for _ in c] for c in cuts]
        span = self.leaf
        while any(len(x) > 1 for x in nodes):
            places = [(k, i) for k, x in enumerate(nodes) for i in range(0, len(x) - 1, 2)]
            joined = iter(self.join([(nodes[k][i], nodes[k][i + 1], whole[k], (i + 1) * span) for k, i in places]))
            nodes = [[next(joined) if i + 1 < len(x) else x[i] for i in range(0, len(x), 2)] for x in nodes]
            span *= 2
        return [x[0] if x else np.empty(0, np.int64) for x in nodes]

    def join(self, pairs: list[tuple]) -> list[np.ndarray]:
        """The tokens of the two joined texts of each (left tokens, right tokens, letters, place of the join)."""
        out: list = [None] * len(pairs)
        todo, w = list(range(len(pairs))), 1
        while todo:
            ends = []
            for k in todo:
                a, b, letters, at = pairs[k]
                i, j = min(w, len(a)), min(w, len(b))
                ends.append((i, j, letters[at - int(self.size[a[len(a) - i :]].sum()) : at + int(self.size[b[:j]].sum())]))
            again = []
            for k, (i, j, _), new in zip(todo, ends, self.side_by_side([x[2] for x in ends])):
                a, b = pairs[k][:2]
                if (i == len(a) or new[0] == a[len(a) - i]) and (j == len(b) or new[-1] == b[j - 1]):
                    out[k] = np.concatenate([a[: len(a) - i], new, b[j:]])
                else:
                    again.append(k)
            todo, w = again, 2 * w
        return out

    def decode(self, ids) -> str:
        """What the library's decode gives without a decoder: the tokens, with their word ends, joined by a space."""
        return " ".join([self.text[i] for i in ids])

    def units(self, text: str) -> list[str]:
        """Words, digits, runs of marks and special tokens, in order. NFC and lower case hold for words only, letter by letter."""
        parts = self.at_special.split(text) if self.at_special and any(x in text for x in self.special) else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            out += [part] if i % 2 else self.words_of(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def short(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of words of at most a leaf, with their letters laid out for all words at once."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts, buf = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words) + bytes(LEAF), np.uint8)
        low = 0
        for width in (1, 2, 4, 6, 8, 10, 12, 16, 24, LEAF):
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for i in range(0, len(at), 1 << 14):
                part = at[i : i + (1 << 14)]
                raw = buf[starts[part][:, None] + np.arange(width)]
                ids, last = self.letter[raw], (np.arange(len(part)), sizes[part] - 1)
                ids[last] = self.last_letter[raw[last]]
                ids[np.arange(width) >= sizes[part][:, None]] = 0xFFFFFFF
                for k, x in zip(part.tolist(), self._merge(ids, sizes[part])):
                    out[k] = x
        return out

    def learn(self, words: set[str]) -> dict:
        """(tokens, ids joined by a space, decoded text) of each unit; those of a leaf at most are remembered, up to ``REMEMBERED``."""
        known = self.known
        while self.passing:
            del known[self.passing.pop()]
        new = [w for w in words if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {w: known[w] for w in words if w in known}
        digits, text = self.digits, self.text
        raw = {w: w.encode() for w in new if w not in self.special}
        short, long_ = [w for w, b in raw.items() if len(b) <= LEAF], [w for w, b in raw.items() if len(b) > LEAF]
        for w, ids in zip(short, self.short([raw[w] for w in short])):
            ids = ids.tolist()
            known[w] = (len(ids), " ".join([digits[i] for i in ids]), " ".join([text[i] for i in ids]))
        known |= {w: (1, digits[self.special[w]], w) for w in new if w in self.special}
        for w, ids in zip(long_, self.tree([self.letters(w) for w in long_])):
            known[w] = (len(ids), " ".join([digits[i] for i in ids]), self.decode(ids))
        self.passing = long_
        return known

    def encode(self, text: str) -> list[int]:
        units = self.units(text)
        of = self.learn(set(units))
        return [int(i) for u in units for i in of[u][1].split(" ")]

    def run(self, column: pa.Array) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of each text."""
        texts = [self.units(t or "") for t in column.to_pylist()]
        of = self.learn(set().union(*texts)).__getitem__
        for t in texts:
            n, ids, decoded = zip(*map(of, t)) if t else ((), (), ())
            yield sum(n), " ".join(ids), " ".join(decoded)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_decode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array) and decoded (text) of each document, or with ``digest`` the SHA-256 of the ids joined
    by a space and of the decoded text; ``path``: the tokenizer's .json file, on every executor."""
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = encoder(path).run(b.column("text"))
            n, ids, decoded = zip(*([(n, sha(i), sha(d)) for n, i, d in rows] if digest else list(rows)))
            ids = pa.array(ids) if digest else pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), ids, pa.array(decoded)], [x.split(" ")[0] for x in schema.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
