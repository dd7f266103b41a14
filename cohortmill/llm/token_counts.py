"""Token counts of a byte-level BPE tokenizer by deterministic transducers, without building tokens.

Two transducers stand for the tokenizer. The *splitter* reads character classes and annotates each transition with 1
where a new pre-token begins. Texts are laid end to end and cut into equal chunks; every chunk's map from start state to
end state is run for all chunks at once, the maps are composed by a parallel prefix scan, and a second pass from the now
known start states emits the pre-token starts. The *merger* reads the bytes of a pre-token and annotates each transition
with the change in the number of tokens emitted so far. Its states are pre-token prefixes, compiled when first met (all
new ones of a step at once) into a table of bounded size; all pre-tokens of a batch run through it in step. Pre-tokens of
more than ``long_piece`` bytes run through a machine whose state is the last token at each position that a later token
can begin at: two tokens are adjacent in an encoding exactly if the encoding of their joined bytes is these two.

Defined cases: null text counts as empty; special tokens' strings inside texts are one token each, as the library does by
default; whole texts of any length; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textcols import Texts, pieces

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
# character classes, with what the next characters are folded in
L, N, O, APOS2, APOS3, SPACE_LAST, WHITE_LAST, WHITE = range(8)
# splitter states: nothing open; in letters, digits, others; after a prefix space; in white space; 1 or 2 letters of a contraction to come
START, IN_L, IN_N, IN_O, PREFIX, IN_W, ONE, TWO = range(8)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def char_kinds() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for each code point."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[at[m.start() : m.end()]] = kind
    kinds[0x1C:0x20] = 0  # separators that are no white space to the tokenizer's patterns
    return kinds


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 where a pre-token begins) by class * 8 + state; classes from 8 on are those of a text's first character."""
    go, emit = np.zeros((16, 8), np.uint8), np.ones((16, 8), np.uint8)
    run = {L: IN_L, N: IN_N, O: IN_O}
    for c in range(8):
        for s in range(8):
            begins, to = 1, START
            if c in run:
                begins, to = int(s not in (run[c], PREFIX)), run[c]
                if c == L and s in (ONE, TWO):
                    begins, to = 0, START if s == ONE else ONE
            elif c in (APOS2, APOS3):
                begins, to = (0, IN_O) if s in (IN_O, PREFIX) else (1, ONE if c == APOS2 else TWO)
            elif c == WHITE:
                begins, to = int(s != IN_W), IN_W
            elif c == SPACE_LAST:
                to = PREFIX
            go[c, s], emit[c, s] = to, begins
    go[8:], emit[8:] = go[:8, :1], 1
    return go.ravel(), emit.ravel()


class Splitter:
    chunk = 64

    def __init__(self):
        self.go, self.emit = splitter()

    def classes(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(chars)
        kind = char_kinds()[chars]
        inside = np.zeros(n, bool)  # the next character belongs to the same text
        inside[:-1] = ~first[1:]
        white = kind == 3
        solid_next = np.zeros(n, bool)
        solid_next[:-1] = ~white[1:]
        solid_next &= inside
        c = np.array([O, L, N, WHITE], np.uint8)[kind]
        c[white & solid_next] = WHITE_LAST
        c[(chars == 32) & solid_next] = SPACE_LAST
        at = np.flatnonzero((chars == 39) & inside)
        for text in CONTRACTIONS:
            ok = at[at + len(text) <= n]
            for i in range(1, len(text)):
                ok = ok[(chars[ok + i] == ord(text[i])) & inside[ok + i - 1]]
            c[ok] = APOS2 if len(text) == 2 else APOS3
        c[first] += 8
        return c

    def starts(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions at which pre-tokens begin."""
        n = len(chars)
        rows = -(-n // self.chunk)
        c = np.full(rows * self.chunk, 8 + WHITE, np.uint16)
        c[:n] = self.classes(chars, first)
        steps = np.ascontiguousarray(c.reshape(rows, self.chunk).T * np.uint16(8))
        maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
        for col in steps:
            maps = self.go[col[:, None] + maps]
        d = 1
        while d < rows:  # inclusive scan: maps[i] becomes the map of chunks 0..i
            maps[d:] = np.take_along_axis(maps[d:], maps[:-d].copy(), 1)
            d *= 2
        state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint16)
        out = np.empty((self.chunk, rows), np.uint8)
        for i, col in enumerate(steps):
            at = col + state
            out[i] = self.emit[at]
            state = self.go[at].astype(np.uint16)
        return np.flatnonzero(out.T.ravel()[:n])


class Table:
    """64-bit keys to 32-bit values by open addressing; looks up and adds whole arrays."""

    none = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, self.none)
        self.values = np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slot = self.slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found != self.none))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != self.none)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys != self.none
            k, v = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(int(2 * len(k)).bit_length() + 1)
            return self.add(k, v)
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == self.none
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        self.n += len(keys)


class Merger:
    """Transducer over the bytes of one pre-token. A state is a prefix; entering it emits the change in the number of tokens.

    States are compiled when first met, all new ones of a step at once, and forgotten when there are ``most_states``.
    """

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], most_states: int = 3_000_000, long_piece: int = 256):
        self.vocab = set(vocab)
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.begins = {t[:i] for t in vocab for i in range(len(t) + 1)}
        self.adjacent: dict[tuple[bytes, bytes], bool] = {}
        self.most_states, self.long_piece = most_states, long_piece
        self.letter = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        self.rank, self.merged = Table(18), np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank.add(np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.uint64), np.arange(len(merges), dtype=np.int32))
        self.reset()

    def reset(self) -> None:
        self.go, self.n = Table(20), 1
        self.count = np.zeros(1 << 16, np.int32)  # tokens of each state's prefix
        self.emit = np.zeros(1 << 16, np.int16)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.rank.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)).astype(np.int64)
        r[r < 0] = 1 << 40
        return r

    def encoded(self, texts: np.ndarray) -> np.ndarray:
        """Tokens of each row of bytes: the lowest-ranked adjacent pair is merged, leftmost first, in all rows at once."""
        n, m = texts.shape
        ids, left = self.letter[texts], np.full(n, m)
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, m - 1) if m > 1 else np.zeros((n, 0), np.int64)
        rows = np.arange(n)
        while rank.shape[1] and len(rows):
            j = rank.argmin(1)
            best = rank[np.arange(len(rows)), j]
            some = best < 1 << 40
            rows, ids, rank, j, best = rows[some], ids[some], rank[some], j[some], best[some]
            if not len(rows):
                break
            left[rows] -= 1
            here, width = np.arange(len(rows)), ids.shape[1]
            ids[here, j] = self.merged[best]
            after = np.arange(width - 1)
            ids = np.take_along_axis(ids, after + (after > j[:, None]), 1)
            rank = np.take_along_axis(rank, after[:-1] + (after[:-1] >= j[:, None]), 1)
            for at, ok in ((j - 1, j > 0), (j, j < width - 2)):
                r = here[ok]
                rank[r, at[ok]] = self.pair_ranks(ids[r, at[ok]], ids[r, at[ok] + 1])
            # slots past a row's end keep a pair that no merge has
            ends = left[rows]
            past = np.arange(rank.shape[1]) >= (ends - 1)[:, None]
            rank[past] = 1 << 40
        return left

    def counts(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each byte range."""
        if self.n > self.most_states:
            self.reset()
        total = np.zeros(len(start), np.int64)
        big = size > self.long_piece
        for i in np.flatnonzero(big):
            total[i] = self.scan(buf[start[i] : start[i] + size[i]].tobytes())
        order = np.flatnonzero(~big)
        order = order[np.argsort(-size[order], kind="stable")]
        at, left = start[order], -size[order]
        state = np.zeros(len(order), np.int64)
        n = np.zeros(len(order), np.int64)
        k = 0
        while m := int(np.searchsorted(left, -k, "left")):
            key = ((state[:m] << 8) | buf[at[:m] + k]).astype(np.uint64)
            to = self.go.get(key)
            if (missing := np.flatnonzero(to < 0)).size:
                new, where = np.unique(key[missing], return_index=True)
                prefixes = buf[at[missing[where]][:, None] + np.arange(k + 1)]
                self.compile(new, prefixes)
                to[missing] = self.go.get(key[missing])
            state[:m] = to
            n[:m] += self.emit[to]
            k += 1
        total[order] = n
        return total

    def compile(self, keys: np.ndarray, prefixes: np.ndarray) -> None:
        """Add the states that transitions ``keys`` (state * 256 + byte) lead to."""
        while self.n + len(keys) > len(self.count):
            self.count, self.emit = (np.concatenate([x, np.zeros_like(x)]) for x in (self.count, self.emit))
        new = np.arange(self.n, self.n + len(keys))
        step = 1 << 16
        for i in range(0, len(keys), step):
            self.count[new[i : i + step]] = self.encoded(prefixes[i : i + step])
        self.emit[new] = self.count[new] - self.count[(keys >> np.uint64(8)).astype(np.int64)]
        self.go.add(keys, new.astype(np.int32))
        self.n += len(keys)

    def encode(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether b can follow a in an encoding: their joined bytes are encoded as these two (b alone, for an empty a)."""
        known = self.adjacent.get((a, b))
        if known is None:
            if len(self.adjacent) > 1_000_000:
                self.adjacent.clear()
            known = self.adjacent[a, b] = self.encode(a + b) == ([a, b] if a else [b])
        return known

    def scan(self, text: bytes) -> int:
        """Tokens of one long pre-token in time linear in its length.

        The state is the last token of the encoding of every prefix that a later token may begin at; the token that ends
        at a byte is the only one that fits the last token before it.
        """
        suffix, last, count, n = b"", [b""], [0], 0
        for i in range(len(text)):
            suffix += text[i : i + 1]
            for size in range(len(suffix), 0, -1):
                token = suffix[-size:]
                if token in self.vocab and self.fits(last[-size], token):
                    break
            n = count[-size] + 1
            last.append(token)
            count.append(n)
            while suffix not in self.begins:
                suffix = suffix[1:]
            del last[: -len(suffix) - 1], count[: -len(suffix) - 1]
        return n


class Counter:
    """Both transducers of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec.get("normalizer") or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is compiled")
        letters = byte_letters()
        raw = lambda t: bytes(letters[x] for x in t)
        for x in spec["added_tokens"]:
            if any(x.get(flag) for flag in ("lstrip", "rstrip", "single_word")):
                raise ValueError(f"added token {x['content']!r} has a flag that is not compiled")
        special = {x["content"] for x in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.special = sorted((x.encode() for x in special), key=len, reverse=True)
        self.splitter, self.merger = Splitter(), Merger(vocab, merges)

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text."""
        t = Texts(column)
        size = int(t.doc_at[-1])
        raw = t.buf[:size].tobytes()
        byte_at = np.flatnonzero((t.buf[:size] & 0xC0) != 0x80)
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        cut = np.zeros(size + 1, bool)
        cut[t.doc_at] = True
        specials = []
        for text in self.special:
            i = raw.find(text)
            while i >= 0:
                if not cut[i + 1 : i + len(text)].any():
                    specials.append((i, i + len(text)))
                    i += len(text) - 1
                i = raw.find(text, i + 1)
        for a, b in specials:
            cut[a] = cut[b] = True
        start = byte_at[self.splitter.starts(chars, cut[byte_at])] if size else byte_at
        length = np.diff(np.append(start, size))
        n = self.merger.counts(t.buf, start, length)
        for a, b in specials:
            n[np.searchsorted(start, a) : np.searchsorted(start, b)] = 0
            n[np.searchsorted(start, a)] = 1
        sums = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, t.doc_at)]
        return np.diff(t.doc_at), np.diff(sums)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document; ``path``: the tokenizer's .json file, on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n_bytes, n_tokens = counter(path).count(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)
