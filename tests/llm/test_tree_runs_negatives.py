import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortmill.llm import bpe_tree, hard_negatives, periodic_runs, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = "a b c d e f g h".encode().split()


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [(e.ids, t.decode(e.ids, skip_special_tokens=False)) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def long_texts(r):
    letters = list("aeinrstth  \n\t'!.,-_012") + ["é", "ß", "日", "本", "　", "\x1c", "\x85", "'re", "'ll", "'s", "<|endoftext|>", "<|startoftext|>", "🎉", "َ", "Σ", "İ", "é", "ﬁ", "=="]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    texts += ["=" * 3000, "=" * 777 + "-" * 300, "ab" * 400, "a" * 5000, "日本語" * 1000, "the" * 3000, "ing" * 1001 + "th", "\n" * 50 + "x", "<|EndOfText|>"]
    return texts + ["".join(r.choice(kind) for _ in range(4000)) for kind in ("etaoinshrdlu", "日本语的是了", "=-", "!?.")]


@pytest.mark.parametrize("leaf", [2, 5, 32])
def test_joined_halves_are_the_encoding_of_the_whole(leaf):
    texts = long_texts(random.Random(leaf))
    e = bpe_tree.Encoder(PATH, leaf)
    assert [(e.encode(t), e.decode(e.encode(t))) for t in texts] == library(texts)


def test_a_join_grows_until_both_sides_agree():
    e = bpe_tree.Encoder(PATH)
    r = random.Random(4)
    for _ in range(300):
        word = "".join(r.choice("=ab") for _ in range(r.randint(2, 60)))
        letters, at = e.letters(word), r.randint(1, len(word) - 1)
        a, b = e._one(letters[:at]), e._one(letters[at:])
        assert e.join([(a, b, letters, at)])[0].tolist() == e._one(letters).tolist() == e.side_by_side([letters])[0].tolist()


def test_remembered_words_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(bpe_tree, "REMEMBERED", 50)
    texts = long_texts(random.Random(9))[:300]
    e = bpe_tree.Encoder(PATH)
    for t, (ids, _) in zip(texts, library(texts)):
        assert e.encode(t) == ids and len(e.known) <= 150


def test_encode_decode(documents, corpus):
    expected = library([t for _, t in corpus])
    rows = {r.doc_id: r for r in bpe_tree.encode_decode(documents, PATH).collect()}
    assert {i: (rows[i].ids, rows[i].decoded, rows[i].n_tokens) for i, _ in corpus} == {i: (ids, d, len(ids)) for (i, _), (ids, d) in zip(corpus, expected)}
    digests = {r.doc_id: r for r in bpe_tree.encode_decode(documents, PATH, digest=True).collect()}
    assert {i: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for i, x in digests.items()} == {i: (len(ids), sha(" ".join(map(str, ids))), sha(d)) for (i, _), (ids, d) in zip(corpus, expected)}


def test_encode_decode_odd_tables(odd, empty):
    assert bpe_tree.encode_decode(empty, PATH).count() == 0
    clash = odd.selectExpr("*", "7L as n_tokens", "'x' as ids", "'x' as decoded")
    rows = bpe_tree.encode_decode(clash, PATH).collect()
    assert len(rows) == odd.count() and sorted(r.n_tokens for r in rows if r.doc_id is None) == [0, len(library(["a lone text without any id at all"])[0][0])]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe_tree.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def plain_runs(w, shortest=12):
    """Every stretch of each period, word by word; the smallest period of a stretch."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(shortest, 2 * q) and i > s:
                out.setdefault((s, i - s + q), q)
            i = max(i, s + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def random_words(r):
    k = r.choice([1, 2, 3, 8])
    w = [r.choice(WORDS[:k]) for _ in range(r.randint(0, 90))]
    for _ in range(r.randint(0, 2)):
        if w:
            i, p = r.randrange(len(w)), r.randint(1, 12)
            w[i:i] = w[i : i + p] * r.randint(1, 6)
    return w


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_against_every_period(shortest):
    r = random.Random(shortest)
    for _ in range(150):
        texts = [random_words(r) for _ in range(8)]
        assert periodic_runs.runs_of(texts, shortest) == [plain_runs(w, shortest) for w in texts]


def test_runs_of_long_repetitive_texts():
    fibonacci = [b"a"], [b"a", b"b"]
    for _ in range(9):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    texts = [fibonacci[1], [b"a"] * 1500, [b"a", b"b"] * 600 + [b"c"], [str(i % 97).encode() for i in range(900)], [b"x"] + [b"y z".split()[i % 2] for i in range(40)] * 3]
    assert periodic_runs.runs_of(texts, 12) == [plain_runs(w) for w in texts]


def expected_runs(doc_id, text):
    words = periodic_runs.planted(doc_id, (text or "").encode().split())
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(kept)), runs, kept


def test_periodic_runs(documents, corpus):
    expected = {i: expected_runs(i, t) for i, t in corpus}
    rows = periodic_runs.periodic_runs(documents, rewrite=periodic_runs.planted, digest=True).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: x[0] for i, x in expected.items()}
    assert any(x[0][0] for x in expected.values())
    rows = periodic_runs.periodic_runs(documents, rewrite=periodic_runs.planted).collect()
    assert {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in rows} == {i: x[1:] for i, x in expected.items()}


def test_planted_words():
    for i in range(400):
        words = [str(k).encode() for k in range(i % 50)]
        h = __import__("zlib").crc32(str(i).encode())
        n, g = len(words), h // 10
        out = list(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert periodic_runs.planted(i, words) == out


def test_periodic_runs_odd_tables(odd, empty):
    assert periodic_runs.periodic_runs(empty).count() == 0
    clash = odd.selectExpr("*", "7L as n_runs", "'x' as start", "'x' as runs", "'x' as collapsed")
    rows = periodic_runs.periodic_runs(clash, rewrite=periodic_runs.planted).collect()
    assert len(rows) == odd.count() and sorted(r.collapsed for r in rows if r.doc_id is None) == ["", "a lone text without any id at all"]


def plain_negatives(rows, positives=5, negatives=10):
    rows = sorted({(i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    width = max((len(v) for *_, v in rows), default=0)
    q = [[int(np.floor(256 * float(x))) for x in v] + [0] * (width - len(v)) for *_, v in rows]
    out = []
    for a, (i, l, _) in enumerate(rows):
        if i % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(q[a], q[b])), j, m) for b, (j, m, _) in enumerate(rows))
            for s, j, _ in [x for x in found if x[2] == l and x[1] != i][:positives]:
                fit = [x for x in found if x[2] != l and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
                out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def vectors(r, n, width=9):
    kinds = [r.normal(size=width) for _ in range(6)]
    rows = [(i, int(r.integers(-1, 3)), (kinds[i % 6] + r.normal(size=width) * 0.3).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, 1, rows[0][2]) for i in range(40)]  # copies: ties by id
    return rows


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("anchors, candidates, depth", [(512, 4096, 16), (2, 37, 1), (3, 64, 4)])
def test_hard_negatives(spark, monkeypatch, anchors, candidates, depth):
    for name, v in (("ANCHORS", anchors), ("CANDIDATES", candidates), ("DEPTH", depth)):
        monkeypatch.setattr(hard_negatives, name, v)
    rows = vectors(np.random.default_rng(3), 720)
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(x) for x in got.collect()) == plain_negatives(rows) != []


def test_hard_negatives_odd_tables(spark):
    r = np.random.default_rng(5)
    rows = vectors(r, 210, 3)
    odd = [(None, 1, [1.0, 2.0, 3.0]), (100, None, [1.0]), (300, 1, None), (400, 1, [1.0, None, 2.0]), (500, 1, [float("nan"), 0.0, 0.0]), (600, 0, [float("inf"), 0.0, 0.0]), (700, 1, []), (800, 2, [0.5]), (900, 2, [1.0, 1.0, 1.0, 1.0, 1.0]), (200, 2, [0.5, 0.25, 0.125]), rows[0], rows[0], rows[100], (1000, 9, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "7 as tile", "7 as row", "7 as place", "'x' as ids", "7 as numbers", "7 as rank", "7 as positive_id")
    got = sorted(tuple(x) for x in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())
    assert got == plain_negatives(rows + odd) != []
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id % 100 != 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_near_the_largest_long():
    r = np.random.default_rng(2)
    for m, k, n in ((1, 1, 1), (70, 64, 130), (33, 35, 99), (65, 129, 67), (40, 0, 40)):
        a, b = r.integers(-(2**40), 2**40, (m, k)), r.integers(-(2**40), 2**40, (k, n))
        assert (hard_negatives.strassen(a, b, 8) == a @ b).all() and (hard_negatives.strassen(a, b) == a @ b).all()
    big = np.full((40, 40), 1 << 28)
    assert (hard_negatives.strassen(big, big, 4) == 40 << 56).all()


def test_hard_negatives_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    found = con.execute(queries.SQL["op13_hard_negatives"])
    names = [x[0] for x in found.description]
    got = queries.op13_hard_negatives(spark, data)
    assert sorted(tuple(x) for x in got.select(names).collect()) == sorted(found.fetchall())


def test_library_agrees_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.ids_sha256 for r in queries.op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: sha(" ".join(map(str, x[0]))) for r, x in zip(rows, library([r.text for r in rows]))}
    runs = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    short = [r for r in rows if len(r.text or "") < 6000]
    assert len(short) > 100 and {r.doc_id: runs[r.doc_id] for r in short} == {r.doc_id: expected_runs(r.doc_id, r.text)[0] for r in short}


def test_tokens_of_an_arrow_column():
    e = bpe_tree.Encoder(PATH)
    assert list(e.run(pa.array(["", None, "Hi!"])))[:2] == [(0, "", ""), (0, "", "")]
