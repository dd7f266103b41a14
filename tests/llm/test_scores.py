import numpy as np
import pyarrow as pa
import pytest
import regex

import brute
from cohortmill.llm import lm_scoring, mixing, quality, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(documents, corpus):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(documents, PATH).collect()}
    n = library([t or "" for _, t in corpus])
    assert got == {i: (len((t or "").encode()), x, x > 1024) for (i, t), x in zip(corpus, n)}


def test_token_counts_odd_tables(odd, empty):
    assert token_counts.count_tokens(empty, PATH).count() == 0
    clash = odd.selectExpr("*", "7L as n_bytes", "7L as n_tokens", "true as over_limit")
    rows = token_counts.count_tokens(clash, PATH).collect()
    assert len(rows) == odd.count() and {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id is None} == {(0, 0), (len("a lone text without any id at all"), library(["a lone text without any id at all"])[0])}


def test_added_tokens_with_flags_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        token_counts.Counter(str(tmp_path / "t.json"))


def test_tokens_of_every_kind_of_character():
    import random

    r = random.Random(2)
    letters = list("aeinrst  \n\t'!.,-_012") + ["é", "ß", "日", " ", "　", "\x1c", "\x85", "'re", "'ll", "'s", "<|endoftext|>", "🎉", "َ"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(3000)] + ["", " ", "ab" * 400, "=" * 3000, "\n" * 50 + "x"]
    assert token_counts.counter(PATH).count(pa.array(texts))[1].tolist() == library(texts)


def test_chunks_compose_to_one_run():
    s = token_counts.Splitter()
    chars = np.frombuffer(("it's  a test\n\n 12 'll x" * 40).encode("utf-32-le"), np.uint32)
    first = np.zeros(len(chars), bool)
    first[0] = True
    whole = [m.start() for m in regex.finditer(public_tokenizers.PATTERN, "it's  a test\n\n 12 'll x" * 40)]
    for chunk in (1, 3, 64, 4096):
        s.chunk = chunk
        assert s.starts(chars, first).tolist() == whole


def test_states_are_forgotten_and_made_again():
    c = token_counts.counter(PATH)
    c.merger.most_states = 10
    texts = ["forgotten words are counted again"] * 3
    assert [c.count(pa.array([t]))[1][0] for t in texts] == library(texts)
    c.merger.most_states = 3_000_000


def test_quality_measures(documents, corpus):
    got = {r.doc_id: tuple(r[c] for c in quality.MEASURES) + (r.base_failed,) for r in quality.quality_rules(documents).collect()}
    want = {i: (m := brute.measures(t)) + (m[0] < 10 or 100 * m[4] > 20 * m[0],) for i, t in corpus}
    assert got == want


def test_quality_verdict_is_the_plain_model(documents, corpus):
    want = brute.posteriors([brute.quality_votes(t) for _, t in corpus])
    rows = {r.doc_id: r for r in quality.quality_rules(documents).collect()}
    for (i, _), p in zip(corpus, want):
        assert abs(rows[i].p_good - p) < 1e-6
        assert abs(p - 0.5) > 1e-6 and rows[i].kept == (not rows[i].base_failed and p >= 0.5)
    assert {r.kept for r in rows.values()} == {True, False}


def test_quality_model_follows_its_votes():
    """EM finds the classes of votes drawn from known accuracies."""
    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.85
    votes = np.full((quality.N_RULES, len(good)), quality.ABSTAIN)
    for rule in range(quality.N_RULES):
        said = r.random(len(good)) < 0.5
        right = r.random(len(good)) < 0.9
        votes[rule, said] = np.where(right, good, ~good)[said]
    pattern = (votes * (3 ** np.arange(quality.N_RULES))[:, None]).sum(0)
    u, n = np.unique(pattern, return_counts=True)
    kept = quality.fit(u, n.astype(float))[pattern] >= 0.5
    assert (kept == good).mean() > 0.95


def test_quality_keeps_clean_documents(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    j = quality.quality_rules(docs).join(labels, "doc_id")
    clean = j.where("quality = 1 and not base_failed")
    assert clean.where("kept").count() >= 0.98 * clean.count()
    bad = j.where("quality = 0")
    assert bad.where("not kept").count() >= 0.9 * bad.count()
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(quality.keep_documents(docs)) == ids(quality.quality_rules(docs).where("kept"))


def test_quality_odd_tables(odd, empty):
    assert quality.quality_rules(empty).count() == 0 and quality.keep_documents(empty).count() == 0
    assert quality.quality_rules(odd).count() == odd.count()
    assert quality.keep_documents(odd).columns == odd.columns


def test_language_model_beats_word_shares_and_notices_shuffling(spark):
    import random

    r = random.Random(5)
    nouns, verbs = [f"noun{i}" for i in range(40)], [f"verb{i}" for i in range(40)]
    line = lambda: f"the {r.choice(nouns)} will {r.choice(verbs)} a {r.choice(nouns)} ."
    rows = [(i, " ".join(line() for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    train, held = docs.where("doc_id < 250"), docs.where("doc_id >= 250")
    net = lm_scoring.fit(train)
    mean = lambda df, n: np.mean([x.mean_log_likelihood for x in lm_scoring.score(df, n).collect()])
    shares = lm_scoring.Network(lm_scoring.bucket_counts(train))
    shares.p["W2"][:] = 0
    mixed = spark.createDataFrame([(i, " ".join(r.sample(t.split(), len(t.split())))) for i, t in rows[250:]], "doc_id long, text string")
    assert mean(held, net) > mean(held, shares) + 0.5
    assert mean(held, net) > mean(mixed, net) + 0.5


def plain_distribution(net, context):
    """log p of every word (by rank) from its two sides, word by word in double precision."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    x = np.concatenate([p["E"][net.rank[c]] for c in context])
    h = np.tanh(x @ p["W1"] + p["b1"])
    z = p["W2"] @ h + p["b2"]
    z = z - np.log(np.exp(z).sum())
    s = np.exp(p["W3"] @ h + p["b3"])
    whole = np.bincount(net.in_class, s)
    return z[net.in_class] + np.log(s / whole[net.in_class])


def test_language_model_step_follows_the_gradient():
    """The change of one training step against numerical derivatives of the plain loss, for some of each parameter."""
    r = np.random.default_rng(4)
    net = lm_scoring.Network(r.integers(1, 50, 64))
    net.p = {k: (v + r.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in net.p.items()}
    context, word = r.integers(0, 64, (20, 4)), r.integers(0, 64, 20)
    loss = lambda: -np.mean([plain_distribution(net, c)[net.rank[w]] for c, w in zip(context, word)])
    before = {k: v.copy() for k, v in net.p.items()}
    want = {}
    for k, v in net.p.items():
        for i in r.integers(0, v.size - (8 if k == "E" else 0), 5):
            at = np.unravel_index(i, v.shape)
            old, slopes = v[at], []
            for d in (1e-2, -1e-2):
                v[at] = old + d
                slopes.append(loss())
            v[at] = old
            want[k, at] = (slopes[0] - slopes[1]) / 2e-2
    net.train(context, word, {k: np.zeros_like(v) for k, v in net.p.items()})
    for (k, at), g in want.items():
        moved = before[k][at] - net.p[k][at]  # the first step of Adagrad is RATE times the gradient's sign
        assert abs(g) < 2e-4 or abs(moved - lm_scoring.RATE * np.sign(g)) < 0.02, (k, at, g, moved)


def test_language_model_tells_words_of_one_class_apart(spark):
    """Two words of equal frequency, each with its own neighbours: the wrong one costs."""
    rows = [(i, "left alpha right . up beta down . " * 30) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    net = lm_scoring.fit(docs)
    two = spark.createDataFrame([(1, "left alpha right ."), (2, "left beta right .")], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in lm_scoring.score(two, net).collect()}
    assert got[1] > got[2] + 1


def test_language_model_sums_conditionals(documents, corpus):
    net = lm_scoring.fit(documents, rounds=1)
    padded, place, at = lm_scoring.bucket_words(pa.array(["the river and the stone", None, "light"]), net.v)
    got = net.log_p(padded, place)
    for i, p in enumerate(place):
        every = plain_distribution(net, [padded[p + o] for o in lm_scoring.OFFSETS])
        assert abs(np.exp(every).sum() - 1) < 1e-4 and abs(got[i] - every[net.rank[padded[p]]]) < 1e-4
    row = {r.doc_id: r for r in lm_scoring.score(documents, net).collect()}
    nothing = row[next(i for i, t in corpus if t is None)]
    assert (nothing.n_tokens, nothing.log_likelihood, nothing.mean_log_likelihood) == (0, 0, None)


def test_language_model_masks_every_word(spark, monkeypatch):
    """Texts with a period of four words, where two of the four places used never to be predicted."""
    from types import SimpleNamespace

    targets = []
    monkeypatch.setattr(lm_scoring.Network, "train", lambda self, context, word, seen: targets.extend(word.tolist()))
    texts = pa.array(["one two three four " * 25, "five six seven", None, "", "eight"])
    net = SimpleNamespace(value=lm_scoring.Network(np.ones(lm_scoring.V)))
    for round_ in range(2):
        targets.clear()
        list(lm_scoring._train_rows(net, round_, 4)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
        padded, place, _ = lm_scoring.bucket_words(texts)
        assert sorted(targets) == sorted(padded[place].tolist())


def test_language_model_odd_tables(odd, empty):
    assert lm_scoring.pseudo_likelihood(empty).count() == 0
    assert lm_scoring.pseudo_likelihood(odd, rounds=1).count() == odd.count()


def test_mixing_meets_targets_and_finds_domains(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    out = mixing.mix(docs, labels.where("doc_id % 5 <> 3")).cache()
    total = out.selectExpr("sum(n_tokens)").first()[0]
    assert out.where("rate < 0").count() == 0
    for k, share in mixing.SHARES.items():
        assert abs(out.selectExpr(f"sum(rate * n_tokens * p_{k})").first()[0] / total / 0.8 - share) < 1e-4
    held = out.join(labels.where("doc_id % 5 = 3"), "doc_id")
    toxic, clean = held.where("quality = 1 and toxic = 1"), held.where("quality = 1 and toxic = 0")
    assert toxic.where("p_toxic > 0.5").count() >= 0.75 * toxic.count()
    assert clean.where("p_toxic > 0.5").count() <= 0.05 * clean.count()


def test_labels_without_a_document_do_not_count(spark):
    """Ten low labels in eleven have no document any more: marks and priors are those of the labels that do."""
    rows = [(i, ("spam" if i % 8 == 0 else "tea") + f" and w{i}") for i in range(400)]
    labels = [(i, int(i % 8 != 0), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = lambda more: spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int")
    weights, prior = mixing.fit_classifier(docs, table([(i, 0, 0) for i in range(1000, 2000)]))
    want, same = mixing.fit_classifier(docs, table([]))
    assert weights.count() > 0 and prior == pytest.approx(same)
    plain = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    assert plain(weights) == plain(want)


def test_rates_are_the_least_squares_answer(spark):
    """Against plain projected gradient steps in numpy."""
    r = np.random.default_rng(4)
    p, n = r.dirichlet([2, 1, 0.5], 50), r.integers(1, 400, 50)
    rows = [(i, int(n[i]), *map(float, p[i])) for i in range(50)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    goal = dict(zip(mixing.DOMAINS, map(float, (p * n[:, None]).sum(0) * [0.9, 0.4, 0.2])))
    rate = np.array([x.rate for x in mixing.fit_rates(members, goal).orderBy("doc_id").collect()])
    left = np.abs((rate[:, None] * n[:, None] * p).sum(0) - list(goal.values())).sum() / sum(goal.values())
    a, t, x = (p * n[:, None]).T, np.array(list(goal.values())), np.ones(50)
    for _ in range(20_000):
        x = np.maximum(0, x - a.T @ (a @ x - t) / np.linalg.norm(a, 2) ** 2)
    assert left <= np.abs(a @ x - t).sum() / t.sum() + 1e-4


def test_mixing_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    assert mixing.mix(empty, labels).count() == 0
    alone = odd.where("doc_id is null").count()  # each row without an id is a document
    assert mixing.mix(odd, labels).count() == odd.where("doc_id is not null").select("doc_id").distinct().count() + alone
    assert mixing.mix(odd, labels.limit(0)).where("p_clean < 0.999").count() == 0


def test_rows_without_an_id_are_documents_and_repeated_rows_count_once(spark):
    rows = [(None, "one two three"), (None, "one two three four five"), (None, None), (1, "a b c"), (1, "a b c"), (1, "d e"), (2, None), (2, ""), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in mixing.mix(docs, labels).collect())
    assert got == [(0, 0), (0, 3), (0, 5), (1, 5), (2, 0), (3, 1)]


def test_arrays_of_many_tasks_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 100)
    monkeypatch.setattr(lm_scoring, "TREE", (5, 2))

    def run(kind):
        def rows(batches):
            for b in batches:
                if b.num_rows:
                    yield lm_scoring.parts_of((np.arange(250) * b.num_rows).astype(kind))

        return rows

    for kind in (np.float32, np.float64):
        df = spark.range(0, 1000, 1, 23).mapInArrow(run(kind), lm_scoring.PARTS)
        assert lm_scoring.summed(df).tolist() == (np.arange(250) * 1000).tolist()
    assert len(lm_scoring.summed(spark.range(0).mapInArrow(run(np.float32), lm_scoring.PARTS))) == 0
