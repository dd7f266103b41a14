import brute
from cohortmill.llm import jaccard, line_dedup, sentence_spans

import pytest


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (1, 50, 100), (2, 95, 100)])
def test_jaccard_components(documents, corpus, k, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents, k, num, den).collect()}
    assert got == brute.near(corpus, k, num, den)


def test_jaccard_family_of_edited_copies(spark):
    """Many copies that lie about the threshold apart, so that stars leave work to the trees."""
    import random

    r = random.Random(3)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"v{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100, fan_out=4).run().collect()}
    assert got == brute.near(rows, 4, 85, 100)


def long_family(n, length, edits, seed=5):
    """n copies of one long text, each with its own edits: far apart from each other, not from the base."""
    import random

    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for x in r.sample(range(0, length - 8, 8), edits):
            w[x] = f"v{r.randint(0, 10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_jaccard_long_texts_just_below_the_threshold(spark):
    """Each edit takes 4 of 1,500 shingles: two copies share about 1,260 of them, a similarity of 0.72, and none links. The
    bitmaps of single members must see that without texts, and pairs may not be offered under each common root."""
    rows = long_family(300, 1503, 31)
    j = jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 4, 85, 100)
    assert {x.doc_id: x.component_id for x in j.run().collect()} == {i: i for i, _ in rows}
    assert j.n_links == {"nearest": 0, "walk": 0} and j.n_pairs["walk"] < 300 * 299 // 2


def test_jaccard_links_through_a_base(spark):
    """Copies that link with their base only, far above a leaf's size: all pairs but those with the base are no links."""
    rows = [(1000 + i, t) for i, t in long_family(150, 403, 8)]  # to the base 0.85 and more, to each other less
    base = long_family(1, 403, 0)
    rows += [(7, base[0][1])]
    j = jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 4, 85, 100)
    got = {x.doc_id: x.component_id for x in j.run().collect()}
    assert got == {i: c for i, (_, c) in brute.near(rows, 4, 85, 100).items()} and set(got.values()) == {7}
    assert sum(j.n_pairs.values()) < 10 * len(rows)


def test_jaccard_links_come_from_the_walks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    j = jaccard.JaccardJoin(docs, 4, 85, 100)
    want = {i: c for i, (_, c) in brute.near([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 4, 85, 100).items()}
    assert {x.doc_id: x.component_id for x in j.run().collect()} == want
    assert sum(j.n_links.values()) >= 2


def test_jaccard_odd_tables(spark, odd, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and all(r.component_id is None for r in rows if r.doc_id is None)
    kept = jaccard.drop_copies(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 0").count() == 1


def test_lines(documents, corpus):
    want = {i: (n, d, brute.sha(t)) for i, (n, d, t) in brute.lines(corpus).items()}
    for batches in (1, 3, 7):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup(documents, batches=batches, digest=True).collect()}
        assert got == want


def test_lines_odd_tables(odd, empty):
    assert line_dedup.line_dedup(empty).count() == 0
    out = line_dedup.line_dedup(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert {r.text for r in out.where("doc_id is null").collect()} == {None, "a lone text without any id at all"}


def test_line_store_compacts(documents):
    store = line_dedup.LineStore(fan_in=2)
    for i in range(4):
        store.add(line_dedup.line_keys(documents.where(f"doc_id % 4 = {i}"), 10))
    assert [len(x) for x in store.levels] == [0, 0, 1]
    assert store.owners().groupBy("key").count().where("count > 1").count() == 0


def test_spans(documents, corpus):
    got = {r.doc_id: r for r in sentence_spans.span_dedup(documents).collect()}
    want = brute.spans(corpus)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_removed > 0 and min(r.first_doc_ids, default=-1) < i for i, r in got.items())


def lengthened(docs, least=12):
    """{doc_id: kept text} of the documents that lose sentences, by the shortest runs of ``least`` words."""
    held, owner = {}, {}
    for i, t in sorted((i, t or "") for i, t in docs):
        s = brute.sentences(t)
        low = [tuple(brute.lower(m[0]) for m in x) for x in s]
        pairs = set()
        for j in range(len(s)):
            pairs |= set([(j, k) for k in range(j + 1, len(s) + 1) if sum(map(len, low[j:k])) >= least][:1])
            pairs |= set([(k, j + 1) for k in range(j, -1, -1) if sum(map(len, low[k : j + 1])) >= least][:1])
        held[i] = (t, s, [(j, k, tuple(low[j:k])) for j, k in sorted(pairs)])
        for j, k, g in held[i][2]:
            owner.setdefault(g, (i, j))
    out = {}
    for i, (t, s, found) in held.items():
        gone = {x for j, k, g in found if owner[g] != (i, j) for x in range(j, k)}
        if gone:
            cuts = [x[0].start() for x in s] + [len(t)]
            out[i] = t[: cuts[0]] + "".join(t[cuts[j] : cuts[j + 1]] for j in range(len(s)) if j not in gone)
    return out


def test_spans_lengthened(documents, corpus):
    few = [(i, t) for i, t in corpus if len(t or "") < 6000]
    docs = documents.where("length(coalesce(text, '')) < 6000")
    assert {r.doc_id: r.text for r in sentence_spans.span_dedup(docs, lengthen=True).collect()} == lengthened(few)


def test_long_and_short_sentences_are_found(spark, tmp_path):
    """One long sentence between other neighbours, and lines of under 6 words, by the registered query."""
    from cohortmill.llm import queries

    long_ = " ".join(f"word{i}" for i in range(55)) + "."
    lines = "\n".join(f"line {i} of it" for i in range(15))
    rows = [(1, f"Before one. {long_} After one."), (2, f"Other here. {long_} And another."), (3, f"Top three.\n{lines}\nend three"), (4, f"Top four.\n{lines}\nend four")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_removed_words) for r in queries.op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {2: (1, 55), 4: (15, 60)}


def test_spans_odd_tables(odd, empty):
    assert sentence_spans.span_dedup(empty).count() == 0
    assert sentence_spans.span_dedup(odd).where("doc_id is null").count() == 0


def test_runs_leave_the_catalog_when_a_batch_fails(spark, documents, monkeypatch):
    from cohortmill.llm import line_dedup

    before = {t.name for t in spark.catalog.listTables()}
    calls = []

    def failing(self, keys):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return self._losing(keys)

    monkeypatch.setattr(line_dedup.LineStore, "_losing", line_dedup.LineStore.losing, raising=False)
    monkeypatch.setattr(line_dedup.LineStore, "losing", failing)
    with pytest.raises(RuntimeError):
        line_dedup.line_dedup(documents)
    assert {t.name for t in spark.catalog.listTables()} == before
