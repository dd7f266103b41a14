"""The pipeline's stages against plain versions, and the queries on the smallest tables."""

import brute
import corpus_pipeline
from cohortmill.llm import mixing, quality
from cohortmill.llm import queries as registered

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, lambda df: {r.doc_id for r in df.collect()}
    quick = [f for _, f in corpus_pipeline.STAGES]
    assert len(quick) == 5
    one = quick[0](spark, docs, DATA).cache()
    judged = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert ids(one) == {i for i, r in judged.items() if r.kept}
    for i, text in [(r.doc_id, r.text) for r in docs.collect()]:
        m = brute.measures(text)
        assert not judged[i].kept or not (m[0] < 10 or 100 * m[4] > 20 * m[0])
    two = quick[1](spark, one, DATA).cache()
    plain = brute.lines([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id: (r.text, r.n_chars) for r in two.collect()} == {i: (t, len(t)) for i, (_, _, t) in plain.items()}
    three = quick[2](spark, two, DATA).cache()
    near = brute.near([(r.doc_id, r.text) for r in two.collect()], 5, 80, 100)
    assert ids(three) == {i for i, (_, c) in near.items() if c == i}
    four = quick[3](spark, three, DATA).cache()
    assert one.columns == two.columns == three.columns == four.columns == columns
    five = quick[4](spark, four, DATA)
    assert ids(five) == ids(four) and set(five.columns) == {"doc_id", "n_tokens", "rate", *(f"p_{k}" for k in mixing.DOMAINS)}
    assert ids(corpus_pipeline.run(spark, DATA)) == ids(five)


def test_queries_have_the_columns_of_their_contracts(spark):
    want = {
        "op2_": {"doc_id", "n_shingles", "component_id"},
        "op5_": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op6_": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
        "op8_": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
        "op9_": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op11": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op12": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
        "op13": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    }
    for name, f in registered.queries().items():
        df = f(spark, DATA)
        assert want.get(name[:4], set()) <= set(df.columns)


def test_queries_against_sql(spark):

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in registered.oracle_sql().items():
        df = registered.queries()[name](spark, DATA)
        found = con.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in found.fetchall()), name


def test_pipeline_leaves_only_its_result(spark, tmp_path):
    from pathlib import Path

    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:"))
    before = {p.name for p in shared.iterdir()} if shared.exists() else set()
    out = corpus_pipeline.run(spark, DATA)
    assert {p.name.rsplit("-", 1)[0] for p in shared.iterdir() if p.name not in before and p.name != spark.sparkContext.applicationId and "-" in p.name[:-32]} <= {"mixing"}
    assert out.count() > 0


def test_pipeline_stages_on_odd_tables(spark, odd, empty):
    from pyspark.sql import functions as F

    docs = odd.withColumn("text", F.concat("text", F.lit(" and there are some more words, so that the base rules keep it. Yes."))).unionByName(odd.where("doc_id is null"))
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, DATA).count() == 0
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    assert docs.where("text is null").count() == 0 and docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert mixed.count() == docs.where("doc_id is not null").select("doc_id").distinct().count() + docs.where("doc_id is null").count()
