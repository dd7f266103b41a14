import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

VOCABULARY = "the of and to in river stone light paper garden winter table music silver mountain window letter market Anna Paris 12 40 km".split()


def sentence(r):
    return " ".join(r.choice(VOCABULARY) for _ in range(r.randint(3, 14))) + r.choice([".", ".", "!", "?", ""])


def text(r, n=None):
    return "".join(sentence(r) + r.choice([" ", " ", "\n"]) for _ in range(n or r.randint(1, 12)))


def edited(r, t, rate):
    return " ".join(r.choice(VOCABULARY) if r.random() < rate else w for w in t.split(" "))


@pytest.fixture(scope="session")
def corpus():
    """[(doc_id, text)]: near and exact copies, shared passages, null, empty, wordless, short and very long texts."""
    r = random.Random(11)
    texts = [text(r) for _ in range(40)]
    texts += [edited(r, texts[0], p) for p in (0.0, 0.01, 0.02, 0.02, 0.03, 0.05, 0.2)] + [edited(r, texts[1], 0.02) for _ in range(12)]
    passage = text(r, 8)
    texts += [text(r, 3) + passage + text(r, 3) for _ in range(5)]
    texts += [None, None, "", " \n\t ", "one", "one", "One two", "one two three", "x" * 5000, "x" * 5000 + " tail", text(r, 900), "é ü 日本 　 ok", "#*$ | <b> &amp; %%"]
    texts += ["a b c d e a b c d e a b c d e", "same line of text\nsame line of text\nother", "  SAME LINE OF TEXT\t\nfree", "<|endoftext|> and <|endoftext|>"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """Null ids, repeated rows, and extra columns with names that operators use inside."""
    rows = [(None, "a lone text without any id at all"), (None, None), *corpus[:9], corpus[0], corpus[0]]
    names = ["_lost", "_leak", "_id", "n_lines", "n_dropped", "component_id", "k", "comp", "bucket", "pattern", "p_good", "rate"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names:
        df = df.selectExpr("*", f"'extra' as {n}")
    return df
