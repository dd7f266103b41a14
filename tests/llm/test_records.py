import base64
import hashlib
import random

import pytest

from cohortmill.llm import chat, decontamination, warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "payload " * 300 + "</p>"
    rows = [(i, f"http://x/{i}", big) for i in range(5)] + [(10, None, None), (11, "u", ""), (12, "u\r\nv", "short"), (13, "u", "short"), (14, "u", "é" * 700), (15, "u", "é" * 700), (None, "u", big), (20, "u", "x" * 300_000), (3, "again", big)]
    return spark.createDataFrame(rows, PAGES).repartition(2)


def test_warc_round_trip(spark, pages):
    rows = pages.collect()
    last = {}
    for r in rows:
        if r.page_id is not None and len((r.html or "").encode()) >= 1000:
            last[r.html] = max(last.get(r.html, -1), r.page_id)
    want = []
    for r in rows:
        raw = (r.html or "").encode()
        to = last.get(r.html) if r.page_id is not None and last.get(r.html, -1) > r.page_id else None
        want.append((r.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, warc.warc_round_trip(pages).collect()), key=key) == sorted(want, key=key)


def test_archives_follow_the_format(spark, pages, tmp_path):
    import zstandard

    manifest = warc.write_warc(pages, f"file://{tmp_path}/a", archive_size=4000)
    assert manifest.count() > 2 and manifest.selectExpr("sum(records)").first()[0] == pages.count()
    for f in (tmp_path / "a").glob("*.warc.zst"):
        data = f.read_bytes()
        assert data[:4] == bytes.fromhex("5d2a4d18")
        size = int.from_bytes(data[4:8], "little")
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        one = d.decompressobj()
        fields, block = warc.parse_record(one.decompress(data[8 + size :]))
        assert fields["WARC-Type"] in ("response", "revisit") and int(fields["Content-Length"]) == len(block)
        assert len(base64.b32decode(fields["WARC-Payload-Digest"][5:])) == 20


def test_orphans_and_damage(spark, pages, tmp_path):
    folder = f"{tmp_path}/b"
    manifest = warc.write_warc(pages, f"file://{folder}")
    (tmp_path / "b" / "lost-attempt.warc.zst").write_bytes(b"rubbish")
    assert warc.read_warc(spark, f"file://{folder}", manifest).count() == pages.count()
    with pytest.raises(ValueError):
        list(warc.read_archive(warc.archive_bytes([b"a" * 5000, b"b"])[:-3]))


def test_archives_lie_where_hadoop_reads_them(spark, pages, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.other.link./x", f"file://{tmp_path}")
    try:
        conf.set("fs.defaultFS", "viewfs://other/")
        with pytest.raises(ValueError, match="viewfs"):
            warc.write_warc(pages, "/x/c")  # no scheme: the default store, never an executor's own disk
    finally:
        conf.set("fs.defaultFS", before)
    manifest = warc.write_warc(pages, f"{tmp_path}/d")
    assert warc.read_warc(spark, f"{tmp_path}/d", manifest).count() == pages.count()
    assert warc.qualified(spark, f"{tmp_path}/c") == f"file:{tmp_path}/c"


def test_warc_of_no_pages(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


CONV = "conv_id long, turn long, role string, text string"


def plain_chats(rows):
    turns = {}
    for c, t, role, text in set(rows):
        turns.setdefault(c, []).append((t, role, text))
    null = lambda x: (x is not None, x or 0) if not isinstance(x, str) else (True, x)
    held = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda y: tuple(map(null, y)))) for c, v in turns.items()}
    out = {}
    for c, v in held.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in held.values())
        same = [d for d, w in held.items() if w == v and d is not None]
        if not longer and (c == min(same) if same else True):
            out[c] = "".join(f"<|{r or ''}|>\n{x or ''}\n<|end|>\n" for r, x in v)
    return out


def test_chats(spark):
    import random

    r = random.Random(8)
    rows = []
    for c in range(60):
        seed = random.Random(c % 12)
        n = r.randint(1, 6)
        rows += [(c, t, ("user", "assistant")[t % 2], seed.choice(["hi", "what?", "yes", None, ""]) or None) for t in range(n)]
    rows += [(100, 0, "user", "tie"), (100, 0, "user", "tie"), (101, 0, None, None), (102, None, "user", "no turn"), (103, 0, "user", "x" * 50_000), (103, 5, "user", "gap")]
    got = {x.conv_id: x.rendered for x in chat.render_chats(spark.createDataFrame(rows, CONV).withColumnRenamed("extra", "n")).collect()}
    assert got == plain_chats(rows)


def test_chats_of_odd_tables(spark):
    assert chat.render_chats(spark.createDataFrame([], CONV)).count() == 0
    odd = spark.createDataFrame([(None, 0, "user", "a"), (1, 0, "user", "b")], CONV).selectExpr("*", "1 as n", "2 as p1", "3 as h1")
    assert chat.render_chats(odd).count() == 2


def test_turns_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "b"), (None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "a")]
    got = sorted((x.conv_id or 0, x.n_turns, x.rendered) for x in chat.render_chats(spark.createDataFrame(rows, CONV)).collect())
    a, b, none = "<|user|>\na\n<|end|>\n", "<|user|>\nb\n<|end|>\n", "<||>\n\n<|end|>\n"
    assert got == sorted([(0, 1, a), (0, 1, b), (0, 1, none), (1, 1, a)])


ITEM = "If Anna buys 12 apples for 3 dollars each and Ben eats 12 of them, how many are left in her basket?"


def leaks(spark, docs, items=((1, ITEM), (2, None), (3, "too short"), (None, ITEM))):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as id", "3 as h")
    return {(r.doc_id, r.item_id) for r in decontamination.leaked_items(d, spark.createDataFrame(list(items), "item_id long, text string")).collect()}


def test_templates(spark):
    docs = [
        (1, "Before it. " + ITEM + " After it."),
        (2, "so If Carla buys 40 apples for 7 euros each and Dirk eats 40 of them, how many are left in her basket?"),
        (3, "If Carla buys 40 apples for 7 euros each and Dirk eats 41 of them, how many are left in her basket?"),  # 12 = 12 is lost
        (4, "If Anna buys pears and Ben sells them, how many are left? Each of them counts twelve baskets."),
        (5, None), (6, ""), (7, "| | . ,"), (None, ITEM), (8, ITEM), (8, ITEM), (9, "word " * 30_000 + ITEM),
    ]
    assert leaks(spark, docs) == {(1, 1), (2, 1), (8, 1), (9, 1)}


def test_dense_short_and_nearly_verbatim_items(spark):
    dense = "Add 12 and 14 to 17 then 19 by 21 and 23 to 25 with 27 or 29 and 31."
    long_ = ITEM + " After that she walks home along the river and gives 12 of what is left to a friend who has been waiting there."
    items = ((1, dense), (2, "Seven plus five is twelve"), (3, long_))
    changed = long_.replace("Ben eats 12", "Ben eats 13")
    docs = [(1, "Before. " + dense + " After."), (2, "He said seven plus five is twelve, did he not?"), (3, "Before. " + changed), (4, dense.replace("1", "3")), (5, "Seven plus five is not twelve")]
    assert leaks(spark, docs, items) == {(1, 1), (2, 2), (3, 3)}


def test_no_items_no_leaks(spark, empty):
    assert leaks(spark, [(1, ITEM)], [(2, None)]) == set()
    assert decontamination.leaked_items(empty, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def test_whole_items_are_found_and_clean_documents_stay(spark):
    root = "/root/testdata/sf0.1"
    docs, items = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet")
    runs = {}
    for r in items.collect():
        w = r.text.split()
        for i in range(len(w) - 7):
            runs.setdefault(tuple(w[i : i + 8]), set()).add(r.item_id)
    want = set()
    for r in docs.select("doc_id", "text").collect():
        w = (r.text or "").split()
        for i in range(len(w) - 7):
            want |= {(r.doc_id, x) for x in runs.get(tuple(w[i : i + 8]), ())}
    found = {(r.doc_id, r.item_id) for r in decontamination.leaked_items(docs, items).collect()}
    assert found == want
    assert decontamination.clean_documents(docs, items).count() == docs.count() - len({d for d, _ in want})


def test_warc_extra_columns_with_clashing_names(spark):
    from cohortmill.llm import warc

    html = "<p>" + "long page " * 200
    rows = [(1, "u", html, "x", 5, "y"), (2, "u", html, "x", 5, "y"), (None, None, html, "x", 5, "y"), (2, "u", html, "x", 5, "y"), (3, "u", None, "x", 5, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to long, name string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.warc_round_trip(pages).collect())
    assert got == [(0, "response", 0), (1, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "response", 0)]


# Questions with slots: names {a} {b}, numbers {m} {n}. A re-parameterised copy has other values, equal where they were equal.
QUESTIONS = {
    "en": ["If {a} buys {m} apples for {n} dollars each and {b} eats {m} of them, how many are left in the basket at the end?", "yesterday {a} walked {m} km to the market and came back with {n} kg of flour, so how heavy was the bag that {b} carried home?",
           "the train that leaves at {m} hours needs {n} minutes to reach the next town where {a} waits, when does {b} see it arrive?", "there are {m} birds on a wire and {n} of them fly away after {a} claps, how many does {b} still count?"],
    "fr": ["quand {a} achète {m} pommes pour {n} euros et que {b} en mange {m}, combien en reste-t-il dans le panier à la fin ?", "hier {a} a marché {m} km pour aller au marché et elle est revenue avec {n} kg de farine, combien pesait le sac que {b} a porté ?",
           "le train qui part à {m} heures met {n} minutes pour arriver à la ville où {a} attend, quand est-ce que {b} le voit venir ?", "il y a {m} oiseaux sur un fil et {n} partent quand {a} frappe des mains, combien est-ce que {b} en compte encore ?"],
    "es": ["cuando {a} compra {m} manzanas por {n} euros y {b} se come {m} de ellas, cuántas quedan en la cesta al final del día ?", "ayer {a} caminó {m} km para ir al mercado y volvió con {n} kg de harina, cuánto pesaba la bolsa que {b} llevó a casa ?",
           "el tren que sale a las {m} horas tarda {n} minutos en llegar al pueblo donde {a} espera, cuándo lo ve llegar {b} por fin ?", "hay {m} pájaros en un cable y {n} se van cuando {a} da una palmada, cuántos puede contar {b} todavía ?"],
    "de": ["Wenn {a} heute {m} Äpfel für je {n} Euro kauft und {b} davon {m} isst, wie viele Äpfel liegen dann am Ende noch im Korb?", "Gestern ging {a} zu Fuß {m} km zum Markt und kam mit {n} kg Mehl zurück, wie schwer war also der Sack, den {b} nach Hause getragen hat?",
           "Der Zug fährt um {m} Uhr ab und braucht {n} Minuten bis zur nächsten Stadt, in der {a} schon wartet, wann sieht {b} ihn endlich kommen?", "Auf einem Draht sitzen {m} Vögel und {n} davon fliegen weg, wenn {a} laut klatscht, wie viele kann {b} dann noch zählen?"],
}
PEOPLE = "Anna Ben Carla Dirk Elsa Farid Greta Hugo Ines Jonas Kira Liam".split()


def test_reparameterised_questions_are_found(spark):
    """Recall at least 0.9 in each of four languages; texts of the same words in another order stay clean."""
    r = random.Random(8)
    values = lambda: dict(zip("abmn", [*r.sample(PEOPLE, 2), *r.sample(range(2, 400), 2)]))
    items, docs, want, clean = [], [], {}, set()
    for lang, forms in QUESTIONS.items():
        for i, form in enumerate(forms):
            key = len(items) + 1
            items.append((key, form.format(**values())))
            for _ in range(10):
                doc = len(docs) + 1
                words = form.format(**values()).split()
                docs.append((doc, f"a first line of text\n{' '.join(words)}\nand a last line of text"))
                want[doc] = (key, lang)
                r.shuffle(words)
                docs.append((doc + 1, " ".join(words)))
                clean.add(doc + 1)
    found = leaks(spark, docs, items)
    for lang in QUESTIONS:
        mine = [(d, k) for d, (k, of) in want.items() if of == lang]
        assert sum(x in found for x in mine) >= 0.9 * len(mine), lang
    assert not {d for d, _ in found} & clean
    assert all(want[d][0] == k for d, k in found)


# Word problems whose sentences open with a name.
OPENED = {
    "en": ["{a} buys {m} apples at the market. {a} gives {n} of them to a friend. How many apples are left for the two of them?", "{a} and {b} share a garden with {m} trees in it. {b} cuts down {n} of them in the spring. How many trees does {a} see from the window?",
           "{b} reads {m} pages of a long book on every day of the week. {a} reads {n} pages more than that each day. Who of the two has read more by Sunday?", "{a} has {m} marbles in a bag. {b} has {n} marbles more than that in a box. How many marbles do the two of them have together?"],
    "fr": ["{a} achète {m} pommes au marché. {a} donne ensuite {n} de ces pommes à une amie. Combien de pommes reste-t-il dans le panier ?", "{a} lit chaque jour {m} pages de son livre. {b} lit {n} pages de plus que cela. Combien de pages les deux ont-elles lues dimanche ?",
           "{b} possède un jardin avec {m} arbres fruitiers. {a} en coupe {n} au printemps avec son frère. Combien d'arbres reste-t-il dans ce jardin ?", "{a} a rangé {m} billes dans un sac. {b} en a mis {n} de plus dans une boîte. Combien de billes ont-ils ensemble ?"],
    "es": ["{a} compra {m} manzanas en el mercado. {a} regala después {n} de ellas a una amiga. Cuántas manzanas quedan al final en la cesta ?", "{a} lee cada día {m} páginas de un libro. {b} lee {n} páginas más que eso. Cuántas páginas han leído los dos hasta el domingo ?",
           "{b} tiene un jardín grande con {m} árboles. {a} corta en primavera {n} de ellos con su hermano. Cuántos árboles quedan en el jardín ?", "{a} guarda siempre {m} canicas en una bolsa. {b} tiene otras {n} canicas en una caja. Cuántas canicas tienen los dos juntos ?"],
    "de": ["{a} kauft auf dem großen Markt {m} reife Birnen. {a} gibt davon gleich {n} an ihre beste Freundin weiter. Wie viele bleiben dann noch für sie selbst übrig?", "{a} liest jeden Tag genau {m} lange Seiten. {b} liest jeden Tag noch einmal {n} mehr als das. Wie viel haben die beiden zusammen bis zum letzten Tag gelesen?",
           "{b} hat hinter dem alten Haus {m} hohe Tannen stehen. {a} fällt davon im kalten Winter ganze {n} mit der Säge. Wie viele stehen danach noch hinter dem alten Haus?", "{a} hat in einem roten Sack genau {m} bunte Murmeln. {b} hat in einer blauen Dose noch {n} mehr als das. Wie viele haben die beiden dann zusammen?"],
}


def test_reparameterised_questions_that_open_with_a_name_are_found(spark):
    """Half of the questions open with a name: recall at least 0.9 in each language and each half; shuffled texts stay clean."""
    r = random.Random(21)
    values = lambda: dict(zip("abmn", [*r.sample(PEOPLE, 2), *r.sample(range(2, 400), 2)]))
    items, docs, want, clean = [], [], {}, set()
    for half, forms in [((lang, opened), f) for opened, of in ((False, QUESTIONS), (True, OPENED)) for lang, f in of.items()]:
        for form in forms:
            key = len(items) + 1
            items.append((key, form.format(**values())))
            for _ in range(10):
                doc = len(docs) + 1
                copy = form.format(**values())
                docs.append((doc, f"a first line of text\n{copy}\nand a last line of text"))
                want[doc] = (key, half)
                words = copy.split()
                r.shuffle(words)
                docs.append((doc + 1, " ".join(words)))
                clean.add(doc + 1)
    found = leaks(spark, docs, items)
    for half in {h for _, h in want.values()}:
        mine = [(d, k) for d, (k, of) in want.items() if of == half]
        got = sum(x in found for x in mine) / len(mine)
        print(half, got)
        assert got >= 0.9, half
    assert not {d for d, _ in found} & clean
    assert all(want[d][0] == k for d, k in found)


def test_openers_are_names_or_words(spark):
    item = "Anna buys 12 apples at the market. Anna gives 3 of them to a friend."
    docs = [
        (1, "Carla buys 40 apples at the market. Carla gives 7 of them to a friend."),
        (2, "Carla sold 40 apples at the market. Carla takes 7 of them to a friend."),
        (3, "then Anna buys 12 apples at the market. Anna gives 3 of them to a friend."),
    ]
    assert leaks(spark, docs, [(1, item)]) == {(1, 1), (3, 1)}
