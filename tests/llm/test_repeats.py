import random

from pyspark.sql import functions as F

from tessera.llm import common, queries, repeats


def check(found, rows):
    want = {x[0]: x for x in repeats.brute_force(rows)}
    assert len(found) == len(rows)
    for r in found:
        assert (r.doc_id, r.text, r.n_units, r.n_removed, r.removed) == want[r.doc_id]


def test_defined_cases(spark):
    line = "This line of some words repeats here. It has a second sentence too."
    rows = [(5, f"own start here\n{line}\nown end"), (2, f"{line}"), (9, None), (10, ""), (11, "Short. Short."), (12, f"é😀 é {line.upper()} tail"), (13, line + "\n" + line), (14, "w " * 60000 + "."), (15, "w " * 60000 + "."), (16, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("nths", F.lit("clash")).withColumn("key", F.lit(3)).repartition(4)
    found = repeats.apply(docs, keep=("key",)).collect()
    check(found, rows)
    assert {r.key for r in found} == {3}
    assert repeats.apply(docs.where("false")).count() == 0
    assert repeats.apply(docs.where("doc_id = 2").union(docs.where("doc_id = 2"))).where("n_removed > 0").count() == 0


def test_hot_lines_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HELD", 50)
    rng = random.Random(3)
    lines = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 14))) + rng.choice([".", "!", "", ",", " x. y"]) for _ in range(25)]
    rows = [(i * 3 - 40, rng.choice([" ", "\n"]).join(rng.choice([lines[0], rng.choice(lines), f"unique {i} {k}."]) for k in range(rng.randint(0, 9)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(repeats.apply(docs).collect(), rows)


def test_a_long_passage_goes_everywhere_but_once(spark):
    passage = " ".join(f"p{k}" + ("." if k % 7 == 6 else "") for k in range(70))
    rows = [(i, f"document {i} begins. " + passage + f" document {i} ends.") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in repeats.apply(docs).collect()}
    assert found[0].n_removed == 0 and all(r.n_removed >= 9 and "p8 " not in r.text for i, r in found.items() if i)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    check(queries.QUERIES["op9_repeats"](spark, sf).collect(), rows)


def test_short_lines_go_everywhere_but_once(spark):
    rows = [(i, f"own words {i} here\nRead more\nnext {i}\nShare this. Now.") for i in range(20)] + [(20, "start 20. Read more\nend 20"), (21, "Read   MORE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in repeats.apply(docs).collect()}
    assert found[0].text == rows[0][1] and found[21].text == ""
    assert all(found[i].text == f"own words {i} here\nnext {i}\n" and found[i].n_removed == 3 for i in range(1, 20))
    assert found[20].text == rows[20][1]  # two words within a line
    check(list(found.values()), rows)


def test_passages_without_stops_in_mid_sentence(spark):
    rng = random.Random(5)
    passages = [" ".join(f"q{rng.randrange(400)}" for _ in range(51)) for _ in range(40)]
    fresh = lambda i, n: " ".join(f"u{i}x{n}y{k}" for k in range(9))
    rows = [(i, f"{fresh(i, 0)} {passages[i % 40]} {fresh(i, 1)}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in repeats.apply(docs).collect()}
    assert all(found[i].text == rows[i][1] for i in range(40))
    left = [len([w for w in found[i].text.split() if w[0] == "q"]) for i in range(40, 120)]
    assert max(left) < 26 and sum(left) < 15 * len(left)  # mostly gone, each of them
    assert all(fresh(i, 0) in found[i].text and fresh(i, 1) in found[i].text for i in range(120))
    check(list(found.values()), rows)


def test_passages_of_words_that_repeat_at_once(spark):
    rows = [(i, f"start {i} here " + ("the " if i % 2 else "to and ") * (60 + i) + f"end {i} here") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeats.apply(docs).collect()
    assert all(len(r.text.split()) < 20 and f"start {r.doc_id} here" in r.text and f"end {r.doc_id} here" in r.text for r in found if r.doc_id > 5)
    check(found, rows)


def test_equal_ids_of_different_texts_and_long_texts(spark):
    line = "this line of words is there in every text of the table"
    rows = [(1, f"own start {i} z{i}y\n{line}") for i in range(4)] + [(None, f"{line}\nwithout id"), (None, None), (0, "w1 " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.apply(docs).collect()
    assert len(got) == len(rows) and sum(line in (r.text or "") for r in got) == 1
    assert sorted(r.text for r in got if r.doc_id == 1 and line not in r.text) == sorted(f"own start {i} z{i}y\n" for i in range(4) if not any(r.doc_id == 1 and line in r.text and f"start {i} " in r.text for r in got))
