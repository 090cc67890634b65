import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join as J


def brute(rows):
    return sorted(J.brute_force(rows))


def joined(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in J.join(docs, **options).select("doc_id", "n_shingles", "component_id").collect())


def edits(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Families at all distances from the threshold, chains, shared passages, and a group of copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(40)]
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 30, 80, 200]))]
        for k in range(rng.randint(1, 6)):
            rows.append((i, edits(rng, base, k)))
            i += 1
    chain = [word() for _ in range(100)]
    for k in range(10):  # each near the next, the ends far apart
        rows.append((i, " ".join(chain)))
        i += 1
        chain[k * 9 : k * 9 + 3] = [word() for _ in range(3)]
    for _ in range(15):
        rows.append((i, " ".join([word() for _ in range(12)] + shared)))
        i += 1
    rows += [(i + k, " ".join(shared)) for k in range(20)]
    assert joined(spark, rows) == brute(rows)


def test_hot_group_of_near_copies_is_dealt_over_buckets(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = [(k, edits(rng, base, rng.randint(0, 2))) for k in range(150)]
    assert joined(spark, rows, hot=20, bucket_entries=100) == brute(rows)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "a b c d e"), (7, "a b c d e f"), (8, "x " * 30000), (9, "X " * 29999 + "x"), (10, "a b c d e")]
    assert joined(spark, rows) == brute(rows)
    repeated = [(1, "p q r s t u"), (1, "p q r s t u"), (1, "other words are here now"), (0, "p q r s t u")]
    assert joined(spark, repeated) == [(0, 2, 0), (1, 1, 1), (1, 2, 0), (1, 2, 0)]
    assert joined(spark, [(1, "a")])[:0] == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(empty).count() == 0


def test_one_of_each(spark):
    rows = [(5, "p q r s t u"), (5, "p q r s t u"), (7, "P q r s t u"), (8, "nothing like it in here"), (9, ""), (9, ""), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("clash"))
    out = sorted((r.doc_id, r.text or "") for r in J.one_of_each(docs).collect())
    assert out == [(5, "p q r s t u"), (8, "nothing like it in here"), (9, ""), (9, ""), (10, "")]


def test_one_of_each_keeps_unrelated_texts_of_null_and_repeated_ids(spark):
    rows = [(1, "p q r s t u"), (1, "other words are here now"), (None, "a text without an id"), (None, "one more of those texts"), (None, "One more of those texts"), (None, "p q r s t u"), (3, "OTHER words are here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text.lower()) for r in J.one_of_each(docs).collect())
    assert out == [(0, "a text without an id"), (0, "one more of those texts"), (1, "other words are here now"), (1, "p q r s t u")]


def test_components_of_a_long_path(spark):
    from tessera.llm.common import Shared

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in J.components(edges, Shared(spark)).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_whole_table_against_sql(spark, sf):
    from oracle import same

    from tessera.llm import queries

    same(queries.QUERIES["op2_ngram_join"](spark, sf), queries.ORACLES["op2_ngram_join"], sf)
