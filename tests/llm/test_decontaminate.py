import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D

ITEMS = [("b1", "One two three four five six seven eight nine ten eleven twelve"), ("b2", "short item"), ("b3", None), ("b4", ""), ("b5", "one two three four five six seven eight nine ten"), ("b6", "Ünïcode wörd ΣΑΣ")]
TEXTS = [
    (1, "start one TWO three four five six seven eight nine ten eleven twelve end"),
    (2, "a short, item! and a short item"),
    (3, None),
    (4, ""),
    (5, "one two three four five six seven eight nine x ten"),
    (6, "x" * 50 + " " + "short " * 2000 + "item"),
    (7, "Ünïcode wörd ΣΑΣ and ünïcode wörd ΣΑΣ"),
    (8, "... !!! ---"),
    (2, "the same id short item"),
    (2, "the same id short item"),
]


def frames(spark, texts=TEXTS, items=ITEMS):
    return spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("spans", F.lit(1)), spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(7))


def test_against_brute_force(spark):
    docs, bench = frames(spark)
    got = sorted(map(tuple, D.report(D.find(docs, bench)).collect()))
    assert got == sorted(D.brute_force(TEXTS, ITEMS))


def test_blocks_of_items_give_the_same(spark):
    docs, bench = frames(spark)
    got = sorted(map(tuple, D.report(D.find(docs, bench, block_bytes=20)).collect()))
    assert got == sorted(D.brute_force(TEXTS, ITEMS))


def test_small_shards_and_empty_tables(spark):
    docs, bench = frames(spark)
    assert sorted(map(tuple, D.report(D.find(docs, bench, shard_words=1)).collect())) == sorted(D.brute_force(TEXTS, ITEMS))
    assert D.find(docs.where("false"), bench).count() == 0
    assert D.report(D.find(docs, bench.where("false"))).where("contaminated").count() == 0


def test_removal(spark):
    docs, bench = frames(spark)
    out = {r.doc_id: r for r in D.remove(docs.where("doc_id in (1, 3, 4, 7)"), bench).collect()}
    assert out[1].text == "start  end" and out[3].text is None and out[4].text == "" and out[7].text == " and ünïcode wörd ΣΑΣ"
    assert out[1].item_id == "clash"
    counted = D.remove(docs.where("doc_id = 1").withColumn("n_chars", F.lit(0)), bench).first()
    assert counted.n_chars == len(counted.text)


@pytest.mark.parametrize("seed", range(6))
def test_index_against_slices(seed):
    rng = random.Random(seed)
    symbols = [rng.choice([0, 1, 1, 2, 3] if seed % 2 else [0, 1, 1, 1]) for _ in range(400)] + [0]
    codes = np.array(symbols, np.int32)
    index = D.FMIndex(codes, sample=5)
    for _ in range(60):
        n = rng.randint(1, 6)
        phrase = [rng.randint(1, 4) for _ in range(n)]
        low, high = index.search(np.array([phrase], np.int32), np.array([n]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(len(symbols) - n + 1) if symbols[i : i + n] == phrase]


def test_wavelet_ranks():
    x = np.random.default_rng(1).integers(0, 11, 500)
    tree = D.WaveletMatrix(x, 4)
    for c in range(11):
        at = np.arange(501)
        assert (tree.rank(np.full(501, c), at) == np.concatenate(([0], np.cumsum(x == c)))).all()
    symbol, rank = tree.access_rank(np.arange(500))
    assert (symbol == x).all() and all(rank[i] == (x[:i] == x[i]).sum() for i in range(500))


def test_whole_table_against_sql(spark, sf):
    from oracle import same

    from tessera.llm import queries

    same(queries.QUERIES["op1_decontaminate"](spark, sf), queries.ORACLES["op1_decontaminate"], sf)


OVERLAPPING = [("b1", "a b c d e f g h i j"), ("b2", "f g h i j k l m n o")]


def test_overlaps_of_blocks_are_cut_once(spark):
    docs, _ = frames(spark, [(1, "start a b c d e f g h i j k l m n o end"), (2, "a b c d e f g h i j"), (2, "x y f g h i j k l m n o"), (None, None)])
    bench = spark.createDataFrame(OVERLAPPING, "item_id string, text string")
    for size in (1 << 20, 5):
        out = D.remove(docs.withColumn("row_key", F.lit("clash")).withColumn("bytes", F.lit(2)), bench, block_bytes=size).collect()
        assert sorted("-" if r.text is None else r.text for r in out) == ["", "-", "start  end", "x y "]
        assert {(r.row_key, r.bytes) for r in out} == {("clash", 2)}
    # what a cut brings together is no occurrence
    docs, _ = frames(spark, [(1, "p q a b c d e f g h i j r s")])
    bench = spark.createDataFrame([*OVERLAPPING, ("b3", "p q r s")], "item_id string, text string")
    assert {D.remove(docs, bench, block_bytes=size).first().text for size in (1 << 20, 5)} == {"p q  r s"}


def test_rows_of_one_id_in_blocks(spark):
    texts = [(2, "a b c"), (2, "d e f"), (2, "d e f"), (None, "a b c"), (None, "d e f a b c"), (3, ""), (3, None)]
    items = [("x", "a b c"), ("y", "d e f"), ("z", "b c")]
    docs, bench = frames(spark, texts, items)
    for size in (1 << 20, 3):
        got = sorted(map(tuple, D.report(D.find(docs, bench, block_bytes=size)).collect()), key=str)
        assert got == sorted(D.brute_force(texts, items), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_items_in_blocks(spark, seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice("abcdEf") for _ in range(n))
    items = [(f"i{k}", line(rng.randint(0, 14))) for k in range(12)]
    texts = [(rng.randint(1, 20), line(rng.randint(0, 60)) + (" " + rng.choice(items)[1] if k % 3 == 0 else "")) for k in range(60)]
    docs, bench = frames(spark, texts, items)
    want = sorted(D.brute_force(texts, items))
    for size in (1 << 20, 30):
        assert sorted(map(tuple, D.report(D.find(docs, bench, block_bytes=size)).collect())) == want


def test_remove_of_empty_tables_and_repeated_rows(spark):
    docs, bench = frames(spark, [(1, "a short item b"), (1, "a short item b"), (2, "")])
    for size in (1 << 20, 5):
        assert sorted(r.text for r in D.remove(docs, bench, block_bytes=size).collect()) == ["", "a  b", "a  b"]
        assert D.remove(docs.where("false"), bench, block_bytes=size).count() == 0
    assert D.remove(docs, bench.where("false")).where("text = 'a short item b'").count() == 2


def test_phrases_stay_small():
    import sys

    items = [(str(i), " ".join(f"w{(i * 31 + k * 7) % 5003}" for k in range(400))) for i in range(500)]
    phrases = D.Phrases(items)
    size = sum(x.nbytes for x in (phrases.codes, phrases.lengths, phrases.hashes, phrases.item_at, phrases.item_of)) + sys.getsizeof(phrases.names)
    assert size < 80 * 500 * 400  # words


def test_hashes_of_long_texts_are_those_of_their_words():
    from tessera.llm import common

    rng = np.random.default_rng(1)
    words = [b"x" * int(n) for n in rng.integers(1, 9, 400_000)] + [b"y" * (3 << 20), b"z"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]), common.SOLID_BYTES)
    whole = common.span_hashes(data, starts, ends)
    for i in (0, 1, 399_998, 399_999, 400_000, 400_001):
        assert whole[i] == common.span_hashes(np.frombuffer(words[i], np.uint8), np.array([0]), np.array([len(words[i])]))[0]
    assert len(np.unique(whole)) == 10
    assert all(len(x) <= common.STEP_BYTES + 1 for x in common._powers.values())
