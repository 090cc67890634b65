import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, pack
from tessera.llm.queries import TOKENIZER


def check(rows, ids, sequence=2048):
    """Every piece once, cut as agreed, and sequences gapless from 0 within their size."""
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= sequence
    for doc_id, tokens in ids.items():
        expected = [(k, a, len(tokens[a : a + sequence]), zlib.crc32(np.array(tokens[a : a + sequence], "<u4").tobytes())) for k, a in enumerate(range(0, len(tokens), sequence))]
        assert sorted(pieces[doc_id]) == expected
    return len(places)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_ids_are_those_of_the_library(library):
    rng = random.Random(5)
    letters = "aAbBéÉñß ×÷'.,!%12 \n\t—“’ΣσςİKÅ̈̀ạ́ⁿ½ 　Ǆ<|>endoftext"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["don't he'll!' s 's", "", " ", "H̱, ẖ.", "<|endoftext|> a<|startoftext|>b", "x" * 5000]
    out, at = pack.Encoder.of(TOKENIZER).encode(*common.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert out[at[i] : at[i + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_the_encoder_goes_when_a_worker_serves_others():
    encoder = pack.Encoder.of(TOKENIZER)
    assert list(common.tidy(lambda x: x, "encoder")(iter([1, 2]))) == [1, 2]
    assert pack.Encoder.of(TOKENIZER) is encoder
    assert list(common.tidy(lambda x: x)(iter([3]))) == [3]
    assert pack.Encoder.of(TOKENIZER) is not encoder


def test_defined_cases_and_small_cells(spark, library):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["the", "and", "word", "x1"]) for _ in range(rng.choice([1, 5, 300, 1500, 5000]))) for i in range(120)} | {500: None, 501: "", 502: "  "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("task", F.lit(1))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    bound = -(-sum(len(x) for x in ids.values()) // 2048)
    for options in ({}, {"cell": 16}):
        used = check(pack.pack(docs, TOKENIZER, **options).collect(), ids)
        assert bound <= used <= bound * 1.12 + 2
    assert pack.pack(docs.where("false"), TOKENIZER).count() == 0
    again = pack.pack(docs.where("doc_id = 500").union(docs.where("doc_id = 500")), TOKENIZER).collect()
    assert [(r.doc_id, r.length) for r in again] == [(500, 1), (500, 1)] and {r.offset for r in again} == {0, 1}


def test_lengths_that_fill_no_bin(spark, library):
    """Pieces of which no two fit together: cells do not grow, and no piece is lost."""
    text = "the " * 1100
    docs = spark.createDataFrame([(i, text) for i in range(90)], "doc_id long, text string")
    tokens = [*library.encode(text, add_special_tokens=False).ids, 0]
    assert check(pack.pack(docs, TOKENIZER, cell=8, children=2).collect(), {i: tokens for i in range(90)}) == 90


def test_children_keep_every_piece_and_improve():
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in np.concatenate([rng.integers(250, 760, 120), rng.integers(100, 500, 120)])]
    start = pack.best_fit([], list(range(len(lengths))), lengths, 1000)
    later = pack.evolve(lengths, [start], 1000, 7, 40)
    for bins in later:
        assert sorted(p for _, x in bins for p in x) == list(range(len(lengths)))
        assert all(f == sum(lengths[p] for p in x) <= 1000 for f, x in bins)
    assert len(later[0]) < len(start)
    child = pack.cross(start, later[0], lengths, 1000, rng)
    assert sorted(p for _, x in child for p in x) == list(range(len(lengths)))


def test_whole_table(spark, sf, library):
    from tessera.llm import queries

    docs = common.table(spark, sf, "documents").collect()
    ids = {d.doc_id: [*library.encode(d.text or "", add_special_tokens=False).ids, 0] for d in docs}
    used = check(queries.QUERIES["op8_pack"](spark, sf).collect(), ids)
    whole = sum(len(x) // 2048 for x in ids.values())
    rest = sum(len(x) % 2048 for x in ids.values())
    assert used <= whole + -(-rest // 2048) + 1
