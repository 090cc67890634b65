import corpus_pipeline
import pytest

from tessera.llm import common, decontaminate, ngram_join, pii, quality
from tessera.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, written and read again."""
    shared, docs, out = common.Shared(spark), common.table(spark, SF, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.write(stage(spark, docs, SF), keep=True)
        out.append(docs)
    return out


def test_columns_stay(stages):
    for docs in stages[1:-1]:
        assert docs.dtypes == stages[0].dtypes


def test_each_stage_decides_as_its_operator(spark, stages):
    raw, good, single, clean, masked, packed = stages
    labels, bench = common.table(spark, SF, "labels"), common.table(spark, SF, "benchmark")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(raw, labels).where("predicted = 1").collect()}
    members = ngram_join.brute_force([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in members}
    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r.text for r in clean.collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    hit = {x[0] for x in decontaminate.brute_force(list(before.items()), items) if x[5]}
    assert before.keys() == after.keys() and {i for i in before if before[i] != after[i]} == hit
    for r in masked.collect():
        spans = pii.find(pii.weights(), [after[r.doc_id]])[0][1]
        assert r.text == pii.masked(after[r.doc_id], spans) and r.n_chars == len(r.text)
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(TOKENIZER), packed.collect()
    total = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in masked.collect()}
    got: dict[int, int] = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total


def test_run_is_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])
