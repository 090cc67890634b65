import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    rows = queries.QUERIES["op10_quality"](spark, sf).collect()
    assert len(rows) == common.table(spark, sf, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_compiled_rules_are_the_model(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((400, len(quality.STATISTICS))), 6)
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.6)).astype(float)
    bias, rules = quality.learn(x, y)
    assert 0 < len(rules) < 200
    total = bias + sum(w * quality.holds(r, x) for r, w in rules)
    assert np.mean((total > 0) == (y == 1)) > 0.97
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = [r.s for r in df.select(quality.compiled(bias, rules).alias("s")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total)))


def test_statistics_by_hand():
    import pyarrow as pa

    data, offsets = common.buffers(pa.array(["Ab cd!!\nAb cd!!\n\nX", None, "", "éé 12"]))
    got = dict(zip(quality.STATISTICS, quality.statistics(data, offsets).T, strict=True))
    assert got["n_words"].tolist() == [5, 0, 0, 2] and got["n_lines"].tolist() == [3, 0, 0, 1]
    assert got["distinct_words"].tolist() == [3 / 5, 0, 0, 1] and got["distinct_lines"].tolist() == [2 / 3, 0, 0, 1]
    assert got["digit"].tolist() == [0, 0, 0, 2 / 7] and got["exclaim"][0] == 4 / 18


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (2, "x " * 50000), (None, "text"), (3, "text")], "doc_id long, text string").withColumn("upper", F.lit("clash")).withColumn("_text", F.lit(1)).withColumn("score", F.lit(2))
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score(docs.select("doc_id", "text", "score"), labels).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality.score(docs.where("false"), labels).count() == 0
