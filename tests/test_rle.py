import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rle
from tessera.plans.rle_plan import RunPlan


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, text, first=0):
    return spark.createDataFrame([(first + i, None if c == "-" else c) for i, c in enumerate(text)], "vid long, v string")


@pytest.mark.parametrize("chunk", [1, 2, 3, 4, 100])
def test_encode_example_over_chunks(spark, chunk):
    runs = rle.encode(table(spark, "AAAAABBBAABAC"), "vid", ["v"], chunk)
    assert [(r.start_vid, r.length, r.v) for r in runs.orderBy("start_vid").collect()] == [(0, 5, "A"), (5, 3, "B"), (8, 2, "A"), (10, 1, "B"), (11, 1, "A"), (12, 1, "C")]


def test_encode_with_gaps_and_nulls(spark):
    df = table(spark, "AA--B").union(table(spark, "BB", 9))
    assert [(r.start_vid, r.length, r.v) for r in rle.encode(df, "vid", ["v"], 4).orderBy("start_vid").collect()] == [(0, 2, "A"), (2, 2, None), (4, 1, "B"), (9, 2, "B")]


@pytest.mark.parametrize("seed", [1, 2])
def test_decode_undoes_encode(spark, seed):
    rng = random.Random(seed)
    df = table(spark, "".join(rng.choice("AAAB-") for _ in range(300)))
    assert sorted(map(str, rle.decode(rle.encode(df, "vid", ["v"], 16)).collect())) == sorted(map(str, df.collect()))


def test_empty(spark):
    df = table(spark, "A").where("vid > 5")
    runs = rle.encode(df, "vid", ["v"])
    assert runs.count() == 0
    assert rle.decode(runs).count() == 0
    assert rle.reconstruct(runs, rle.project_runs(runs, F.col("v").alias("w"))).count() == 0


def test_reconstruct_example(spark):
    left = spark.createDataFrame([(2, 2, "a", None), (20, 1, "c", 7)], "start_vid long, length long, x string, y int")
    right = spark.createDataFrame([(0, 11, 3.0), (18, 1000, 6.0)], "start_vid long, length long, z double")
    for width in (None, 1, 5, 4000):
        assert rows_of(rle.reconstruct(left, right, width)) == [(2, 2, "a", None, 3.0), (20, 1, "c", 7, 6.0)]


@pytest.mark.parametrize("seed", [3, 4])
def test_reconstruct_against_brute_force(spark, seed):
    rng = random.Random(seed)

    def runs():
        out, at = [], 0
        for i in range(40):
            at += rng.randint(0, 4)
            n = rng.choice([1, 1, 2, 7, 60])
            out.append((at, n, i))
            at += n
        return out

    a, b = runs(), runs()
    expected = sorted((max(s, t), min(s + n, t + m) - max(s, t), x, y) for s, n, x in a for t, m, y in b if max(s, t) < min(s + n, t + m))
    left, right = spark.createDataFrame(a, "start_vid long, length long, x int"), spark.createDataFrame(b, "start_vid long, length long, y int")
    found = rle.reconstruct(left, right)
    assert rows_of(found) == expected
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_weighted_aggregate_equals_decoded(spark):
    runs = spark.createDataFrame([(0, 3, 1.0), (3, 2, None), (5, 5, 2.0)], "start_vid long, length long, x double")
    got = rle.aggregate_runs(runs, [], [rle.weighted("count").alias("n"), rle.weighted("count", "x").alias("nx"), rle.weighted("sum", "x").alias("s"), rle.weighted("avg", "x").alias("a"), rle.weighted("min", "x").alias("lo"), rle.weighted("max", "x").alias("hi")]).first()
    assert tuple(got) == (0, 1, 10, 8, 13.0, 1.625, 1.0, 2.0)
    with pytest.raises(ValueError):
        rle.weighted("median", "x")


def test_join_numbers_runs_left_major(spark):
    left = spark.createDataFrame([(0, 2, "a"), (2, 3, "b"), (5, 1, "a")], "start_vid long, length long, k string")
    right = spark.createDataFrame([(0, 4, "a"), (4, 1, "a"), (5, 2, "c")], "start_vid long, length long, j string")
    for chunk in (1, 2, 100):
        got = rle.join_runs(left, right, [("k", "j")], chunk).orderBy("start_vid")
        assert [(r.start_vid, r.length) for r in got.collect()] == [(0, 8), (8, 2), (10, 4), (14, 1)]


def test_plan_pushes_filters_and_drops_columns(spark):
    x, y = rle.encode(table(spark, "AABBA"), "vid", ["v"]), rle.project_runs(rle.encode(table(spark, "CDDDC"), "vid", ["v"]), F.col("v").alias("w"))
    plan = RunPlan({"v": x, "w": y})
    assert rows_of(plan.filter(["v"], F.col("v") == "A").select("v").rows()) == [(0, "A"), (1, "A"), (4, "A")]
    both = plan.filter(["v", "w"], (F.col("v") == "A") & (F.col("w") == "C"))
    assert rows_of(both.rows()) == [(0, "A", "C"), (4, "A", "C")]
    assert rows_of(plan.aggregate(["v"], [rle.weighted("count").alias("n")])) == [(0, 1, "A", 3), (1, 1, "B", 2)]


def test_decode_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rle, "BLOCK", 4)
    runs = spark.createDataFrame([(-9, 30, "a"), (100, 1, "b"), (200, 0, "c"), (300, 16, None)], "start_vid long, length long, v string")
    assert sorted(map(tuple, rle.decode(runs).collect()), key=str) == sorted([(-9 + i, "a") for i in range(30)] + [(100, "b")] + [(300 + i, None) for i in range(16)], key=str)


def test_a_run_longer_than_any_array(spark):
    runs = spark.createDataFrame([(5, 3_000_000_000, "a")], "start_vid long, length long, v string")
    got = [r.vid for r in rle.decode(runs).limit(3).collect()]
    assert len(set(got)) == 3 and all(5 <= v < 3_000_000_005 for v in got)
    small = spark.createDataFrame([(2_999_999_999, 10, 1.0)], "start_vid long, length long, w double")
    assert rows_of(rle.reconstruct(runs, small)) == [(2_999_999_999, 6, "a", 1.0)]


def test_numbered_over_ranges(spark):
    runs = spark.createDataFrame([(f"k{i:03}", i % 5) for i in range(200)], "k string, length long").repartition(7)
    got = [(r.k, r.start_vid) for r in rle.numbered(runs, [F.col("k")]).orderBy("k").collect()]
    assert got == [(f"k{i:03}", sum(j % 5 for j in range(i))) for i in range(200)]


def test_plans_know_their_columns(spark):
    x, y = rle.encode(table(spark, "AABBA"), "vid", ["v"]), rle.project_runs(rle.encode(table(spark, "CDDDC"), "vid", ["v"]), F.col("v").alias("w"))
    plan, other = RunPlan({"v": x}), RunPlan({"w": y})
    for wrong in (lambda: plan.filter(["z"], F.col("z") == 1), lambda: plan.select("z"), lambda: plan.join(other, []), lambda: plan.join(plan, [("v", "v")]), lambda: plan.join(other, [("v", "z")]), lambda: plan.join(other, [("v", "w")]).filter(["v", "z"], F.lit(True))):
        with pytest.raises(ValueError):
            wrong()


def test_join_plan_pushes_filters(spark):
    x = rle.encode(table(spark, "AABBAC"), "vid", ["v"])
    y = rle.project_runs(rle.encode(table(spark, "CAAB"), "vid", ["v"]), F.col("v").alias("w"))
    plan = RunPlan({"v": x}).join(RunPlan({"w": y}), [("v", "w")])
    assert sorted(r[1:] for r in rows_of(plan.rows())) == [("A", "A")] * 6 + [("B", "B")] * 2 + [("C", "C")]
    pushed = plan.filter(["v"], F.col("v") != "A").filter(["w"], F.col("w") != "C")
    assert not pushed.filters and len(pushed.left.filters) == len(pushed.right.filters) == 1
    assert rows_of(pushed.select("w").rows()) == [(0, "B"), (1, "B")]
    assert len(plan.filter(["v", "w"], F.col("v") == F.col("w")).filters) == 1
