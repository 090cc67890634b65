import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.sources import files


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


@pytest.mark.parametrize(("offset", "fetch", "expected"), [(2, 3, [2, 3, 4]), (8, 5, [8, 9]), (12, 5, []), (0, 0, []), (0, None, list(range(10)))])
def test_offset_and_fetch(spark, offset, fetch, expected):
    assert [r.v for r in R.sort(numbers(spark, *range(10)), [("v", True)], offset, fetch).collect()] == expected


def test_fetch_keeps_no_ties(spark):
    assert [r.v for r in R.sort(numbers(spark, 1, 1, 1, 2), [("v", True)], fetch=2).collect()] == [1, 1]


def test_major_key_decides(spark):
    df = spark.createDataFrame([(0, 9), (1, 1), (2, 2)], "a int, b int")
    assert [tuple(r) for r in R.sort(df, [("a", True), ("b", True)], fetch=1).collect()] == [(0, 9)]


def test_limit_without_order_and_empty_input(spark):
    assert R.sort(numbers(spark, 1, 2, 3), [], fetch=2).count() == 2
    assert R.sort(numbers(spark, 1).where("v > 1"), [("v", True)], 1, 1).collect() == []


def test_null_order(spark):
    df = spark.createDataFrame([(None,), (1,)], "v int")
    assert [r.v for r in R.sort(df, [("v", True)]).collect()] == [1, None]
    assert [r.v for r in R.sort(df, [("v", False)]).collect()] == [None, 1]


def test_global_and_grouped_aggregates_of_nothing(spark):
    none = numbers(spark, 1).where("v > 1")
    assert [tuple(r) for r in R.aggregate(none, [], [F.count("*"), F.sum("v")]).collect()] == [(0, None)]
    assert R.aggregate(none, ["v"], [F.count("*")]).collect() == []
    assert sorted(r.v for r in R.aggregate(numbers(spark, 1, 1, 2), ["v"], []).collect()) == [1, 2]


def test_null_keys_match_nothing(spark):
    a, b = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int"), spark.createDataFrame([(None, 3), (1, 4)], "j int, y int")
    assert [tuple(r) for r in R.join(a, b, [("k", "j")]).select("x", "y").collect()] == [(2, 4)]
    assert R.join(a, b, [("k", "j")], F.col("x") > F.col("y")).collect() == []
    with pytest.raises(ValueError):
        R.join(a, b, [])


def test_selection_vector_is_a_filter(spark):
    df = spark.createDataFrame([(1,), (None,), (5,), (9,)], "v int")
    marked = R.select_vector(R.select_vector(df, F.col("v") > 2), F.col("v") < 9)
    assert marked.count() == 4
    assert [r.v for r in R.compact(marked).collect()] == [5]


def test_plan_pushes_filter_and_columns(spark, sf):
    df = files.read_table(spark, f"{sf}/lineitem.parquet").where("l_quantity < 5").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity" in plan
    assert "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[1]


def test_formats(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|2|3|4|5.00|6.50|0.10|0.02|N|O|1996-01-02|1996-01-03|1996-01-04|NONE|AIR|a comment|\n")
    row = files.read_tbl(spark, str(tmp_path / "t.tbl"), files.LINEITEM).first()
    assert (row.l_orderkey, str(row.l_extendedprice), str(row.l_shipdate), row.l_comment) == (1, "6.50", "1996-01-02", "a comment")
    assert [tuple(r) for r in files.inline_keywords(spark, ["a|b||", "x|y|z", "t"]).collect()] == [("a", ["b"]), ("x", ["y", "z"]), ("t", [])]
    (tmp_path / "k.csv").write_text("Star Wars|space|force\n")
    assert files.read_keywords(spark, str(tmp_path / "k.csv")).first().keywords == ["space", "force"]
    files.write_sample(spark.createDataFrame([(str(i),) for i in range(1000)], "value string"), str(tmp_path / "out"), 0.5, 3)
    assert 350 < spark.read.text(str(tmp_path / "out")).count() < 650
