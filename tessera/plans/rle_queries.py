"""Registered run-length queries. Ids are o_orderkey (unique and dense), or the rank in the order of status and priority,
which makes long runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import rle
from tessera.plans.rle_plan import RunPlan
from tessera.sources.files import read_table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/orders.parquet")


def _runs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return rle.encode(_orders(spark, sf_dir), "o_orderkey", columns)


def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir, "o_orderstatus", "o_orderpriority")


def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.decode(_runs(spark, sf_dir, "o_orderstatus"))


def rle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.filter_runs(_runs(spark, sf_dir, "o_orderstatus"), F.col("o_orderstatus") == "F")


def rle_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.project_runs(_runs(spark, sf_dir, "o_orderpriority"), F.substring("o_orderpriority", 1, 1).alias("p"))


def rle_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rle.reconstruct(_runs(spark, sf_dir, "o_orderstatus"), _runs(spark, sf_dir, "o_orderpriority"))


def rle_reconstruct_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by rank in (status, priority, key): numbered within each group, after the counts of the (few) groups before."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    group = ["o_orderstatus", "o_orderpriority"]
    before = orders.groupBy(*group).agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*group).orderBy("o_orderkey"))
    ranked = orders.withColumn("own", own).join(F.broadcast(before), group).select((F.col("before") + F.col("own") - 1).alias("vid"), *group)
    return rle.reconstruct(rle.encode(ranked, "vid", ["o_orderstatus"]), rle.encode(ranked, "vid", ["o_orderpriority"]))


def rle_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = rle.project_runs(_runs(spark, sf_dir, "o_orderpriority", "o_orderstatus"), "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.ascii("o_orderstatus").cast("long")).alias("x"))
    return rle.aggregate_runs(runs, ["o_orderpriority"], [rle.weighted("count").alias("n"), rle.weighted("count", "x").alias("nx"), rle.weighted("sum", "x").alias("total"), F.round(rle.weighted("avg", "x"), 6).alias("mean"), rle.weighted("min", "x").alias("low"), rle.weighted("max", "x").alias("high")])


def rle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = rle.encode(_orders(spark, sf_dir), "o_orderkey", ["o_orderpriority"])
    sizes = read_table(spark, f"{sf_dir}/nation.parquet")
    right = rle.encode(sizes.select(F.col("n_nationkey").cast("long").alias("vid"), F.concat(F.col("n_regionkey") + 1, F.lit("-x")).alias("tag")), "vid", ["tag"])
    left = rle.project_runs(left, F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-x")).alias("p"))
    return rle.join_runs(left, right, [("p", "tag")])


def filter_reconstruct_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = RunPlan({"o_orderstatus": _runs(spark, sf_dir, "o_orderstatus"), "o_orderpriority": _runs(spark, sf_dir, "o_orderpriority")})
    return plan.filter(["o_orderstatus"], F.col("o_orderstatus") == "O").filter(["o_orderpriority"], F.col("o_orderpriority") < "3").rows()


def join_below_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of plans, a filter for each side and one for both, counted on the runs."""
    tags = read_table(spark, f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("vid"), F.concat(F.col("n_regionkey") + 1, F.lit("-x")).alias("tag"), "n_name")
    left = RunPlan({"p": rle.project_runs(_runs(spark, sf_dir, "o_orderpriority"), F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-x")).alias("p")), "o_orderstatus": _runs(spark, sf_dir, "o_orderstatus")})
    right = RunPlan({"tag": rle.encode(tags, "vid", ["tag"]), "n_name": rle.encode(tags, "vid", ["n_name"])})
    plan = left.join(right, [("p", "tag")]).filter(["o_orderstatus"], F.col("o_orderstatus") != "P").filter(["tag"], F.col("tag") < "5").filter(["o_orderstatus", "n_name"], F.substring("n_name", 1, 1) != F.col("o_orderstatus"))
    return plan.select("p", "o_orderstatus").aggregate(["p", "o_orderstatus"], [rle.weighted("count").alias("n")])


def long_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of many ids: overlaps of a run of 3,000,000,000 ids with the runs of the orders, of which none is decoded."""
    whole = spark.range(1).select(F.lit(0).cast("long").alias("start_vid"), F.lit(3_000_000_000).cast("long").alias("length"), F.lit("x").alias("tag"))
    return rle.reconstruct(whole, _runs(spark, sf_dir, "o_orderstatus"))


QUERIES = {f.__name__: f for f in (rle_encode, rle_decode, rle_filter, rle_project, rle_reconstruct, rle_reconstruct_long, rle_aggregate, rle_join, filter_reconstruct_pushdown, join_below_decode, long_run)}


def _sql_runs(name: str, table: str, vid: str, values: dict[str, str]) -> str:
    """CTEs that end in `name`: the runs of values over ids."""
    changed = " OR ".join([f"v <> lag(v) OVER w + 1", *[f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in values]])
    return f"""{name}_v AS (SELECT {vid} AS v, {", ".join(f"{e} AS {c}" for c, e in values.items())} FROM {table}),
{name}_c AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL OR {changed} THEN 1 ELSE 0 END AS new FROM {name}_v WINDOW w AS (ORDER BY v)),
{name}_g AS (SELECT *, sum(new) OVER (ORDER BY v) AS g FROM {name}_c),
{name} AS (SELECT CAST(min(v) AS BIGINT) AS start_vid, count(*) AS length, {", ".join(f"min({c}) AS {c}" for c in values)} FROM {name}_g GROUP BY g)"""


_S, _P = _sql_runs("s", "orders", "o_orderkey", {"o_orderstatus": "o_orderstatus"}), _sql_runs("p", "orders", "o_orderkey", {"o_orderpriority": "o_orderpriority"})
ORACLES = {
    "rle_encode": f"WITH {_sql_runs('r', 'orders', 'o_orderkey', {'o_orderstatus': 'o_orderstatus', 'o_orderpriority': 'o_orderpriority'})} SELECT * FROM r",
    "rle_decode": "SELECT CAST(o_orderkey AS BIGINT) AS vid, o_orderstatus FROM orders",
    "rle_filter": f"WITH {_S} SELECT * FROM s WHERE o_orderstatus = 'F'",
    "rle_project": f"WITH {_P} SELECT start_vid, length, substr(o_orderpriority, 1, 1) AS p FROM p",
    "rle_reconstruct": f"WITH {_S}, {_P} SELECT greatest(s.start_vid, p.start_vid) AS start_vid, least(s.start_vid + s.length, p.start_vid + p.length) - greatest(s.start_vid, p.start_vid) AS length, o_orderstatus, o_orderpriority FROM s JOIN p ON s.start_vid < p.start_vid + p.length AND p.start_vid < s.start_vid + s.length",
    "rle_reconstruct_long": """
SELECT CAST(min(v) AS BIGINT) AS start_vid, count(*) AS length, o_orderstatus, o_orderpriority
FROM (SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderpriority, o_orderkey) - 1 AS v, o_orderstatus, o_orderpriority FROM orders) GROUP BY o_orderstatus, o_orderpriority""",
    "rle_aggregate": """
WITH t AS (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN CAST(ascii(o_orderstatus) AS BIGINT) END AS x FROM orders)
SELECT CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS start_vid, CAST(1 AS BIGINT) AS length, o_orderpriority, count(*) AS n, count(x) AS nx, CAST(sum(x) AS BIGINT) AS total, round(avg(x), 6) AS mean, min(x) AS low, max(x) AS high
FROM t GROUP BY o_orderpriority""",
    "rle_join": f"""
WITH {_P}, {_sql_runs("n", "nation", "n_nationkey", {"tag": "CAST(n_regionkey + 1 AS VARCHAR) || '-x'"})},
j AS (SELECT p.start_vid AS a, n.start_vid AS b, p.length * n.length AS length, substr(o_orderpriority, 1, 1) || '-x' AS p, tag FROM p JOIN n ON substr(o_orderpriority, 1, 1) || '-x' = tag)
SELECT CAST(coalesce(sum(length) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_vid, length, p, tag FROM j""",
    "join_below_decode": """
WITH j AS (SELECT substr(o_orderpriority, 1, 1) || '-x' AS p, o_orderstatus FROM orders JOIN nation ON substr(o_orderpriority, 1, 1) = CAST(n_regionkey + 1 AS VARCHAR)
           WHERE o_orderstatus <> 'P' AND substr(o_orderpriority, 1, 1) < '5' AND substr(n_name, 1, 1) <> o_orderstatus)
SELECT CAST(row_number() OVER (ORDER BY p, o_orderstatus) - 1 AS BIGINT) AS start_vid, CAST(1 AS BIGINT) AS length, p, o_orderstatus, count(*) AS n FROM j GROUP BY p, o_orderstatus""",
    "long_run": f"WITH {_S} SELECT start_vid, length, 'x' AS tag, o_orderstatus FROM s",
    "filter_reconstruct_pushdown": "SELECT CAST(o_orderkey AS BIGINT) AS vid, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority < '3'",
}
