"""Registered relational queries. Those in SQL are one text for Spark and DuckDB; those in operators name their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.sources.files import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "q1_pricing_summary": """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price,
       round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= date '1998-12-01' - interval '90' day
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "scan_filter_sort": """
SELECT * FROM lineitem WHERE l_shipdate <= date '1995-06-30'
ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice""",
    "filter_conjunction": """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_discount >= 0.05 AND l_quantity < 24 AND (l_returnflag = 'R' OR l_linestatus = 'O')""",
    "project_expr": """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS disc_price, l_quantity + 1 AS qty_1, -l_tax AS neg_tax FROM lineitem""",
    "join_orders_lineitem": """
SELECT o_orderkey, o_orderdate, l_linenumber, l_quantity, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 200000""",
    "join_3way_nation": """
SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "join_residual": """
SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal""",
    "agg_group": """
SELECT l_shipdate, l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_discount), 8) AS mean
FROM lineitem GROUP BY l_shipdate, l_returnflag""",
    "agg_global": """
SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date FROM orders""",
    "agg_global_empty": "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < 0",
    "agg_grouped_empty": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY o_orderstatus",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sort_offset_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40",
    "sort_desc_multi": "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey DESC",
    "limit_zero": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0",
    "tpch_revenue": """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= date '1994-01-01' AND l_shipdate < date '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "set_operations": """
SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey AS k FROM supplier UNION SELECT n_regionkey AS k FROM nation""",
    "window_rank": """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""",
    "events_by_hour": """
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type""",
}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the tables of a folder; each becomes a view of the session."""
    for name in TABLES:
        if name in sql:
            read_table(spark, f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def _sql(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, sql)


def op_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, join, project, aggregate and sort by the operator functions."""
    orders, items = (read_table(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    joined = R.join(R.filter_rows(orders, F.col("o_orderstatus") == "F"), items, [("o_orderkey", "l_orderkey")])
    net = R.project(joined, "o_orderpriority", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    total = R.aggregate(net, ["o_orderpriority"], [F.round(F.sum("net"), 2).alias("total"), F.count("*").alias("n")])
    return R.sort(total, [("o_orderpriority", True)], offset=1, fetch=3)


def selection_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two marking filters in a row, then compaction."""
    items = read_table(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return R.compact(R.select_vector(R.select_vector(items, F.col("l_quantity") > 10), F.col("l_tax") < 0.04))


QUERIES = {name: partial(_sql, sql) for name, sql in SQL.items()} | {"op_chain": op_chain, "selection_vector": selection_vector}
ORACLES = SQL | {
    "op_chain": """
SELECT o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total, count(*) AS n
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 3 OFFSET 1""",
    "selection_vector": "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_quantity > 10 AND l_tax < 0.04",
}
