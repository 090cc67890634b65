"""Registered queries over the text formats, event windows and selection vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import relational
from tessera.sources import files
from tessera.streaming import windows

NATION = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.LongType())])


def tbl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as lines of fields between bars, read with a declared schema."""
    rows = files.read_table(spark, f"{sf_dir}/nation.parquet")
    lines = rows.select(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey", F.lit("")).alias("value"))
    return files.parse_tbl(lines, NATION)


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as lines of a title and keywords; empty fields at the end do not count."""
    rows = files.read_table(spark, f"{sf_dir}/events.parquet")
    lines = rows.select(F.concat_ws("|", "event_id", "event_type", F.col("user_id") % 7, F.lit(""), F.lit("")).alias("value"))
    return files.parse_keywords(lines).select("title", F.array_join("keywords", ",").alias("keywords"), F.size("keywords").cast("long").alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours by event type, by the function that streams use."""
    found = windows.windowed(files.read_table(spark, f"{sf_dir}/events.parquet"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours every hour."""
    found = windows.windowed(files.read_table(spark, f"{sf_dir}/events.parquet"), "2 hours", "1 hour")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def aggregate_all_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global aggregate where a selection vector has marked every row inactive: one row of empty values."""
    marked = relational.select_vector(files.read_table(spark, f"{sf_dir}/orders.parquet"), F.col("o_totalprice") < 0)
    return relational.aggregate(relational.compact(marked), [], [F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderstatus").alias("top")])


def aggregate_some_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of what two selection vectors leave active."""
    orders = files.read_table(spark, f"{sf_dir}/orders.parquet")
    marked = relational.select_vector(relational.select_vector(orders, F.col("o_totalprice") > 1000), F.col("o_orderstatus") != "P")
    return relational.aggregate(relational.compact(marked), ["o_orderpriority"], [F.count("*").alias("n")])


QUERIES = {f.__name__: f for f in (tbl_lines, keyword_lines, event_windows, event_sliding, aggregate_all_inactive, aggregate_some_inactive)}

ORACLES = {
    "tbl_lines": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "keyword_lines": "SELECT CAST(event_id AS VARCHAR) AS title, event_type || ',' || CAST(user_id % 7 AS VARCHAR) AS keywords, CAST(2 AS BIGINT) AS n FROM events",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(round(sum(value), 4), 2) AS total FROM events GROUP BY ALL",
    "event_sliding": "SELECT strftime(date_trunc('hour', ts) - to_hours(k), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) h(k) GROUP BY ALL",
    "aggregate_all_inactive": "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderstatus) AS top FROM orders WHERE o_totalprice < 0",
    "aggregate_some_inactive": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' GROUP BY o_orderpriority",
}
