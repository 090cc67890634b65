"""Readers and writers of the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D = T.DecimalType(15, 2)
LINEITEM = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    + [T.StructField(n, _D) for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [T.StructField(n, T.StringType()) for n in ("l_returnflag", "l_linestatus")]
    + [T.StructField(n, T.DateType()) for n in ("l_shipdate", "l_commitdate", "l_receiptdate")]
    + [T.StructField(n, T.StringType()) for n in ("l_shipinstruct", "l_shipmode", "l_comment")]
)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Fields between bars, with a declared schema; a bar may end the line."""
    wide = T.StructType([*schema.fields, T.StructField("_end", T.StringType())])
    return spark.read.schema(wide).option("sep", "|").csv(path).drop("_end")


def parse_tbl(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of lines (`value`) of fields between bars; a bar may end the line."""
    wide = T.StructType([*schema.fields, T.StructField("_end", T.StringType())])
    return lines.select(F.from_csv("value", F.lit(wide.toDDL() if hasattr(wide, "toDDL") else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide)), {"sep": "|"}).alias("r")).select("r.*").drop("_end")


def parse_keywords(lines: DataFrame) -> DataFrame:
    """(title, keywords) of lines `title|keyword|...`; empty fields at the end do not count."""
    fields = F.split(F.regexp_replace("value", r"\|+$", ""), r"[|]")
    return lines.select(F.get(fields, 0).alias("title"), F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))).alias("keywords"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    return parse_keywords(spark.read.text(path))


def inline_keywords(spark: SparkSession, lines: list[str]) -> DataFrame:
    return parse_keywords(spark.createDataFrame([(x,) for x in lines], "value string"))


def write_sample(df: DataFrame, path: str, fraction: float, seed: int | None = None) -> None:
    """A sample without replacement, as text in one file."""
    df.sample(False, fraction, seed).coalesce(1).write.text(path)
