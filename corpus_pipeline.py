"""A training corpus from raw documents: five stages, each of which works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. It is run
on what its predecessor wrote as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontaminate, ngram_join, pack, pii, quality
from tessera.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go.

    Null and empty texts are scored like any; repeated rows go or stay together; a row of null id is scored too, and is no
    labelled row; an empty table stays empty; further columns stay, whatever their names."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links stays: that of the smallest id.

    Documents without words (null and empty texts) all stay. Of equal rows one stays; rows of one id or of none, but of
    different texts, count as documents of their own. Columns stay as they are."""
    return ngram_join.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that occurrences of test phrases cover are cut out of the texts.

    No row goes: a null text stays null, and a text that is covered wholly becomes what stands between its words. Repeated
    rows are cut alike; columns stay, and n_chars is counted anew."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind.

    No row goes: null and empty texts stay as they are, repeated rows are masked alike; columns stay, and n_chars is
    counted anew."""
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of pieces with their places in sequences.

    A null or empty text is one piece of the closing token alone; repeated rows are packed one by one; no document, no
    piece; further columns are not read."""
    return pack.pack(docs, TOKENIZER)


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("benchmark", remove_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Learned models decide in some stages: not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's input and what the stage itself kept are deleted once its output is written."""
    docs, before = common.table(spark, sf_dir, "documents"), common.Shared(spark)
    for _, stage in STAGES[:-1]:
        mark, own = common.Shared.kept(), common.Shared(spark)
        docs = own.write(stage(spark, docs, sf_dir))
        common.Shared.release(mark)
        before.drop()
        before = own
    before.keep()
    return STAGES[-1][1](spark, docs, sf_dir)
