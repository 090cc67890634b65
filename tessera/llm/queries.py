"""The registered queries of the operators, with their production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, fingerprints, licences, main_text, ngram_join, pack, pii, quality, repeats, urls
from tessera.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.apply(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_ngram_join, op3_fingerprint, op4_urls, op5_pii, op6_main_text, op7_licences, op8_pack, op9_repeats, op10_quality)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table_: str, pattern: str, id_: str) -> str:
    return f"SELECT row_number() OVER () AS k, {id_}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}') AS w FROM {table_}"


_WORD, _SOLID = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS ({_words("documents", _WORD, "doc_id")}), b AS ({_words("benchmark", _WORD, "item_id")}),
p AS (SELECT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM b, range(1, greatest(len(w) - 8, 2)) r(i) WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM p),
o AS (SELECT k, i, l.n AS n, array_to_string(w[i:i + l.n - 1], ' ') AS g FROM d, l, range(1, len(w) - l.n + 2) r(i)),
h AS (SELECT DISTINCT o.k, o.i, o.n, p.item FROM o JOIN p ON o.n = p.n AND o.g = p.g),
c AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS place FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)"""

OP2 = f"""
WITH RECURSIVE d AS ({_words("documents", _SOLID, "doc_id")}),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS g FROM d, range(1, greatest(len(w) - 3, 2)) r(i) WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
i AS (SELECT a.k AS a, b.k AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k),
e AS (SELECT a, b FROM i JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT k AS a, k AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.k = d.k JOIN (SELECT a, min(doc_id) AS c FROM reach JOIN d ON d.k = reach.b GROUP BY a) m ON m.a = d.k"""

#: 5 and 10 follow learned models, 8 a search, 6 markup, 3 and 7 digests and an index that SQL lacks, 9 runs of units: those are
#: tested by brute force.
ORACLES: dict[str, str] = {"op1_decontaminate": OP1, "op2_ngram_join": OP2, "op4_urls": urls.oracle_sql()}
