import pytest
from oracle import same
from pyspark.sql import functions as F

from tessera.llm import queries, urls

CASES = [
    ("https://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://shop.net/any", "shop.net", "/any", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://xnet/", "xnet", "/", None, None),
    ("http://shop.net", "shop.net", "", None, None),
    ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    ("http://example.com/de", "example.com", "/de", None, None),
    ("http://x.org/fr/a?b", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://x.org?/fr/", "x.org", "", None, None),
    ("x.org/fr/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("https://casino-poker.example.com/win", "casino-poker.example.com", "/win", None, "block"),
    ("https://library.example.com/books", "library.example.com", "/books", None, "allow"),
    ("ftp://a://b/c", "a:", "//b/c", None, None),
    ("http://h.example.com/" + "a" * 50000, "h.example.com", "/" + "a" * 50000, None, None),
]


def test_cases(spark):
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = sorted(urls.judge(pages).collect(), key=lambda r: r.page_id)
    for r, (_, host, path, rule, verdict) in zip(got, CASES, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        method = "block" if urls.score_of(host + path) > 0 else "allow"
        assert r.verdict == (dict(urls.RULES)[rule] if rule else method)
        assert verdict is None or r.verdict == verdict
    assert urls.judge(pages.where("false")).count() == 0


def test_score_column_is_the_model(spark):
    texts = ["", "a", "casino-win.example.org/en/14", "ththan.example.com/es/9", "ünï.example/ß😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.score(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.s == pytest.approx(urls.score_of(r.t), abs=1e-9)


def test_labelled_rows_are_learned():
    assert all(urls.score_of(x) > 0 for x in urls.BLOCKED.split()) and all(urls.score_of(x) < 0 for x in urls.ALLOWED.split())


def test_whole_table_against_sql(spark, sf):
    same(queries.QUERIES["op4_urls"](spark, sf), queries.ORACLES["op4_urls"], sf)
