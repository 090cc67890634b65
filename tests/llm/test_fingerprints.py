import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm import fingerprints as P
from tessera.llm import queries

SAME = [("Hello   World", " hello\tworld\n"), ("é", "e\u0301"), ("Ａｂｃ", "abc"), ("ﬁne", "FINE"), ("Straße", "STRASSE"), ("ΣΟΦΟΣ", "σοφος"), ("ậ", "a\u0323\u0302"), ("a\u00a0b", "A b"), ("x²", "X2"), ("", "  "), ("a\u2003b", "a b")]


def test_canonical_forms(spark):
    df = spark.createDataFrame(SAME, "a string, b string")
    for r in df.select("a", P.canonical(F.col("a")).alias("x"), P.canonical(F.col("b")).alias("y")).collect():
        assert r.x == r.y, r
        assert r.x == P.canonical_of(r.a)
    words = ["Crème brûlée", "ＦＵＬＬ ｗｉｄｔｈ", "Å Å", "한국어 テキスト", "½ cup", "😀 ok", "q\u0307\u0323"]
    got = spark.createDataFrame([(w,) for w in words], "a string").select("a", P.canonical(F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == [P.canonical_of(r.a) for r in got]
    assert P.canonical_of("Crème") == unicodedata.normalize("NFKC", "crème")


def expected(rows):
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), float(P.canonical_of(text) == P.canonical_of(edited)), float(P.canonical_of(text) == P.canonical_of(after)), P.canonical_of(text), P.canonical_of(edited))
    return out


def check(found, rows):
    want, prints = expected(rows), {}
    assert len(found) == len(rows)
    for r in found:
        n, sha, near, near_next, canon, edited = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near, near_next), r
        for text, print_ in ((canon, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(text, print_) == print_
    assert len(set(prints.values())) == len(prints)


@pytest.mark.parametrize("per", [2, 1024])
def test_small_table_in_ranges(spark, monkeypatch, per):
    monkeypatch.setattr(P, "RANGE_ROWS", per)
    rows = [(-5, "minus 😀 five"), (0, None), (1, ""), (7, "aaaa"), (8, "aaaa"), (100, "é" * 31), (1000, "long " * 20000), (10**15, "Z z"), (10**15 + 1, "z  Z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash")).withColumn("c", F.lit(1))
    check(P.fingerprint(docs).collect(), rows)


def test_one_row_no_row_and_equal_ids(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert P.fingerprint(docs).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert P.fingerprint(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_chars for r in P.fingerprint(twice).collect()) == [0, 1, 1]


def test_a_shared_digest_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "digest", lambda c: F.substring(c, 1, 1))
    docs = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "AB"), (4, "x")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in P.fingerprint(docs).collect()}
    assert got[1] == got[3] != got[2] and got[4] == "x"


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    check(queries.QUERIES["op3_fingerprint"](spark, sf).collect(), rows)


def test_normal_form_against_the_unicode_database(spark):
    import random
    import sys

    rng = random.Random(6)
    codes = [c for c in range(0x80, sys.maxunicode) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = ["".join(map(chr, codes[i : i + 50])) for i in range(0, len(codes), 50)]
    odd = [c for c in codes if unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c)) or 0x1100 <= c < 0x1200]
    texts += ["".join(chr(rng.choice(odd)) if rng.random() < 0.7 else rng.choice("aeoAEO한ᄒ") for _ in range(12)) for _ in range(3000)]
    texts += ["ậ", "ậ", "한", "한", "\U0002f800", "丽"]
    got = spark.createDataFrame([(t,) for t in texts], "a string").select("a", P.normalised(F.col("a")).alias("x"), P.canonical(F.col("a")).alias("y")).collect()
    assert all(r.x == unicodedata.normalize("NFKC", r.a) and r.y == P.canonical_of(r.a) for r in got)
    assert got[-6].x == got[-5].x and got[-4].x == got[-3].x and got[-2].x == got[-1].x


def test_null_and_hot_ids_are_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 8)
    rows = [(i, f"t{i}") for i in range(60)] + [(30, f"hot {i % 9}") for i in range(90)] + [(None, "none" if i % 2 else f"none {i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.col("text"))
    led = P.with_next(frame).collect()
    assert sorted(r.next_text for r in led) == sorted(r.text for r in led) == sorted(t for _, t in rows)
    assert all(r.next_d == r.next_text for r in led)
    after = {r.doc_id: r.next_text for r in led if r.doc_id is not None and r.doc_id not in (30, 31)}
    assert all(after[i] == f"t{i - 1}" for i in after if i > 0) and after[0].startswith("none")
    assert [r.next_text for r in led if r.doc_id is None and r.next_text == "t59"] == ["t59"]
    plan = P.with_next(frame)
    assert plan.count() == len(rows)


def test_digests_of_edited_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "digest", lambda c: F.substring(c, 1, 1))
    docs = spark.createDataFrame([(9, "abcdef"), (8, "xyz"), (7, "q")], "doc_id long, text string")
    got = {r.doc_id: r for r in P.fingerprint(docs).collect()}
    assert got[9].fingerprint != got[9].edited_fingerprint and got[9].near_edited == 0.0  # abcdef and abcdxy
    assert got[7].fingerprint == got[7].edited_fingerprint == "q" and got[7].near_edited == 1.0
