"""Canonical exact fingerprints in DataFrame operations only.

A text is normalised (NFKC), case-folded (full folding, and NFKC again), its white space folded to single spaces, and hashed
to 128 bits with two chained xxhash64. Normalisation and folding are those of the ICU library that Spark ships and uses for
its collations, called by the SQL function reflect, so they run inside the JVM. Fingerprints, of texts and of edited texts,
are grouped by the hash; inside a bucket that holds more than one text the canonical texts are compared byte by byte, and
edited ones by their SHA-256. Where a bucket holds different texts, their fingerprints get the SHA-256 as a suffix, so equal
fingerprints mean equal canonical texts.

An exact digest knows equal and different only: a likeness is 1 or 0.

Defined cases: a null text counts as empty; the one row of a table is its own next document; rows of equal doc_id, and those
of none, which come last, follow each other in the order of a hash; an empty table gives no rows; further columns are not
read."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Rows that a task of the ordering holds, about.
RANGE_ROWS = 1024
#: Ranges that are found by one approximate quantile; it answers in the driver.
MOST_RANGES = 20_000
#: Digests that may be broadcast (tens of MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    """The text in normalisation form KC."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def case_folded(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    folded = normalised(case_folded(normalised(F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\x{1680}\x{2028}\x{2029}]+", " "))


def canonical_of(text: str | None) -> str:
    """canonical() by Python's Unicode database, for tests."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub("[ \t\n\x0b\x0c\r\x85\u1680\u2028\u2029]+", " ", folded).strip(" ")


def digest(canon: Column) -> Column:
    """128 bits as hexadecimal digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon))])


def with_next(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, d) with next_text and next_d, of the next row by descending doc_id, after the last the first. The
    ids are cut at quantiles into ranges of a bounded number of rows, and an id that fills several, or none at all, is dealt
    over as many by a hash. Each range is ordered on its own; only its first row goes to the range before."""
    facts = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    ranges = min(MOST_RANGES, max(1, facts["ids"] // RANGE_ROWS))
    cuts = rows.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100_000).alias("c")).first()["c"] if ranges > 1 else []
    hot = {c: n for c in set(cuts or []) if (n := cuts.count(c)) > 1}  # ids that several quantiles fall on
    cuts = sorted(set(cuts or []))
    if cuts:  # binary search in a literal array: how many cuts are below the id
        bounds = F.lit(cuts)
        search = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(F.when(F.get(bounds, F.floor((s["low"] + s["high"]) / 2).cast("int")) < F.col("doc_id"), F.struct((F.floor((s["low"] + s["high"]) / 2) + 1).cast("int").alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), F.floor((s["low"] + s["high"]) / 2).cast("int").alias("high")))), lambda s: s["low"])
    else:
        search = F.when(F.col("doc_id").isNotNull(), F.lit(0))
    # equal rows of such an id may be many: they are dealt by their place in the input too
    spread, dealt = F.xxhash64("text"), F.xxhash64("text", F.monotonically_increasing_id())
    ways = F.when(F.col("doc_id").isNull(), F.lit(-(-(facts["n"] - facts["ids"]) // RANGE_ROWS) or 1))
    for c, n in hot.items():
        ways = ways.when(F.col("doc_id") == c, F.lit(n + 1))
    rows = rows.withColumn("spread", spread).withColumn("dealt", dealt).withColumn("range", F.coalesce(search, F.lit(-1)))
    # an id that is dealt over ranges has them for itself; no part of the key is null, so window and join share a shuffle
    rows = rows.withColumn("hot", ways.isNotNull()).withColumn("own", F.when(F.col("hot"), F.coalesce("doc_id", F.lit(0))).otherwise(F.lit(0).cast("long"))).withColumn("way", F.coalesce(F.pmod("dealt", ways), F.lit(0).cast("long")))
    key = ["range", "hot", "own", "way"]
    order = [F.col("doc_id").desc_nulls_last(), F.col("spread"), F.col("text")]
    mine = Window.partitionBy(*key).orderBy(*order)
    led = rows.withColumn("next_text", F.lead("text").over(mine)).withColumn("next_d", F.lead("d").over(mine)).withColumn("last", F.lead(F.lit(1)).over(mine).isNull())
    # the first rows of the ranges: as many as ranges, moved to the range above (the last takes the overall first)
    first = rows.groupBy(*key).agg(F.min_by(F.struct("text", "d"), F.struct(F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)), F.col("spread"), F.col("text"))).alias("head"), F.max("doc_id").alias("top"))
    down = Window.orderBy(F.col("top").desc_nulls_last(), "range", F.col("hot").desc(), "way")  # over the ranges
    follows = first.withColumn("after", F.lead("head").over(down)).withColumn("after", F.coalesce("after", F.first("head").over(down)))
    heads = follows.select(*key, "after")
    joined = led.join(heads, key, "left")
    pick = lambda own, there: F.when(F.col("last"), F.col(f"after.{there}")).otherwise(F.col(own))
    return joined.select("doc_id", "text", "d", pick("next_text", "text").alias("next_text"), pick("next_d", "d").alias("next_d"))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    shared = common.Shared(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    canon = texts.select("doc_id", "text", canonical(F.col("text")).alias("c"))
    rows = canon.select("doc_id", "text", F.struct(digest(F.col("c")).alias("d"), F.unhex(F.sha2("c", 256)).alias("s")).alias("d"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    led = with_next(rows).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "d", "next_d")
    led = led.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "d", "next_d", canonical(F.col("edited")).alias("e"))
    # without texts: what is left to do moves digests only
    fp = shared.write(led.select("doc_id", "n_chars", "edited_sha256", "d.d", "d.s", F.col("next_d.d").alias("nd"), F.col("next_d.s").alias("ns"), digest(F.col("e")).alias("ed"), F.unhex(F.sha2("e", 256)).alias("es")), keep=True)
    mixed = shared.write(collisions(fp, texts), keep=True)
    few = common_few(mixed)
    out = fp
    for d in ("d", "ed", "nd"):
        out = out.join(few.select(F.col("d").alias(d), F.lit(True).alias(f"{d}_mixed")), d, "left")
    full = lambda d, s: F.when(F.col(f"{d}_mixed"), F.concat(F.col(d), F.lit("-"), F.lower(F.hex(s)))).otherwise(F.col(d))
    out = out.select("doc_id", "n_chars", "edited_sha256", full("d", "s").alias("fingerprint"), full("ed", "es").alias("edited_fingerprint"), full("nd", "ns").alias("next"))
    near = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next").alias("near_next"))


def common_few(digests: DataFrame) -> DataFrame:
    """The table, to be broadcast if its counted rows are few enough."""
    return F.broadcast(digests) if digests.count() <= BROADCAST_ROWS else digests


def collisions(fp: DataFrame, texts: DataFrame) -> DataFrame:
    """Digests whose bucket holds different texts. A bucket's SHA-256 sums of texts and edited texts are held against each
    other; and the canonical texts themselves, byte by byte, of documents whose digest is there more than once: equal
    texts meet in a task before the shuffle, so a hot group of copies costs two texts for each task."""
    sums = fp.select("d", "s").unionByName(fp.select(F.col("ed").alias("d"), F.col("es").alias("s")))
    unlike = sums.groupBy("d").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select("d")
    again = fp.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    canon = texts.select(canonical(F.col("text")).alias("c")).select(digest(F.col("c")).alias("d"), "c")
    bytes_ = canon.join(common_few(again), "d", "left_semi").groupBy("d").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("d")
    return unlike.unionByName(bytes_).distinct()
