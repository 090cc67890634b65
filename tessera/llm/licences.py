"""Licence scans by a positional index of rare words.

Every document's words that occur in the licence texts below are kept with their positions. How many documents hold each
of them is counted over the whole table; the rarest words of each template are its anchors. Anchor hits are joined with
the postings (word, template, place in the template); hits that agree on where the template would begin, and are enough,
make a candidate, which stands if the template's mandatory phrase is at its place.

Defined cases: a null or empty text has no words and no labels; repeated documents are each scanned; a template found
several times gives its label once; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Phrases and labels of the base.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, template, mandatory phrase); words as the scan sees them.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "use this file except in compliance with the license"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("epl-2.0", "made available under the terms of the eclipse public license", "eclipse public license"),
)

#: Anchors of a template, and how many of them must agree on its place (all, if a template has fewer words).
ANCHORS, AGREE = 4, 2
VOCABULARY = sorted({w for phrase in [p for p, _ in BASE] + [t for _, t, _ in TEMPLATES] for w in phrase.split()})
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hits(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_key, doc_id, n_words, hits): the licence words of each document as (word, at), by position."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.regexp_extract_all(low, F.lit(f"({WORDS})"), F.lit(1)).alias("words"))
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(VOCABULARY))
    found = words.select("doc_id", F.size("words").cast("long").alias("n_words"), placed.alias("placed"))
    number = F.transform("placed", lambda x: F.struct((F.array_position(F.lit(VOCABULARY), x["word"]) - 1).cast("int").alias("word"), x["at"].alias("at")))
    return found.select("doc_id", "n_words", number.alias("hits"))


def places(phrase: str, found: Column) -> Column:
    """Where a phrase of licence words stands: its words are neighbours among the hits too."""
    codes = [VOCABULARY.index(w) for w in phrase.split()]

    def at(x: Column, i: Column) -> Column:
        ok = x["word"] == codes[0]
        for k, code in enumerate(codes[1:], 1):
            follower = F.get(found, i + k)
            ok = ok & (follower["word"] == code) & (follower["at"] == x["at"] + k)
        return F.when(ok, x["at"])

    return F.filter(F.transform(found, at), lambda p: p.isNotNull())


def postings(counts: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(word, template, place, anchors needed) of the rarest words of each template; ties by place."""
    out = []
    for t, (_, template, _) in enumerate(TEMPLATES):
        words = [VOCABULARY.index(w) for w in template.split()]
        unique = [(counts.get(w, 0), k, w) for k, w in enumerate(words) if words.count(w) == 1]
        chosen = sorted(unique)[:ANCHORS]
        out += [(w, t, k, min(AGREE, len(chosen))) for _, k, w in chosen]
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    spark = docs.sparkSession
    shared = common.Shared(spark)
    # equal rows share a key: they have equal labels
    found = shared.write(hits(docs, doc_id, text).withColumn("key", F.xxhash64("doc_id", "hits")), keep=True)
    # one count for each licence word: bounded by the vocabulary
    counts = {r["word"]: r["n"] for r in found.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    index = spark.createDataFrame(postings(counts), "word int, template int, place int, need int")
    anchors = sorted({p[0] for p in postings(counts)})
    rare = found.where(F.exists("hits", lambda h: h["word"].isin(anchors)))
    hit = rare.select("key", F.explode(F.filter("hits", lambda h: h["word"].isin(anchors))).alias("h"))
    aligned = hit.join(F.broadcast(index), F.col("h.word") == index["word"]).select("key", "template", (F.col("h.at") - F.col("place")).alias("begin"), index["word"].alias("anchor"), "need")
    agreed = aligned.groupBy("key", "template", "begin").agg(F.countDistinct("anchor").alias("n"), F.max("need").alias("need")).where(F.col("n") >= F.col("need"))
    before = F.lit([len(f" {t} "[: f" {t} ".index(f" {m} ")].split()) for _, t, m in TEMPLATES])  # words before the mandatory phrase
    candidates = agreed.groupBy("key").agg(F.collect_set(F.struct("template", (F.col("begin") + F.get(before, F.col("template"))).alias("phrase_at"), (F.col("n") / ANCHORS).alias("share"))).alias("candidates"))
    joined = found.join(candidates, "key", "left")

    def stands(template: int, phrase: str) -> Column:
        return F.exists("candidates", lambda c: (c["template"] == template) & F.array_contains(places(phrase, F.col("hits")), c["phrase_at"]))

    own = F.array_compact(F.array(*[F.when(stands(i, phrase), label) for i, (label, _, phrase) in enumerate(TEMPLATES)]))
    own = F.when(F.col("candidates").isNull(), F.array().cast("array<string>")).otherwise(own)
    base = joined.select("doc_id", "n_words", own.alias("own"), *[places(p, F.col("hits")).alias(f"at_{i}") for i, (p, _) in enumerate(BASE)], F.coalesce(F.array_max(F.transform("candidates", lambda c: c["share"])), F.lit(0.0)).alias("share"))
    everywhere = F.concat(*[F.col(f"at_{i}") for i in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, label) for i, (_, label) in enumerate(BASE)]))
    out = base.select("doc_id", "n_words", "own", "share", everywhere.alias("at"), labels.alias("labels"))
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("labels")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("labels", "own"))), ",").alias("labels"),
        F.when((F.size("labels") > 0) | (F.size("own") > 0), F.lit(1.0)).otherwise(F.least(F.col("share") / 2, F.lit(0.5))).alias("score"),
    )

