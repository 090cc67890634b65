import re

from pyspark.sql import functions as F

from tessera.llm import common, licences, queries


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def spots(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def brute(text, counts):
    """Templates aligned at every place."""
    w = words_of(text)
    base = {label: spots(w, p) for p, label in licences.BASE}
    places = [i for x in base.values() for i in x]
    own, share = set(), 0.0
    by = {}
    for word, t, place, need in licences.postings(counts):
        by.setdefault(t, []).append((licences.VOCABULARY[word], place, need))
    for t, (label, template, mandatory) in enumerate(licences.TEMPLATES):
        offset = len(f" {template} "[: f" {template} ".index(f" {mandatory} ")].split())
        for begin in range(-20, len(w)):
            n = sum(0 <= begin + place < len(w) and w[begin + place] == word for word, place, _ in by[t])
            if n >= by[t][0][2]:
                share = max(share, n / licences.ANCHORS)
                if begin + offset in spots(w, mandatory):
                    own.add(label)
    labels = {x for x, at in base.items() if at}
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), 1.0 if labels | own else min(share / 2, 0.5)


def counted(texts):
    counts = {}
    for t in texts:
        for w in set(words_of(t)) & set(licences.VOCABULARY):
            counts[licences.VOCABULARY.index(w)] = counts.get(licences.VOCABULARY.index(w), 0) + 1
    return counts


def check(rows, found):
    counts, want = counted([t for _, t in rows]), {}
    for doc_id, text in rows:
        want[doc_id] = (doc_id, *brute(text, counts))
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r) == want[r.doc_id]


def test_cases(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0."), (2, "cc by cc by, general PUBLIC license"), (3, None), (4, ""), (5, "the license the version the mit"),
        (6, "Released under the MIT License. All rights reserved."), (7, "x " * 30000 + "Licensed under the Apache License, Version 2.0"), (8, "license apache the under licensed 0 2"),
        (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (10, "all rights - reserved! ünïcode ALL RIGHTS RESERVED"),
        (11, "permission is hereby granted free to no person"), (12, "This work is licensed under the GNU General Public License, version 3."), (13, "cc cc by by"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit("clash")).withColumn("key", F.lit(1))
    found = licences.scan(docs).collect()
    check(rows, found)
    got = {r.doc_id: r.labels for r in found}
    assert (got[1], got[2], got[6], got[7], got[8], got[9]) == ("cc-by,cc-by-nc", "cc-by,gpl", "mit,reserved", "apache-2.0", "", "mit")
    assert licences.scan(docs.where("false")).count() == 0
    assert [r.labels for r in licences.scan(docs.where("doc_id = 6").union(docs.where("doc_id = 6"))).collect()] == ["mit,reserved"] * 2


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    check(rows, queries.QUERIES["op7_licences"](spark, sf).collect())
