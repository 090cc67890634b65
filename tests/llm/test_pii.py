import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii


def plain(text):
    """The base as it is stated, by the library's search."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_against_plain_search():
    rng = random.Random(2)
    parts = ["a", "é", "@", ".", "-", "+", " ", "1", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+1 (663) 555-6869", "x.y@z.com", "10.0.0.1", "(", ")", "_", "%", "\n", "0000", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), repr(text)


def test_long_runs_take_linear_time():
    for c in ("a", "1", "1.", "1 ", "+1", "@", "a@", "1-"):
        pii.base_spans(c * 200_000)


def test_network_adds_what_patterns_miss_and_leaves_others():
    p = pii.weights()
    texts = ["the call (663) 555-6869 now and then", "der 663-555-6869, im Jahr 1999 und 2001", "made 2024-01-15, v1.2.3, 12,000 items at $4.99", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "ip 10.0.0.300 here", "", "no digits at all"]
    spans = [x for _, x in pii.find(p, texts)]
    assert [[(k, texts[i][a:b]) for a, k, b in x] for i, x in enumerate(spans)] == [[(3, "(663) 555-6869")], [(3, "663-555-6869")], [], [], [], [], []]


def test_held_out_stretches():
    make, p, hit, total = pii.Generator(404), pii.weights(), 0, 0
    made = [make.stretch(150) for _ in range(120)]
    for (_, tags), got in zip(made, pii.decode(p, [t for t, _ in made]), strict=True):
        hit += int((tags == got).sum())
        total += len(tags)
    assert hit / total > 0.95


def test_overlapping_windows_agree():
    """A span decodes alike wherever the window borders fall."""
    p = pii.weights()
    for pad in range(0, 90, 7):
        text = "the word " * 20 + "x" * pad + " 1 2 3 " * 8 + "call (663) 555-6869 now " + "and 12 " * 10
        assert [text[a:b] for a, k, b in pii.find(p, [text])[0][1] if k == 3] == ["(663) 555-6869"]


def test_rows(spark):
    import hashlib

    rows = [(1, "x.y@z.com +1 (663) 555-6869 10.0.0.1 4111111111111111"), (2, None), (3, ""), (4, "word " * 50000 + "a@b.co"), (5, "é😀 a@b.co"), (5, "é😀 a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("n_ip", F.lit(5))
    got = sorted(pii.report(docs).collect(), key=lambda r: r.doc_id)
    assert len(got) == 6
    for r, (_, text) in zip(got, rows, strict=True):
        base = plain(text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))
    assert pii.report(docs.where("false")).count() == 0


def test_mask(spark):
    docs = spark.createDataFrame([(1, "a@b.co, +1 (663) 555-6869!", 7), (2, None, 0), (3, "clean 1999", 10)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(docs).collect()}
    assert got == {1: ("<EMAIL>, <PHONE>!", 17), 2: (None, 0), 3: ("clean 1999", 10)}


def slow_path(score, move):
    """The best path from outside to outside, character by character."""
    import numpy as np

    best, back = move[0] + score[0], []
    for row in score[1:]:
        each = best[:, None] + move
        back.append(each.argmax(0))
        best = each.max(0) + row
    tags = [int((best + move[:, 0]).argmax())]
    for came in reversed(back):
        tags.append(int(came[tags[-1]]))
    return np.array(tags[::-1])


def slow_tags(p, text):
    """Tags of a text by the network as it is trained, window by window, and the plain search."""
    import numpy as np

    code = pii.text_codes(text).astype(np.int64)
    total, seen = np.zeros((len(code), pii.TAGS)), np.zeros((len(code), 1))
    last = max(0, len(code) - pii.WINDOW)
    starts = [k for k in range(0, last, pii.STRIDE)] + [last] * (len(code) > 0)
    whole = [k for k in starts if k + pii.WINDOW <= len(code)]
    for group in ([whole] if whole else []) + [[k] for k in starts if k not in set(whole)]:
        score, _ = pii.emissions(p, np.stack([code[k : k + pii.WINDOW] for k in group], 1))
        for j, k in enumerate(group):
            total[k : k + pii.WINDOW] += score[:, j]
            seen[k : k + pii.WINDOW] += 1
    return slow_path(total / seen, p["t"].astype(np.float64)) if len(code) else np.zeros(0, np.int64)


def slow_spans(p, text):
    """All spans of the kinds, and secrets."""
    import numpy as np

    base, tags = plain(text), slow_tags(p, text)
    out: list[list] = [list(base), []]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0])))).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        kind = int(tags[a]) - 1
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip(" \t\r\n,;\"'"))
        b = a + len(piece.strip(" \t\r\n,;\"'"))
        if kind >= 0 and pii.holds(kind, text[a:b]) and all(b <= s or a >= e for s, _, e in base):
            out[kind >= len(pii.KINDS)].append((a, kind, b))
    return sorted(set(out[0])), out[1]


def test_best_paths_against_plain_search(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    move = rng.normal(size=(pii.TAGS, pii.TAGS)).astype(np.float32)
    for chunk in (3, 512):
        monkeypatch.setattr(pii, "CHUNK", chunk)
        length = rng.integers(1, 40, 60)
        score = rng.normal(size=(int(length.sum()), pii.TAGS)).astype(np.float32)
        first = np.cumsum(length) - length
        got = pii.best_paths(score, move, first, length)
        for a, n in zip(first.tolist(), length.tolist(), strict=True):
            assert (got[a : a + n] == slow_path(score[a : a + n].astype(np.float64), move.astype(np.float64))).all()


def test_whole_table_by_the_slow_reader(spark, sf):
    from tessera.llm import common, queries

    p = pii.weights()
    want, added = {}, 0
    for r in common.table(spark, sf, "documents").collect():
        every, secrets = slow_spans(p, r.text or "")
        want[r.doc_id] = (pii.joined(every), pii.joined(secrets))
        added += len(every) - len(plain(r.text or "")) + len(secrets)
    got = {r.doc_id: (r.spans, r.secrets) for r in queries.QUERIES["op5_pii"](spark, sf).collect()}
    assert got == want and added > 0


def test_what_the_network_adds():
    """Cards that fail the check digit, and secrets; without them nothing in prose and junk."""
    p = pii.weights()
    reader = pii.Reader(p)
    import pyarrow as pa

    texts = ['of in token = "1eb9c654e721b4f812088970e66a6345cee33dd6" and', "theon the 9807915762804490 anre", "ERE!! 5927243074273351!! OF!!", "x @ y, 1999; the-end (4) 12:30 100% 3.14 v1.2.3 2024-01-15 #a1b2c3 " * 40, "日本語のテキスト 한국어 кириллица " * 50]
    got = pii.examine(reader, pa.array(texts))
    assert [[(pii.LABELS[k], t[a:b]) for a, k, b in every + secrets] for t, (_, every, secrets) in zip(texts, got, strict=True)] == [[("secret", "1eb9c654e721b4f812088970e66a6345cee33dd6")], [("card", "9807915762804490")], [("card", "5927243074273351")], [], []]


def test_spans_do_not_depend_on_neighbours_and_long_runs_are_bounded():
    import resource

    p = pii.weights()
    text = "call (663) 555-6869 " + "the words in between " * 30 + "9807915762804490 here"
    alone = pii.find(p, [text])[0][1]
    assert len(alone) == 2
    assert pii.find(p, ["x", text, "7" * 300, text, ""])[1][1] == alone
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    long = "1234567890" * 30_000 + " " + text
    spans = pii.find(p, [long] + ["call 12 now"] * 255)[0][1]
    assert [(a - 300_001, k, b - 300_001) for a, k, b in spans if a >= 300_000][-1] == alone[-1]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 * 1024


def test_mask_of_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "")], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    assert sorted((r.text, r.spans) for r in pii.mask(docs).collect()) == [("", "clash"), ("<EMAIL>", "clash"), ("<EMAIL>", "clash")]
    assert pii.mask(docs.where("false")).count() == 0


def test_few_windows_do_not_step_alone(monkeypatch):
    """The windows of a step of text go through the network in one run for each direction, a few beyond a block included."""
    runs, run = [], pii.Reader._run
    monkeypatch.setattr(pii.Reader, "_run", lambda self, steps, side: runs.append(steps.shape[1]) or run(self, steps, side))
    text = "some words and call (663) 555-6869 now " * (pii.STRIDE * (pii.BLOCK + 60) // 39)
    tags = pii.decode(pii.weights(), [text])[0]
    assert len(tags) == len(text)
    assert len(runs) == 2 and min(runs) > pii.BLOCK
    assert [list(pii._shares(n, 4)) for n in (0, 1, 4, 6, 7, 14)] == [[], [(0, 1)], [(0, 4)], [(0, 6)], [(0, 4), (4, 7)], [(0, 4), (4, 8), (8, 14)]]
