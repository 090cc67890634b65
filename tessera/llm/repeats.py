"""Substring dedup by hashing the sentences of lines, and stretches of words whatever their punctuation.

A sentence ends at a line break, or at a word that ends in `.`, `!` or `?`. A stretch is CHUNKS neighbouring chunks of the
document's words; a chunk ends at a word whose hash is the least of the NEAR words on either side, so a passage is cut at
the same words wherever it stands, and only words before its first cut and after its last are beyond its stretches.

Case (A-Z) and white space are normalised, digests (96 bits) of these units are grouped over all documents, and the
occurrence of the lowest rank (document id, then place) is kept. The words of the others are removed where they make up a
whole line, however short, or a run of enough words; offsets are those of the original text, in code points.

Units travel in packed columns. A task sends only its earliest occurrence of a digest to the digest's bucket: the others
are settled already and go to buckets by their document, so a line that a third of all documents share costs its bucket one
entry a task.

Defined cases: a null or empty text has no units and stays as it is; rows of equal document id are ranked by a hash of
their text, and rows equal in both are one document, each with the same result; an empty table gives no rows; further
columns are kept only by apply()."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Words that a run of repeated units must have to be removed, unless it is a whole line.
MIN_WORDS = 10
#: Chunks of a stretch, and words on either side that the end of a chunk is the least of: 11 words a stretch
#: at least, where words do not repeat at once.
CHUNKS, NEAR = 4, 2
#: Bytes of text for each bucket, about; units that a task holds before it packs them.
BUCKET_BYTES, HELD = 64 << 20, 1_000_000

_LOWER = common.lower_ascii()
_STOPS = np.isin(np.arange(256), list(b".!?"))
_A, _B = np.uint64(0x9E6C63D0876A3F6B), np.uint64(0xD1342543DE82EF95)


class Units:
    """The units of a step of rows, sentences before stretches: row, place among the row's units, first and last word,
    digests. Of the words: row, line, sentence, first and last byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = common.word_spans(data, offsets, common.SOLID_BYTES)
        rows = len(offsets) - 1
        self.start, self.end = starts, ends
        n = len(starts)
        self.word_row = row = np.repeat(np.arange(rows), np.diff(first))
        if not n:
            self.count = self.first = self.later = np.zeros(rows, np.int64)
            self.line = self.sentence = self.row = self.nth = self.begin = self.last = np.zeros(0, np.int64)
            self.digest, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            return
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        self.line = breaks[starts]
        last = np.ones(n, bool)
        last[:-1] = (row[1:] != row[:-1]) | _STOPS[data[ends[:-1] - 1]] | (self.line[1:] > self.line[:-1])
        end = np.flatnonzero(last)
        begin = np.concatenate(([0], end[:-1] + 1))
        self.sentence = np.repeat(np.arange(len(end)), end - begin + 1)
        self.count = np.bincount(row[begin], minlength=rows)
        hashes = common.span_hashes(_LOWER[data], starts, ends)
        chunk_end = np.flatnonzero(_chunk_ends(hashes, row))
        chunk = np.concatenate(([0], chunk_end[:-1] + 1))
        long = np.flatnonzero(row[chunk[: len(chunk) - CHUNKS + 1]] == row[chunk_end[CHUNKS - 1 :]]) if len(chunk) >= CHUNKS else np.zeros(0, np.int64)
        many = np.bincount(row[chunk[long]], minlength=rows)
        self.first, self.later = np.cumsum(self.count) - self.count, len(begin) + np.cumsum(many) - many
        self.begin, self.last = np.concatenate((begin, chunk[long])), np.concatenate((end, chunk_end[long + CHUNKS - 1]))
        self.row = row[self.begin]
        self.nth = np.arange(len(self.row)) - self.first[self.row]
        self.nth[len(begin) :] += (self.first + self.count - self.later)[self.row[len(begin) :]]
        digests = [np.concatenate((self._sums(hashes, begin, end, x), self._chained(self._sums(hashes, chunk, chunk_end, x), long, x))) for x in (_A, _B)]
        self.digest, self.check = digests[0], (digests[1] >> np.uint64(32)).astype(np.uint32)

    def at(self, row: int, nths: np.ndarray) -> np.ndarray:
        """Indexes of the units of these places among a row's."""
        return np.where(nths < self.count[row], self.first[row] + nths, self.later[row] + nths - self.count[row])

    @staticmethod
    def _chained(chunks: np.ndarray, at: np.ndarray, base: np.uint64) -> np.ndarray:
        """Hashes of the stretches from these chunks on, unlike those of sentences of the same words."""
        total = np.full(len(at), base, np.uint64)
        for k in range(CHUNKS):
            total = common.mix((total ^ chunks[at + k]) + base)
        return total

    @staticmethod
    def _sums(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
        """Hashes of runs of words, by the words' places in the run."""
        place = (np.arange(len(hashes)) - np.repeat(begin, end - begin + 1)).astype(np.uint64)
        each = common.mix(hashes + (place + np.uint64(1)) * base)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
        return common.mix(total[end + 1] - total[begin])


def _chunk_ends(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which words end a chunk: the last of a row, those of the least hash among NEAR words before and after (of equal
    ones the last, so no two are within NEAR words), and where each word is that of one or two before, which has no such
    least word, every fourth."""
    n = len(hashes)
    least = np.zeros(n, bool)
    if n > 2 * NEAR:
        own = hashes[NEAR : n - NEAR]
        inner = row[: n - 2 * NEAR] == row[2 * NEAR :]
        for k in range(1, NEAR + 1):
            inner &= (own <= hashes[NEAR - k : n - NEAR - k]) & (own < hashes[NEAR + k : n - NEAR + k])
        least[NEAR : n - NEAR] = inner
    again = np.zeros(n, bool)
    for k in range(1, NEAR + 1):
        again[k:] |= (hashes[k:] == hashes[:-k]) & (row[k:] == row[:-k])
    head = again & np.concatenate(([True], ~again[:-1] | (row[1:] != row[:-1])))[:n]
    place = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))
    least = np.where(again, place % 4 == 3, least)
    least[:-1] |= row[1:] != row[:-1]
    least[-1:] = True
    return least


def _pack(settled: tuple[np.ndarray, np.ndarray], digest: np.ndarray, check: np.ndarray, doc: np.ndarray, key: np.ndarray, nth: np.ndarray) -> bytes:
    parts = [np.array([len(digest), len(settled[0])], np.int64), digest, doc, key, check, nth.astype(np.uint32), settled[0], settled[1].astype(np.uint32)]
    return zlib.compress(b"".join(x.tobytes() for x in parts), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    blob = zlib.decompress(blob)
    m, k = np.frombuffer(blob, np.int64, 2)
    at, out = 16, []
    for kind, size in ((np.uint64, m), (np.int64, m), (np.int64, m), (np.uint32, m), (np.uint32, m), (np.int64, k), (np.uint32, k)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * out[-1].itemsize
    return out


def scattered(buckets: int):
    """(doc_id, key, text) to packed units (bucket, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            digest, check, doc, key, nth = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((nth, key, doc, check, digest))
            digest, check, doc, key, nth = digest[order], check[order], doc[order], key[order], nth[order]
            again = np.concatenate(([False], (digest[1:] == digest[:-1]) & (check[1:] == check[:-1])))
            # equal rows (same id and text) are one document: their units are as early as the first's
            same = np.concatenate(([False], (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (nth[1:] == nth[:-1]))) & again
            late, early = again & ~same, ~again
            late_key, late_nth = key[late], nth[late]
            to = _home(late_key, buckets)
            bucket = ((digest[early] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            digest, check, doc, key, nth = digest[early], check[early], doc[early], key[early], nth[early]
            by, late_by = np.argsort(bucket, kind="stable"), np.argsort(to, kind="stable")
            there = np.unique(np.concatenate((bucket, to)))  # of a task's units, not of all buckets
            names, blobs = there.tolist(), []
            at = [np.searchsorted(x, there, side) for x in (bucket[by], to[late_by]) for side in ("left", "right")]
            for low, high, late_low, late_high in zip(*[x.tolist() for x in at], strict=True):
                g, h = by[low:high], late_by[late_low:late_high]
                g = g[np.lexsort((nth[g], doc[g]))]
                blobs.append(_pack((late_key[h], late_nth[h]), digest[g], check[g], doc[g], key[g], nth[g]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "data"])

        for batch in batches:
            docs = batch.column(0).fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = common.buffers(batch.column(2))
            for a, b in common.steps(offsets):
                u = Units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append((u.digest, u.check, docs[a:b][u.row], keys[a:b][u.row], u.nth))
                size += len(u.row)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _home(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return ((key.view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def judged(buckets: int):
    """Packed buckets to packed units (bucket, data) that are not the earliest of their digest, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(bucket, []).append(_unpack(data.as_py()))
        for bucket in list(held):
            digest, doc, key, check, nth, late_key, late_nth = (np.concatenate(x) for x in zip(*held.pop(bucket), strict=True))
            order = np.lexsort((nth, key, doc, check, digest))
            digest, check, doc, key, nth = digest[order], check[order], doc[order], key[order], nth[order]
            head = np.concatenate(([True], (digest[1:] != digest[:-1]) | (check[1:] != check[:-1])))[: len(digest)]
            at = np.maximum.accumulate(np.where(head, np.arange(len(digest)), 0))
            late = ~((doc == doc[at]) & (key == key[at]) & (nth == nth[at]))
            key, nth = np.concatenate((key[late], late_key)), np.concatenate((nth[late], late_nth)).astype(np.uint32)
            if not len(key):
                continue
            to = _home(key, buckets)
            order = np.lexsort((nth, key, to))
            key, nth, to = key[order], nth[order], to[order]
            cut = np.append(np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))), len(to)).tolist()
            blobs = [zlib.compress(key[a:b].tobytes() + nth[a:b].tobytes(), 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "data"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed units of documents to (key, nths), a row a document."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            blob = zlib.decompress(data.as_py())
            n = len(blob) // 12
            held.setdefault(bucket, []).append((np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.uint32, n, 8 * n)))
    for bucket in list(held):
        key, nth = (np.concatenate(x) for x in zip(*held.pop(bucket), strict=True))
        nth = nth.astype(np.int32)
        order = np.lexsort((nth, key))
        key, nth = key[order], nth[order]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.ListArray.from_arrays(pa.array(np.append(cut, len(key)).astype(np.int32)), pa.array(nth))], ["key", "nths"])


def _runs(marked: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of marked words within parts."""
    fresh = part[1:] != part[:-1]
    first = marked & np.concatenate(([True], fresh | ~marked[:-1]))[: len(marked)]
    last = marked & np.concatenate((fresh | ~marked[1:], [True]))[: len(marked)]
    return np.flatnonzero(first), np.flatnonzero(last)


def _gone(u: Units, late: np.ndarray, min_words: int) -> np.ndarray:
    """Which words go: of those of the late units, whole lines and runs of enough words."""
    n = len(u.start)
    if not len(late):
        return np.zeros(n, bool)
    edges = np.bincount(u.begin[late], minlength=n + 1) - np.bincount(u.last[late] + 1, minlength=n + 1)
    marked = np.cumsum(edges)[:n] > 0
    head = np.flatnonzero(np.concatenate(([True], (u.line[1:] != u.line[:-1]) | (u.word_row[1:] != u.word_row[:-1]))))
    goes = np.repeat(np.logical_and.reduceat(marked, head), np.diff(np.append(head, n)))
    for x, y in zip(*_runs(marked, u.word_row), strict=True):
        if y - x + 1 >= min_words:
            goes[x : y + 1] = True
    return goes


OUT = "text string, n_units long, n_removed long, removed string"


def _cut(names: list[str], min_words: int):
    """Batches whose first columns are text and nths, to the kept text and what was removed, and the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            for a, b in common.steps(offsets):
                own_rows = batch.slice(a, b - a)
                texts, nths = own_rows.column(0).to_pylist(), own_rows.column(1).to_pylist()
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                u = Units(part, own)
                point = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))  # code points before each byte
                late = [u.at(i, np.asarray(nths[i], np.int64)) for i in range(b - a) if nths[i]]
                goes = _gone(u, np.concatenate(late) if late else np.zeros(0, np.int64), min_words)
                x, y = _runs(goes, u.sentence)
                base = point[own[u.word_row[x]]]
                pieces: dict[int, list[str]] = {}
                for i, from_, to in zip(u.word_row[x].tolist(), (point[u.start[x]] - base).tolist(), (point[u.end[y]] - base).tolist(), strict=True):
                    pieces.setdefault(i, []).append(f"{from_}:{to}")
                n_units = u.count.tolist()
                n_removed = [len(pieces.get(i, ())) for i in range(b - a)]
                spans = [",".join(pieces.get(i, ())) for i in range(b - a)]
                x, y = _runs(goes, u.word_row)
                kept: dict[int, list[tuple[int, int]]] = {}
                for i, from_, last in zip(u.word_row[x].tolist(), u.start[x].tolist(), y.tolist(), strict=True):  # with the white space up to the next word
                    more = last + 1 < len(u.start) and u.word_row[last + 1] == i
                    kept.setdefault(i, []).append((from_, int(u.start[last + 1] if more else own[i + 1])))
                for i, cuts in kept.items():
                    raw, out, end = part[own[i] : own[i + 1]].tobytes(), [], 0
                    for from_, to in cuts:
                        out.append(raw[end : from_ - int(own[i])])
                        end = to - int(own[i])
                    texts[i] = b"".join([*out, raw[end:]]).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.string()), *own_rows.columns[2:]], ["text", "n_units", "n_removed", "removed", *names])

    return run


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, text without repeats, n_units, n_removed, removed), and the columns to keep under their names.
    n_units: sentences; removed: start:end of each removed sentence, or removed piece of one, in the original text;
    n_removed: their number."""
    spark = docs.sparkSession
    key = F.xxhash64(F.col(doc_id), F.col(text))
    source = docs.select(F.col(text).cast("string").alias("_text"), key.alias("_key"), F.col(doc_id).alias("_doc"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    size = source.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    packed = source.select(F.col("_doc").cast("long"), "_key", "_text").mapInArrow(common.tidy(scattered(buckets)), "bucket int, data binary")
    late = common.scatter(packed, buckets).mapInArrow(common.tidy(judged(buckets)), "bucket int, data binary")
    late = common.scatter(late, buckets).mapInArrow(common.tidy(_gathered), "key long, nths array<int>")  # of one document: at most its units
    joined = source.join(late, source["_key"] == late["key"], "left").select("_text", "nths", "_doc", *[f"_keep_{c}" for c in keep])
    rest = [docs.schema[doc_id], *[docs.schema[c] for c in keep]]
    schema = OUT + ", " + ", ".join(f"`{'doc_id' if i == 0 else f.name}` {f.dataType.simpleString()}" for i, f in enumerate(rest))
    out = joined.mapInArrow(common.tidy(_cut(["doc_id", *keep], min_words)), schema)
    return out.select("doc_id", "text", "n_units", "n_removed", "removed", *keep)


def brute_force(rows: list[tuple[int, str | None]], min_words: int = MIN_WORDS) -> list[tuple]:
    """apply() by a dictionary, for tests; rows of distinct ids."""
    import re

    seen: dict[tuple[str, ...], tuple[int, int]] = {}
    places: dict[int, list[tuple[int, int, str, int, int]]] = {}  # words: start, end, normalised, line, sentence
    units: dict[int, list[tuple[int, int, tuple[str, ...]]]] = {}  # first word, behind the last, key
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words: list[tuple[int, int, str, int, int]] = []
        sentence = 0
        for line in re.finditer(r"[^\n]+", text or ""):
            for m in re.finditer(r"[^\x20\x09-\x0D]+", line[0]):
                words.append((m.start() + line.start(), m.end() + line.start(), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0]), line.start(), sentence))
                sentence += m[0][-1] in ".!?"
            sentence += bool(words and words[-1][4] == sentence)
        own, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and words[j][4] == words[i][4]:
                j += 1
            own.append((i, j, ("sentence", *[w[2] for w in words[i:j]])))
            i = j
        raw = [w[2].encode() for w in words]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        order = common.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends).tolist() if raw else []
        cut, run = [0], 0
        for i in range(len(order) - 1):
            run = run + 1 if order[i] in order[max(i - NEAR, 0) : i] else 0
            if run and run % 4 == 0 or not run and NEAR <= i < len(order) - NEAR and order[i] <= min(order[i - NEAR : i]) and order[i] < min(order[i + 1 : i + 1 + NEAR]):
                cut.append(i + 1)
        cut += [len(order)] if order else []
        chunks = [" ".join(w[2] for w in words[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        own += [(cut[i], cut[i + CHUNKS], ("stretch", *chunks[i : i + CHUNKS])) for i in range(len(chunks) - CHUNKS + 1)]
        for i, u in enumerate(own):
            seen.setdefault(u[2], (doc_id, i))
        places[doc_id], units[doc_id] = words, own
    out = []
    for doc_id, text in rows:
        words = places[doc_id]
        late = [False] * len(words)
        for i, (a, b, key) in enumerate(units[doc_id]):
            if seen[key] != (doc_id, i):
                late[a:b] = [True] * (b - a)
        stays = {w[3] for w, x in zip(words, late, strict=True) if not x}  # lines that do not repeat as a whole
        gone, i = [w[3] not in stays for w in words], 0
        while i < len(words):
            j = i
            while j < len(words) and late[j]:
                j += 1
            if j - i >= min_words:
                gone[i:j] = [True] * (j - i)
            i = max(j, i + 1)
        spans, cuts, i = [], [], 0
        while i < len(words):
            j = i
            while j < len(words) and gone[j]:
                j += 1
            if j > i:
                for sentence in sorted({w[4] for w in words[i:j]}):
                    piece = [w for w in words[i:j] if w[4] == sentence]
                    spans.append((piece[0][0], piece[-1][1]))
                cuts.append((words[i][0], words[j][0] if j < len(words) else len(text)))
            i = max(j, i + 1)
        kept = text
        for a, b in reversed(cuts):
            kept = kept[:a] + kept[b:]
        out.append((doc_id, kept, len({w[4] for w in words}), len(spans), ",".join(f"{a}:{b}" for a, b in spans)))
    return out
