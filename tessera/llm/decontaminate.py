"""Benchmark decontamination with an FM-index per shard of the training text.

The words of a shard are numbered by the vocabulary of the test phrases. A run of such words that is shorter than the
shortest phrase cannot hold an occurrence, so it leaves the sequence; what stays is one sequence of runs, each closed by a
separator of its own. The index is the Burrows-Wheeler transform of that sequence in a wavelet matrix, with the suffix
positions sampled. All phrases are searched backward together, their rows are located by walking to the next sampled
row, and overlapping occurrences are merged to removal spans. Words are known by 64-bit hashes.

Test items are searched in blocks, each a pass over the documents that finds spans in the original texts. Spans of several
blocks meet by a 128-bit hash of id and text, are merged, and cut once; rows that no block hits take no part. So the blocks
do not show in the results.

Defined cases: a null or empty text has no words and is never contaminated; a null or empty item has no phrase; an item
of fewer words than a window is one phrase; equal items each count; repeated documents are each judged; further columns
are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Words in a window.
WINDOW = 10
#: Words that one shard's index covers at most (or one document).
SHARD_WORDS = 2_000_000
#: Every so many positions of a run have their suffix position kept.
SAMPLE = 8
#: Bytes of test items that are searched at a time; more take further passes over the documents. Their phrases are arrays of
#: about 60 bytes a word, so a block is some 50 MB in a broadcast (and 120 MB if all words have one letter).
BLOCK_BYTES = 4 << 20

LOWER = common.lower_ascii()
SCHEMA = "row_key long, row_check long, doc_id long, n_words long, spans array<struct<start:int,end:int>>, bytes array<struct<start:int,end:int>>, items array<string>"


class Phrases:
    """Distinct windows of test items, as numbers of their words; 0 is no word of theirs. All in arrays."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        data, offsets = common.buffers(pa.array([t for _, t in items], pa.string()))
        data = LOWER[data]
        starts, ends, first = common.word_spans(data, offsets, common.WORD_BYTES)
        words = common.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.hashes, number = np.unique(words, return_inverse=True)
        number = (number + 1).astype(np.int32)
        size = np.diff(first)
        own = np.minimum(size, window)  # words of an item's windows
        count = np.where(size > 0, size - own + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        begin = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        longest = int(own.max(initial=0))
        codes = np.zeros((len(item), longest), np.int32)
        for k in range(longest):
            live = own[item] > k
            codes[live, k] = number[begin[live] + k]
        order = np.lexsort(codes.T) if longest else np.zeros(0, np.int64)  # equal phrases side by side
        fresh = np.ones(len(order), bool)
        fresh[1:] = (codes[order[1:]] != codes[order[:-1]]).any(1)
        phrase = np.cumsum(fresh) - 1
        self.codes = codes[order[fresh]]
        self.lengths = (self.codes > 0).sum(1)
        self.shortest = int(self.lengths.min(initial=longest))
        pairs = np.unique(phrase * len(items) + item[order]) if len(items) else np.zeros(0, np.int64)
        self.item_at = np.searchsorted(pairs, np.arange(len(self.codes) + 1) * max(len(items), 1))
        self.item_of = (pairs % max(len(items), 1)).astype(np.int32)
        self.names = [str(i) for i, _ in items]

    def items(self, phrases: np.ndarray) -> list[str]:
        """The ids of the items that hold any of the phrases, sorted."""
        return sorted({self.names[i] for p in phrases.tolist() for i in self.item_of[self.item_at[p] : self.item_at[p + 1]].tolist()})

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int32)


class WaveletMatrix:
    """rank(symbol, i): occurrences of a symbol before position i, by one rank in a bit vector per bit of the symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=count[1:], dtype=np.int32)
            self.ones.append(count)
            self.zeros.append(int(self.n - count[-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        start = np.zeros((1 << bits) + 1, np.int64)  # where each symbol's run begins on the last level
        values, first = np.unique(now, return_index=True)
        start[values] = first
        self.first = start

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1
            count = self.ones[level][i]
            i = np.where(one == 1, self.zeros[level] + count, i - count)
        return i - self.first[symbol]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            count = self.ones[level][i]
            one = self.ones[level][i + 1] - count
            symbol = (symbol << 1) | one
            i = np.where(one == 1, self.zeros[level] + count, i - count)
        return symbol, i - self.first[symbol]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; 0 is a separator, each one different from and before all words. Only suffixes
    whose rank is not final yet are sorted again."""
    n = len(symbols)
    key = symbols.astype(np.int64)
    stops = np.flatnonzero(key == 0)
    key = key + len(stops)
    key[stops] = np.arange(len(stops))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    rank = np.empty(n, np.int64)
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    width = 1
    final = np.concatenate((first[1:], [True])) & first
    todo = np.flatnonzero(~final)  # places in `order` whose group has more than one suffix
    while len(todo):
        suffix = order[todo]
        after = np.where(suffix + width < n, rank[np.minimum(suffix + width, n - 1)], -1)
        group = rank[suffix]
        sort = np.lexsort((after, group))
        suffix, after, group = suffix[sort], after[sort], group[sort]
        order[todo] = suffix
        first = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        rank[suffix] = np.maximum.accumulate(np.where(first, todo, 0))
        final = np.concatenate((first[1:], [True])) & first
        todo = todo[~final]
        width *= 2
    return order


class FMIndex:
    """Search by words over a sequence whose runs each end with 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        self.n = len(symbols)
        order = suffix_order(symbols)
        before = symbols[order - 1].astype(np.int64)  # of suffix 0: the last, a separator
        size = int(symbols.max()) + 1 if self.n else 1
        self.tree = WaveletMatrix(before, max(1, int(size - 1).bit_length()))
        self.size = size
        self.start = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size)))).astype(np.int64)
        kept = (order % sample == 0) | (before == 0)  # no walk passes a separator
        self.kept = np.concatenate(([0], np.cumsum(kept))).astype(np.int64)
        self.places = order[kept]

    def search(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase."""
        m = len(lengths)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            c = codes[live, lengths[live] - back].astype(np.int64)
            known = c < self.size
            low[live[~known]] = high[live[~known]] = 0
            live, c = live[known], c[known]
            low[live] = self.start[c] + self.tree.rank(c, low[live])
            high[live] = self.start[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes, by walking back to sampled rows."""
        out, walked = np.zeros(len(rows), np.int64), 0
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            hit = self.kept[rows + 1] > self.kept[rows]
            out[open_[hit]] = self.places[self.kept[rows[hit]]] + walked
            open_, rows = open_[~hit], rows[~hit]
            symbol, rank = self.tree.access_rank(rows)
            rows = self.start[symbol] + rank
            walked += 1
        return out


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open spans, adjacent ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Shard:
    """Words of consecutive documents, reduced as the module says."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.docs, self.parts, self.words = phrases, [], [], 0

    def add(self, keys: list[tuple], data: np.ndarray, offsets: np.ndarray) -> None:
        """Rows of text, each with a key that comes back with its result."""
        data = LOWER[data]
        starts, ends, first = common.word_spans(data, offsets, common.WORD_BYTES)
        base = len(self.docs)
        self.docs += [(*key, n) for key, n in zip(keys, np.diff(first).tolist(), strict=True)]
        self.words += len(starts)
        shortest = self.phrases.shortest
        if not shortest or not len(starts):
            return
        code = self.phrases.number(common.span_hashes(data, starts, ends))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        known = code > 0
        cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | ~known[1:] | ~known[:-1]))  # a new run begins here
        at = np.flatnonzero(cut)
        length = np.diff(np.concatenate((at, [len(code)])))
        keep = (length >= shortest) & known[at]
        at, length = at[keep], length[keep]
        if not len(at):
            return
        # word indices of the kept runs, each with one separator behind it
        total = length + 1
        begin = np.concatenate(([0], np.cumsum(total)[:-1]))
        index = np.arange(int(total.sum())) - np.repeat(begin - at, total)
        stop = begin + length
        index[stop] = at  # any word: it stands for the separator
        symbols = code[index]
        symbols[stop] = 0
        start, end = starts[index] - offsets[doc[index]], ends[index] - offsets[doc[index]]
        self.parts.append((symbols, doc[index] + base, index - first[doc[index]], start, end))

    def rows(self) -> Iterator[tuple]:
        spans: dict[int, list[tuple[int, int]]] = {}
        places: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, list[str]] = {}
        if self.parts:
            symbols, doc, word, start, end = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            index = FMIndex(symbols)
            low, high = index.search(self.phrases.codes, self.phrases.lengths)
            count = np.maximum(high - low, 0)
            phrase = np.repeat(np.arange(len(count)), count)
            rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - low, count)
            position = index.locate(rows)
            last = position + self.phrases.lengths[phrase] - 1
            order = np.lexsort((position, doc[position]))
            position, last, phrase = position[order], last[order], phrase[order]
            for group in np.split(np.arange(len(position)), np.flatnonzero(np.diff(doc[position])) + 1) if len(position) else []:
                d = int(doc[position[group[0]]])
                spans[d] = merged(word[position[group]], word[last[group]] + 1)
                places[d] = merged(start[position[group]], end[last[group]])
                items[d] = self.phrases.items(np.unique(phrase[group]))
        for i, doc in enumerate(self.docs):
            yield *doc, spans.get(i, []), places.get(i, []), items.get(i, [])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    columns = list(zip(*rows, strict=True))
    pairs = [[[{"start": a, "end": b} for a, b in x] for x in columns[i]] for i in (4, 5)]
    return pa.RecordBatch.from_arrays([*[pa.array(columns[i], pa.int64()) for i in range(4)], pa.array(pairs[0], span), pa.array(pairs[1], span), pa.array(columns[6], pa.list_(pa.string()))], ["row_key", "row_check", "doc_id", "n_words", "spans", "bytes", "items"])


def searcher(phrases: Broadcast, shard_words: int = SHARD_WORDS):
    """Arrow batches of (row_key, row_check, doc_id, text) to batches of SCHEMA, a shard of documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(phrases.value)
        for batch in batches:
            data, offsets = common.buffers(batch.column(3))
            for a, b in common.steps(offsets):
                keys = list(zip(*[batch.column(i).slice(a, b - a).to_pylist() for i in range(3)], strict=True))
                shard.add(keys, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if shard.words >= shard_words:
                    yield _batch(list(shard.rows()))
                    shard = Shard(phrases.value)
        if shard.docs:
            yield _batch(list(shard.rows()))

    return run


def blocks(benchmark: DataFrame, id_column: str, text_column: str, window: int = WINDOW, most: int = BLOCK_BYTES) -> list[Broadcast]:
    """The phrases of blocks of test items, each of a bounded size; the driver holds one block at a time."""
    send, held, size, out = benchmark.sparkSession.sparkContext.broadcast, [], 0, []
    for item_id, text in benchmark.select(id_column, text_column).toLocalIterator():
        own = len((text or "").encode())
        if held and size + own > most:
            out.append(send(Phrases(held, window)))
            held, size = [], 0
        held.append((item_id, text))
        size += own
    return [*out, send(Phrases(held, window))]


def _keys(*columns: Column) -> list[Column]:
    """A 128-bit hash of columns."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("check"), *columns)]


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: row_key, row_check, doc_id, n_words, merged word spans, merged byte spans (of UTF-8), items. Each block
    of test items takes a pass over the documents; the usual single block needs no shuffle at all."""
    key, check = _keys(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    source = docs.select(key.alias("row_key"), check.alias("row_check"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    passes = [source.mapInArrow(common.tidy(searcher(block, shard_words)), SCHEMA) for block in blocks(benchmark, item_id, item_text, window, block_bytes)]
    return passes[0] if len(passes) == 1 else _combined(passes)


def _combined(passes: list[DataFrame]) -> DataFrame:
    """Results of several blocks. Rows of equal keys are equal in id and text, so every pass says the same of each: the
    hits of one of them stand for all, and the first pass gives the rows."""
    own = ["row_key", "row_check"]
    hits = passes[0].where(F.size("items") > 0).dropDuplicates(own)
    for one in passes[1:]:
        hits = hits.unionByName(one.where(F.size("items") > 0).dropDuplicates(own))

    def union(name: str) -> DataFrame:
        """The spans of a key, sorted, where they meet joined."""
        each = hits.select(*own, F.explode(name).alias("s")).select(*own, F.col("s.start").alias("start"), F.col("s.end").alias("end"))
        order = Window.partitionBy(*own).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("fresh", F.when(F.col("start") <= F.max("end").over(order), 0).otherwise(1))
        each = each.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        joined = each.groupBy(*own, "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return joined.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))

    items = hits.select(*own, F.explode("items").alias("item")).groupBy(*own).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = union("spans").join(union("bytes"), own).join(items, own)
    none = lambda c: F.coalesce(c, F.array().cast(passes[0].schema[c].dataType)).alias(c)
    return passes[0].select(*own, "doc_id", "n_words").join(found, own, "left").select(*own, "doc_id", "n_words", none("spans"), none("bytes"), none("items"))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of find()'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _without(raw: bytes, places: list[tuple[int, int]]) -> str:
    out, end = [], 0
    for a, b in places:
        out.append(raw[end:a])
        end = b
    return b"".join([*out, raw[end:]]).decode("utf-8", "replace")


def _cut(phrases: Broadcast, at: int):
    """Arrow batches with a text column to the same without the words that occurrences cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(at))
            for a, b in common.steps(offsets):
                shard = Shard(phrases.value)
                shard.add([(i,) for i in range(a, b)], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield _replaced(batch.slice(a, b - a), at, {i - a: _without(data[offsets[i] : offsets[i + 1]].tobytes(), places) for i, _, _, places, _ in shard.rows() if places})

    return run


def _cut_there(at: int):
    """Arrow batches whose last column holds byte spans, to the same without the spans and without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(at))
            for a, b in common.steps(offsets):
                part = batch.slice(a, b - a)
                fresh = {i: _without(data[offsets[a + i] : offsets[a + i + 1]].tobytes(), [(s["start"], s["end"]) for s in spans]) for i, spans in enumerate(part.column(part.num_columns - 1).to_pylist()) if spans}
                yield _replaced(part.select(range(part.num_columns - 1)), at, fresh)

    return run


def _replaced(part: pa.RecordBatch, at: int, fresh: dict[int, str]) -> pa.RecordBatch:
    if not fresh:
        return part
    texts = part.column(at).to_pylist()
    for i, text in fresh.items():
        texts[i] = text
    return part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the merged removal spans, all columns kept; `n_chars`, if there, is counted anew."""
    found = blocks(benchmark, item_id, item_text, window, block_bytes)
    at = docs.columns.index(text)
    if len(found) == 1:
        out = docs.mapInArrow(common.tidy(_cut(found[0], at)), docs.schema)
    else:
        key, check = _keys(F.col(text).cast("string"))
        source = docs.select(key.alias("row_key"), check.alias("row_check"), F.lit(None).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        hits = _combined([source.mapInArrow(common.tidy(searcher(block)), SCHEMA) for block in found]).where(F.size("bytes") > 0).dropDuplicates(["row_key", "row_check"])
        free = common.free_names(docs.columns, "row_key", "row_check", "bytes")
        own = docs.select("*", key.alias(free[0]), check.alias(free[1]))
        spans = own.join(hits.select(*[F.col(c).alias(x) for c, x in zip(("row_key", "row_check", "bytes"), free, strict=True)]), free[:2], "left").select(*docs.columns, free[2])
        out = spans.mapInArrow(common.tidy(_cut_there(at)), docs.schema)
    return out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def brute_force(texts: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple]:
    """report() by comparing every window with every place, for tests."""
    import re

    def words(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    phrases = [(str(i), w[k : k + window]) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - window + 1))]
    out = []
    for doc_id, text in texts:
        own, hit, found = words(text), set(), set()
        for item, phrase in phrases:
            for k in range(len(own) - len(phrase) + 1):
                if own[k : k + len(phrase)] == phrase:
                    hit |= set(range(k, k + len(phrase)))
                    found.add(item)
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
