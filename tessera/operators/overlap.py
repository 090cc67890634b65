"""Keyword sets against a block of queries, counted where the records are: a block travels to the records, so neither sets
nor candidates are shuffled.

Keywords are known by 64-bit hashes (a clash of two goes unnoticed). Those of a block are numbered rarest first, by how many
of its queries hold them; a keyword that no query holds comes before all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Keywords of a block and its queries: some 100 MB at most in a worker.
BLOCK_WORDS, BLOCK_QUERIES = 1 << 22, 1 << 15
#: Keywords of records that are looked up at a time, and cells of counts or marks, or postings, that are held at a time.
STEP, CELLS = 1 << 18, 1 << 21


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of rows of lists, and the rows' bounds among them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    bounds = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64, copy=False), bounds - bounds[0]


def spread(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range that each element of many ranges belongs to, and its place."""
    owner = np.repeat(np.arange(len(length)), length)
    return owner, np.arange(len(owner)) + np.repeat(start - (np.cumsum(length) - length), length)


def parts(weight: np.ndarray, most: float, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many rows and so much weight, or of one row."""
    total, a = np.concatenate(([0], np.cumsum(weight))), 0
    while a < len(weight):
        b = max(a + 1, min(a + rows, int(np.searchsorted(total, total[a] + most, "right")) - 1))
        yield a, min(b, len(weight))
        a = b


def similarity(common: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Rounded to single precision, as hashing.jaccard_value()."""
    return (common / (size + other - common)).astype(np.float32).astype(np.float64)


class Postings:
    """The queries that hold each keyword."""

    def __init__(self, word: np.ndarray, query: np.ndarray, words: int):
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=words))))
        self.queries = query[np.argsort(word, kind="stable")].astype(np.int32)


class Block:
    """Queries with their keywords. With `least`, a similarity, the postings are those of the first keywords of each query,
    of which two sets of such a similarity share one; without, those of all keywords."""

    def __init__(self, ids: pa.Array, hashes: pa.Array, least: float | None = None, minhash: np.ndarray | None = None):
        values, self.bounds = lists(hashes)
        self.ids, self.least, self.size = ids, least, np.diff(self.bounds)
        self.none = np.flatnonzero(self.size == 0)
        row = np.repeat(np.arange(len(self.size)), self.size)
        self.words, number, count = np.unique(values, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(count), np.int32)
        self.rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)
        word = self.rank[number]
        self.word = word[np.lexsort((word, row))]
        first = np.ones(len(row), bool)
        if least is not None:
            self.prefix = self.prefixes(self.size)
            first = np.arange(len(row)) - self.bounds[row] < self.prefix[row]
            self.last = np.full(len(self.size), -1, np.int64)
            some = self.prefix > 0
            self.last[some] = self.word[(self.bounds[:-1] + self.prefix - 1)[some]]
        self.postings = Postings(self.word[first], row[first], len(self.words))
        if minhash is not None:
            self.order = np.argsort(minhash, kind="stable")
            self.minhash = minhash[self.order]

    def prefixes(self, size: np.ndarray) -> np.ndarray:
        return np.minimum(size, size - np.ceil(size * self.least).astype(np.int64) + 1)

    def known(self, values: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, keyword) of the keywords that queries hold, in the common order."""
        if not len(self.words) or not len(values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.words, values)
        at[at == len(self.words)] = 0
        hit = np.flatnonzero(self.words[at] == values)
        key = np.repeat(np.arange(len(size)), size)[hit] * len(self.words) + self.rank[at[hit]]
        key.sort()
        return np.divmod(key, len(self.words))

    def counts(self, row: np.ndarray, word: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the given keywords each query shares, by rows from low to high."""
        start = self.postings.bounds[word]
        length = self.postings.bounds[word + 1] - start
        n, out = len(self.size), np.zeros((high - low) * len(self.size), np.int64)
        for a, b in parts(length, CELLS, len(length) or 1):
            owner, at = spread(start[a:b], length[a:b])
            cell = (row[a:b] - low)[owner] * n + self.postings.queries[at]
            out += np.bincount(cell, minlength=len(out))
        return out

    def shared(self, row: np.ndarray, word: np.ndarray, r: np.ndarray, q: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many keywords the pairs (r, q) share; row and word: all known keywords of the rows from low to high."""
        marks, n = np.zeros((high - low) * len(self.words), bool), len(self.words)
        marks[(row - low) * n + word] = True
        out = np.zeros(len(r), np.int64)
        for a, b in parts(self.size[q], CELLS, len(q) or 1):
            owner, at = spread(self.bounds[q[a:b]], self.size[q[a:b]])
            out[a:b] = np.bincount(owner[marks[(r[a:b] - low)[owner] * n + self.word[at]]], minlength=b - a)
        return out

    def rows_at_once(self) -> int:
        """Rows whose counts and marks are held at a time."""
        return max(1, min(CELLS // max(1, len(self.size)), 8 * CELLS // max(1, len(self.words))))

    def near(self, values: np.ndarray, bounds: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (record, query) of a similarity above the threshold; two empty sets are equal."""
        least, size = self.least, np.diff(bounds)
        alpha = least / (1 + least)
        for a, b in parts(size, STEP, len(size)):
            own = size[a:b]
            none = np.flatnonzero(own == 0) if threshold < 1 and len(self.none) else own[:0]
            for x, y in parts(np.full(len(none), len(self.none)), CELLS, len(none)):
                yield np.repeat(none[x:y] + a, len(self.none)), np.tile(self.none, y - x)
            row, word = self.known(values[bounds[a] : bounds[b]], own)
            have = np.bincount(row, minlength=b - a)
            start = np.cumsum(have) - have
            prefix = self.prefixes(own)
            some = np.maximum(0, prefix - (own - have))  # known keywords among the first
            last = np.full(b - a, -1, np.int64)
            last[some > 0] = word[(start + some - 1)[some > 0]]
            first = np.flatnonzero(np.arange(len(row)) - start[row] < some[row])
            f_row, f_word = row[first], word[first]
            work = np.bincount(f_row, weights=self.postings.bounds[f_word + 1] - self.postings.bounds[f_word], minlength=b - a)
            for low, high in parts(work, CELLS, self.rows_at_once()):
                x, y = np.searchsorted(f_row, (low, high))
                if x == y:
                    continue
                count = self.counts(f_row[x:y], f_word[x:y], low, high)
                hit = np.flatnonzero(count)
                r, q = np.divmod(hit, len(self.size))
                r += low
                less, more = np.minimum(own[r], self.size[q]), np.maximum(own[r], self.size[q])
                # a shared keyword that is not among the first of both stands behind them in the set whose first end earlier
                left = np.where(last[r] < self.last[q], own[r] - prefix[r], self.size[q] - self.prefix[q])
                fits = (less >= more * least) & (count[hit] + left >= (less + more) * alpha - 1e-6)
                r, q = r[fits], q[fits]
                if len(r):
                    x, y = np.searchsorted(row, (low, high))
                    common = self.shared(row[x:y], word[x:y], r, q, low, high)
                    good = similarity(common, own[r], self.size[q]) > threshold
                    yield r[good] + a, q[good]

    def distances(self, values: np.ndarray, bounds: np.ndarray, minhash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the sum of 1 - similarity to the records of its min-hash, and their number."""
        total, number = np.zeros(len(self.size)), np.zeros(len(self.size), np.int64)
        begin, end = np.searchsorted(self.minhash, minhash, "left"), np.searchsorted(self.minhash, minhash, "right")
        size, weight = np.diff(bounds), np.concatenate(([0], np.cumsum(self.size[self.order])))
        for a, b in parts(size, STEP, len(size)):
            own, some = size[a:b], end[a:b] > begin[a:b]
            inside = np.repeat(some, own)
            row, word = self.known(values[bounds[a] : bounds[b]][inside], np.where(some, own, 0))
            work = np.bincount(row, weights=self.postings.bounds[word + 1] - self.postings.bounds[word], minlength=b - a)
            each = weight[end[a:b]] - weight[begin[a:b]]  # keywords of the queries of a record
            for low, high in parts(np.minimum(work, each), CELLS, self.rows_at_once()):
                owner, at = spread(begin[a + low : a + high], (end - begin)[a + low : a + high])
                if not len(owner):
                    continue
                r, q = owner + low, self.order[at]
                x, y = np.searchsorted(row, (low, high))
                if work[low:high].sum() < each[low:high].sum():
                    common = self.counts(row[x:y], word[x:y], low, high)[owner * len(self.size) + q]
                else:
                    common = self.shared(row[x:y], word[x:y], r, q, low, high)
                total += np.bincount(q, weights=1 - similarity(common, own[r], self.size[q]), minlength=len(total))
                number += np.bincount(q, minlength=len(total))
        return total, number
